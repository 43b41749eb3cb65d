"""Where intermediate tables go."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Without that setting it lies in the warehouse, the other folder that driver and executors
    share.  What an application puts there goes when it ends.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    root = root or spark.conf.get("spark.sql.warehouse.dir")
    own = context._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/votespan-{context.applicationId}")
    files = own.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(own):
        files.mkdirs(own)
        files.deleteOnExit(own)
    return f"{own.toString()}/{name}-{uuid.uuid4().hex}"
