"""Evaluation over a stream of predictions.

The grouped sums of ``votespan.operators.metrics`` take a streaming table as it is: confusion
counts, F1 per label, squared error and losses are one aggregation each, so they run in update
and in complete mode, and within windows of event time under a watermark.  Averages over labels
are a second aggregation, which a stream has only in append mode.  Here they are taken, batch by
batch, from the small table of sums (a row for each split and item) that complete mode hands out.

Results go to tables in the shared folder, one folder for each micro-batch.  A batch that is run
again after a restart writes the same folder anew, so nothing counts twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from votespan.functions.columns import as_list
from votespan.operators.metrics import UNTRAINED, cell_f1, f1, item_sums, metrics_of


def windowed(pred: DataFrame, time: str, width: str, late: str, slide: str | None = None, out: str = "window") -> DataFrame:
    """Adds the window of event time a row falls in; rows later than ``late`` may be dropped by a stream.

    A time without a zone counts as UTC, whatever the session's zone.
    """
    if pred.schema[time].dataType == T.TimestampNTZType():
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        pred = pred.withColumn(time, F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(time))))
    return pred.withWatermark(time, late).withColumn(out, F.window(time, width, slide))


def start_updates(
    sums: DataFrame, path: str, checkpoint: str, mode: str = "update", finish: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    once: bool = True,
) -> StreamingQuery:
    """Runs a streaming aggregation and keeps what every micro-batch gives under ``path``.

    In ``update`` mode a batch gives the groups it has changed, in ``complete`` mode all groups;
    ``finish`` turns them into what is written, an aggregation included.  ``once``: takes what
    has arrived, in as many batches as the source's limits ask for, and ends; else it goes on.
    """
    def write(rows: DataFrame, batch: int) -> None:
        finish(rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = sums.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_latest(spark: SparkSession, path: str, keys: str | Sequence[str]) -> DataFrame:
    """The last row that ``update`` mode gave for each key (for windows: their columns)."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*as_list(keys), "batch")]
    last = F.max_by(F.struct(*others), "batch").alias("_last")
    return rows.groupBy(*as_list(keys)).agg(last).select(*as_list(keys), "_last.*")


def read_newest_batch(spark: SparkSession, path: str) -> DataFrame:
    """All rows that the last batch of ``complete`` mode gave."""
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("batch").alias("batch"))
    return rows.join(newest, "batch", "left_semi").drop("batch")


def start_metrics(
    pred: DataFrame, task: str, path: str, checkpoint: str, names: Sequence[str] | None = None, split: str = "split",
    item: str = "item", freqs: Sequence[float] | None = None, no_loss: Sequence[str] = UNTRAINED, once: bool = True,
) -> StreamingQuery:
    """``task_metrics`` of all rows so far, written after every micro-batch.

    State is a row of sums for each split and item, however long the stream runs.
    """
    return start_updates(
        item_sums(pred, [split, item]), path, checkpoint, "complete",
        lambda sums: metrics_of(sums, task, names, split, item, freqs, no_loss), once)


def window_summary(cells: DataFrame, window: str = "window", by: Sequence[str] = ()) -> DataFrame:
    """Macro and micro F1 of each window, and how they change from the window before it (a batch table of counts)."""
    keys = [F.col(f"{window}.start").alias("start"), *as_list(by)]
    scores = cells.groupBy(*keys).agg(
        F.avg(cell_f1()).alias("macro_f1"), f1(F.sum("pos_pos"), F.sum("neg_pos"), F.sum("pos_neg")).alias("micro_f1"))
    # A row for each window: as many as there is time.
    before = Window.partitionBy(*as_list(by)).orderBy("start")
    return scores.withColumn("macro_change", F.col("macro_f1") - F.lag("macro_f1").over(before))
