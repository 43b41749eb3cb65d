"""Dense batches from sparse rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from votespan.functions.columns import row_hash
from votespan.operators.permutation import shuffled
from votespan.operators.positions import ordered_index


def pad_length(df: DataFrame, by, tokens: str = "tokens", fixed: int | None = None, out: str = "length") -> DataFrame:
    """Padding length: the fixed one, or the longest row of the batch.

    A batch has a bounded number of rows, so the window over it does too.
    """
    if fixed is not None:
        return df.withColumn(out, F.lit(fixed))
    by = [by] if isinstance(by, str) else list(by)
    return df.withColumn(out, F.max(F.size(tokens)).over(Window.partitionBy(*by)))


def complete_batches(df: DataFrame, batch: str, source: str, sources: Sequence[str]) -> DataFrame:
    """Rows of those batches that have a row of every source.

    Like the padding length a window over the batch, so the two share a shuffle.
    """
    whole = Window.partitionBy(batch)
    present = [F.max(F.col(source).eqNullSafe(s)).over(whole) for s in sources]
    return df.withColumn("_present", F.array(*present)).filter(
        F.forall("_present", lambda p: p)).drop("_present")


def bucketed_batches(
    df: DataFrame, key: Sequence[str], length: str, size: int, per_bucket: int = 64, seed: int = 0, drop_last: bool = False,
) -> DataFrame:
    """Adds ``batch``: ``size`` rows of about the same length each, in a random order of batches.

    Rows are numbered by length; ``per_bucket`` batches of neighbours are a bucket, in which
    the seeded order of the keys deals rows to batches, so that a batch is a random draw among
    rows of like length.  Batch numbers are shuffled then, and lengths come mixed.  The rows
    that fill no batch are the longest ones; ``drop_last`` leaves them out.

    Rows of one length are cut by their keys' hashes, so no task numbers all of them; a bucket
    has ``size`` times ``per_bucket`` rows.
    """
    hashed = df.withColumn("_h", row_hash(seed, *key))
    placed = ordered_index(hashed, [], [length, "_h", *key], "_at", total="_total")
    placed = placed.withColumn("_bucket", F.floor(F.col("_at") / (size * per_bucket)))
    # Another order than that of the numbering, or neighbours would stay together.
    inner = Window.partitionBy("_bucket").orderBy(row_hash(f"{seed}:batch", *key), *key)
    number = F.col("_bucket") * per_bucket + F.floor((F.row_number().over(inner) - 1) / size)
    rows = placed.withColumn("_number", number)
    batches = F.ceil(F.col("_total") / size)
    if drop_last:
        batches = F.floor(F.col("_total") / size)
        rows = rows.filter(F.col("_number") < batches)
    return rows.withColumn("batch", shuffled(F.col("_number"), batches, seed)).drop(
        "_h", "_at", "_total", "_bucket", "_number")


def padding_share(df: DataFrame, batch: str, length: str) -> DataFrame:
    """(rows, cells, padding): cells of all batches when each is padded to its longest row, and the share that is padding."""
    per_batch = df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n"), F.max(length).alias("longest"), F.sum(length).alias("filled"))
    cells = F.sum(F.col("n") * F.col("longest"))
    return per_batch.agg(F.sum("n").alias("rows"), cells.alias("cells"), F.try_divide(cells - F.sum("filled"), cells).alias("padding"))
