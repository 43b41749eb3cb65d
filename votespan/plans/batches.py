"""From prepared datasets to dense, padded batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from votespan.functions.arrays import densify, pad, spans_to_mask
from votespan.operators.batches import complete_batches, pad_length
from votespan.operators.positions import assign_batches
from votespan.operators.sampling import balanced_draws, balanced_sample, combine_sources


def dense(df: DataFrame, length: str = "length") -> DataFrame:
    """Token ids padded with 0, mask runs to flags and rationale entries to an array."""
    n = F.col(length)
    out = {"tokens": pad(F.col("tokens"), n), "mask": spans_to_mask(F.col("mask"), n)}
    if "rationale" in df.columns:
        out["rationale"] = F.when(F.col("rationale").isNotNull(), densify(F.col("rationale"), n))
    return df.withColumns(out)


def build_batches(
    datasets: Mapping[str, DataFrame], key: Sequence[str], size: int = 200, seed=0,
    balanced: bool = True, replacement: bool = False, drop_last: bool = True, complete: bool = True,
    max_length: int | None = None,
) -> DataFrame:
    """Rows with ``source``, ``batch``, ``size`` (rows of the source in the batch), ``length`` and dense arrays.

    Several datasets are sampled evenly if ``balanced`` (with or without replacement) and
    mixed into common batches; padding goes to the longest row of the same source in the
    batch, or to ``max_length``.  ``complete`` leaves out batches that lack a source.
    """
    rows, keys = combine_sources(datasets), ["source", *key]
    if balanced and len(datasets) > 1:
        if replacement:
            rows, keys = balanced_draws(rows, "source", key, seed=seed), ["draw"]
        else:
            rows = balanced_sample(rows, "source", key, seed=seed)
    rows = assign_batches(rows, keys, size, seed, drop_last)
    if complete and len(datasets) > 1:
        rows = complete_batches(rows, "batch", "source", list(datasets))
    rows = rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("batch", "source")))
    return dense(pad_length(rows, ["batch", "source"], fixed=max_length))
