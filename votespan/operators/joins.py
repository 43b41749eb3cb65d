"""Joins of derived features to posts, and of span tables by containment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from votespan.functions.columns import as_list
from votespan.operators.positions import ordered_index


def left_join_features(df: DataFrame, *features: DataFrame, key) -> DataFrame:
    """Aggregated features next to their posts; posts without any keep nulls."""
    for feature in features:
        df = df.join(feature, as_list(key), "left")
    return df


def inner_join_features(df: DataFrame, features: DataFrame, key) -> DataFrame:
    return df.join(features, as_list(key), "inner")


def remap_span_rows(old: DataFrame, new: DataFrame, key, cell_bits: int = 6) -> DataFrame:
    """The containment join of ``remap_spans`` on long tables, for rows of any length.

    ``old`` (key, pos, start, end, value), ``new`` (key, pos, start, end); gives (key,
    pos, value) with the value of the last old span around each new one.  A containing
    span covers the cell its content starts in, so an equality on (key, cell) replaces the
    comparison of all spans of a key, and spreads a large key over its cells.  Spans are many
    times the rows they come from, which Spark's estimate of their size does not see, so neither
    side may be sent to all tasks.

    Nor need they be written to disk: where both sides were dealt out by ``repartitionById``
    before they became spans, its column is one of several in ``key``, and the join takes the
    spans as they lie.  A join of frames that were dealt by the key itself would deal them anew,
    for it asks for the cell too.
    """
    keys = as_list(key)

    def cell_of(c):
        return F.shiftright(F.greatest(F.col(c), F.lit(0)), cell_bits)

    # Of equal old spans only the last can win.
    last = old.groupBy(*keys, "start", "end").agg(F.max_by("value", "pos").alias("value"), F.max("pos").alias("old_pos"))
    covered = last.withColumn("cell", F.explode(F.sequence(cell_of("start"), cell_of("end"))))
    o, n = covered.alias("o"), new.withColumn("cell", cell_of("start")).alias("n")
    same = reduce(and_, [F.col(f"o.{c}") == F.col(f"n.{c}") for c in [*keys, "cell"]])
    inside = same & (F.col("n.start") >= F.col("o.start")) & (F.col("n.end") <= F.col("o.end"))
    # A new span has one cell, so grouping by it too changes nothing and spares a shuffle.
    best = n.join(o.hint("merge"), inside).groupBy(
        *[F.col(f"n.{c}").alias(c) for c in keys], "n.cell", F.col("n.pos").alias("pos")).agg(
        F.max_by("o.value", "o.old_pos").alias("value"))
    return best.drop("cell")


def align_by_position(frames: Sequence[tuple[DataFrame, Sequence[str]]], how: str = "full", out: str = "pos") -> DataFrame:
    """Frames side by side: the first row of each, the second of each, and so on.

    Each frame comes with the columns that order it (unique together); its rows are numbered
    along them without sorting it in one task, and frames meet on the numbers.  Shorter
    frames are filled up with nulls (``how="inner"``: the others are cut).  Names must differ.
    """
    names = [c for df, _ in frames for c in df.columns]
    if len(set(names)) < len(names) or out in names:
        raise ValueError(f"columns must differ, also from {out}")
    numbered = [ordered_index(df, [], order, out) for df, order in frames]
    return reduce(lambda a, b: a.join(b, out, how), numbered)
