"""Dataset statistics and the class weights derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from votespan.functions.arrays import map_to_pairs, sum_values, sum_widths


def avg_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of each column over the table, as one row."""
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def avg_map(df: DataFrame, col: str, keys: Sequence | None = None) -> DataFrame:
    """Per map key: sum of its values divided by the number of rows of the table.

    With ``keys`` one row, an array ``values`` in their order; a key nobody has counts 0.
    """
    if keys is not None:
        return df.agg(F.array(*[
            F.coalesce(F.sum(F.try_element_at(col, F.lit(k))), F.lit(0.0)) / F.count(F.lit(1)) for k in keys]).alias("values"))
    sums = (map_to_pairs(df, [], col)
            .groupBy(F.col("k").alias("key")).agg(F.sum("v").alias("total")))
    rows = df.agg(F.count(F.lit(1))).scalar()
    return sums.select("key", (F.col("total") / rows).alias("value"))


def sum_map_values(df: DataFrame, col: str, out: str = "total") -> DataFrame:
    return df.agg(F.sum(sum_values(F.col(col))).alias(out))


def sum_span_widths(df: DataFrame, col: str, out: str = "total") -> DataFrame:
    return df.agg(F.sum(sum_widths(F.col(col))).alias(out))


def dataset_stats(
    df: DataFrame, label_cols: Sequence[str], target_cols: Sequence[str],
    rationale: str = "rationale", mask: str = "mask", where: Column | None = None,
) -> DataFrame:
    """label_freqs, target_freqs and rationale_freq in one row and one pass.

    ``where`` restricts the rows, e.g. to the training split.
    """
    rows = df if where is None else df.filter(where)
    return rows.agg(
        F.array(*[F.avg(c) for c in label_cols]).alias("label_freqs"),
        F.array(*[F.avg(c) for c in target_cols]).alias("target_freqs"),
        F.try_divide(
            F.sum(sum_values(F.col(rationale))), F.sum(sum_widths(F.col(mask)))).alias("rationale_freq"))


def pos_weight(freq: Column) -> Column:
    """Weight of the positive class: (1 - freq) / (freq + 1e-8)."""
    return (F.lit(1.0) - freq) / (freq + F.lit(1e-8))


def pos_weights(stats: DataFrame, col: str = "target_freqs") -> DataFrame:
    """(item, pos_weight) from an array of frequencies."""
    return stats.select(F.posexplode(col).alias("item", "freq")).select(
        "item", pos_weight(F.col("freq")).alias("pos_weight"))
