"""Votes of annotators to shares, majorities and consensus rationales."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from votespan.functions.arrays import arr_to_pairs, bind, indices
from votespan.functions.columns import as_list, category_columns


def agg_cols(df: DataFrame, fn: Callable[[Column], Column], keys, cols) -> DataFrame:
    """The same aggregate over several columns per key."""
    return df.groupBy(*as_list(keys)).agg(*[fn(F.col(c)).alias(c) for c in as_list(cols)])


def is_label(col: str) -> Callable[[str], Column]:
    return lambda cat: F.col(col) == cat


def names_label(col: str) -> Callable[[str], Column]:
    return lambda cat: F.array_contains(col, cat)


def vote_shares(votes: DataFrame, key, groups: dict[str, tuple[Callable[[str], Column], Sequence[str]]]) -> DataFrame:
    """Share of annotators per category, several column groups in one grouping.

    ``groups`` maps a prefix to (test of a category, categories).  Null votes are left out
    of the mean.
    """
    return votes.groupBy(*as_list(key)).agg(*[
        F.avg(test(cat).cast("double")).alias(name)
        for group, (test, cats) in groups.items()
        for cat, name in zip(cats, category_columns(cats, group))
    ])


def vote_share(votes: DataFrame, key, col: str, cats: Sequence[str], group: str = "label") -> DataFrame:
    return vote_shares(votes, key, {group: (is_label(col), cats)})


def vote_share_multi(votes: DataFrame, key, col: str, cats: Sequence[str], group: str = "target") -> DataFrame:
    return vote_shares(votes, key, {group: (names_label(col), cats)})


def share_in_row(votes: Column, test: Callable[[Column], Column]) -> Column:
    """Share of an array's elements that pass a test; those testing null do not count.

    For posts that carry their votes as an array: no explode and no shuffle.
    """
    tested = F.filter(F.transform(votes, test), lambda t: t.isNotNull())
    return bind(tested, lambda t: F.try_divide(
        F.size(F.filter(t, lambda x: x)).cast("double"), F.size(t).cast("double")))


def nested_label_share(votes: Column, member: str, cat: str) -> Column:
    return share_in_row(votes, lambda v: v[member] == cat)


def nested_target_share(votes: Column, member: str, cat: str) -> Column:
    return share_in_row(votes, lambda v: F.array_contains(v[member], cat))


def majority(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Half-up rounding of the named shares."""
    return df.withColumns({c: F.round(c) for c in cols})


def is_tie(cols: Sequence[str]) -> Column:
    """No category won: every rounded share is 0."""
    out = F.lit(True)
    for c in cols:
        out = out & (F.col(c) == 0)
    return out


def rationale_consensus(rationales: DataFrame, key, flags: str = "flags", denominator: str = "nonzero") -> DataFrame:
    """Mean mark per (key, pos) over annotators, for marked positions.

    ``nonzero`` averages the non-zero marks only (for 0/1 marks: their union);
    ``annotators`` averages over everyone who marked the word either way.
    """
    if denominator not in ("nonzero", "annotators"):
        raise ValueError(denominator)
    keys = as_list(key)
    pairs = arr_to_pairs(rationales, keys, flags, sparse=denominator == "nonzero")
    means = pairs.groupBy(*keys, "pos").agg(F.avg("value").alias("value"))
    return means if denominator == "nonzero" else means.filter(F.col("value") != 0)


def nested_consensus(rationales: Column, denominator: str = "nonzero") -> Column:
    """The same inside a row: array of mark arrays to a map of position to mean mark."""
    if denominator not in ("nonzero", "annotators"):
        raise ValueError(denominator)

    def counted(v: Column) -> Column:
        return v.isNotNull() & (v != 0) if denominator == "nonzero" else v.isNotNull()

    def marked(marks: Column) -> Column:
        return F.coalesce(F.filter(indices(F.size(marks)), lambda i: F.get(marks, i) != 0), F.array().cast("array<int>"))

    def means(rows: Column) -> Column:
        # Most words are not marked: only for positions with a mark are the rows looked at together.
        def mean(i: Column) -> Column:
            some = F.filter(F.transform(rows, lambda marks: F.get(marks, i)), counted)
            total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
            return F.struct(i.alias("key"), bind(some, lambda v: total(v) / F.size(v)).alias("value"))

        found = F.transform(F.sort_array(F.array_distinct(F.flatten(F.transform(rows, marked)))), mean)
        return found if denominator == "nonzero" else F.filter(found, lambda e: e["value"] != 0)

    return bind(rationales, lambda rows: F.map_from_entries(means(rows)))


def dedupe_mean(df: DataFrame, key, score: str = "score", text: str = "text") -> DataFrame:
    """One row per comment: mean score and its first text in text order."""
    return df.groupBy(*as_list(key)).agg(F.avg(score).alias("score"), F.min(text).alias("text"))
