"""Column groups, indicator columns, thresholds and label decoding."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def as_list(x) -> list:
    """One name, several names or none as a list."""
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def category_columns(cats: Sequence[str], group: str) -> list[str]:
    """Column names ``<group>_<category>`` of a column group."""
    return [f"{group}_{c}" for c in cats]


def prefix_cols(df: DataFrame, cols: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in cols})


def apply_cols(df: DataFrame, keys, cols, fn: Callable[[Column], Column]) -> DataFrame:
    """The keys as they are and ``fn`` over each of ``cols``."""
    return df.select(*as_list(keys), *[fn(F.col(c)).alias(c) for c in as_list(cols)])


def drop_cols(df: DataFrame, *cols: str) -> DataFrame:
    """Drops columns; names that are absent are ignored."""
    return df.drop(*cols)


def flatten_struct(df: DataFrame, col: str, members: Sequence[str] | None = None) -> DataFrame:
    """Replaces a struct column by its members (all, or the named ones)."""
    others = [c for c in df.columns if c != col]
    inner = [f"{col}.{m}" for m in members] if members else [f"{col}.*"]
    return df.select(*others, *inner)


def onehot(df: DataFrame, key, col: str, cats: Sequence[str]) -> DataFrame:
    """0/1 column per category; a null value gives nulls, an unknown one zeros."""
    return df.select(*as_list(key), *[(F.col(col) == c).cast("double").alias(c) for c in cats])


def multihot(df: DataFrame, key, col: str, cats: Sequence[str]) -> DataFrame:
    """The same for an array of categories."""
    return df.select(*as_list(key), *[F.array_contains(col, c).cast("double").alias(c) for c in cats])


def empty_map(key_type: str, value_type: str) -> Column:
    return F.create_map().cast(f"map<{key_type},{value_type}>")


def coalesce_map(df: DataFrame, col: str) -> DataFrame:
    """Null map becomes an empty map of the same type."""
    return df.withColumn(col, F.coalesce(F.col(col), F.create_map().cast(df.schema[col].dataType)))


def slice_bounds(n: int, part: int, parts: int) -> tuple[int, int]:
    """Half-open bounds of the ``part``-th (from 1) of ``parts`` contiguous slices of n."""
    if not 1 <= part <= parts:
        raise ValueError(f"slice {part} of {parts} does not exist")

    def cut(k: int) -> int:
        return -(-k * n // parts)

    return cut(part - 1), cut(part)


def label_slice(cats: Sequence[str], part: int | str, parts: int | None = None) -> list[str]:
    """A contiguous slice of the categories, given as two numbers or as text ``"a b"``."""
    if isinstance(part, str):
        found = re.fullmatch(r"(\d+)\s+(\d+)", part)
        if found is None:
            raise ValueError(f"not a slice: {part!r}")
        part, parts = int(found[1]), int(found[2])
    lower, upper = slice_bounds(len(cats), part, parts)
    return list(cats[lower:upper])


def slice_number(item: Column, n: int, parts: int) -> Column:
    """Number (from 1) of the slice a category index falls in."""
    out = F.lit(None).cast("int")
    for part in range(parts, 0, -1):
        lower, upper = slice_bounds(n, part, parts)
        out = F.when((item >= lower) & (item < upper), F.lit(part)).otherwise(out)
    return out


def harden(df: DataFrame, logit: str = "logit", truth: str = "truth") -> DataFrame:
    """Adds ``pred`` (logit > 0) and ``hard`` (truth > 0.5), both strict."""
    return df.withColumns({"pred": F.col(logit) > 0, "hard": F.col(truth) > 0.5})


def argmax(arr: Column) -> Column:
    """Index (from 0) of the first maximum."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def gated(mask: Column, label_scores: Sequence[Column]) -> Column:
    """A token counts if it is valid and its post has one of the given scores above 0."""
    hit = F.lit(False)
    for score in label_scores:
        hit = hit | (score > 0)
    return mask & hit


def gate_tokens(mask: Column, label_scores: Sequence[Column]) -> Column:
    """The same for an array of token flags."""
    return F.transform(mask, lambda m: gated(m, label_scores))


def decode_top(probs: Column, names: Sequence[str]) -> Column:
    """Struct of the best label's name and probability."""
    at = argmax(probs)
    labels = F.array(*[F.lit(n) for n in names])
    return F.struct(F.get(labels, at).alias("name"), F.get(probs, at).alias("prob"))


def decode_above(probs: Column, names: Sequence[str], threshold: float = 0.5) -> Column:
    """Array of (name, prob) of every label above the threshold, in label order."""
    labels = F.array(*[F.lit(n) for n in names])
    pairs = F.zip_with(labels, probs, lambda n, p: F.struct(n.alias("name"), p.alias("prob")))
    return F.filter(pairs, lambda x: x["prob"] > threshold)


def above(arr: Column, threshold: float, slack: float = 1e-7) -> Column:
    """Flag per element: above the threshold less a small slack."""
    return F.transform(arr, lambda x: x > F.lit(threshold - slack))


def keep_matching(df: DataFrame, col: str, pattern: str, value: str | None = None) -> DataFrame:
    """Rows whose text matches and, if named, whose value is not null."""
    keep = F.col(col).rlike(pattern)
    return df.filter(keep if value is None else keep & F.col(value).isNotNull())


def extract_groups(df: DataFrame, col: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """One column per regex group; null where the pattern does not match."""
    matched = F.col(col).rlike(pattern)
    return df.withColumns({
        n: F.when(matched, F.regexp_extract(col, pattern, i + 1)) for i, n in enumerate(names)
    })


def row_hash(seed, *cols: str) -> Column:
    """Seeded md5 of a key, as hex text: a repeatable random order and random buckets."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def with_key(df: DataFrame, cols: Sequence[str], out: str = "row_key") -> DataFrame:
    """Row key that depends on the row's content only, not on its partition."""
    return df.withColumn(out, F.xxhash64(*cols))
