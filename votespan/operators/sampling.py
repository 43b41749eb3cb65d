"""Unions of sources, shuffles, splits and samples that repeat under a seed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from votespan.functions.columns import row_hash
from votespan.operators.positions import cut_starts, hash_index, hash_prefix, with_cut


def combine_sources(sources: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """Union of datasets with their name; columns a dataset lacks are null."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def source_sizes(df: DataFrame, source: str = "source") -> DataFrame:
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("size"))


def append_rows(df: DataFrame, summary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Summary rows after the others, in the given column order."""
    return df.select(*columns).unionByName(summary.select(*columns))


def shuffle(df: DataFrame, key: Sequence[str], seed) -> DataFrame:
    """A random row order that depends on the seed and the keys only."""
    return df.orderBy(row_hash(seed, *key), *key)


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed) -> DataFrame:
    """n random rows, for inspection."""
    return shuffle(df, key, seed).limit(n)


def split_column(key: Sequence[str], weights: Mapping[str, float], seed=None) -> Column:
    """Name of the split a row falls in, from its key's hash: no sort, no shuffle."""
    total = float(sum(weights.values()))
    names = [n for n, w in weights.items() if w]
    if any(w < 0 for w in weights.values()) or not names:
        raise ValueError("weights must not be negative, nor all 0")
    digits = F.substring(F.md5(F.concat_ws(":", *([F.lit(str(seed))] if seed is not None else []),
                                           *[F.col(k).cast("string") for k in key])), 1, 4)
    place = F.conv(digits, 16, 10).cast("int")
    out, passed = None, 0.0
    for name in names[:-1]:
        passed += weights[name]
        below = place < round(passed / total * 65536)
        out = F.when(below, name) if out is None else out.when(below, name)
    return F.lit(names[0]) if out is None else out.otherwise(names[-1])


SPLITS = {"train": 0.8, "valid": 0.1, "test": 0.1}


def with_split(df: DataFrame, key: Sequence[str], weights: Mapping[str, float] = SPLITS, seed=None, out: str = "split") -> DataFrame:
    return df.withColumn(out, split_column(key, weights, seed))


def _quotas(sizes: DataFrame, n: int | None, per_source: bool) -> DataFrame:
    """Adds nth, sources, n and quota to one row (_source, size, …) per source."""
    every = Window.partitionBy(F.lit(1))
    ranked = sizes.withColumns({
        "nth": F.row_number().over(every.orderBy("_source")) - 1,
        "sources": F.count(F.lit(1)).over(every),
        "n": (F.min("size").over(every) if n is None else F.lit(n)).cast("bigint"),
    })
    if per_source:
        return ranked.withColumn("quota", F.col("n"))
    extra = (F.col("nth") < F.col("n") % F.col("sources")).cast("bigint")
    return ranked.withColumn("quota", F.floor(F.col("n") / F.col("sources")) + extra)


def balanced_sample(
    df: DataFrame, source: str, key: Sequence[str], n: int | None = None, seed=0, per_source: bool = False,
) -> DataFrame:
    """About equally many rows of each source, without replacement.

    n rows in total (the smallest source's size by default), or n of each source: the first
    of a seeded random order.  Two passes over the keys find the last row each source
    gives: counts per hash prefix tell which prefix its quota ends in, and only the rows
    with that prefix are ranked.  The rows then meet the one row of their source.  Fails if
    the last key of a source is not unique.
    """
    hashed = df.withColumn("_h", row_hash(seed, *key))
    cut = with_cut(hashed, [source], hash_prefix(hashed, [source]))
    # A source has one cut for some ten thousand rows.
    cuts = cut_starts(cut, "size").groupBy(F.col(f"_cut.{source}").alias("_source")).agg(
        F.max("size").alias("size"),
        F.collect_list(F.struct(F.col("_cut._coarse").alias("at"), F.col("_start").alias("start"), F.col("_n").alias("n"))).alias("cuts"))
    quota = F.col("quota")
    edge = F.filter("cuts", lambda c: (c["start"] < quota) & (c["start"] + c["n"] >= quota))
    edges = (_quotas(cuts, n, per_source).withColumn("e", F.try_element_at(edge, F.lit(1))).select(
        "_source", (quota > F.col("size")).alias("_all"), F.col("e.at").alias("_edge"),
        (quota - F.col("e.start")).alias("_left")))
    same = F.col(source).eqNullSafe(F.col("_source"))
    order = ["_h", *key]
    rank = F.row_number().over(Window.partitionBy("_source").orderBy(*order))
    twice = F.lead(F.struct(*order)).over(Window.partitionBy("_source").orderBy(*order)) == F.struct(*order)
    # One row a source goes to all tasks: dealt out by source, the rows of one would meet in one.
    last = (cut.select(source, "_cut", *order).join(F.broadcast(edges), same).filter(F.col("_cut._coarse") == F.col("_edge"))
            .withColumns({"_rank": rank, "_twice": F.coalesce(twice, F.lit(False))}).filter(F.col("_rank") == F.col("_left"))
            .select("_source", F.when(F.col("_twice"), F.raise_error(F.lit("the key is not unique"))).otherwise(
                F.struct(*order)).alias("_last")))
    whole = edges.filter("_all").select("_source", F.lit(None).cast(last.schema["_last"].dataType).alias("_last"))
    limits = last.unionByName(whole)
    kept = F.col("_last").isNull() | (F.struct(*order) <= F.col("_last"))
    return hashed.join(F.broadcast(limits), same).filter(kept).drop("_h", "_source", "_last")


def _draw(seed, what: str, draw: Column, modulus: Column) -> Column:
    """A number below ``modulus`` from the draw's hash; 60 random bits."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(what), draw.cast("string")))
    return F.pmod(F.conv(F.substring(text, 1, 15), 16, 10).cast("bigint"), modulus)


def balanced_draws(
    df: DataFrame, source: str, key: Sequence[str], n: int | None = None, seed=0,
) -> DataFrame:
    """n draws with replacement, every source equally likely, every row of a source too.

    Adds ``draw`` (0 .. n-1).  A draw hashes to a source and to a position in it, and finds
    the key at that position in an equality join over keys alone; the drawn keys then
    fetch their rows.  n defaults to the smallest source's size: its rows number the draws.
    """
    sizes = source_sizes(df, source).withColumnRenamed(source, "_source")
    quotas = _quotas(sizes, n, False).select("_source", "size", "nth")
    placed = hash_index(df.select(source, *key), [source], key, seed, "_idx")
    if n is None:
        smallest = quotas.agg(F.min_by("_source", F.struct("size", "nth"))).scalar()
        draws = placed.filter(F.col(source).eqNullSafe(smallest)).select(F.col("_idx").alias("draw"))
    else:
        draws = df.sparkSession.range(n).withColumnRenamed("id", "draw")
    sources = quotas.agg(F.count(F.lit(1))).scalar()
    aimed = draws.withColumn("_nth", _draw(seed, "source", F.col("draw"), sources)).join(
        quotas, F.col("_nth") == F.col("nth")).select(
        "draw", "_source", _draw(seed, "row", F.col("draw"), F.col("size")).alias("_at"))
    drawn = placed.join(
        aimed, F.col(source).eqNullSafe(F.col("_source")) & (F.col("_idx") == F.col("_at")),
    ).select("draw", "_source", *[F.col(k).alias(f"_{k}") for k in key])
    fetched = F.col(source).eqNullSafe(F.col("_source"))
    for k in key:
        fetched = fetched & (F.col(k) == F.col(f"_{k}"))
    return df.join(drawn, fetched).drop("_source", *[f"_{k}" for k in key])
