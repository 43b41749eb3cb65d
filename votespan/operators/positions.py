"""Row numbers over large groups.

A plain ``row_number`` sorts a whole group in one task.  Here a group is cut along a
coarse, order-preserving column; the cuts are counted first, and a row's number is the size
of the cuts before its own plus its rank inside it.  Cuts follow the data: hash prefixes are as
long as the number of rows asks for, and other orders are cut at points of a draw.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from votespan.functions.arrays import bind
from votespan.functions.columns import row_hash

#: Rows of a cut by hash prefix, at most about; a sixteenth of it at least, in the largest group.
CUT_ROWS = 1 << 16
#: Rows drawn in all to see how an order is spread, about; drawn rows from one cut to the next; cuts looked through at once.
DRAWN, APART, BLOCK = 1 << 16, 16, 64


def cut_starts(cut: DataFrame, total: str | None = None) -> DataFrame:
    """(_cut, _start): how many rows of its group lie in the cuts before each cut."""
    by = [F.col(f"_cut.{c}") for c in cut.schema["_cut"].dataType.names if c != "_coarse"]
    before = Window.partitionBy(*by).orderBy("_cut._coarse")
    return cut.groupBy("_cut").agg(F.count(F.lit(1)).alias("_n")).select(
        "_cut", (F.sum("_n").over(before) - F.col("_n")).alias("_start"), "_n",
        *([F.sum("_n").over(Window.partitionBy(*by)).alias(total)] if total else []))


def with_cut(df: DataFrame, by: Sequence[str], coarse: Column) -> DataFrame:
    # A struct compares nulls as equal, so rows with a null group keep their place.
    return df.withColumn("_cut", F.struct(*by, coarse.alias("_coarse")))


def offset_index(
    df: DataFrame, by: Sequence[str], coarse: Column, order: Sequence[Column],
    out: str = "idx", total: str | None = None,
) -> DataFrame:
    """Position (from 0) of each row in its ``by`` group.

    ``coarse`` must be non-decreasing along ``order``.  ``total`` adds the group's size.
    The ranking and the join with the starts share one shuffle and one sort.
    """
    cut = with_cut(df, by, coarse)
    rank = F.row_number().over(Window.partitionBy("_cut").orderBy(*order))
    placed = cut.withColumn("_rank", rank).join(cut_starts(cut, total).drop("_n"), "_cut")
    return placed.withColumn(out, (F.col("_start") + F.col("_rank") - 1).cast("bigint")).drop(
        "_cut", "_start", "_rank")


def spread_points(df: DataFrame, by: Sequence[str], order: Sequence[str], drawn: int = DRAWN, apart: int = APART) -> DataFrame:
    """(by, _points): values of ``order`` that cut each group into about equal parts, in blocks.

    Rows are drawn by a hash of their values, about ``drawn`` in all, however many there are;
    equal rows are drawn once.  Which ones does not depend on partitions or lost tasks, unlike a
    sketch that is merged in any order, so the cuts are the same wherever they are used.  Every
    ``apart``-th one cuts.  A group with few drawn rows is not cut.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    place = F.pmod(F.xxhash64(*by, *order), F.lit(1 << 30)).cast("double")
    taken = df.where(place * total < float(drawn << 30))
    every = F.sort_array(F.collect_set(F.struct(*order)))
    cuts = taken.groupBy(*by).agg(every.alias("_drawn")).withColumn(
        "_drawn", F.filter("_drawn", lambda _, i: i % apart == apart - 1)).where(F.size("_drawn") > 0)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_drawn") - 1) / BLOCK).cast("int")), lambda i: F.slice("_drawn", i * BLOCK + 1, BLOCK))
    return cuts.select(*by, blocks.alias("_points"))


def _points_up_to(points: Column, row: Column) -> Column:
    """How many points lie at or before ``row``: whole blocks first, then the last one."""
    def in_block(nth: Column) -> Column:
        upto = F.size(F.filter(F.get(points, nth - 1), lambda p: p <= row))
        return F.when(nth == 0, 0).otherwise((nth - 1) * BLOCK + upto)

    return F.coalesce(bind(F.size(F.filter(points, lambda b: F.get(b, F.lit(0)) <= row)), in_block), F.lit(0))


def ordered_index(
    df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "idx", total: str | None = None,
    drawn: int = DRAWN, apart: int = APART,
) -> DataFrame:
    """Position (from 0) of each row in its ``by`` group along ``order`` (ascending, nulls first).

    However skewed the order is, its cuts hold about as many rows: they are points of all its
    columns together, so many rows of one time are cut too, by what comes after it.  Rows equal
    in ``order`` stand in any order among themselves.  The points are no more than ``drawn`` over
    ``apart``, about, whatever the size of the table.
    """
    points, row = spread_points(df, by, order, drawn, apart), F.struct(*order)
    if by:
        named = points.withColumnsRenamed({c: f"_{i}" for i, c in enumerate(by)})
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)])
        met = df.join(F.broadcast(named), same, "left").drop(*[f"_{i}" for i in range(len(by))])
    else:
        met = df.withColumn("_points", points.select("_points").scalar())
    cut = met.withColumn("_stretch_of", _points_up_to(F.col("_points"), row)).drop("_points")
    return offset_index(cut, by, F.col("_stretch_of"), [F.col(c) for c in order], out, total).drop("_stretch_of")


def hash_index(
    df: DataFrame, by: Sequence[str], key: Sequence[str], seed, out: str = "idx", total: str | None = None,
) -> DataFrame:
    """Position in the seeded random order of a unique key, cut by hash prefix."""
    hashed = df.withColumn("_h", row_hash(seed, *key))
    return offset_index(
        hashed, by, hash_prefix(hashed, by), [F.col("_h"), *[F.col(k) for k in key]], out, total).drop("_h")


def hash_prefix(df: DataFrame, by: Sequence[str]) -> Column:
    """So many hex digits of the hash that the largest group has no more than ``CUT_ROWS`` rows a cut."""
    largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"))
    digits = largest.select(F.greatest(F.ceil(F.log(16.0, F.col("max(n)") / CUT_ROWS)), F.lit(0)).cast("int")).scalar()
    return F.substring(F.col("_h"), F.lit(1), digits)


def source_index(df: DataFrame, source: str, key: Sequence[str], seed=0) -> DataFrame:
    """Adds ``local_idx`` within its source and ``global_idx`` over all sources.

    Sources lie one after another in name order: global = rows of the sources before + local.
    """
    local = hash_index(df, [source], key, seed, "local_idx")
    sizes = df.groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        F.col(source).alias("_source"),
        (F.sum("_n").over(Window.orderBy(source)) - F.col("_n")).alias("_offset"))
    return (local.join(offsets, F.col(source).eqNullSafe(F.col("_source")))
            .withColumn("global_idx", F.col("_offset") + F.col("local_idx"))
            .drop("_offset", "_source"))


def assign_batches(df: DataFrame, key: Sequence[str], size: int, seed=0, drop_last: bool = False) -> DataFrame:
    """Adds ``batch``: consecutive rows of a seeded random order, ``size`` to a batch.

    Keys alone are ranked; the rows then meet their batch number.
    """
    places = hash_index(df.select(*key), [], key, seed, "_idx", total="_total")
    if drop_last:
        places = places.filter(F.col("_idx") < F.col("_total") - F.col("_total") % size)
    batches = places.select(*[F.col(k).alias(f"_{k}") for k in key], F.floor(F.col("_idx") / size).alias("batch"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    return df.join(batches, same).drop(*[f"_{k}" for k in key])


#: Spark keeps only the first rows of a group in each task, before the shuffle, up to this many.
KEPT_IN_TASKS = 1000
#: Parts of a group that are ranked by themselves first if more rows than that are wanted.
PARTS = 64


def newest(df: DataFrame, by: Sequence[str], order: Sequence[Column], key: str, n: int) -> DataFrame:
    """The first n rows per group along ``order``.

    Every task keeps its own first n of a group, so n rows a task and group are shuffled and no
    task sorts a whole group.  Spark does that by itself for ``n`` below a limit; beyond it,
    parts of a group are ranked first, then their winners.
    """
    every = Window.partitionBy(*by).orderBy(*order)
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", str(KEPT_IN_TASKS)))
    if n > min(limit, KEPT_IN_TASKS):
        some = Window.partitionBy(*by, "_part").orderBy(*order)
        df = df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS))).withColumn("_rn", F.row_number().over(some)).filter(
            F.col("_rn") <= n).drop("_rn", "_part")
    return df.withColumn("_rn", F.row_number().over(every)).filter(F.col("_rn") <= n).drop("_rn")


def beyond_n_latest(df: DataFrame, by: Sequence[str], order: Sequence[Column], key: str, n: int) -> DataFrame:
    """Rows outside the n newest of their group: those whose (unique) key is not among them."""
    return df.join(newest(df, by, order, key, n).select(key), key, "left_anti")


#: Runs at the borders of so many stretches of positions are joined up in one task.
FAN = 1 << 20


def runs_table(df: DataFrame, by: Sequence[str], pos: str, flag: str, step: int = 4096, fan: int = FAN) -> DataFrame:
    """Half-open runs of true per group, from rows (by, pos, flag) with pos 0, 1, 2, …

    Runs are found within steps of positions.  Those that touch the border of a step, two a
    step at most, are joined up within stretches of ``fan`` steps, those that then touch the
    border of a stretch within ``fan`` stretches, and so on: a task sees two rows for each
    part it joins, however long the group.
    """
    on = df.filter(F.col(flag)).withColumn("_step", F.floor(F.col(pos) / step))
    in_step = Window.partitionBy(*by, "_step").orderBy(pos)
    cols = [*by, "start", "end"]
    runs = (on.withColumn("_island", F.col(pos) - F.row_number().over(in_step))
            .groupBy(*by, "_step", "_island")
            .agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"))).select(*cols)
    out, width = None, step
    while width < 1 << 62:
        wider = min(width * fan, 1 << 62)
        at_edge = (F.col("start") % width == 0) | (F.col("end") % width == 0)
        inner = runs.filter(~at_edge)
        out = inner if out is None else out.unionByName(inner)
        group = [*by, F.floor(F.col("start") / wider).alias("_stretch")]
        along = Window.partitionBy(*by, "_stretch").orderBy("start")
        runs = (runs.filter(at_edge).select(*cols, group[-1])
                .withColumn("_new", (F.col("start") != F.coalesce(F.lag("end").over(along), F.lit(-1))).cast("int"))
                .withColumn("_run", F.sum("_new").over(along))
                .groupBy(*by, "_stretch", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*cols))
        width = wider
    return out.unionByName(runs)


def sort_by(df: DataFrame, column: str, last: Sequence[str] = ()) -> DataFrame:
    """Rows in the order of a column, those named in ``last`` behind all others, in the order given there."""
    place = F.array_position(F.array(*[F.lit(x) for x in last]).cast("array<string>"), F.col(column).cast("string"))
    return df.orderBy(F.coalesce(place, F.lit(0)), column)
