import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from votespan.functions.arrays import (
    arr_to_pairs, by_cell, cell, densify, explode_rows, indices, keep_empty, map_to_pairs, pad, pairs_to_map,
    render_spans, runs_of_true, spans_to_mask, sum_values, sum_widths,
)

SPANS = "array<struct<start:int,end:int>>"


def one(spark, value, kind, fn, **more):
    schema = f"x {kind}" + "".join(f", {k} {t}" for k, (_, t) in more.items())
    df = spark.createDataFrame([(value, *[v for v, _ in more.values()])], schema)
    return df.select(fn(F.col("x"), *[F.col(k) for k in more])).first()[0]


@pytest.mark.parametrize("flags, runs, legacy", [
    ([1, 1, 1], [(0, 3)], [(0, 4)]),
    ([0, 0], [], []),
    ([0, 1, 1, 0], [(1, 3)], [(1, 3)]),
    ([], [], []),
    ([1], [(0, 1)], [(0, 2)]),
    ([1, 0, 1], [(0, 1), (2, 3)], [(0, 1), (2, 4)]),
])
def test_runs_of_true(spark, flags, runs, legacy):
    flags = [bool(f) for f in flags]
    assert [tuple(r) for r in one(spark, flags, "array<boolean>", runs_of_true)] == runs
    assert [tuple(r) for r in one(spark, flags, "array<boolean>", lambda x: runs_of_true(x, True))] == legacy


def test_runs_of_null(spark):
    assert one(spark, None, "array<boolean>", runs_of_true) is None
    assert [tuple(r) for r in one(spark, [True, None, True], "array<boolean>", runs_of_true)] == [(0, 1), (2, 3)]


def test_mask_of_runs_is_the_flags(spark):
    rng = random.Random(1)
    data = [(i, [rng.random() < 0.6 for _ in range(rng.randrange(90))]) for i in range(40)]
    df = spark.createDataFrame(data, "id int, f array<boolean>").withColumn("runs", runs_of_true(F.col("f")))
    for r in df.select("f", spans_to_mask(F.col("runs"), F.size("f")).alias("g")).collect():
        assert r.f == r.g


def test_mask_of_any_spans(spark):
    rng = random.Random(2)
    data = []
    for i in range(60):
        spans = [(a, a + rng.randrange(0, 40)) for a in (rng.randrange(-2, 120) for _ in range(rng.randrange(8)))]
        data.append((i, spans, rng.randrange(0, 130)))
    df = spark.createDataFrame(data, f"id int, s {SPANS}, n int")
    for r in df.select("s", "n", spans_to_mask(F.col("s"), F.col("n")).alias("m")).collect():
        assert r.m == [any(s.start <= i < s.end for s in r.s) for i in range(r.n)]


def test_by_cell(spark):
    items = [(0, 3), (40, 70), (33, 34)]
    got = one(spark, items, SPANS, lambda x: by_cell(x, lambda s: cell(s["start"]), lambda s: cell(s["end"])))
    assert [[tuple(i) for i in c] for c in got] == [[(0, 3)], [(33, 34), (40, 70)], [(40, 70)]]
    assert one(spark, [], SPANS, lambda x: by_cell(x, lambda s: cell(s["start"]), lambda s: cell(s["end"]))) == []


def test_render(spark):
    def line(flags, spans):
        return one(spark, flags, "array<boolean>", render_spans, s=(spans, SPANS))

    assert line([True, False, True], [(0, 2), (3, 5), (6, 8)]) == "XX    XX"
    assert line([False, True, False], [(0, 2), (3, 5), (6, 8)]) == "   XX   "
    assert line([True, True], [(3, 6), (0, 5)]) == "XXXXXX"
    assert line([False, False], [(0, 0), (0, 4)]) == "    "


def test_pad(spark):
    assert one(spark, [1, 2], "array<int>", lambda x: pad(x, 4)) == [1, 2, 0, 0]
    assert one(spark, [1, 2, 3], "array<int>", lambda x: pad(x, 2)) == [1, 2]
    assert one(spark, None, "array<int>", lambda x: pad(x, 2)) is None


def test_densify(spark):
    def dense(m, n):
        return one(spark, m, "map<int,double>", densify, n=(n, "int"))

    assert dense({2: 1.0, 0: 0.5}, 4) == [0.5, 0.0, 1.0, 0.0]
    assert dense({}, 2) == [0.0, 0.0]
    assert dense({5: 1.0}, 3) == [0.0, 0.0, 0.0]
    assert dense({0: 1.0}, 0) == []


def test_pairs_sparse_and_predicate(spark):
    df = spark.createDataFrame([(1, [0, 2, 0, 3]), (2, [0, 0]), (3, None), (4, [])], "id int, a array<int>")
    assert rows(arr_to_pairs(df, "id", "a")) == [(1, 0, 0), (1, 1, 2), (1, 2, 0), (1, 3, 3), (2, 0, 0), (2, 1, 0)]
    assert rows(arr_to_pairs(df, "id", "a", sparse=True)) == [(1, 1, 2), (1, 3, 3)]
    assert rows(arr_to_pairs(df, "id", "a", sparse=True, predicate=lambda v: v > 2)) == [(1, 3, 3)]
    assert rows(arr_to_pairs(df, "id", "a", sparse=True, keep_empty=True)) == [
        (1, 1, 2), (1, 3, 3), (2, None, None), (3, None, None), (4, None, None)]
    with pytest.raises(ValueError):
        arr_to_pairs(df, "id", "a", predicate=lambda v: v > 2)


def test_explode_keeps_null_elements(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, [])], "id int, a array<string>")
    assert rows(explode_rows(df, "id", "a")) == [(1, "a"), (1, None)]


def test_maps_and_pairs(spark):
    df = spark.createDataFrame([(1, {3: 1.0, 1: 2.0}), (2, {}), (3, None)], "id int, m map<int,double>")
    pairs = map_to_pairs(df, "id", "m")
    assert rows(pairs) == [(1, 1, 2.0), (1, 3, 1.0)]
    assert rows(map_to_pairs(df, "id", "m", keep_empty=True)) == [
        (1, 1, 2.0), (1, 3, 1.0), (2, None, None), (3, None, None)]
    assert rows(pairs_to_map(pairs.unionAll(pairs), "id", "k", "v", "m")) == [(1, {1: 2.0, 3: 1.0})]
    two = pairs.unionAll(pairs.withColumn("v", F.col("v") + 1))
    with pytest.raises(Exception, match="several values"):
        pairs_to_map(two, "id", "k", "v", "m").collect()
    assert rows(pairs_to_map(two, "id", "k", "v", "m", "max")) == [(1, {1: 3.0, 3: 2.0})]
    assert rows(pairs_to_map(two, "id", "k", "v", "m", "min")) == [(1, {1: 2.0, 3: 1.0})]
    assert rows(keep_empty(df, "id", pairs)) == [(1, 1, 2.0), (1, 3, 1.0), (2, None, None), (3, None, None)]


def test_sums_and_indices(spark):
    assert one(spark, [(0, 3), (5, 6)], SPANS, sum_widths) == 4
    assert one(spark, {1: 2.0, 2: 0.5}, "map<int,double>", sum_values) == 2.5
    assert one(spark, 3, "int", indices) == [0, 1, 2]
    assert one(spark, 0, "int", indices) == []
