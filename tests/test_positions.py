"""Positions, samples and batches: equal to the plain form, also with one hot group."""

from collections import Counter, defaultdict

import pytest
from conftest import rows
from pyspark.sql import Window, functions as F

from votespan.operators.batches import complete_batches, pad_length
from votespan.operators.positions import (
    assign_batches, beyond_n_latest, newest, offset_index, ordered_index, runs_table, source_index, spread_points,
)
from votespan.operators.sampling import (
    append_rows, balanced_draws, balanced_sample, combine_sources, sample_n, shuffle, with_split,
)
from votespan.plans.batches import build_batches


@pytest.fixture(scope="module")
def hot(spark):
    """Source a holds two thirds of the rows, one source has no name."""
    return spark.range(3000).select(
        "id", F.when(F.col("id") % 3 != 0, "a").when(F.col("id") % 30 == 0, "b").when(F.col("id") % 5 == 0, F.lit(None)).otherwise("c").alias("source"),
        (F.col("id") * 7919 % 101).alias("t")).cache()


def test_offset_index_equals_row_number(hot):
    got = offset_index(hot, ["source"], F.floor(F.col("t") / 10), [F.col("t"), F.col("id")], "idx", total="n")
    plain = Window.partitionBy("source").orderBy("t", "id")
    want = hot.withColumn("idx", (F.row_number().over(plain) - 1).cast("bigint")).withColumn("n", F.count("*").over(Window.partitionBy("source")))
    assert rows(got) == rows(want.select(*got.columns))


@pytest.mark.parametrize("by", [[], ["source"]])
@pytest.mark.parametrize("drawn, apart", [(1 << 16, 16), (500, 3), (1 << 16, 1), (1, 1)])
def test_ordered_index_equals_row_number(hot, by, drawn, apart):
    skewed = hot.withColumn("t", F.when(F.col("id") % 2 == 0, F.lit(50)).when(F.col("id") % 7 != 0, F.col("t")))
    got = ordered_index(skewed, by, ["t", "id"], "idx", total="n", drawn=drawn, apart=apart)
    plain = Window.partitionBy(*by).orderBy("t", "id")
    want = skewed.withColumn("idx", (F.row_number().over(plain) - 1).cast("bigint")).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    assert rows(got) == rows(want.select(*got.columns))


def test_ordered_cuts_follow_the_data(hot):
    """Half of the rows share one value, the others crowd at one end: no cut holds much more than its part."""
    skewed = hot.select(F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(F.exp(-F.col("id") / 20)).alias("t"), "id")
    points = spread_points(skewed, [], ["t", "id"], drawn=1500, apart=16).first()[0]
    flat = [tuple(p) for block in points for p in block]
    assert flat == sorted(set(flat)) and all(len(b) <= 64 for b in points) and 60 < len(flat) < 130
    places = sorted(tuple(r) for r in skewed.collect())
    edges = [0, *[places.index(p) for p in flat], len(places)]
    assert max(b - a for a, b in zip(edges[:-1], edges[1:])) < 100
    again = spread_points(skewed.repartition(11), [], ["t", "id"], drawn=1500, apart=16).first()[0]
    assert [tuple(p) for block in again for p in block] == flat


def test_ordered_index_edges(spark):
    empty = spark.createDataFrame([], "g string, t double")
    assert ordered_index(empty, ["g"], ["t"]).collect() == [] == ordered_index(empty, [], ["t"]).collect()
    # Rows equal in everything are drawn once and get all the places.
    same = spark.createDataFrame([(None, 1.0)] * 50 + [("a", float("nan")), ("a", None)], "g string, t double")
    got = ordered_index(same, ["g"], ["t"], apart=1).collect()
    assert sorted(r["idx"] for r in got if r["g"] is None) == list(range(50))
    assert [r["t"] for r in sorted((r for r in got if r["g"]), key=lambda r: r["idx"])][0] is None


def test_hash_cuts_follow_the_size(spark, monkeypatch):
    """Prefixes grow with the largest group; positions stay the same."""
    from votespan.operators import positions

    df = spark.range(5000).withColumn("g", F.col("id") % 50 == 0)
    want = rows(source_index(df, "g", ["id"]), "id", "local_idx", "global_idx")
    monkeypatch.setattr(positions, "CUT_ROWS", 30)
    assert rows(source_index(df, "g", ["id"]), "id", "local_idx", "global_idx") == want
    hashed = df.withColumn("_h", positions.row_hash(0, "id"))
    assert hashed.select(F.length(positions.hash_prefix(hashed, ["g"]))).distinct().collect() == [(2,)]


def test_source_index_is_dense(hot):
    got = rows(source_index(hot, "source", ["id"]), "global_idx", "source", "local_idx")
    assert sorted(r[0] for r in got) == list(range(3000))
    by_source = defaultdict(list)
    for g, s, i in sorted(got):
        by_source[s].append((i, g))
    assert all(p == [(i, p[0][1] + i) for i in range(len(p))] for p in by_source.values())
    assert rows(source_index(hot.repartition(9), "source", ["id"]), "global_idx", "source", "local_idx") == got


@pytest.mark.parametrize("drop_last", [False, True])
def test_batches(hot, drop_last):
    got = rows(assign_batches(hot, ["id"], 64, seed=1, drop_last=drop_last), "id", "batch")
    sizes = Counter(b for _, b in got)
    assert set(sizes) == set(range(46 if drop_last else 47))
    assert all(sizes[b] == 64 for b in range(46))
    assert len({i for i, _ in got}) == len(got)
    assert rows(assign_batches(hot.repartition(5), ["id"], 64, seed=1, drop_last=drop_last), "id", "batch") == got
    assert rows(assign_batches(hot, ["id"], 64, seed=2, drop_last=drop_last), "id", "batch") != got


def test_newest_and_beyond(hot):
    order = [F.desc("t"), F.col("id")]
    rn = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    ranked = hot.withColumn("rn", rn)
    for n in (1, 35, 1500):
        assert rows(newest(hot, ["source"], order, "id", n), *hot.columns) == rows(ranked.filter(F.col("rn") <= n), *hot.columns)
        assert rows(beyond_n_latest(hot, ["source"], order, "id", n), *hot.columns) == rows(ranked.filter(F.col("rn") > n), *hot.columns)


def runs_of(flags):
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            out.append((start, i))
            start = None
    return out


@pytest.mark.parametrize("step", [1, 4, 1000])
def test_runs_over_steps(spark, step):
    import random

    rng = random.Random(step)
    flags = {k: [rng.random() < p for _ in range(n)] for k, p, n in [("hot", 0.9, 400), ("all", 1.1, 16), ("none", -1, 9), ("mix", 0.5, 50)]}
    df = spark.createDataFrame([(k, i, f) for k, fs in flags.items() for i, f in enumerate(fs)], "k string, pos int, flag boolean")
    want = sorted(((k, a, b) for k, fs in flags.items() for a, b in runs_of(fs)), key=repr)
    assert rows(runs_table(df, ["k"], "pos", "flag", step=step)) == want
    assert rows(runs_table(df.filter("k != 'none'"), ["k"], "pos", "flag", step=step, fan=1 << 12)) == want


def test_runs_over_many_levels(spark):
    """Stretches of 64 steps: a run goes on over borders of three levels, far along the group."""
    far = 1 << 40
    ranges = [(0, 1), (60, 4100), (5000, 8192), (8193, 8200), (far - 10, far + 4096), (far + 5000, far + 5001)]
    df = spark.createDataFrame([("g", a, b) for a, b in ranges], "k string, a long, b long").select(
        "k", F.explode(F.sequence("a", F.col("b") - 1)).alias("pos"), F.lit(True).alias("flag"))
    assert rows(runs_table(df, ["k"], "pos", "flag", step=8, fan=64)) == sorted((("g", a, b) for a, b in ranges), key=repr)


def test_newest_keeps_few_rows_before_the_shuffle(hot, plan_of):
    plan = plan_of(newest(hot, ["source"], [F.desc("t"), F.col("id")], "id", 35))
    below = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in below and plan.count("Exchange") == 1 and "_part" not in plan


def test_pad_length_and_complete(spark):
    df = spark.createDataFrame([(0, "a", [1, 2]), (0, "b", [1]), (1, "a", [1, 2, 3])], "batch int, source string, tokens array<int>")
    assert rows(pad_length(df, "batch"), "batch", "source", "length") == [(0, "a", 2), (0, "b", 2), (1, "a", 3)]
    assert rows(pad_length(df, "batch", fixed=9), "length") == [(9,)] * 3
    assert rows(complete_batches(df, "batch", "source", ["a", "b"]), "batch", "source") == [(0, "a"), (0, "b")]


def test_split_is_a_partition(hot):
    got = rows(with_split(hot, ["id"]), "id", "split")
    sizes = Counter(s for _, s in got)
    assert sum(sizes.values()) == 3000 and abs(sizes["train"] - 2400) < 120
    assert rows(with_split(hot.repartition(6), ["id"]), "id", "split") == got
    assert rows(with_split(hot, ["id"], seed=1), "id", "split") != got
    assert {s for _, s in rows(with_split(hot, ["id"], {"x": 1.0}), "id", "split")} == {"x"}
    thirds = Counter(s for _, s in rows(with_split(hot, ["id"], {"x": 1, "y": 1, "z": 1}), "id", "split"))
    assert all(abs(n - 1000) < 120 for n in thirds.values())


def test_shuffle_and_sample(hot):
    order = [r.id for r in shuffle(hot, ["id"], 1).collect()]
    assert sorted(order) == list(range(3000)) and order != list(range(3000))
    assert [r.id for r in shuffle(hot.repartition(3), ["id"], 1).collect()] == order
    assert [r.id for r in sample_n(hot, 10, ["id"], 1).collect()] == order[:10]


def test_split_without_weight(spark):
    many = spark.range(10_000)
    for weights in ({"train": 1.0, "test": 0.0}, {"test": 0.0, "train": 3}):
        assert {r.split for r in with_split(many, ["id"], weights).collect()} == {"train"}
    counts = Counter(r.split for r in with_split(many, ["id"], {"train": 0.9, "valid": 0.1, "test": 0}).collect())
    assert set(counts) == {"train", "valid"} and abs(counts["train"] - 9000) < 200
    with pytest.raises(ValueError):
        with_split(many, ["id"], {"a": 0, "b": 0})
    with pytest.raises(ValueError):
        with_split(many, ["id"], {"a": 2, "b": -1})


def test_balanced_sample_needs_a_key(spark):
    same = spark.createDataFrame([(7, "a")] * 60 + [(i, "b") for i in range(60)], "id int, source string")
    with pytest.raises(Exception, match="not unique"):
        balanced_sample(same, "source", ["id"], n=10).collect()


def test_balanced_sample(hot):
    sizes = Counter(r[0] for r in rows(hot, "source"))
    smallest = min(sizes.values())
    got = Counter(r[0] for r in rows(balanced_sample(hot, "source", ["id"]), "source"))
    assert sum(got.values()) == smallest and max(got.values()) - min(got.values()) <= 1
    each = balanced_sample(hot, "source", ["id"], per_source=True)
    assert Counter(r[0] for r in rows(each, "source")) == {s: smallest for s in sizes}
    more = Counter(r[0] for r in rows(balanced_sample(hot, "source", ["id"], n=150, per_source=True), "source"))
    assert more == {s: min(150, n) for s, n in sizes.items()}
    assert rows(balanced_sample(hot.repartition(5), "source", ["id"])) == rows(balanced_sample(hot, "source", ["id"]))


def test_balanced_draws(hot):
    named = hot.filter("source is not null")
    got = rows(balanced_draws(named, "source", ["id"], n=6000, seed=3), "draw", "source", "id")
    assert [d for d, _, _ in sorted(got)] == list(range(6000))
    per = Counter(s for _, s, _ in got)
    assert all(abs(n - 2000) < 200 for n in per.values())
    a = Counter(i for _, s, i in got if s == "a")
    assert max(a.values()) > 1 and len(a) < 2000  # with replacement
    default = rows(balanced_draws(named, "source", ["id"], seed=3), "draw", "source", "id")
    assert [d for d, _, _ in sorted(default)] == list(range(min(Counter(r[0] for r in rows(named, "source")).values())))
    assert sorted(got)[:len(default)] == sorted(default)


def test_union_and_append(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, t string"), spark.createDataFrame([(2, 0.5)], "k int, s double")
    assert rows(combine_sources({"a": a, "b": b}), "source", "k", "t", "s") == [("a", 1, "x", None), ("b", 2, None, 0.5)]
    assert append_rows(a, a, ["t", "k"]).columns == ["t", "k"]


def test_build_batches(spark):
    def dataset(n, key, with_rationale):
        df = spark.range(n).select(
            F.concat(F.lit(key), F.col("id")).alias("key"), F.transform(F.sequence(F.lit(1), (F.col("id") % 5 + 1).cast("int")), lambda i: i).alias("tokens"))
        df = df.withColumn("mask", F.array(F.struct(F.lit(0).alias("start"), F.size("tokens").alias("end"))))
        return df.withColumn("rationale", F.create_map(F.lit(0), F.lit(1.0))) if with_rationale else df

    sets = {"x": dataset(90, "x", True), "y": dataset(40, "y", False)}
    for replacement in (False, True):
        got = build_batches(sets, ["key"], size=10, replacement=replacement).collect()
        assert len(got) == 40
        by = defaultdict(list)
        for r in got:
            by[r.batch, r.source].append(r)
            n = sum(r.mask)
            assert len(r.tokens) == len(r.mask) == r.length
            assert r.tokens[:n] == list(range(1, n + 1)) and not any(r.tokens[n:])
            assert (r.rationale is None) == (r.source == "y")
            assert r.rationale is None or r.rationale == [1.0] + [0.0] * (r.length - 1)
        assert all(max(sum(r.mask) for r in rs) == rs[0].length for rs in by.values())
    fixed = build_batches({"x": sets["x"]}, ["key"], size=7, drop_last=False, max_length=8).collect()
    assert len(fixed) == 90 and {len(r.tokens) for r in fixed} == {8}
