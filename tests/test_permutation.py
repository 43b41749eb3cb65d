"""Computed shuffles, batches of like length, frames side by side, report order."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from votespan.operators.batches import bucketed_batches, padding_share
from votespan.operators.joins import align_by_position
from votespan.operators.permutation import shuffled, unshuffled
from votespan.operators.positions import assign_batches, sort_by


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 97, 1000, 4097])
@pytest.mark.parametrize("seed", [0, 3])
def test_a_shuffle_is_a_permutation_and_can_be_undone(spark, n, seed):
    got = spark.range(n).select("id", shuffled(F.col("id"), n, seed).alias("p")).withColumn("back", unshuffled(F.col("p"), F.lit(n), seed)).collect()
    assert sorted(r["p"] for r in got) == list(range(n)) and all(r["back"] == r["id"] for r in got)


def test_shuffles_look_random(spark):
    n = 20_000
    got = [r[0] for r in spark.range(n).orderBy("id").select(shuffled(F.col("id"), n, 1)).collect()]
    other = [r[0] for r in spark.range(n).orderBy("id").select(shuffled(F.col("id"), n, 2)).collect()]
    assert sum(a == b for a, b in zip(got, other)) < 10
    # Rank correlations of neighbours, and with the place itself, near 0.
    mean = (n - 1) / 2
    spread = sum((x - mean) ** 2 for x in got)
    assert abs(sum((a - mean) * (b - mean) for a, b in zip(got, got[1:]))) < 0.03 * spread
    assert abs(sum((x - mean) * (i - mean) for i, x in enumerate(got))) < 0.03 * spread
    halves = [sum(x < n // 2 for x in got[i : i + 2000]) for i in range(0, n, 2000)]
    assert all(850 < h < 1150 for h in halves)


def test_places_outside_and_large_tables(spark):
    n = 3_000_000_000_017
    df = spark.createDataFrame([(x,) for x in (-1, 0, 1, n - 1, n, None)], "x long")
    got = df.select("x", shuffled(F.col("x"), n, 5).alias("p")).withColumn("back", unshuffled(F.col("p"), n, 5)).collect()
    assert [r["back"] for r in got] == [None, 0, 1, n - 1, None, None]
    assert all(0 <= r["p"] < n for r in got if r["p"] is not None)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.range(1003).select("id", (F.pow(F.col("id") * 7919 % 1009, 2) / 1000).cast("long").alias("n")).withColumn(
        "n", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("n"))).cache()


@pytest.mark.parametrize("drop_last", [True, False])
def test_batches_of_like_length(texts, drop_last):
    got = bucketed_batches(texts, ["id"], "n", 16, per_bucket=5, seed=1, drop_last=drop_last)
    assert got.columns == ["id", "n", "batch"]
    sizes = sorted(r[1] for r in got.groupBy("batch").count().collect())
    assert sizes == ([16] * 62 if drop_last else [11] + [16] * 62)
    assert sorted({r[0] for r in got.select("batch").collect()}) == list(range(62 if drop_last else 63))
    assert rows(got) == rows(bucketed_batches(texts.repartition(5), ["id"], "n", 16, per_bucket=5, seed=1, drop_last=drop_last))
    mixed = padding_share(assign_batches(texts, ["id"], 16, drop_last=drop_last), "batch", "n").first()
    like = padding_share(got, "batch", "n").first()
    assert like["rows"] == mixed["rows"] and like["padding"] < mixed["padding"] / 2
    # A bucket's rows are dealt at random: batches of one bucket overlap in length.
    spans = got.groupBy("batch").agg(F.min("n").alias("a"), F.max("n").alias("b")).where("b > 7").collect()
    assert sum(x["a"] < y["b"] and y["a"] < x["b"] and x["batch"] < y["batch"] for x in spans for y in spans) > 60


def test_padding_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, n long")
    assert bucketed_batches(empty, ["id"], "n", 4).collect() == []
    assert padding_share(empty.withColumn("batch", F.lit(0)), "batch", "n").first()["padding"] is None


def test_frames_side_by_side(spark):
    a = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string").repartition(3)
    b = spark.createDataFrame([(0.5, 9), (0.5, 8)], "w double, m int")
    got = rows(align_by_position([(a, ["k"]), (b, ["w", "m"])]), "pos", "k", "v", "w", "m")
    assert got == [(0, 1, "a", 0.5, 8), (1, 2, "b", 0.5, 9), (2, 3, "c", None, None)]
    assert align_by_position([(a, ["k"]), (b, ["w", "m"])], how="inner").count() == 2
    with pytest.raises(ValueError):
        align_by_position([(a, ["k"]), (a, ["k"])])


def test_report_order(spark):
    df = spark.createDataFrame([("micro",), ("b",), ("macro",), ("a",), (None,)], "name string")
    assert [r[0] for r in sort_by(df, "name", last=["micro", "macro"]).collect()] == [None, "a", "b", "micro", "macro"]
    assert [r[0] for r in sort_by(df, "name").collect()] == [None, "a", "b", "macro", "micro"]
