import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from votespan.operators.stats import avg_cols, avg_map, dataset_stats, pos_weights
from votespan.operators.votes import (
    agg_cols, dedupe_mean, is_tie, majority, nested_consensus, rationale_consensus, vote_share, vote_share_multi,
)
from votespan.plans.prepare import label_posts, label_votes
from votespan.sources.keyed_json import ANNOTATED

CATS = {"label": ["h", "o", "n"], "target": ["X", "Y"]}
POSTS = [
    ("tie", [("h", 1, ["X"]), ("o", 2, ["X", "Y"]), ("n", 3, None)], [[0, 1, 0], [1, 1, 0]], ["a", "b", "c"]),
    ("half", [("h", 1, ["None"]), ("o", 2, ["Y"])], [], ["a"]),
    ("clear", [("n", 1, []), ("n", 2, []), ("h", 3, ["X"])], [[1], [0, 0, 1]], ["a", "b"]),
    ("nulls", [(None, 1, None), ("o", 2, None)], None, []),
    ("nobody", [], [[0, 0]], ["a", "b"]),
]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(POSTS, ANNOTATED)


@pytest.fixture(scope="module")
def votes(posts):
    return posts.select("post_id", F.explode("annotators").alias("a")).select(
        "post_id", F.col("a.label").alias("label"), F.col("a.target").alias("targets"))


def test_shares(votes):
    assert rows(vote_share(votes, "post_id", "label", CATS["label"])) == [
        ("clear", 1 / 3, 0.0, 2 / 3), ("half", 0.5, 0.5, 0.0), ("nulls", 0.0, 1.0, 0.0), ("tie", 1 / 3, 1 / 3, 1 / 3)]
    assert rows(vote_share_multi(votes, "post_id", "targets", CATS["target"])) == [
        ("clear", 1 / 3, 0.0), ("half", 0.0, 0.5), ("nulls", None, None), ("tie", 1.0, 0.5)]


def test_majority_is_half_up_and_ties_show(votes):
    cols = ["label_h", "label_o", "label_n"]
    won = majority(vote_share(votes, "post_id", "label", CATS["label"]), cols).withColumn("tie", is_tie(cols))
    assert rows(won) == [
        ("clear", 0.0, 0.0, 1.0, False), ("half", 1.0, 1.0, 0.0, False),
        ("nulls", 0.0, 1.0, 0.0, False), ("tie", 0.0, 0.0, 0.0, True)]


def test_in_row_and_long_shares_agree(posts, votes):
    for rounded in ((), ("label",), ("label", "target")):
        cols = ["post_id", "label_h", "label_o", "label_n", "target_X", "target_Y"]
        nested = rows(label_posts(posts, CATS, rounded).filter(F.size("annotators") > 0), *cols)
        assert nested == rows(label_votes(votes, "post_id", CATS, rounded), *cols)


def test_consensus_denominators(spark, posts):
    long = posts.select("post_id", F.posexplode("rationales").alias("annotator", "flags"))
    nonzero = [("clear", 0, 1.0), ("clear", 2, 1.0), ("tie", 0, 1.0), ("tie", 1, 1.0)]
    everyone = [("clear", 0, 0.5), ("clear", 2, 1.0), ("tie", 0, 0.5), ("tie", 1, 1.0)]
    assert rows(rationale_consensus(long, "post_id")) == nonzero
    assert rows(rationale_consensus(long, "post_id", denominator="annotators")) == everyone
    for kind, want in (("nonzero", nonzero), ("annotators", everyone)):
        maps = {r[0]: r[1] for r in posts.select("post_id", nested_consensus(F.col("rationales"), kind)).collect()}
        assert sorted((p, k, v) for p, m in maps.items() if m for k, v in m.items()) == want
        assert maps["half"] == {} and maps["nobody"] == {} and maps["nulls"] is None
    with pytest.raises(ValueError):
        rationale_consensus(long, "post_id", denominator="?")
    with pytest.raises(ValueError):
        nested_consensus(F.col("rationales"), "?")


def test_consensus_of_uneven_marks(spark):
    rng = random.Random(5)
    marks = [None, 0.0, 0.0, 1.0, -1.0, 0.5, float("nan")]
    data = [(i, [[rng.choice(marks[: rng.choice([3, 6, 6, 7])]) for _ in range(rng.randrange(6))] if rng.random() < 0.9 else None
                 for _ in range(rng.randrange(5))]) for i in range(300)]
    df = spark.createDataFrame(data, "id int, r array<array<double>>")
    for kind, counts in (("nonzero", lambda v: v is not None and v != 0), ("annotators", lambda v: v is not None)):
        got = dict(df.select("id", nested_consensus(F.col("r"), kind)).collect())
        for i, rows_of in data:
            want = {}
            for at in range(5):
                some = [m[at] for m in rows_of if m is not None and at < len(m) and counts(m[at])]
                if some and (kind == "nonzero" or sum(some) != 0):
                    want[at] = sum(some) / len(some)
            assert repr(sorted(got[i].items())) == repr(sorted(want.items())), (kind, rows_of)


def test_agg_cols_and_dedupe(spark):
    df = spark.createDataFrame([("a", 1.0, "z"), ("a", 3.0, "y"), ("b", None, None)], "k string, score double, text string")
    assert rows(agg_cols(df, F.max, "k", "score")) == [("a", 3.0), ("b", None)]
    want = [("a", 2.0, "y"), ("b", None, None)]
    assert rows(dedupe_mean(df, "k")) == want
    assert rows(dedupe_mean(df.repartition(3), "k")) == want


def test_stats(spark):
    df = spark.createDataFrame(
        [(1.0, 0.0, {0: 1.0, 3: 0.5}, [(0, 4)], "train"), (0.0, 1.0, {}, [(0, 2)], "test"), (1.0, 0.0, {3: 1.0}, [], "train")],
        "l double, t double, rationale map<int,double>, mask array<struct<start:int,end:int>>, split string")
    got = dataset_stats(df, ["l"], ["t"]).first()
    assert got.label_freqs == [2 / 3] and got.target_freqs == [1 / 3] and got.rationale_freq == 2.5 / 6
    assert dataset_stats(df, ["l"], ["t"], where=F.col("split") == "train").first().rationale_freq == 2.5 / 4
    assert dataset_stats(df.filter("size(mask) = 0"), ["l"], ["t"]).first().rationale_freq is None
    assert rows(avg_map(df, "rationale")) == [(0, 1 / 3), (3, 0.5)]
    assert rows(avg_cols(df, ["l", "t"])) == [(2 / 3, 1 / 3)]
    weight = rows(pos_weights(dataset_stats(df, ["l"], ["t"])))[0][1]
    assert abs(weight - (1 - 1 / 3) / (1 / 3 + 1e-8)) < 1e-12
