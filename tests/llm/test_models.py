"""Classifier, licence scan, top-k search, pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from votespan.llm import knn
from votespan.llm.knn import KdTree, top_k
from votespan.llm.licenses import license_matches, windows
from votespan.llm.license_texts import NOTICES
from votespan.llm.quality import BITS, DENSE, OrdinalModel, expected_grade, features, fit, fit_rows, good, graded, rate, sampled


def sentences(spark, n, start=0):
    """Grade 2: plain; 1: with a bad word or shouting; 0: with both."""
    draw = random.Random(start)
    rows = []
    for i in range(n):
        grade = i % 3
        words = [f"w{draw.randrange(300)}" for _ in range(draw.randrange(20, 60))]
        flaws = {2: [], 1: [draw.randrange(2)], 0: [0, 1]}[grade]
        if 0 in flaws:
            words[3:3] = ["vile", "nasty"]
        text = " ".join(words)
        rows.append((start + i, text.upper().replace(" ", "!! ") if 1 in flaws else text, grade))
    return spark.createDataFrame(rows, "doc_id long, text string, grade int")


def test_classifier_on_held_out_rows(spark):
    rated = sentences(spark, 900)
    model = fit(rated.select("doc_id", "text"), rated.select("doc_id", "grade"), F.col("grade"), 3)
    assert (np.diff(model.thresholds) > 0).all()
    held = rate(sentences(spark, 300, 5000), model).select(
        "grade", "tails", expected_grade("tails").alias("e"), good("tails", 0.5).alias("good")).collect()
    assert np.mean([r["good"] == (r["grade"] == 2) for r in held]) > 0.95
    assert all(r["tails"][0] >= r["tails"][1] for r in held)
    means = [np.mean([r["e"] for r in held if r["grade"] == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]


def test_classifier_edges(spark):
    rated = sentences(spark, 60)
    odd = spark.createDataFrame(
        [(0, 2), (0, 0), (None, 1), (7, None), (999_999, 1)], "doc_id long, grade int").unionByName(rated.select("doc_id", "grade"))
    model = fit(rated, odd, F.col("grade"), 3)
    texts = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "x " * 50_000, 5)], "doc_id long, text string, grade int")
    got = rate(texts, model).collect()
    assert len(got) == 3 and all(0 <= p <= 1 for r in got for p in r["tails"]) and got[0]["tails"] == got[1]["tails"]
    unfitted = fit(rated, odd.limit(0), F.col("grade"), 3)
    assert rate(texts, unfitted).first()["tails"] == pytest.approx([2 / 3, 1 / 3])
    assert rate(texts.limit(0), model).collect() == []


def test_classifier_sample_is_of_joined_rows(spark):
    """An id that a third of the documents have, and one that many ratings have."""
    docs = spark.createDataFrame(
        [(0, f"text {i}") for i in range(3000)] + [(i, "plain") for i in range(1, 3001)] + [(1, "copy")] * 3000, "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(3001)] + [(2, 1)] * 1000, "doc_id long, grade int")
    some = sampled(docs, ratings, F.col("grade"), sample=500).select("id", "grade", "t", "copies").distinct()
    of = {r["id"]: r["n"] for r in some.groupBy("id").agg(F.sum("copies").alias("n")).collect()}
    assert 400 < sum(of.values()) < 600
    assert 100 < of[0] < 200 and 145 <= of[1] <= 155 and 45 <= of[2] <= 55
    whole = sampled(docs, ratings, F.col("grade")).select("id", "grade", "t", "copies").distinct()
    assert whole.agg(F.sum("copies")).first()[0] == 3000 + 3000 + 3000 + 1000


def test_ordinal_gradient():
    """The fitted loss falls, and a flat model gives the shares of the grades."""
    draw = np.random.default_rng(0)
    rows = [(draw.integers(0, 1 << BITS, 5), np.zeros(DENSE)) for _ in range(300)]
    grades = np.array([0] * 60 + [1] * 90 + [2] * 150)
    model = fit_rows(rows, grades, 3, l1=1e9)
    assert not model.weights.any()
    tails = model.tails(np.zeros(1))[0]
    assert tails == pytest.approx([0.8, 0.5], abs=0.05)


def test_features_count_words_once():
    data = np.frombuffer("Aa aA b".encode() + b"", np.uint8)
    doc, index, dense = features(data, np.array([0, 5, 5, 7]))
    assert doc.tolist() == [0, 2] and dense.shape == (3, DENSE)
    assert isinstance(OrdinalModel(np.zeros(1), np.zeros(1)), OrdinalModel)


def test_grades(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1), (None, 1)], "quality int, toxic int")
    assert [r[0] for r in rows.select(graded()).collect()] == [1, 0, 2, 1, None]


def test_licenses(spark):
    mit = NOTICES[-1][1]
    texts = [
        (1, "Some prose.\nReleased under the MIT License.\nMore prose follows here."), (2, mit), (3, "intro words\n\n" + mit + "\n\nend words"),
        (4, "released UNDER the -- mit license"), (5, None), (6, ""), (7, "license"), (8, "no licence at all " * 3000), (None, "Licensed under CC BY 4.0."),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, license string")
    got = {(r["k1"], r["passage"], r["line"], r["license"]) for r in license_matches(docs, NOTICES).collect()}
    null = -(2**63)
    assert {(1, "line", 1, "MIT"), (2, "text", 0, "MIT"), (3, "paragraph", 2, "MIT"), (4, "line", 0, "MIT"), (4, "text", 0, "MIT"),
            (null, "line", 0, "CC-BY-4.0")} <= got
    assert {k for k, *_ in got} == {1, 2, 3, 4, null}
    assert license_matches(docs.limit(0), NOTICES).collect() == []
    with pytest.raises(ValueError):
        license_matches(docs, [])


def test_licenses_of_one_family_are_told_apart(spark):
    """Each notice is found under its own name, alone and amid other words, as are versions near another notice."""
    rows, want = [], set()
    for i, (name, text) in enumerate(NOTICES):
        rows.append((i, "words before it\n\n" + text.replace("\n", " ") + "\n\nand words after it"))
        want.add((i, name))
    others = [("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
              ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License v2.1"),
              ("MIT", "// SPDX-License-Identifier: MIT"), ("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-only")]
    for i, (name, text) in enumerate(others, len(rows)):
        rows.append((i, "some code\n" + text + "\nmore code"))
        want.add((i, name))
    # Words of a thousand letters that only their order tells apart are different words.
    rows.append((len(rows), "license identifier " + "ab" * 600))
    got = license_matches(spark.createDataFrame(rows, "doc_id long, text string"), NOTICES)
    assert {(r["k1"], r["license"]) for r in got.where("passage = 'line'").collect()} == want
    assert {(r["k1"], r["license"]) for r in got.collect()} == want


def test_licenses_in_windows(spark):
    """Notices laid out over paragraphs, in comments, in mid-line and next to each other."""
    prose = "\n".join(f"line {i} of a long file with words w{i * 7} and x{i * 11} in it" for i in range(300))
    apache, gpl, mit = (max((t for m, t in NOTICES if m == n), key=len) for n in ("Apache-2.0", "GPL-3.0", "MIT"))

    def laid_out(notice, *breaks, mark=""):
        for at in breaks:
            assert at in notice.replace("\n", " ")
            notice = notice.replace("\n", " ").replace(at, "\n\n" + at)
        return "\n".join(mark + x for x in notice.split("\n"))

    published = [
        laid_out(mit, "The above copyright notice", "THE SOFTWARE IS"), laid_out(gpl, "This program is distributed", "You should have", mark=" * "),
        laid_out(apache, "Unless required", "You may obtain", "http", mark="# ")]
    middle = "This module is, as its authors say, released under the MIT License. and its docs are something else that goes on for long"
    texts = [f"{prose}\n{x}\n{prose}" for x in [*published, middle]]
    texts += [f"{prose}\n{published[0]}\n\n{published[2]}\n{published[0]}\n{prose}", prose, (middle + "\n") * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["k1"], r["line"], r["passage"], r["license"], r["dice"]) for r in license_matches(docs, NOTICES).collect() if r["k1"] < 5)
    wanted = [(0, "MIT"), (1, "GPL-3.0"), (2, "Apache-2.0"), (3, "MIT"), (4, "MIT"), (4, "Apache-2.0"), (4, "MIT")]
    assert [(k, name) for k, _, kind, name, _ in got if kind == "window"] == wanted
    assert all(dice > 0.99 for *_, kind, _, dice in got if kind == "window")
    assert [at for _, at, kind, _, _ in got if kind == "window"][:4] == [300] * 4
    many = [r for r in license_matches(docs, NOTICES).collect() if r["k1"] > 4]
    assert len(many) == 3000 and {(r["k1"], r["passage"], r["license"]) for r in many} == {(6, "window", "MIT")}


def test_windows_find_what_trying_all_finds():
    draw = random.Random(5)
    for _ in range(150):
        n, size = draw.randrange(2, 45), draw.randrange(2, 9)
        pairs = np.array([draw.randrange(draw.choice([6, 14, 40])) for _ in range(n)], np.uint64)
        hit = pairs < size
        dice = {(i, j): 2 * len(np.unique(pairs[i : j + 1][hit[i : j + 1]])) / (len(np.unique(pairs[i : j + 1])) + size)
                for i in range(n) for j in range(i, n)}
        found = windows(pairs, hit, size, 0.8)
        assert all(dice[i, j] == d >= 0.8 for d, i, j in found)
        assert max(dice.values()) < 0.8 or max(found)[0] == max(dice.values())
        taken = np.zeros(n + 1, int)
        for _, i, j in found:
            taken[i : j + 2] += 1
        assert taken.max() <= 1
        assert all(taken[i : j + 2].any() for (i, j), d in dice.items() if d >= 0.8)


def knn_truth(rows, k, is_query):
    sound = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in sound:
        if is_query(i):
            near = sorted((-int(q @ v), j) for j, v in sound if j != i and len(v) == len(q))[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(near)}
    return out


def test_top_k(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=12).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(30)]
    rows += [(500, None), (501, [1.0] * 11 + [None]), (502, [float("nan")] + [1.0] * 11), (503, [float("inf")] + [1.0] * 11), (None, [1.0] * 12)]
    rows += [(600, [0.5, 0.25]), (601, [0.5, -0.25]), (610, []), (620, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, query_id int, rank int")
    want = knn_truth(rows, 20, lambda i: i % 10 == 0)
    for shard_size, block_size, leaf in ((8192, 2048, 128), (60, 7, 4)):
        got = top_k(df, F.col("vec_id") % 10 == 0, shard_size=shard_size, block_size=block_size, leaf=leaf)
        assert {tuple(r) for r in got.collect()} == want


def test_top_k_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert top_k(spark.createDataFrame([], kind), F.col("vec_id") % 2 == 0).collect() == []
    one = spark.createDataFrame([(2, [1.0]), (2, [1.0]), (3, [2.0])], kind)
    assert [tuple(r) for r in top_k(one, F.col("vec_id") % 2 == 0).collect()] == [(2, 1, 3, 8192)]
    with pytest.raises(Exception, match="too large"):
        top_k(spark.createDataFrame([(2, [1e9]), (3, [1.0])], kind), F.col("vec_id") % 2 == 0).collect()


def test_top_k_of_a_repeated_row(spark, monkeypatch):
    """A third of the rows are one row: shards hold it once, ranks list it as often as it occurs."""
    draw = np.random.default_rng(8)
    rows = [(i, draw.integers(-60, 60, 4).tolist()) for i in range(1, 60)] + [(0, [70, 70, 70, 70])] * 7 + [(3, [1, 1, 1, 1])] * 400
    df = spark.createDataFrame([(i, [x / 64 for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    seen, plain = [], knn.grow_trees
    monkeypatch.setattr(knn, "grow_trees", lambda *given: seen.append(plain(*given)) or seen[-1])
    got = {tuple(r) for r in top_k(df, F.col("vec_id") % 10 == 0, k=12, shard_size=16, leaf=4).collect()}
    sizes = [r["n"] for r in seen[0][2].collect()]
    assert sum(sizes) == 61 and len(sizes) >= 4 and max(sizes) < 40
    want = set()
    for own, q in rows[:59] + rows[59:60]:
        if own % 10 == 0:
            ranked = sorted((-int(np.dot(q, v)), i) for i, v in rows if i != own)[:12]
            want |= {(own, n + 1, i, -score) for n, (score, i) in enumerate(ranked)}
    assert got == want


def test_equal_vectors_fill_no_shard(spark, monkeypatch):
    """A third of the ids share one vector: their cell is dealt on by a hash, and no result changes."""
    draw = np.random.default_rng(9)
    rows = [(i, draw.integers(-60, 60, 3).tolist()) for i in range(600)] + [(600 + i, [50, -50, 50]) for i in range(300)]
    df = spark.createDataFrame([(i, [x / 64 for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    seen, plain = [], knn.grow_trees
    monkeypatch.setattr(knn, "grow_trees", lambda *given: seen.append(plain(*given)) or seen[-1])
    got = {tuple(r) for r in top_k(df, F.col("vec_id") % 100 == 0, shard_size=50, leaf=8).collect()}
    assert got == knn_truth([(i, [x / 64 for x in v]) for i, v in rows], 20, lambda i: i % 100 == 0)
    sizes = [r["n"] for r in seen[0][2].collect()]
    assert sum(sizes) == 900 and max(sizes) < 100


def test_like_vectors_share_cells_and_queries_skip_far_ones(spark):
    """Two far groups: boxes of the other group cannot hold the kth score."""
    draw = np.random.default_rng(10)
    vectors = np.concatenate([draw.integers(100, 120, (300, 4)), draw.integers(-120, -100, (300, 4))])
    cuts = knn.median_cuts(vectors, 3)
    cells = knn.cells_of(vectors, cuts)
    assert set(cells[:300]).isdisjoint(cells[300:]) and set(cells) == set(range(8))
    boxes = {4: (np.arange(8), *(np.stack([f(vectors[cells == c]) for c in range(8)]) for f in (lambda x: x.min(0), lambda x: x.max(0))))}
    scores = np.sort(vectors @ vectors[0])[-20]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([4]), pa.array([vectors[0].astype("<i4").tobytes()]), pa.array([float(scores)])], names=["dims", "raw", "floor"])
    found = set(next(knn._routed(boxes)([batch])).column(3).to_pylist()[0])
    assert found <= set(cells[:300]) and set(cells[np.flatnonzero(vectors @ vectors[0] >= scores)]) <= found


def test_a_stored_tree_is_the_same(spark):
    draw = np.random.default_rng(11)
    vectors, copies = draw.integers(-2**31 + 1, 2**31, (100, 5)), draw.integers(1, 9, 100)
    tree = KdTree(np.arange(100), vectors, 8)
    again, times = KdTree.unpacked(5, *tree.packed(copies))
    assert (vectors[again.ids] == again.vectors).all() and (copies[again.ids] == times).all()
    assert (again.low == tree.low).all() and (again.high == tree.high).all()
    assert all((np.sort(again.ids[again.rows[n]]) == np.sort(rows)).all() for n, rows in tree.rows.items())


def test_kd_tree_bounds():
    draw = np.random.default_rng(6)
    vectors = draw.integers(-50, 50, (500, 6)).astype(float)
    tree = KdTree(np.arange(500), vectors, 16)
    queries = draw.integers(-50, 50, (5, 6)).astype(float)
    bounds = tree.bounds(queries)
    for node, rows in tree.rows.items():
        assert len(rows) <= 16
        assert (bounds[:, node] >= (queries @ vectors[rows].T).max(axis=1)).all()


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= rows
        rows = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == rows


def test_pipeline_drops_planted_copies(spark, sf):
    """Exact and near copies and a shared passage go; texts without a match stay as they are."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    first, second, passage = ([word() for _ in range(n)] for n in (100, 100, 60))
    near = [*first[:99], "other"]
    rows = [(1, " ".join(first)), (2, "  ".join(first)), (3, " ".join(near)), (4, " ".join(second + passage)), (5, " ".join(passage + [word()])),
            (None, "no id\nhere"), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, kept, sf)
    got = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(got) == {2, 4, 5, None, 6}
    assert got[2] == rows[1][1] and got[4] == rows[3][1] and got[None] == "no id\nhere" and got[6] in (None, "")
    assert got[5] == rows[4][1].split()[-1]
