"""Token counts of huge texts, spellings next to each other, whitened vectors: against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from votespan.llm import queries
from votespan.llm.piece_counts import Pieces, around, count_pieces, cuts
from votespan.llm.spelling import counted_words, spelling_forms
from votespan.llm.whitening import fit_whitening, leading_eigenpairs, minres, scaled, whiten

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdeéß漢🙂▁ \t") for _ in range(draw.randint(1, 12))) for _ in range(300)]
    prose = " ".join(draw.choice(words) for _ in range(3000))
    return [
        "", None, " ", "▁", "a", "plain text", prose, prose[:7001], "a" * 5000, " " * 3001, "ab" * 3000, "1234567890" * 300,
        "\n" * 2500, "🙂" * 1500, "漢字" * 1200, "é" * 2049, "<s>" * 900 + "</s>", "x\0y" * 1000, "=" * 4096 + " end",
        "".join(draw.choice("ab") for _ in range(6000)), "".join(chr(draw.randint(32, 0x2FFF)) for _ in range(4000)),
        "The " + "the" * 2000, "".join(draw.choice("🙂🙃é́a") for _ in range(3000)), "hello world " * 700,
    ]


@pytest.mark.parametrize("chunk,overlap", [(16, 4), (64, 16), (700, 60), (1 << 15, 256)])
def test_counts_equal_the_library(spark, library, chunk, overlap):
    docs = [(i, t, "x") for i, t in enumerate(texts())] + [(6, texts()[6], "again"), (6, "another", "x"), (None, "ab" * 900, "x"), (None, None, "x")]
    got = count_pieces(spark.createDataFrame(docs, DOC).repartition(3), MODEL, chunk=chunk, overlap=overlap)
    want = Counter((-(2**63) if i is None else i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, _ in docs)
    assert Counter(tuple(r) for r in got.select("k1", "n_bytes", "n_tokens").collect()) == want


def test_a_long_run_of_one_letter_needs_wider_overlaps(library):
    """Chunks that begin at odd places share no token near the border."""
    with open(MODEL, "rb") as f:
        code = Pieces(f.read())
    text = "a" * 4001
    (_, left, right, end), (start, lead, _, last) = cuts(np.frombuffer(text.encode(), np.uint8), 2001, 63)[:2]
    a, b = (np.array(code.encode([text[x:y]])[0]) for x, y in ((0, end), (start, last)))
    shared = np.intersect1d(around(code, a, end, right, 63)[0], around(code, b, last - start, lead - start, 63)[0])
    assert len(shared) == 0


def test_offsets_that_do_not_add_up_align_nowhere(library):
    with open(MODEL, "rb") as f:
        code = Pieces(f.read())
    ids = np.array(code.encode(["some words"])[0])
    assert len(around(code, ids, 10, 5, 4)[0]) and not len(around(code, ids, 11, 5, 4)[0])


def test_counts_of_an_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], DOC)
    assert count_pieces(empty, MODEL).collect() == []
    clash = spark.createDataFrame([(1, "a b" * 100, 5, 6, "z")], "doc_id long, text string, k1 long, n_tokens int, chunk string")
    assert count_pieces(clash, MODEL, chunk=64, overlap=16).count() == 1
    with pytest.raises(ValueError):
        count_pieces(empty, MODEL, chunk=10, overlap=8)


# Spelling


def distance_is_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def forms_by_trial(words, ratio=2):
    out, form_of = [], {}
    near = {w: [v for v in words if distance_is_one(w, v)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form_of[w] = best if best is not None and words[best] >= ratio * n else None
    for w, n in words.items():
        root = w
        while form_of[root] is not None:
            root = form_of[root]
        out.append((w, n, len(near[w]), form_of[w], words.get(form_of[w]), root))
    return sorted(out, key=repr)


def words_by_trial(docs, one_in, least_length, least):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least}


@pytest.mark.parametrize("letters,length", [("ab", 6), ("aé×", 5), ("abcdefgh", 3), ("a", 9)])
def test_forms_equal_a_trial_of_all_pairs(spark, letters, length):
    draw = random.Random(len(letters))
    words = {}
    for _ in range(400):
        words["".join(draw.choice(letters) for _ in range(draw.randint(1, length)))] = draw.choice([3, 4, 6, 9, 20, 41, 100, 1000])
    got = spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3))
    rows = sorted((tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=repr)
    assert rows == forms_by_trial(words)


def test_a_chain_of_forms_ends_at_its_root(spark):
    words = {"a" * (5 + i): 3 * 2**i for i in range(40)}
    got = {r["word"]: r["root"] for r in spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"a" * 44}


def test_words_of_documents(spark):
    draw = random.Random(3)
    runs = ["Straße", "straße", "MAISON", "maison", "ÀÉÎ×÷ö", "naïve", "tiny", "wording", "wordng", "KKelvin", "x1y2zzzzz"]
    docs = [(i if i % 7 else None, " ".join(draw.choice(runs) + draw.choice(["", ",", "-", "\n"]) for _ in range(60))) for i in range(80)]
    docs += [(1, None), (2, ""), (3, "123 İı"), docs[5], docs[5]]
    got = counted_words(spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, word string"), one_in=5)
    assert {r["word"]: r["n"] for r in got.collect()} == words_by_trial(docs, 5, 5, 3)


def test_spelling_query_on_whole_texts(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_spelling_variants"](spark, sf)
    rows = {r["word"]: tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()}
    words = words_by_trial(docs, 97, 5, 3)
    assert rows.keys() == words.keys()
    some = dict(sorted(words.items())[:400])
    for w in some:
        near = [v for v in words if abs(len(v) - len(w)) < 2 and distance_is_one(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 2 * words[w] else None
        assert rows[w][1:5] == (words[w], len(near), form, words.get(form))
        assert rows[w][5] == (w if form is None else rows[form][5])


def test_no_words(spark):
    assert spelling_forms(spark.createDataFrame([], "word string, n long")).collect() == []
    assert counted_words(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect() == []


# Whitening


@pytest.mark.parametrize("spectrum", ["flat", "steep", "twins", "low rank", "identity", "one"])
def test_eigenpairs_reach_double_precision(spectrum):
    draw = np.random.default_rng(4)
    basis = np.linalg.qr(draw.standard_normal((40, 40)))[0]
    values = {
        "flat": np.linspace(2, 1, 40), "steep": np.logspace(0, -8, 40), "twins": np.repeat(np.linspace(5, 1, 20), 2),
        "low rank": np.r_[np.arange(5, 0, -1), np.zeros(35)], "identity": np.ones(40), "one": np.ones(1)}[spectrum]
    basis = basis[: len(values), : len(values)] if len(values) == 40 else np.eye(1)
    matrix = (basis * values) @ basis.T
    got, vectors = leading_eigenpairs(lambda q: matrix @ q, len(values), 8)
    k = {"low rank": 5, "one": 1}.get(spectrum, 8)
    assert len(got) == k and np.allclose(got, values[:k], rtol=0, atol=1e-13 * values[0])
    assert np.linalg.norm(matrix @ vectors - vectors * got, axis=0).max() < 1e-13 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13


def test_minres_solves_indefinite_systems():
    draw = np.random.default_rng(1)
    a = draw.standard_normal((25, 25))
    a, right = a + a.T, draw.standard_normal((25, 3))
    assert np.abs(a @ minres(lambda t: a @ t, right, 60, 1e-14) - right).max() < 1e-10


def whitened_by_trial(vectors, k=8):
    """(deviations, whitened up to sign, explained) with exact sums."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    exact = [[n * c - s for c, s in zip(row, sums)] for row in x]
    centred = np.array([[c / n for c in row] for row in exact])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return [sum(c * c for c in row) for row in exact], centred @ basis / np.sqrt(values), values / np.square(centred).sum() * n


def test_whitening_query_equals_a_dense_solution(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    deviations, w, explained = whitened_by_trial([r["embedding"] for r in rows])
    got = queries.QUERIES["op13_whitening"](spark, sf).orderBy("vec_id", "component").toPandas()
    assert len(got) == 8 * len(rows) and (got["n"] == len(rows)).all()
    assert got["deviation"].tolist() == np.repeat(deviations, 8).tolist()
    found = got["whitened"].to_numpy().reshape(-1, 8)
    sign = np.sign((found * w).sum(axis=0))
    assert np.abs(found - w * sign).max() < 1e-9
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 8)[0], explained, rtol=1e-10)
    assert got["identity_error"].max() < 1e-10 and got["identity_error"].nunique() == 1


def test_rows_without_a_whole_vector_are_dropped(spark):
    draw = np.random.default_rng(2)
    good = [(i, [float(c) for c in draw.standard_normal(3)], "x") for i in range(50)] + [(None, [1.0, 2.0, 3.0], "x"), (7, [0.5, 0.5, 0.5], "x")]
    bad = [(60, None, "x"), (61, [], "x"), (62, [1.0, None, 2.0], "x"), (63, [float("nan"), 0.0, 0.0], "x"),
           (64, [float("inf"), 0.0, 0.0], "x"), (65, [1e30, 0.0, 0.0], "x"), (66, [1.0, 2.0], "x"), (67, [1.0, 2.0, 3.0, 4.0], "x")]
    df = spark.createDataFrame(good + bad, "id long, v array<double>, n string").withColumn("x", scaled(F.col("v"), 1024, 100_000))
    got = whiten(df, "id", "x", fit_whitening(df, "x", 8)).toPandas()
    assert len(got) == 3 * len(good) and set(got["n"]) == {len(good)}
    _, w, explained = whitened_by_trial([g[1] for g in good], 3)
    assert np.allclose(sorted(set(got["explained"])), sorted(explained))
    for k in range(3):
        one = got[got["component"] == k + 1].set_index("id")["whitened"]
        want = w[:50, k] * np.sign(one[0] * w[0, k])
        assert np.allclose(one[one.index.isin([i for i in range(50) if i != 7])].sort_index(), np.delete(want, 7), atol=1e-10)


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]]])
def test_nothing_to_whiten(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, v array<double>").select(
        "vec_id", scaled(F.col("v"), 1024, 0).alias("x"))
    assert whiten(df, "vec_id", "x", fit_whitening(df, "x", 8)).collect() == []


def test_fewer_dimensions_than_rows_and_large_entries(spark):
    """Sums beyond a long stay exact; a deviation beyond a long is null."""
    rows = [(1, [2**61, 5]), (2, [2**61 - 4, 6]), (3, [2**61 - 2, 9]), (4, [2**61 - 2, 0])]
    df = spark.createDataFrame(rows, "id long, x array<long>")
    model = fit_whitening(df, "x", 8)
    assert model.n == 4 and int(model.whole[0]) * 4 + int(model.rest[0]) == sum(r[1][0] for r in rows)
    sums = [sum(c) for c in zip(*(r[1] for r in rows))]
    want = {i: sum((4 * c - s) ** 2 for c, s in zip(x, sums)) for i, x in rows}
    assert {r["id"]: r["deviation"] for r in whiten(df, "id", "x", model).collect()} == want
    far = spark.createDataFrame([(1, [2**61, 5]), (2, [-(2**61), 6])], "id long, x array<long>")
    assert {r["deviation"] for r in whiten(far, "id", "x", fit_whitening(far, "x", 8)).collect()} == {None}
