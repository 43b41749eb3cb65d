import pytest
from conftest import rows
from pyspark.sql import functions as F

from votespan.operators.tokenizer import SPECIALS
from votespan.plans.prepare import (
    Preparation, join_labelled, prepare_annotated, prepare_scored, run_prepare,
)
from votespan.sources.datasets import Catalog, read_dataset, read_stats, write_input
from votespan.sources.keyed_json import ANNOTATED

CATEGORIES = {"target": ["red", "blue", "green"], "label": ["harmful", "rude", "plain"]}
VOCAB = {t: i for i, t in enumerate(SPECIALS + ["i", "ca", "##n", "can", "'", "t", "stand", "##s", "you", "."])}
POSTS = [
    ("1", [("plain", 1, ["red"]), ("plain", 2, ["red", "blue"]), ("rude", 3, ["None"])],
     [[0, 1, 0, 1, 0, 0], [0, 1, 1, 0, 0, 0]], ["I", "ca", "n't", "stand", "you", "."]),
    ("2", [("harmful", 1, []), ("rude", 2, []), ("plain", 3, [])], [], ["you"]),
]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(POSTS, ANNOTATED)


def test_annotated(posts):
    got = {r.post_id: r for r in prepare_annotated(posts, VOCAB, CATEGORIES).collect()}
    one = got["1"]
    assert (one.label_plain, one.label_rude, one.label_harmful) == (1.0, 0.0, 0.0)
    assert (one.target_red, one.target_blue, one.target_green) == (1.0, 0.0, 0.0)
    inverse = {i: t for t, i in VOCAB.items()}
    assert [inverse[t] for t in one.tokens] == ["[CLS]", "i", "can", "'", "t", "stand", "you", ".", "[SEP]"]
    assert [tuple(m) for m in one.mask] == [(0, 9)]
    # "can" crosses the words "ca" and "n't"; the pieces ' and t lie in the marked "n't".
    assert one.rationale == {3: 1.0, 4: 1.0, 5: 1.0}
    two = got["2"]
    assert [two[f"label_{c}"] for c in CATEGORIES["label"]] == [0.0, 0.0, 0.0]
    assert two.rationale == {}


def test_first_word_reaches_special_tokens(spark):
    posts = spark.createDataFrame([("1", [("plain", 1, [])], [[1, 0]], ["you", "."])], ANNOTATED)
    assert prepare_annotated(posts, VOCAB, CATEGORIES).first().rationale == {0: 1.0, 1: 1.0, 3: 1.0}
    assert prepare_annotated(posts, VOCAB, CATEGORIES, skip_empty=True).first().rationale == {1: 1.0}


def test_rounding_is_optional(posts):
    raw = prepare_annotated(posts, VOCAB, CATEGORIES, rounded=(), denominator="annotators").filter("post_id = '1'").first()
    assert raw.label_plain == pytest.approx(2 / 3) and raw.rationale[5] == 0.5
    assert prepare_annotated(posts, VOCAB, CATEGORIES, max_length=4, tail_plus_one=True).first().mask[0].end == 5


def test_nothing_is_cut_unless_asked(spark):
    words = ["you"] * 500
    posts = spark.createDataFrame([("1", [("plain", 1, [])], [[1] * 500], words)], ANNOTATED)
    row = prepare_annotated(posts, VOCAB, CATEGORIES).first()
    assert len(row.tokens) == 502 and len(row.rationale) == 502
    comments = spark.createDataFrame([(1, 1.0, " ".join(words))], "comment_id int, score double, text string")
    assert len(prepare_scored(comments, VOCAB).first().tokens) == 502


def test_scored(spark):
    df = spark.createDataFrame([(1, 1.0, "you"), (1, 2.0, "can"), (2, 0.5, None)], "comment_id int, score double, text string")
    got = {r.comment_id: r for r in prepare_scored(df, VOCAB).collect()}
    assert got[1].score == 1.5 and got[1].tokens == [VOCAB["[CLS]"], VOCAB["can"], VOCAB["[SEP]"]]
    assert got[2].tokens is None
    assert prepare_scored(df, VOCAB).columns == ["comment_id", "score", "tokens", "mask", "offsets"]


def test_run_prepare(spark, tmp_path):
    many = [(f"{i}", *POSTS[i % 2][1:]) for i in range(300)]
    catalog = Catalog(str(tmp_path))
    write_input(spark.createDataFrame(many, ANNOTATED), catalog, "posts")
    run_prepare(spark, catalog, "posts", VOCAB, Preparation("annotated", "post_id", {"cats": CATEGORIES}))
    parts = [read_dataset(spark, catalog, "posts", s).count() for s in ("train", "valid", "test")]
    assert sum(parts) == 300 and all(parts)
    stats = read_stats(spark, catalog, ["posts"]).first()
    assert stats.label_freqs == [0.0, 0.0, 0.5]
    assert stats.rationale_freq == pytest.approx(150 * 3 / (150 * 9 + 150 * 3))
    comments = spark.createDataFrame([(1, 1.0, "you")], "comment_id int, score double, text string")
    write_input(comments, catalog, "comments")
    run_prepare(spark, catalog, "comments", VOCAB, Preparation("scored", "comment_id"))
    with pytest.raises(ValueError):
        run_prepare(spark, catalog, "comments", VOCAB, Preparation("other", "comment_id"))
    assert read_stats(spark, catalog, ["posts", "comments"]).first() == stats


def test_join_labelled(spark):
    base = spark.createDataFrame([(1,), (2,)], "id int")
    labels = spark.createDataFrame([(1, 0.5)], "id int, label_a double")
    rationale = spark.createDataFrame([(2, {0: 1.0})], "id int, rationale map<int,double>")
    assert rows(join_labelled(base, labels, rationale, "id")) == [(1, 0.5, {}), (2, None, {0: 1.0})]


def test_documents_equal_brute_force(spark, sf):
    """Alignment, tokenising and moving of marks, word by word in plain Python."""
    tokenizers = pytest.importorskip("tokenizers")
    from test_text import aligned, moved
    from votespan.functions.text import detokenize
    from workload.tables import CATEGORIES as GROUPS, posts as documents
    from workload.text import corpus_vocab

    vocab = corpus_vocab(spark, sf)
    public = tokenizers.BertWordPieceTokenizer(vocab=vocab, lowercase=True, strip_accents=False)
    raw = documents(spark, sf).withColumn("text", detokenize(F.col("post_tokens")))
    got = {r.post_id: r for r in prepare_annotated(documents(spark, sf), vocab, GROUPS, strip_accents=False).collect()}
    seen = 0
    for r in raw.collect():
        encoded = public.encode(r.text)
        marks = {i: 1.0 for i in range(len(r.post_tokens)) if any(m[i] for m in r.rationales)}
        spans = aligned(r.post_tokens, r.text)
        inside = [(i, s) for i, s in enumerate(spans) if i in marks]
        # Only marked words can give a value, which keeps the nested loops short.
        want = {}
        for j, (start, end) in enumerate(encoded.offsets):
            for i, (a, b) in inside:
                if start >= a and end <= b:
                    want[j] = marks[i]
        assert got[r.post_id].tokens == encoded.ids
        assert got[r.post_id].rationale == want
        assert len(r.text) > 300 or want == moved(marks, spans, encoded.offsets)
        seen += len(want)
    assert seen > 100
