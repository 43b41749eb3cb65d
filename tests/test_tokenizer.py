import random
import time

import pytest
from conftest import rows

from votespan.operators.tokenizer import LongestMatch, SPECIALS, Vocabulary, build_vocab, pieces_of, tokenize, vocab_dict, word_counts

VOCAB = {t: i for i, t in enumerate(SPECIALS + ["hello", "wor", "##ld", ",", "!", "un", "##able"])}


def test_pieces_and_offsets(spark):
    df = spark.createDataFrame([(1, "Hello, WORLD!"), (2, "zzz unable"), (3, None), (4, "")], "id int, text string")
    got = {r.id: r for r in tokenize(df, "text", VOCAB).collect()}
    inverse = {i: t for t, i in VOCAB.items()}
    assert [inverse[t] for t in got[1].tokens] == ["[CLS]", "hello", ",", "wor", "##ld", "!", "[SEP]"]
    assert [tuple(o) for o in got[1].offsets] == [(0, 0), (0, 5), (5, 6), (7, 10), (10, 12), (12, 13), (0, 0)]
    assert [tuple(m) for m in got[1].mask] == [(0, 7)]
    assert [inverse[t] for t in got[2].tokens] == ["[CLS]", "[UNK]", "un", "##able", "[SEP]"]
    assert got[3].tokens is None and got[3].mask is None and got[3].offsets is None
    assert len(got[4].tokens) == 2


def test_truncation_counts_specials(spark):
    df = spark.createDataFrame([(1, "hello hello hello")], "id int, text string")
    row = tokenize(df, "text", VOCAB, max_length=4, tail_plus_one=True).first()
    assert len(row.tokens) == 4 and row.tokens[-1] == VOCAB["[SEP]"]
    assert [tuple(m) for m in row.mask] == [(0, 5)]


HARD = ["Hello, wörld! don't  stop", "日本 language 語x", "a​b   ctl\x07x İstanbul", "", "한국어 test",
        "é" * 120, "$5.00 + x^2 = ~y`", "tab\tnew\nline", "�bad\x00chars"]


@pytest.mark.parametrize("accents", [True, False])
@pytest.mark.parametrize("max_length", [None, 16])
def test_equals_a_public_tokenizer(spark, sf, accents, max_length):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    vocab = vocab_dict(build_vocab(docs, size=1500))
    public = tokenizers.BertWordPieceTokenizer(vocab=vocab, lowercase=True, strip_accents=accents)
    if max_length:
        public.enable_truncation(max_length)
    hard = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(HARD)], "doc_id bigint, text string")
    for r in tokenize(hard.unionByName(docs.select("doc_id", "text")), "text", vocab, max_length, accents, longest_word=100).collect():
        want = public.encode(r.text)
        assert r.tokens == want.ids
        assert [tuple(o) for o in r.offsets] == want.offsets


def test_vocab(spark):
    df = spark.createDataFrame([("ab ab c, ab",), ("c cd",)], "text string")
    assert rows(word_counts(df)) == [(",", 1), ("ab", 3), ("c", 2), ("cd", 1)]
    vocab = vocab_dict(build_vocab(df, size=1))
    assert [t for t, _ in sorted(vocab.items(), key=lambda x: x[1])] == SPECIALS + [
        "##a", "##b", "##c", "a", "b", "c", "##,", "##d", ",", "d", "ab"]
    with pytest.raises(ValueError):
        vocab_dict(build_vocab(df), limit=3)


def greedy(word, vocab):
    """Piece after piece by trying every length."""
    out, start = [], 0
    while start < len(word):
        for end in range(len(word), start, -1):
            if (piece := vocab.get(("##" if start else "") + word[start:end])) is not None:
                out.append((piece, end - start))
                start = end
                break
        else:
            return None
    return out


@pytest.mark.parametrize("letters,longest", [("ab", 3), ("ab", 7), ("abc", 4), ("a", 9), ("abcde", 2)])
def test_the_trie_gives_the_longest_pieces(letters, longest):
    draw = random.Random(longest)
    for _ in range(60):
        some = lambda: "".join(draw.choice(letters) for _ in range(draw.randint(1, longest)))
        tokens = {some() for _ in range(draw.randint(0, 9))} | {"##" + some() for _ in range(draw.randint(0, 9))} | {"##"}
        vocab = {t: i for i, t in enumerate(sorted(tokens))}
        trie = LongestMatch(vocab)
        for _ in range(40):
            word = "".join(draw.choice(letters) for _ in range(draw.randint(1, 25)))
            assert trie.pieces(word) == greedy(word, vocab), (vocab, word)


def test_long_words_take_linear_time_and_the_same_ids():
    vocab = Vocabulary({t: i for i, t in enumerate([*SPECIALS, "a", "##a", "##aa", "##aaaab", "##b", "ab", "##" + "a" * 50])})
    for text in ("ab" * 70, "a" * 333, "a" * 100 + "b" * 30, "b" * 80):
        word = [p[0] for p in pieces_of(text, vocab, True)]
        want = greedy(text, vocab)
        assert word == ([vocab["[UNK]"]] if want is None else [p for p, _ in want])
    seconds = []
    for n in (250_000, 1_000_000):
        begun = time.perf_counter()
        assert len(vocab.trie.pieces("ab" + "aab" * (n // 3))) > n // 4
        seconds.append(time.perf_counter() - begun)
    assert seconds[1] < 12 * seconds[0]


def test_a_word_may_be_set_to_be_unknown(spark):
    df = spark.createDataFrame([("unable" + "able" * 40,)], "text string")
    assert len(tokenize(df, "text", VOCAB).first().tokens) == 44
    assert tokenize(df, "text", VOCAB, longest_word=100).first().tokens == [VOCAB[t] for t in ("[CLS]", "[UNK]", "[SEP]")]
