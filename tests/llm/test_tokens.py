"""Token store, byte-level BPE and packing: round trips and the public libraries."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from votespan.llm.bpe import decimal_digest, decode, encode
from votespan.llm.packing import best_fit, least_sequences, pack, sequences, slot_table, solve_configurations, token_pieces
from votespan.llm.token_store import read_store, train_dictionary, write_store
from votespan.llm.tokens import PieceEncoder, read_vocabulary
from votespan.sources.scratch import scratch_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "\n\n", "a", "Hello  world \n next\tline", "it's '' 's  x", " lead and trail ", "naïve — ünïcödé 日本語  nbsp  ",
    "<|endoftext|> is text <|endoftext|>", "word " * 3000, "x" * 50_000, "\x1c a \x85b", "tab\tand  two", "a\n\n b \n c", "0123 4567.89",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(7 * i % 31, t, "kept", 1) for i, t in enumerate(TEXTS * 2)] + [(None, "no id", "kept", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n int").repartition(3)


def truth(library, docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    return [(i, library.encode(t, add_special_tokens=False).ids) for i, t in rows]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 'sé\n\t 　!1\x1c"), max_size=40), min_size=1, max_size=6))
def test_pieces_are_the_librarys_ids(texts):
    code = PieceEncoder(read_vocabulary(BYTE_BPE))
    want = [np.array(e.ids, "<u2").tobytes() for e in code.library.encode_batch(texts, add_special_tokens=False)]
    assert code.encode(texts) == want
    assert code.encode(texts) == want


@cache
def one_coder():
    return PieceEncoder(read_vocabulary(BYTE_BPE))


PARTS = st.sampled_from([
    *"ab'é!1$|<>×÷ß\n\r\t\v\x1c\x85\xa0\u1680\u180e\u2003\u200b\u2019\u2028\u205f\u3000\ufeff日😀", " ", "  ", "'s", "<|endoftext|>", "|endoftext", "word", "Ġ"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=30).map("".join), min_size=1, max_size=6))
def test_pieces_around_blanks_marks_and_added_tokens(texts):
    code = one_coder()
    want = [np.array(e.ids, "<u2").tobytes() for e in code.library.encode_batch(texts, add_special_tokens=False)]
    assert code.encode(texts) == want
    padded = pa.array(["out", *texts, "of it"])
    assert code.encode(padded.slice(1, len(texts))) == want


def test_words_between_lines_and_marks_are_encoded_once():
    draws = random.Random(3)
    words = ["".join(draws.choices("abcdefgh", k=7)) for _ in range(40)]
    texts = ["".join(w for _ in range(50) for w in (draws.choice(words), draws.choice([" ", "\n", ".\n", "!! ", ", "]))) for _ in range(80)]
    code = PieceEncoder(read_vocabulary(BYTE_BPE))
    want = [np.array(e.ids, "<u2").tobytes() for e in code.library.encode_batch(texts, add_special_tokens=False)]
    sent, plain = [], code._ids
    code._ids = lambda some: sent.extend(some) or plain(some)
    assert code.encode(texts) == want
    # Words after a space, after a line feed and at a text's begin, and the marks.
    assert sum(map(len, sent)) < 3 * 8 * len(words) + 20


def test_ids_of_both_generations(monkeypatch):
    monkeypatch.setattr("votespan.llm.tokens.KEPT", 5)
    code = PieceEncoder(read_vocabulary(BYTE_BPE))
    texts = [f"one two three four{i} five  six\tseven, eight" for i in range(6)] + ["", "one two"]
    want = [np.array(e.ids, "<u2").tobytes() for e in code.library.encode_batch(texts, add_special_tokens=False)]
    assert [code.encode([t])[0] for t in texts] == want
    assert [code.encode(texts[i : i + 3]) for i in (0, 3, 0)] == [want[:3], want[3:6], want[:3]]


def test_store_round_trip(spark, docs, library):
    path = scratch_path(spark, "store-test")
    write_store(docs, path, BYTE_BPE, end_id=2)
    got = read_store(spark, path).collect()
    want = sorted((-1 if i is None else i, len(x) + 1, (np.array([*x, 2], "<u4")).tobytes()) for i, x in truth(library, docs))
    assert sorted((max(r["k1"], -1), r["n_tokens"], bytes(r["ids"])) for r in got) == want
    # Ascending ids, no gaps.
    order = sorted(got, key=lambda r: r["start"])
    assert [r["k1"] for r in order] == sorted(r["k1"] for r in got)
    assert [r["start"] for r in order] == np.cumsum([0, *(r["n_tokens"] for r in order)])[:-1].tolist()


def test_store_single_documents(spark, docs):
    path = scratch_path(spark, "store-test")
    write_store(docs, path, BYTE_BPE, end_id=None)
    everything = {(r["k1"], r["k2"]): (r["start"], bytes(r["ids"])) for r in read_store(spark, path).collect()}
    some = read_store(spark, path, wanted=[0, 14, 999]).collect()
    assert {r["k1"] for r in some} == {0, 14}
    assert {(r["k1"], r["k2"]): (r["start"], bytes(r["ids"])) for r in some} == {
        k: v for k, v in everything.items() if k[0] in (0, 14)}


def test_dictionary_hash_is_checked(spark, docs):
    path = scratch_path(spark, "store-test")
    write_store(docs, path, BYTE_BPE, end_id=2)
    spark.createDataFrame([("0" * 64, bytearray(b"other"), False, "<u2")], "hash string, dictionary binary, trained boolean, width string").write.mode(
        "overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError):
        read_store(spark, path)


def test_empty_store(spark, docs):
    path = scratch_path(spark, "store-test")
    write_store(docs.limit(0), path, BYTE_BPE, end_id=2)
    assert read_store(spark, path).collect() == []
    assert train_dictionary([], 1000) == (b"", False)


def test_bpe_is_tiktokens(spark, docs):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = encode(docs, RANKS, public_tokenizers.PATTERN)
    got = decode(coded, RANKS).select("k1", "ids", "decoded", decimal_digest("ids").alias("d")).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = sorted((-1 if i is None else i, library.encode_ordinary(t), t.encode()) for i, t in texts)
    assert sorted((max(r["k1"], -1), r["ids"], bytes(r["decoded"])) for r in got) == want
    for r in got:
        assert r["d"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
    assert encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_ids_that_are_no_tokens(spark):
    rows = spark.createDataFrame([(1, [0, 99_999_999])], "k int, ids array<int>")
    with pytest.raises(Exception, match="99999999"):
        decode(rows, RANKS).collect()
    nothing = spark.createDataFrame([(1, None)], "k int, ids array<int>")
    assert bytes(decode(nothing, RANKS).first()["decoded"]) == b""


def check_packing(rows, room):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    return len(by)


@pytest.mark.parametrize("room", [16, 2048])
def test_packing(spark, docs, library, room):
    packed = pack(token_pieces(docs, BYTE_BPE, end_id=0, most=room, keep_ids=True), room)
    rows = packed.collect()
    n = check_packing(rows, room)
    per_text = defaultdict(list)
    for r in rows:
        per_text[r["k1"], r["k2"]].append(r)
    tokens = sorted([*x, 0] for _, x in truth(library, docs))
    assert sum(r["length"] for r in rows) == sum(map(len, tokens))
    assert n >= -(-sum(map(len, tokens)) // room)
    found = []
    for pieces in per_text.values():
        times = sum(p["piece"] == 0 for p in pieces)
        whole = sorted({p["piece"]: p for p in pieces}.values(), key=lambda p: p["piece"])
        assert [p["start"] for p in whole] == np.cumsum([0, *(p["length"] for p in whole)])[:-1].tolist()
        assert all(p["length"] == room for p in whole[1:]) and whole[0]["length"] <= room
        assert all(p["ids_crc32"] == zlib.crc32(p["ids"]) for p in whole)
        found += [np.frombuffer(b"".join(bytes(p["ids"]) for p in whole), "<u4").tolist()] * times
    assert sorted(found) == tokens
    laid = {r["sequence_id"]: bytes(r["ids"]) for r in sequences(packed).collect()}
    assert all(laid[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"]) for r in rows)


def test_packing_nothing(spark, docs):
    assert pack(token_pieces(docs.limit(0), BYTE_BPE, end_id=0, most=64), 64).collect() == []


def test_configurations_reach_the_bound():
    draw = random.Random(2)
    histogram = defaultdict(int)
    for _ in range(3000):
        histogram[min(256, int(draw.expovariate(1 / 60)) + 1)] += 1
    plan, least = solve_configurations(dict(histogram), 256)
    covered = defaultdict(int)
    for times, config in plan:
        assert sum(n * t for n, t in config.items()) <= 256
        for n, t in config.items():
            covered[n] += times * t
    assert covered == histogram
    bound = -(-sum(n * c for n, c in histogram.items()) // 256)
    assert least >= bound
    assert sum(t for t, _ in plan) <= bound * 1.005 + 1
    table = slot_table(plan)
    assert len(table) == sum(sum(c.values()) for _, c in plan)
    assert solve_configurations({}, 256) == ([], 0) and slot_table([]).shape == (0, 4)


def by_pieces(lengths, room):
    """Best-fit decreasing, piece by piece."""
    import bisect

    spaces = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(spaces, n)
        space = spaces.pop(at) if at < len(spaces) else room
        bisect.insort(spaces, space - n)
    return len(spaces)


def checked(plan, histogram, room):
    covered = defaultdict(int)
    for times, config in plan:
        assert times > 0 and sum(n * t for n, t in config.items()) <= room
        for n, t in config.items():
            covered[n] += times * t
    assert covered == histogram
    return sum(t for t, _ in plan)


#: Shortest and longest piece, and how far over the bound the plan may be.
SHAPES = [(300, 1300, 0.005), (650, 760, 0.025), (500, 1100, 0.03), (1, 2047, 0.002), (1, 300, 0.0), (900, 2048, 0.001), (2048, 2048, 0.0)]


@pytest.mark.parametrize("low,high,gap", SHAPES)
def test_the_program_is_never_above_best_fit_and_near_its_bound(low, high, gap):
    draw = random.Random(low)
    lengths = [draw.randint(low, high) for _ in range(20_000)]
    histogram = defaultdict(int)
    for n in lengths:
        histogram[n] += 1
    plain = checked(best_fit(dict(histogram), 2048), histogram, 2048)
    assert plain == by_pieces(lengths, 2048)
    plan, bound = solve_configurations(dict(histogram), 2048)
    assert bound <= checked(plan, histogram, 2048) <= min(plain, bound * (1 + gap) + 1)
    assert bound >= least_sequences(dict(histogram), 2048) >= -(-sum(lengths) // 2048)


def fewest(lengths, room):
    """The least number of sequences, by trying everything."""
    best = len(lengths)

    def go(i, spaces):
        nonlocal best
        if len(spaces) >= best:
            return
        if i == len(lengths):
            best = len(spaces)
            return
        for at in range(len(spaces)):
            if spaces[at] >= lengths[i] and spaces[at] not in spaces[:at]:
                go(i + 1, [s - lengths[i] if j == at else s for j, s in enumerate(spaces)])
        go(i + 1, [*spaces, room - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bounds_hold_for_small_tables(lengths):
    histogram = defaultdict(int)
    for n in lengths:
        histogram[n] += 1
    plan, bound = solve_configurations(dict(histogram), 20, rounds=50)
    least = fewest(lengths, 20)
    assert bound <= least <= checked(plan, histogram, 20)
