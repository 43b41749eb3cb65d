"""Substring, line and exact dedup and the Jaccard join against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from votespan.llm.exact import BinaryFuse, exact_classes, keep_best
from votespan.llm.graph import components
from votespan.llm.jaccard import jaccard_links, least_depth, link_classes
from votespan.llm.lines import apply_bitmaps, keep_bitmaps, line_digests, read_bitmap
from votespan.llm.substring import remove_repeats, repeated_windows, substring_digests

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, k1 int, rest string, z string"


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, "r", "z") for i, t in rows], SCHEMA)


def prose(seed, n, vocabulary=60):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}é" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, blanks, long and empty texts."""
    draw = random.Random(3)
    base = [prose(i, draw.randrange(1, 120), 5000) for i in range(60)]
    shared = prose("shared", 30, 5000)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t + "\n\t" + shared + "\n" + t) for i, t in enumerate(base[:20])]
    rows += [(200 + i, base[5].replace(" ", "  ", i)) for i in range(6)]
    for i in range(12):
        words = base[7].split() * 2
        words[i % len(words)] = f"new{i}"
        rows.append((300 + i, " ".join(words)))
    rows += [(400, ""), (401, None), (402, " \n\t "), (403, "one"), (404, "one"), (405, "ab ab " * 300)]
    rows += [(406, "x" * 200_000), (407, prose("long", 30_000, 100_000)), (408, "Same Line Here\nsame line here \nshort")]
    rows += [(409, "  SAME line here\t\nshort"), (410, "été" * 3 + "\n" + "é" * 9), (411, "été" * 3 + "\n" + "é" * 9 + "\n" + "é" * 10), (412, "é" * 10)]
    draw.shuffle(rows)
    return rows


def substring_truth(rows, length=20):
    seen, out = set(), []
    for i, words in sorted((i, WORDS.findall(t or "")) for i, t in rows):
        gone = [False] * len(words)
        for a in range(len(words) - length + 1):
            window = tuple(words[a : a + length])
            if window in seen:
                gone[a : a + length] = [True] * length
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring(spark, corpus):
    got = sorted(tuple(r) for r in substring_digests(table(spark, corpus)).collect())
    assert got == substring_truth(corpus)


def test_substring_levels_and_hot_anchors(spark, corpus):
    """More levels, and anchors dealt out one by one, change nothing."""
    want = {r[0]: r[2] for r in substring_truth(corpus)}
    for more in ({"first": 5}, {"hot": 2}):
        got = remove_repeats(table(spark, corpus), **more)
        assert {r["k1"]: r["n_removed"] for r in got.collect()} == want
    with pytest.raises(ValueError):
        repeated_windows(table(spark, corpus), first=7)


def test_substring_carries_and_leaves_whole(spark):
    text = "  keep   these\nblanks "
    copy = " ".join(f"v{i}" for i in range(25))
    got = remove_repeats(table(spark, [(1, text), (2, copy), (3, copy)]), carry=["rest", "k1"], whole=True)
    rows = {r["k1"]: (r["kept"], r["rest"]["rest"], r["rest"]["k1"]) for r in got.collect()}
    assert rows == {1: (text, "r", 1), 2: (copy, "r", 1), 3: ("", "r", 1)}


def test_rows_of_one_document(spark):
    """Equal rows are one document; null ids come first; an id with another text is a further document."""
    copy = " ".join(f"v{i}" for i in range(25))
    rows = [(5, copy), (5, copy), (None, copy), (6, None)]
    got = sorted((tuple(r)[:3] for r in substring_digests(table(spark, rows)).collect()), key=repr)
    assert got == [(5, 25, 25), (5, 25, 25), (6, 0, 0), (None, 25, 0)]
    two = [(5, copy), (5, copy + " more")]
    got = sorted(tuple(r)[1:3] for r in substring_digests(table(spark, two)).collect())
    assert got in ([(25, 0), (26, 25)], [(25, 25), (26, 0)])


def lines_truth(rows, least=10):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    first, out = {}, []
    texts = sorted((i, (t or "").split("\n")) for i, t in rows)
    for i, lines in texts:
        for line in lines:
            if len(key(line)) >= least:
                first.setdefault(key(line), i)
    for i, lines in texts:
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_lines(spark, corpus):
    got = sorted(tuple(r) for r in line_digests(table(spark, corpus)).collect())
    assert got == lines_truth(corpus)


def test_line_bitmaps(spark):
    rows = [(1, "a common line\nx\na common line"), (2, "y\nA common line  "), (2, "y\nA common line  "), (None, "a common line")]
    docs = table(spark, rows)
    maps = keep_bitmaps(docs).collect()
    found = {r["k1"]: read_bitmap(r["keep"], r["n_lines"]).tolist() for r in maps}
    assert found == {-(2**63): [True], 1: [False, True, False], 2: [True, False]}
    texts = sorted((r["k1"], r["kept"]) for r in apply_bitmaps(docs, keep_bitmaps(docs)).collect())
    assert texts == [(-(2**63), "a common line"), (1, "x"), (2, "y"), (2, "y")]


def exact_truth(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    out = []
    for bare, members in groups.items():
        best = min(members)
        digest = hashlib.sha256(bare.encode()).hexdigest()
        out += [(m[1], best[1], len(members), m == best, digest) for m in members]
    return sorted(out)


@pytest.mark.parametrize("part_size", [100_000, 5])
def test_exact(spark, corpus, part_size):
    got = keep_best(table(spark, corpus), part_size=part_size).select(
        "id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")))
    assert sorted(tuple(r) for r in got.collect()) == exact_truth(corpus)


def test_exact_nulls_and_repeated_rows(spark):
    rows = [(None, "a b"), (3, "ab"), (2, "a b"), (2, "a b"), (None, None), (4, " ")]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_classes(table(spark, rows)).collect()), key=repr)
    assert got == sorted([
        (None, 2, 4, False), (3, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (None, 4, 2, False), (4, 4, 2, True)], key=repr)
    none = table(spark, [(None, "a"), (None, "b")])
    assert sorted(r["group_size"] for r in exact_classes(none).collect()) == [1, 1]


def test_binary_fuse():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 10, 1000, 50_000):
        keys = draw.integers(0, 2**63, n).astype(np.uint64)
        fuse = BinaryFuse.build(np.concatenate([keys, keys[:1]]))
        assert fuse.contains(keys).all()
        others = draw.integers(2**63, 2**64, 20_000, dtype=np.uint64)
        assert fuse.contains(others).mean() < 0.01
    assert len(fuse.prints) < 1.4 * n


def jaccard_truth(rows, size=5, similarity=0.8):
    sets = []
    for i, t in rows:
        words = WORDS.findall(t or "")
        n = min(size, len(words))
        sets.append((i, {tuple(words[a : a + n]) for a in range(len(words) - n + 1)} if words else set()))
    parent, links = {i: i for i, _ in sets}, defaultdict(int)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and len(x & y) >= similarity * len(x | y):
                links[i] += 1
                links[j] += 1
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return sorted((i, root(i), links[i]) for i, _ in sets)


def test_jaccard(spark, corpus):
    got = sorted(tuple(r) for r in link_classes(table(spark, corpus)).collect())
    assert got == jaccard_truth(corpus)


def test_jaccard_clumps(spark, corpus):
    """Nodes that are too large for pairs lose no link."""
    truth = {i: n for i, _, n in jaccard_truth(corpus)}
    for cap, block in ((2, 4), (3, 512)):
        got = jaccard_links(table(spark, corpus), cap=cap, block=block)
        assert {r["k1"]: r["n_links"] for r in got.collect()} == truth


def test_jaccard_nulls_and_repeats(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (2, ""), (3, "a b"), (4, "a b")]
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in link_classes(table(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, None, 2), (1, None, 2), (1, None, 2), (2, 2, 0), (2, 2, 0), (3, 3, 1), (4, 3, 1)], key=repr)


def test_forest_depth():
    d = least_depth(0.8, 16, 8, 0.999)
    assert d == 4 and 1 - (1 - 0.8**d) ** 16 >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** 16


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(50)]
    got = {r["v"]: r["label"] for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert set(got[i] for i in range(201)) == {0} and set(got[1001 + i] for i in range(50)) == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("run", [substring_digests, line_digests, exact_classes, link_classes])
def test_empty_tables(spark, run):
    assert run(table(spark, [])).collect() == []
