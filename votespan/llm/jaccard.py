"""N-gram Jaccard join by a MinHash LSH forest.

Documents with the same set of word shingles form a class; only one of each goes on.  A class
has ``trees`` signature paths of ``depth`` minima.  Sorted by path, each tree is a prefix
trie.  Two classes are compared if in some tree they share a prefix.  How far prefixes are
shortened follows from the similarity and the target recall alone (``least_depth``), the same
for all nodes: what a node holds does not change it, for a prefix that stops early could lose a
link.  All candidates are then verified on their whole shingle sets.

Small nodes give their pairs one by one.  Nodes with more than ``cap`` classes would give
pairs by the square of their size; they are joined to clumps instead.  The members of a clump
are written as differences from its first one, dealt into blocks, and every two blocks meet in
a task that counts the links of each member and keeps a spanning forest of them.  No pair is
left out, and none leaves the task as a row.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D.  Shingles are compared by 64-bit
hashes, classes by two of them; a class is known by one.

Cases: texts of fewer words than a shingle have one shingle of all their words; texts without
words (null, empty) link to nothing and are classes of their own; rows that repeat an id are
documents each by itself; ids may be null; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from votespan.llm.common import (
    BASES, NULL_ID, inside, keyed, longs, mix, packed, plain_id, ranges_hash, signed, slices, squeeze, stash, text_bytes, text_of_rows,
    unsqueezed, window_hashes, word_bounds, word_hashes)
from votespan.llm.graph import components

SLICE = 2 << 20
#: Members of a clump that are compared with its first one in one go, about.
SALT = 128


def least_depth(similarity: float, trees: int, depth: int, target: float) -> int:
    """The longest prefix at which a pair of that similarity is met in some tree often enough."""
    for d in range(depth, 1, -1):
        if 1 - (1 - similarity**d) ** trees >= target:
            return d
    return 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted in each text, where each text's begin)."""
    starts, ends, bounds = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    grams = window_hashes(words, size)
    at = np.flatnonzero(inside(bounds, size, len(grams)))
    doc, hashes = text_of_rows(bounds, at), grams[at]
    n_words = np.diff(bounds)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        doc = np.concatenate([doc, short])
        hashes = np.concatenate([hashes, ranges_hash(words, bounds[short], bounds[short + 1], BASES[1])])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(offsets)))


def signatures(hashes: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """``count`` 32-bit minima of every set; ``starts`` of non-empty sets."""
    factors = mix(np.arange(1, count + 1, dtype=np.uint64), 11) | np.uint64(1)
    out = np.empty((len(starts), count), ">u4")
    for i, f in enumerate(factors):
        out[:, i] = np.minimum.reduceat(hashes * f, starts) >> np.uint64(32)
    return out


def _classes(size: int, count: int):
    def run(batches):
        for batch in slices(batches, "text", SLICE):
            data, offsets = text_bytes(batch.column(2))
            hashes, bounds = shingle_sets(data, offsets, size)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            if not len(full):
                continue
            starts = bounds[full]
            s1 = mix(np.add.reduceat(mix(hashes, 21), starts))
            s2 = mix(np.add.reduceat(mix(hashes, 22), starts))
            minima = signatures(hashes, starts, count)
            rows = pa.array(full)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(rows), batch.column(1).take(rows), signed(s1), signed(s2),
                packed(minima.reshape(-1), np.arange(len(full)) * count, 4), pa.array(n[full].astype(np.int64))],
                names=["k1", "k2", "c", "s2", "signature", "n"])

    return run


def _paths(trees: int, depth: int, least: int):
    """(node, path, c, n) for each tree: ``node`` stands for the tree and the prefix that must match."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(batch.num_rows, trees, depth)
            for tree in range(trees):
                prefix = raw[:, tree, :least].astype(np.uint64)
                node = np.full(len(raw), mix(np.array([tree + 1], np.uint64), 31)[0])
                for d in range(least):
                    node = mix(node ^ prefix[:, d], 32 + d)
                rest = np.ascontiguousarray(raw[:, tree, least:])
                paths = packed(rest.reshape(-1), np.arange(len(raw)) * (depth - least), 4)
                yield pa.RecordBatch.from_arrays(
                    [signed(node), paths, batch.column(0), batch.column(2)], names=["node", "path", "c", "n"])

    return run


def _candidates(similarity: float, cap: int):
    """From rows sorted by (node, path): pairs of small nodes, (first, member) of large ones."""

    def pairs(c: np.ndarray, n: np.ndarray):
        i, j = np.triu_indices(len(c), 1)
        near = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])
        return c[i[near]], c[j[near]]

    def run(batches):
        node, head, c, n, large = None, None, np.zeros(0, np.int64), np.zeros(0, np.int64), False
        for batch in batches:
            nodes, cs, ns = longs(batch, "node"), longs(batch, "c"), longs(batch, "n")
            cuts = np.flatnonzero(np.diff(nodes)) + 1
            out: list[tuple[np.ndarray, np.ndarray, bool]] = []
            for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(nodes)]])):
                if a == b:
                    continue
                if nodes[a] != node:
                    if not large and len(c) > 1:
                        out.append((*pairs(c, n), False))
                    node, head, large = nodes[a], cs[a], False
                    c, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if b - a == 1 and not len(c) and not large:
                    c, n = cs[a:b], ns[a:b]
                    continue
                c, n = np.concatenate([c, cs[a:b]]), np.concatenate([n, ns[a:b]])
                if large or len(c) > cap:
                    out.append((np.full(len(c), head), c, True))
                    c, n, large = c[:0], n[:0], True
            if out:
                yield _edges(out)
        if not large and len(c) > 1:
            yield _edges([(*pairs(c, n), False)])

    return run


def _edges(found) -> pa.RecordBatch:
    a, b = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    large = np.concatenate([np.full(len(x[0]), x[2]) for x in found])
    keep = a != b
    a, b, large = a[keep], b[keep], large[keep]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(large)], names=["a", "b", "large"])


def _sets(size: int):
    def run(batches):
        for batch, data, offsets in unsqueezed(batches, SLICE):
            hashes, bounds = shingle_sets(data, offsets, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), packed(hashes, bounds[:-1], 8)], names=["c", "shingles"])

    return run


def _compare(similarity: float):
    """Rows sorted by (key, salt, member): the key's own set (member null) comes before its members'.

    Gives the link of each member (``linked``) and its differences from the key's set.
    """

    def run(batches):
        own = None
        for batch in batches:
            out = [[] for _ in range(6)]
            for key, member, clump, raw in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist()
                                                 for x in ("key", "member", "clump", "shingles"))):
                shingles = np.frombuffer(raw, "<u8")
                if member is None:
                    own = shingles
                    continue
                both = np.intersect1d(own, shingles, assume_unique=True)
                common = len(both)
                linked = common >= similarity * (len(own) + len(shingles) - common)
                less = more = None
                if clump:
                    less = np.setdiff1d(own, both, assume_unique=True).tobytes()
                    more = np.setdiff1d(shingles, both, assume_unique=True).tobytes()
                elif not linked:
                    continue
                for column, value in zip(out, (key, member, len(own), less, more, clump)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], names=["key", "member", "n", "less", "more", "clump"])

    return run


def _counted(similarity: float):
    """Links within a pair of blocks: (c, links weighed by class size, root of its part of the links)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        c, side = table.column("member").to_numpy(), table.column("side").to_numpy(zero_copy_only=False).astype(bool)
        size = table.column("size").to_numpy()
        # A class is the clump's set, less some shingles, and some more.
        raw = [[np.frombuffer(x, "<u8") for x in table.column(name).to_pylist()] for name in ("less", "more")]
        n_less, n_more = (np.array([len(x) for x in xs]) for xs in raw)
        whole = table.column("n").to_numpy()
        n = whole - n_less + n_more
        common = whole[:, None] - n_less[:, None] - n_less[None, :] + _shared(raw[0]) + _shared(raw[1])
        linked = common >= similarity * (n[:, None] + n[None, :] - common)
        np.fill_diagonal(linked, False)
        crossing = side[:, None] != side[None, :]
        if crossing.any():
            linked &= crossing
        root = np.arange(len(c))
        while True:
            near = np.where(linked, root[None, :], len(c)).min(axis=1, initial=len(c))
            further = np.minimum(root, near)
            further = further[further]
            if (further == root).all():
                break
            root = further
        return pa.table({"c": pa.array(c), "links": pa.array((linked * size[None, :]).sum(axis=1)), "root": pa.array(c[root])})

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of slices of the incidence matrix."""
    m = len(sets)
    out = np.zeros((m, m))
    if not any(map(len, sets)):
        return out.astype(np.int64)
    row = np.repeat(np.arange(m), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count > 1
    number = np.cumsum(several) - 1
    row, column = row[several[column]], number[column[several[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for start in range(0, int(several.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((m, width), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        out += part @ part.T
    diagonal = [len(x) for x in sets]
    np.fill_diagonal(out, diagonal)
    return np.rint(out).astype(np.int64)


def jaccard_links(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8,
    trees: int = 16, depth: int = 8, target: float = 0.999, cap: int = 16, block: int = 512,
) -> DataFrame:
    """(k1, k2, label, n_links): one row for each row of ``docs``.

    ``label`` is the same for documents that links connect (null: no words); ``n_links`` is the
    number of other rows of at least that similarity, equal ones included.
    """
    rows = stash(keyed(docs, id_col, text_col).mapInArrow(
        _classes(size, trees * depth), "k1 long, k2 long, c long, s2 long, signature binary, n long"), "jaccard-rows")
    classes = stash(rows.groupBy("c", "s2").agg(
        F.max("signature").alias("signature"), F.max("n").alias("n"), F.count("*").alias("size"),
        F.min(F.struct("k1", "k2")).alias("first")), "jaccard-classes")
    least = least_depth(similarity, trees, depth, target)
    paths = classes.select("c", "signature", "n").mapInArrow(
        _paths(trees, depth, least), "node long, path binary, c long, n long")
    found = stash(
        paths.repartition(F.col("node")).sortWithinPartitions("node", "path", "c")
        .mapInArrow(_candidates(similarity, cap), "a long, b long, large boolean").distinct(), "jaccard-candidates")

    clumps = components(found.where("large")).withColumnRenamed("label", "clump")
    sizes = stash(clumps.groupBy("clump").agg(F.count("*").alias("members")), "clump-sizes")
    at = {s: clumps.select(F.col("v").alias(s), F.col("clump").alias(f"clump_{s}")) for s in "ab"}
    pairs = stash(found.where("not large").join(at["a"], "a", "left").join(at["b"], "b", "left").where(
        "clump_a is null or clump_b is null or clump_a <> clump_b").select("a", "b"), "jaccard-pairs")

    # Whole sets of whatever is to be compared, one document for each class.
    wanted = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).unionByName(
        clumps.select(F.col("v").alias("c"))).distinct()
    chosen = classes.join(wanted, "c", "left_semi").select("c", F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"))
    texts = squeeze(keyed(docs, id_col, text_col)).join(chosen, ["k1", "k2"]).select("c", "z")
    sets = stash(texts.mapInArrow(_sets(size), "c long, shingles binary").dropDuplicates(["c"]), "jaccard-sets")

    salted = clumps.join(sizes, "clump").select(
        F.col("clump").alias("key"), F.col("v").alias("member"), "members",
        F.pmod(F.xxhash64("v"), F.ceil(F.col("members") / SALT)).cast("long").alias("salt"))
    members = (
        pairs.select(F.col("a").alias("key"), F.col("b").alias("member"), F.lit(0).cast("long").alias("salt"), F.lit(False).alias("clump"))
        .unionByName(salted.select("key", "member", "salt", F.lit(True).alias("clump"))))
    heads = members.select("key", "salt", "clump").distinct().select(
        "key", F.lit(None).cast("long").alias("member"), "salt", "clump", F.col("key").alias("c"))
    meeting = heads.unionByName(members.withColumn("c", F.col("member"))).join(sets, "c").select(
        "key", "salt", "clump", "member", "shingles")
    compared = stash(
        meeting.repartition(F.col("key"), F.col("salt"), F.col("clump"))
        .sortWithinPartitions("key", "salt", "clump", F.asc_nulls_first("member"))
        .mapInArrow(_compare(similarity), "key long, member long, n long, less binary, more binary, clump boolean"),
        "jaccard-compared")

    weights = classes.select("c", "size")
    singles = compared.where("not clump").select(F.col("key").alias("a"), F.col("member").alias("b"))
    in_blocks = (
        compared.where("clump").join(weights, F.col("member") == F.col("c"))
        .join(sizes.select(F.col("clump").alias("key"), F.ceil(F.col("members") / block).cast("int").alias("blocks")), "key")
        .withColumn("own", F.pmod(F.xxhash64("member", F.lit(3)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "member", "n", "less", "more", "size", (F.col("own") > F.col("other")).alias("side"),
                F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    inner = stash(in_blocks.groupBy("key", "i", "j").applyInArrow(_counted(similarity), "c long, links long, root long"), "jaccard-inner")

    edges = singles.unionByName(inner.where("c <> root").select(F.col("c").alias("a"), F.col("root").alias("b")))
    labels = components(edges)
    counted = (
        singles.join(weights, F.col("b") == F.col("c")).select(F.col("a").alias("c"), F.col("size").alias("links"))
        .unionByName(singles.join(weights, F.col("a") == F.col("c")).select(F.col("b").alias("c"), F.col("size").alias("links")))
        .unionByName(inner.select("c", "links")).groupBy("c").agg(F.sum("links").alias("links")))
    known = stash(classes.select("c", "s2", "size").join(counted, "c", "left").join(
        labels.withColumnRenamed("v", "c"), "c", "left").select(
        "c", "s2", F.coalesce("label", "c").alias("label"),
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")), "jaccard-known")
    linked = rows.select("k1", "k2", "c", "s2").join(known, ["c", "s2"]).select("k1", "k2", "label", "n_links")
    none = keyed(docs, id_col, text_col).where(~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(
        "k1", "k2", F.lit(None).cast("long").alias("label"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(none)


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links): ``class_id`` is the smallest id that links reach."""
    found = stash(jaccard_links(docs, id_col, text_col), "jaccard-links")
    first = stash(found.where("label is not null").groupBy("label").agg(F.min("k1").alias("least")), "jaccard-first")
    named = found.join(first, "label", "left").withColumn("least", F.coalesce("least", "k1"))
    return named.select(
        plain_id(id_col), F.when(F.col("least") != NULL_ID, F.col("least")).alias("class_id"), "n_links")
