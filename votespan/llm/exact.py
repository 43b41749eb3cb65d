"""Exact dedup against immutable snapshots, screened by binary-fuse filters.

A snapshot holds, dealt out by the first bits of the digest, the distinct digests of its
texts with the best row and the number of rows of each (its exact buckets), and one static
binary-fuse filter for each part (9 bits a digest).  An incoming batch is first grouped by
itself; its distinct digests pass the filter of their part.  What the filter does not know is
new.  The rest meets the exact buckets by digest, and the two best rows' texts are compared
byte by byte.

Texts are equal if they are identical without the characters 0x20 and 0x09 to 0x0D.  Of equal
texts the row with the most code points stays, then the smallest id.

Cases: null and empty texts are equal to each other and to texts of blanks; null ids come
after all others when the longest text is chosen; rows that agree in id and text are counted
one by one, and each of them is the kept one if its id is; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from votespan.llm.common import BLANK, mix, slices, stash, text_bytes

SLICE = 8 << 20
#: Keys are hashed to three neighbouring segments; this many slots a key, and spare ones.
LOAD, SPARE = 1.125, 64


class BinaryFuse:
    """A static set of 64-bit keys: no false negatives, one false positive in 256."""

    def __init__(self, seed: int, segment: int, count: int, prints: np.ndarray):
        self.seed, self.segment, self.count, self.prints = seed, segment, count, prints

    @staticmethod
    def slots(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Three slots of each key, one in each of three segments in a row, and its fingerprint."""
        h = mix(keys, seed)
        first = ((h >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
        mask = np.uint64(segment - 1)
        spread = mix(h, 5)
        at = np.stack([
            (first + i) * segment + ((spread >> np.uint64(20 * i)) & mask).astype(np.int64) for i in range(3)])
        return at, (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(np.asarray(keys, np.uint64))
        n = len(keys)
        segment = 1 << int(np.clip(np.floor(np.log(max(n, 1)) / np.log(3.33) + 2.25), 2, 18))
        size = max(LOAD, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        count = max(1, int(np.ceil((n * size + SPARE) / segment)) - 2)
        for seed in range(1, 200):
            built = cls._peel(keys, seed, segment, count)
            if built is not None:
                return cls(seed, segment, count, built)
            if seed % 20 == 0:
                count += max(1, count // 10)
        raise ValueError("no seed gives a filter")

    @classmethod
    def _peel(cls, keys, seed, segment, count):
        at, prints = cls.slots(keys, seed, segment, count)
        size = segment * (count + 2)
        degree = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(len(keys)))
        rounds = []
        single = np.flatnonzero(degree == 1)
        left = len(keys)
        while len(single):
            # A key that is alone in several slots is taken from one of them.
            taken, where = np.unique(owner[single], return_index=True)
            rounds.append((taken, single[where]))
            left -= len(taken)
            for row in at[:, taken]:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(owner, row, taken)
            touched = np.unique(at[:, taken])
            single = touched[degree[touched] == 1]
        if left:
            return None
        table = np.zeros(size, np.uint8)
        for taken, slot in reversed(rounds):
            a = at[:, taken]
            table[slot] = 0
            table[slot] = prints[taken] ^ table[a[0]] ^ table[a[1]] ^ table[a[2]]
        return table

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key], np.uint64))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at, prints = self.slots(np.asarray(keys, np.uint64), self.seed, self.segment, self.count)
        return (self.prints[at[0]] ^ self.prints[at[1]] ^ self.prints[at[2]]) == prints


def _digests(batches):
    for batch in slices(batches, "text", SLICE):
        data, offsets = text_bytes(batch.column(1))
        ink = ~BLANK[data]
        bare = memoryview(data[ink])
        edges = np.concatenate([[0], np.cumsum(ink)])[offsets]
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        digests = [hashlib.sha256(bare[a:b]).digest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(np.diff(heads))],
            names=["id", "k2", "digest", "points"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k2, digest, points): hash of the text, SHA-256 of it without blanks, code points of all of it."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("k2", F.xxhash64("text")).mapInArrow(_digests, "id long, k2 long, digest binary, points long")


def _bare(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]", "")


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, best, n): one row for each distinct digest; the best row is the largest struct."""
    best = F.struct(F.col("points"), F.bitwise_not("id").alias("minus_id"), F.col("k2"))
    return rows.groupBy("digest").agg(F.max(best).alias("best"), F.count("*").alias("n"))


def _part(parts: int) -> Column:
    """The part of a digest, by its first 32 bits."""
    return F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % parts


def _key(digest: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[8:16] for d in digest), "<u8")


def _build(table: pa.Table) -> pa.Table:
    made = BinaryFuse.build(_key(table.column("digest").to_pylist()))
    return pa.table({
        "part": table.column("part")[:1], "seed": pa.array([made.seed], pa.int32()),
        "segment": pa.array([made.segment], pa.int32()), "count": pa.array([made.count], pa.int32()),
        "prints": pa.array([made.prints.tobytes()], pa.binary())})


class Snapshot:
    """Exact buckets and their filters, both in the shared folder and never changed."""

    def __init__(self, buckets: DataFrame, filters: DataFrame, parts: int):
        self.buckets, self.filters, self.parts = buckets, filters, parts

    @classmethod
    def build(cls, rows: DataFrame, part_size: int = 100_000) -> Snapshot:
        """``rows``: of ``digests``.  ``part_size``: digests in a filter, about."""
        buckets = stash(grouped(rows), "exact-buckets")
        parts = max(1, -(-buckets.count() // part_size))
        filters = (
            buckets.select("digest", _part(parts).alias("part")).groupBy("part")
            .applyInArrow(_build, "part long, seed int, segment int, count int, prints binary"))
        return cls(buckets, stash(filters, "exact-filters"), parts)

    def screen(self, fresh: DataFrame) -> DataFrame:
        """``fresh`` (digest, best, n) with ``maybe``: whether the snapshot may hold the digest.

        Rows of a part pass its filter in pieces of bounded size.
        """
        piece = 16
        keys = fresh.select("digest", "best", "n", _part(self.parts).alias("part"),
                            (F.conv(F.hex(F.substring("digest", 5, 1)), 16, 10).cast("int") % piece).alias("piece"))
        filters = self.filters.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(piece - 1))))

        def screen(key, rows: pa.Table, found: pa.Table) -> pa.Table:
            maybe = np.zeros(rows.num_rows, bool)
            if rows.num_rows and found.num_rows:
                one = found.to_pylist()[0]
                fuse = BinaryFuse(one["seed"], one["segment"], one["count"], np.frombuffer(one["prints"], np.uint8))
                maybe = fuse.contains(_key(rows.column("digest").to_pylist()))
            return rows.select(["digest", "best", "n"]).append_column("maybe", pa.array(maybe))

        kind = fresh.schema["best"].dataType.simpleString()
        return keys.groupBy("part", "piece").cogroup(filters.groupBy("part", "piece")).applyInArrow(
            screen, f"digest binary, best {kind}, n long, maybe boolean")


def _same_bytes(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of (digest, best, held): digests whose two best rows have the same bytes without blanks."""
    wanted = pairs.select("digest", F.explode(F.array("best", "held")).alias("b")).select(
        "digest", F.bitwise_not(F.col("b.minus_id")).alias("id"), F.col("b.points").alias("points")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = wanted.join(texts, wanted["id"].eqNullSafe(texts["id"])).select(
        "digest", wanted["id"].alias("id"), _bare("text").alias("bare")).where(
        F.sha2(F.col("bare").cast("binary"), 256) == F.lower(F.hex("digest")))
    return found.groupBy("digest").agg(
        (F.min("bare") == F.max("bare")).alias("same")).where("same").select("digest")


def match(snapshot: Snapshot, fresh: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, best, n, held, n_held) of an incoming batch: ``held`` is the snapshot's best row, if any.

    ``docs`` gives the texts of the best rows of both for the byte check.
    """
    screened = stash(snapshot.screen(fresh), "exact-screened")
    buckets = snapshot.buckets.select("digest", F.col("best").alias("held"), F.col("n").alias("n_held"))
    positive = screened.where("maybe").join(buckets, "digest")
    checked = positive.join(_same_bytes(positive, docs, id_col, text_col), "digest", "left_semi")
    return screened.select("digest", "best", "n").join(checked.select("digest", "held", "n_held"), "digest", "left")


def keep_best(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_size: int = 100_000) -> DataFrame:
    """(id, k2, digest, points, keep_id, group_size, kept): one row for each row of ``docs``.

    Rows up to the middle of the id range are the snapshot, the others the incoming batch.
    """
    rows = stash(digests(docs, id_col, text_col), "exact-digests")
    ends = rows.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    middle = None if ends["a"] is None else ends["a"] + (ends["b"] - ends["a"]) // 2
    old = F.lit(False) if middle is None else F.coalesce(F.col("id") <= middle, F.lit(False))
    snapshot = Snapshot.build(rows.where(old), part_size)
    fresh = match(snapshot, grouped(rows.where(~old)), docs, id_col, text_col)
    both = fresh.select("digest", "best", "n").unionByName(snapshot.buckets).unionByName(
        fresh.where("held is not null").select("digest", F.col("held").alias("best"), F.lit(0).cast("long").alias("n")))
    # Written, so that both sides of the join below are shuffled and a hot digest can be split.
    groups = stash(both.groupBy("digest").agg(F.max("best").alias("best"), F.sum("n").alias("group_size")), "exact-groups")
    own = F.struct(F.col("points"), F.bitwise_not("id").alias("minus_id"), F.col("k2"))
    return rows.join(groups, "digest").select(
        "id", "k2", "digest", "points", F.bitwise_not("best.minus_id").alias("keep_id"), "group_size",
        own.eqNullSafe(F.col("best")).alias("kept"))


def exact_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256)."""
    return keep_best(docs).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
