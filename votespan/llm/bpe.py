"""Byte-level BPE by ranks: every distinct word of the corpus is encoded once.

Texts are taken in blocks of bounded size.  In a block, pre-tokens with their positions become
numbers into the block's list of distinct words.  Those words, not the pre-tokens, are shuffled
by hash (packed by bucket, so a word that a third of the corpus uses arrives once a block);
where they meet, each distinct word is encoded once.  The ids go back to their blocks, where the
positions put them in order.

Decoding joins ids with the table of token bytes.  That table has as many rows as the
vocabulary file, so it is sent to all tasks.

Cases: null and empty texts have no ids; rows that repeat an id or agree in everything are
encoded each by itself; ids without bytes cannot be decoded and raise; other columns are not
read.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from votespan.llm.common import keyed, shuffle_partitions, slices, worker_cache
from votespan.llm.tokens import SAFE, id_width

BLOCK = 10 << 20
ROW = "bucket long, block long, words binary, places binary, codes binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _pack(values) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=9).compress(bytes(values))


def _unpack(frame: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(frame)


class _Numbers(dict):
    """A word's number, given out as words come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def pre_tokens(texts: list[str], pattern) -> tuple[list[str], list[np.ndarray]]:
    """(distinct pre-tokens, for each text the numbers of its pre-tokens).

    Texts are cut at single spaces between non-blanks, where every match of the pattern ends,
    and the pieces' matches are looked up rather than matched again.
    """
    numbers = _Numbers()
    known: dict[str, bytes] = {}
    out = []

    def coded(piece: str) -> bytes:
        return np.array([numbers[w] for w in pattern.findall(piece)], "<u4").tobytes()

    for text in texts:
        parts = text.split(" ")
        new, tail = set(parts[1:]).difference(known), b""
        if parts[0][-1:].isspace() or any(not p or p[0].isspace() or p[-1].isspace() for p in new):
            parts = SAFE.split(text)
            # Only the end of a text may be blank, and means something else elsewhere.
            if len(parts) > 1 and parts[-1][-1].isspace():
                tail = coded(" " + parts.pop())
            new = set(parts[1:]).difference(known)
        for p in new:
            known[p] = coded(" " + p)
        out.append(np.frombuffer(coded(parts[0]) + b"".join(map(known.__getitem__, parts[1:])) + tail, "<u4"))
    return list(numbers), out


def _blocks(pattern: str, buckets: int):
    def run(batches):
        import regex
        import xxhash

        split = regex.compile(pattern)
        base, n = TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches, "text", BLOCK):
            words, codes = pre_tokens(batch.column(2).to_pylist(), split)
            flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
            raw = [w.encode() for w in words]
            home = np.array([xxhash.xxh64_intdigest(w) % buckets for w in raw], np.int64)
            # Frequent words get small numbers; words of one bucket and count follow one another.
            counts = np.bincount(flat, minlength=len(words))
            alphabet = np.empty(len(words), np.int64)
            alphabet[sorted(range(len(words)), key=raw.__getitem__)] = np.arange(len(words))
            by_count = np.lexsort((alphabet, home, -counts))
            number = np.empty(len(words), np.uint32)
            number[by_count] = np.arange(len(words))
            block = base | n
            n += 1
            rows = []
            for bucket in np.unique(home).tolist():
                own = by_count[home[by_count] == bucket]
                sizes = np.array([len(raw[i]) for i in own.tolist()], "<u4")
                steps = np.diff(number[own].astype(np.int64), prepend=0).astype("<u4")
                rows.append((bucket, block, _pack(_head(sizes) + b"".join(raw[i] for i in own.tolist())), _pack(steps.tobytes()), None))
            # Two bytes a pre-token, all low ones first; numbers that need more follow as a list.
            flat = number[flat] if len(flat) else flat
            large = flat >= 0xFFFF
            small = np.where(large, 0xFFFF, flat).astype(np.uint16)
            body = (
                _head(np.array([len(c) for c in codes], "<u4")) + batch.column(0).cast(pa.int64()).to_numpy().astype("<i8").tobytes()
                + batch.column(1).to_numpy().astype("<i8").tobytes() + (small & 0xFF).astype(np.uint8).tobytes()
                + (small >> 8).astype(np.uint8).tobytes() + flat[large].astype("<u4").tobytes())
            rows.append(((TaskContext.get().partitionId() + n) % buckets, block, None, None, _pack(body)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                names=["bucket", "block", "words", "places", "codes"])

    return run


def _head(sizes: np.ndarray) -> bytes:
    return np.array([len(sizes)], "<u4").tobytes() + sizes.tobytes()


def _sizes(raw: bytes) -> tuple[np.ndarray, int]:
    """Sizes written by ``_head``, and where it ends."""
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.frombuffer(raw, "<u4", n, 4), 4 + 4 * n


def _coder(ranks, pattern: str):
    import tiktoken

    kept = worker_cache()
    if kept.get("ranks_of") != ranks.value["name"]:
        kept["coder"] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value["ranks"], special_tokens={})
        kept["ranks_of"] = ranks.value["name"]
    return kept["coder"]


def _encode_words(ranks, pattern: str):
    """Rows sorted by bucket: words to ids, each distinct word of a bucket once."""

    def run(batches):
        code = _coder(ranks, pattern)
        width = id_width(code.n_vocab)
        known: dict[bytes, tuple[int, bytes]] = {}
        bucket = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["codes"] is not None:
                    out.append((row["block"], None, None, row["codes"]))
                    continue
                if row["bucket"] != bucket:
                    bucket, known = row["bucket"], {}
                raw = _unpack(row["words"])
                sizes, at = _sizes(raw)
                ends = at + np.cumsum(sizes)
                found = []
                for a, b in zip((ends - sizes).tolist(), ends.tolist()):
                    word = raw[a:b]
                    one = known.get(word)
                    if one is None:
                        ids = code.encode_ordinary(word.decode())
                        one = known[word] = (len(ids), np.array(ids, width).tobytes())
                    found.append(one)
                counts, ids = zip(*found)
                out.append((row["block"], _pack(width.encode() + _head(np.array(counts, "<u4")) + b"".join(ids)), row["places"], None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
                if out else [pa.array([], k) for k in (pa.int64(), pa.binary(), pa.binary(), pa.binary())],
                names=["block", "ids", "places", "codes"])

    return run


def _assemble(table: pa.Table) -> pa.Table:
    """The ids of a block's texts, from its words' ids and its positions."""
    places, counts, ids, body = [], [], [], b""
    for row in table.to_pylist():
        if row["codes"] is not None:
            body = _unpack(row["codes"])
            continue
        raw = _unpack(row["ids"])
        n, at = _sizes(raw[3:])
        counts.append(n)
        ids.append(np.frombuffer(raw, raw[:3].decode(), offset=3 + at))
        places.append(np.cumsum(np.frombuffer(_unpack(row["places"]), "<u4").astype(np.int64)))
    n_words = sum(map(len, places))
    size, start = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
    if n_words:
        n, place = np.concatenate(counts).astype(np.int64), np.concatenate(places)
        size[place] = n
        start[place] = np.cumsum(n) - n
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    per_text, at = _sizes(body)
    rows = len(per_text)
    k1, k2 = np.frombuffer(body, "<i8", rows, at), np.frombuffer(body, "<i8", rows, at + 8 * rows)
    at += 16 * rows
    total = int(per_text.sum())
    codes = np.frombuffer(body, np.uint8, total, at) + (np.frombuffer(body, np.uint8, total, at + total).astype(np.int64) << 8)
    codes[codes == 0xFFFF] = np.frombuffer(body, "<u4", offset=at + 2 * total)
    sizes = size[codes]
    ends = np.cumsum(sizes)
    out = flat[np.repeat(start[codes] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if total else 0)]
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text.astype(np.int64))])]
    return pa.table({
        "k1": pa.array(k1), "k2": pa.array(k2),
        "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out.astype(np.int32)))})


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None,
) -> DataFrame:
    """(k1, k2, ids): one row for each row of ``docs``.  ``buckets``: parts of the word space, two a shuffle partition."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast({"name": ranks_path, "ranks": read_ranks(ranks_path)})
    n = buckets or 2 * shuffle_partitions(spark)
    rows = keyed(docs, id_col, text_col).mapInArrow(_blocks(pattern, n), ROW)
    coded = rows.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(
        _encode_words(ranks, pattern), "block long, ids binary, places binary, codes binary")
    return coded.groupBy("block").applyInArrow(_assemble, "k1 long, k2 long, ids array<int>")


def _decode(ranks):
    def run(batches):
        kept = worker_cache()
        if kept.get("bytes_of") != ranks.value["name"]:
            kept["token_bytes"] = {i: b for b, i in ranks.value["ranks"].items()}
            kept["bytes_of"] = ranks.value["name"]
        of = kept["token_bytes"].__getitem__
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().tolist()
            there = lists.is_valid().to_pylist()
            texts = [b"".join(map(of, flat[a:b].tolist())) if ok else b"" for a, b, ok in zip(ends[:-1], ends[1:], there)]
            kept = [i for i, name in enumerate(batch.schema.names) if name != "decoded"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(texts, pa.binary())],
                names=[*(batch.schema.names[i] for i in kept), "decoded"])

    return run


def decode(ids: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded``, the bytes of ``ids``, in place of a column of that name."""
    ranks = ids.sparkSession.sparkContext.broadcast({"name": ranks_path, "ranks": read_ranks(ranks_path)})
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema if f.name != "decoded"]
    return ids.mapInArrow(_decode(ranks), ", ".join([*fields, "decoded binary"]))


def decimal_digest(ids: str):
    """SHA-256 of the ids in decimal, joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256)
