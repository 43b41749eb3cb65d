"""Line dedup that returns keep bitmaps instead of text.

A line's key is the line without blanks (0x20, 0x09 to 0x0D) at both ends and with A-Z in
lower case.  Keys of at least ``least`` code points that occur in at least two documents stay
in the first document that holds them and go everywhere else.

Hashes of keys are dealt out by range and sorted by (hash, document, position); a stream over
the sorted rows passes the first document of each hash and reports the others.  Before that,
each slice of the input keeps only its own first document of a key: a line that all documents
share arrives once for each slice, whatever its share of the corpus.

Cases: null and empty texts are one empty line; rows that agree in id and text are one
document, listed several times (see ``common``); null ids come first; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from votespan.llm.common import (
    keyed, longs, plain_id, shuffle_partitions, slices, squeeze, stash, text_bytes, unsqueezed)

SLICE = 8 << 20
BLANKS = b" \t\n\x0b\x0c\r"
ROW = "h1 long, h2 long, k1 long, k2 long, at binary, gone boolean, n int"


def _ints(values: list[int]) -> bytes:
    return np.array(values, "<i4").tobytes()


def _key_rows(least: int):
    """(hash, document, positions): ``gone`` if an earlier document of the slice has the key.

    A row without hash gives ``n``, the number of a document's lines.
    """

    def run(batches):
        import xxhash

        for batch in slices(batches, "text", SLICE):
            k1, k2 = longs(batch, "k1"), longs(batch, "k2")
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
            whole = data.tobytes()
            h, keys, places, gone, counts = [], [], [], [], []
            first: dict[bytes, tuple] = {}
            listed = set()
            for i in np.lexsort((k2, k1)).tolist():
                who = (k1[i], k2[i])
                if who in listed:
                    continue
                listed.add(who)
                here: dict[bytes, list[int]] = {}
                lines = whole[offsets[i] : offsets[i + 1]].split(b"\n")
                for n, line in enumerate(lines):
                    key = line.strip(BLANKS).lower()
                    if len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least):
                        here.setdefault(xxhash.xxh3_128_digest(key), []).append(n)
                for digest, at in here.items():
                    h.append(digest)
                    keys.append(i)
                    places.append(_ints(at))
                    gone.append(first.setdefault(digest, who) != who)
                    counts.append(None)
                h.append(None)
                keys.append(i)
                places.append(None)
                gone.append(False)
                counts.append(len(lines))
            rows = np.array(keys, np.int64)
            known = np.array([x is not None for x in h], bool)
            raw = np.frombuffer(b"".join(x if x is not None else bytes(16) for x in h), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                pa.array(raw[:, 0], mask=~known), pa.array(raw[:, 1], mask=~known), pa.array(k1[rows]), pa.array(k2[rows]),
                pa.array(places, pa.binary()), pa.array(gone), pa.array(counts, pa.int32())],
                names=["h1", "h2", "k1", "k2", "at", "gone", "n"])

    return run


def _later(batches):
    """From rows sorted by (h1, h2, k1, k2): those whose hash began with another document."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h = np.stack([longs(batch, "h1"), longs(batch, "h2")])
        k = np.stack([longs(batch, "k1"), longs(batch, "k2")])
        if last is not None:
            h, k = np.concatenate([last[0], h], axis=1), np.concatenate([last[1], k], axis=1)
        begins = np.ones(h.shape[1], bool)
        begins[1:] = (h[:, 1:] != h[:, :-1]).any(axis=0)
        lead = np.maximum.accumulate(np.where(begins, np.arange(len(begins)), 0))
        gone = (k != k[:, lead]).any(axis=0)
        extra = 0 if last is None else 1
        last = h[:, -1:], k[:, lead[-1:]]
        yield batch.filter(pa.array(gone[extra:])).select(["k1", "k2", "at"])


def _bitmaps(batches):
    for batch in batches:
        counts = batch.column(2).to_pylist()
        maps = []
        for n, dropped in zip(counts, batch.column(3).to_pylist()):
            keep = np.ones(n, np.uint8)
            for at in dropped or ():
                keep[np.frombuffer(at, "<i4")] = 0
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())],
            names=["k1", "k2", "n_lines", "keep"])


def read_bitmap(keep: bytes, n_lines: int) -> np.ndarray:
    """The bitmap of a document as booleans, one for each line."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines, bitorder="little").astype(bool)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """(k1, k2, n_lines, keep): one row per document; ``read_bitmap`` opens ``keep``."""
    rows = stash(keyed(docs, id_col, text_col).mapInArrow(_key_rows(least), ROW), "line-keys")
    dealt = rows.where("h1 is not null and not gone").repartitionByRange(
        shuffle_partitions(docs.sparkSession), "h1", "h2").sortWithinPartitions("h1", "h2", "k1", "k2")
    later = dealt.mapInArrow(_later, "k1 long, k2 long, at binary")
    marks = later.withColumn("n", F.lit(None).cast("int")).unionByName(
        rows.where("h1 is null or gone").select("k1", "k2", "at", "n"))
    lists = marks.groupBy("k1", "k2").agg(F.max("n").alias("n"), F.collect_list("at").alias("at"))
    return lists.mapInArrow(_bitmaps, "k1 long, k2 long, n_lines long, keep binary")


def _apply(batches):
    for batch, data, offsets in unsqueezed(batches, SLICE):
        whole = data.tobytes()
        counts, maps = longs(batch, "n_lines"), batch.column(batch.schema.get_field_index("keep")).to_pylist()
        texts, dropped = [], []
        for i, (n, bits) in enumerate(zip(counts.tolist(), maps)):
            text, keep = whole[offsets[i] : offsets[i + 1]], read_bitmap(bits, n)
            dropped.append(n - int(keep.sum()))
            if dropped[-1]:
                text = b"\n".join(x for x, k in zip(text.split(b"\n"), keep) if k)
            texts.append(text)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(counts), pa.array(dropped, pa.int64()),
            pa.array(texts, pa.binary()).cast(pa.string())], names=["k1", "k2", "n_lines", "n_dropped", "kept"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, n_lines, n_dropped, kept): the texts less the lines whose bit is 0."""
    return squeeze(keyed(docs, id_col, text_col)).join(bitmaps, ["k1", "k2"]).select(
        "k1", "k2", "z", "n_lines", "keep").mapInArrow(
        _apply, "k1 long, k2 long, n_lines long, n_dropped long, kept string")


def line_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256)."""
    return apply_bitmaps(docs, keep_bitmaps(docs)).select(
        plain_id(), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
