"""Substring dedup: windows of words that occur before, found by doubling the window.

Level by level.  A window can only repeat if the shorter windows in it repeat, so the first
level looks at windows of half the length (or a quarter, ...), and only what repeats there is
extended to twice the length, until the wanted length is reached or no candidate survives
(longer windows cover no word that theirs do not cover).  On a level below the last one a
window stands for all longer windows around it in which its hash is the smallest, so about
two in eleven positions are looked at and every longer window has one.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, unchanged.  Windows are compared
by two independent 64-bit hashes: of the window and of the smallest window in it.

Cases: null and empty texts have no words; texts shorter than the window keep all; rows that
agree in id and text are one document (see ``common``), rows that repeat an id with another
text come one after the other; null ids come first; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from votespan.llm.common import (
    discard, inside, keyed, longs, mix, packed, plain_id, signed, slices, squeeze, stash, text_bytes, text_of_rows,
    unsqueezed, window_hashes, word_bounds, word_hashes)

SLICE = 2 << 20
#: Windows dealt out as one row at most.
RUN = 32


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum over every ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    return pick(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def anchors(words: np.ndarray, bounds: np.ndarray, short: int, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each short window, the smallest of them in each long window, which long windows lie in one text)."""
    grams = window_hashes(words, short)
    if len(words) < long:
        return grams, np.zeros(0, np.uint64), np.zeros(0, bool)
    least = sliding(grams, long - short + 1, np.minimum)
    return grams, least, inside(bounds, long, len(least))


def _anchor_rows(short: int, long: int):
    def run(batches):
        width = long - short + 1
        for batch in slices(batches, "text", SLICE):
            data, offsets = text_bytes(batch.column(1))
            starts, ends, bounds = word_bounds(data, offsets)
            grams, least, ok = anchors(word_hashes(data, starts, ends), bounds, short, long)
            if not len(least):
                continue
            edge = np.zeros(width - 1, np.uint64)
            most = sliding(np.concatenate([edge, np.where(ok, least, 0), edge]), width, np.maximum)
            at = np.flatnonzero((most == grams) & (most > 0))
            doc, hashes = text_of_rows(bounds, at), grams[at]
            # One row for each text and anchor, two if it repeats in the text itself.
            order = np.lexsort((hashes, doc))
            doc, hashes = doc[order], hashes[order]
            nth = np.ones(len(doc), bool)
            nth[2:] = (doc[2:] != doc[:-2]) | (hashes[2:] != hashes[:-2])
            yield pa.RecordBatch.from_arrays(
                [signed(hashes[nth]), batch.column(0).take(pa.array(doc[nth]))], names=["a", "kk"])

    return run


def _window_rows(short: int, long: int):
    def run(batches):
        for batch, data, offsets in unsqueezed(batches, SLICE):
            k1, k2 = longs(batch, "k1"), longs(batch, "k2")
            starts, ends, bounds = word_bounds(data, offsets)
            words = word_hashes(data, starts, ends)
            _, least, ok = anchors(words, bounds, short, long)
            if not len(least):
                continue
            sets = [np.frombuffer(b"".join(x for x in batch.column(batch.schema.get_field_index(c)).to_pylist() if x), "<u8")
                    for c in ("hits", "hot")]
            at = np.flatnonzero(ok & np.isin(least, sets[0]))
            doc = text_of_rows(bounds, at)
            # In the order of documents; a document that is listed twice counts once.
            order = np.lexsort((k2, k1))
            again = np.zeros(len(k1), bool)
            again[order[1:]] = (k1[order[1:]] == k1[order[:-1]]) & (k2[order[1:]] == k2[order[:-1]])
            place = np.empty(len(k1), np.int64)
            place[order] = np.arange(len(k1))
            at, doc = at[~again[doc]], doc[~again[doc]]
            order = np.argsort(place[doc], kind="stable")
            at, doc = at[order], doc[order]
            a, w = least[at], window_hashes(words, long, 1)[at]
            # Windows that come earlier in this very slice need not travel.
            order = np.argsort(w, kind="stable")
            same = (w[order[1:]] == w[order[:-1]]) & (a[order[1:]] == a[order[:-1]])
            seen = np.zeros(len(at), bool)
            seen[order[1:][same]] = True
            alone = np.isin(a, sets[1])
            key = np.where(seen, mix(k2[doc].view(np.uint64)), np.where(alone, mix(w ^ mix(a, 4), 3), a))
            cut = np.ones(len(at), bool)
            cut[1:] = (np.diff(at) != 1) | (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (seen[1:] != seen[:-1])
            first = np.flatnonzero(cut)
            lengths = np.diff(np.append(first, len(at)))
            # Long runs are cut, so that rows stay small.
            pieces = -(-lengths // RUN)
            first = np.repeat(first, pieces) + RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            if not len(first):
                continue
            lengths = np.diff(np.append(first, len(at)))
            d = doc[first]
            payload = packed(w, first, 8)
            yield pa.RecordBatch.from_arrays([
                signed(key[first]), pa.array(k1[d]), pa.array(k2[d]), pa.array((at[first] - bounds[d]).astype(np.int64)),
                pa.array(lengths.astype(np.int32)), pa.array(seen[first]), payload],
                names=["a", "k1", "k2", "start", "n", "seen", "w"])

    return run


def _repeats(batches):
    """From rows sorted by (a, k1, k2, start): the runs of windows that are not their first occurrence."""
    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, k1, k2 = longs(batch, "a"), longs(batch, "k1"), longs(batch, "k2")
        start, n, seen = longs(batch, "start"), longs(batch, "n"), longs(batch, "seen").astype(bool)
        row = np.repeat(np.arange(len(a)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        w = np.frombuffer(b"".join(batch.column(6).to_pylist()), "<u8")
        fresh = np.stack([a[row], k1[row], k2[row], start[row] + step])
        at = np.flatnonzero(~seen[row])
        old = 0
        hashes, facts = w[at], fresh[:, at]
        if left is not None:
            old = len(left[0])
            hashes, facts = np.concatenate([left[0], hashes]), np.concatenate([left[1], facts], axis=1)
        order = np.argsort(hashes, kind="stable")
        begins = np.ones(len(order), bool)
        begins[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (facts[0, order[1:]] != facts[0, order[:-1]])
        lead = order[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]
        later = (facts[:, lead] != facts[:, order]).any(axis=0)
        flagged = seen[row].copy()
        hit = order[later]
        flagged[at[hit[hit >= old] - old]] = True
        # The last key may go on in the next batch: keep its first occurrences.
        keep = order[begins]
        keep = np.sort(keep[facts[0, keep] == a[-1]])
        left = hashes[keep], facts[:, keep]
        cut = np.ones(len(row), bool)
        cut[1:] = (row[1:] != row[:-1]) | (flagged[1:] != flagged[:-1])
        first = np.flatnonzero(cut)
        lengths = np.diff(np.append(first, len(row)))
        first, lengths = first[flagged[first]], lengths[flagged[first]]
        f = fresh[:, first]
        yield pa.RecordBatch.from_arrays(
            [pa.array(f[1]), pa.array(f[2]), pa.array(f[3].astype(np.int64)), pa.array(lengths.astype(np.int32))],
            names=["k1", "k2", "start", "n"])


def repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, first: int = 10, hot: int = 1_000,
) -> DataFrame:
    """(k1, k2, spans): per document the runs of window starts, as (start, count) pairs of ints in binary.

    ``first``: words in the windows of the first level (``length`` / 2^k).  ``hot``: anchors in
    more rows than this have their windows dealt out one by one rather than together.
    """
    rows = keyed(docs, id_col, text_col).withColumn("kk", F.xxhash64("k1", "k2"))
    short, hits = first, None
    while short < length:
        if 2 * short > length or length % short:
            raise ValueError("length must be first times a power of two")
        before, hits = hits, stash(_hits(rows, hits, short, length, hot), "substring-hits")
        if before is not None:
            discard(before)
        if 2 * short >= length:
            break
        short *= 2
    cut = _window_rows(short, length)
    windows = (
        squeeze(rows).join(hits, "kk").select("k1", "k2", "z", "hits", "hot")
        .mapInArrow(cut, "a long, k1 long, k2 long, start long, n int, seen boolean, w binary"))
    marks = (
        windows.repartition(F.col("a")).sortWithinPartitions("a", "k1", "k2", "start")
        .mapInArrow(_repeats, "k1 long, k2 long, start long, n int"))
    return marks.groupBy("k1", "k2").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), "n")).alias("spans"))


def _hits(rows: DataFrame, before: DataFrame | None, short: int, long: int, hot: int) -> DataFrame:
    """(kk, hits, hot): the short windows of each document that repeat, as 64-bit values."""
    source = rows if before is None else rows.join(before.select("kk"), "kk", "left_semi")
    found = source.select("kk", "text").mapInArrow(_anchor_rows(short, long), "a long, kk long")
    counts = found.groupBy("a").agg(F.count("*").alias("c")).where("c > 1")
    return _packed_hits(found.join(counts, "a"), hot)


def _packed_hits(found: DataFrame, hot: int) -> DataFrame:
    lists = found.groupBy("kk").agg(
        F.collect_list("a").alias("hits"), F.collect_list(F.when(F.col("c") > hot, F.col("a"))).alias("hot"))

    def run(batches):
        for batch in batches:
            columns = [batch.column(0)]
            for c in (1, 2):
                lists = batch.column(c)
                values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                columns.append(packed(values, ends[:-1], 8))
            yield pa.RecordBatch.from_arrays(columns, names=["kk", "hits", "hot"])

    return lists.mapInArrow(run, "kk long, hits binary, hot binary")


def _cut(length: int, whole: bool):
    """Kept words of each text, joined by one space; ``whole``: texts that lose nothing stay as they are."""

    def run(batches):
        for batch, data, offsets in unsqueezed(batches, SLICE):
            starts, ends, bounds = word_bounds(data, offsets)
            gone = np.zeros(len(starts) + 1, np.int64)
            spans = batch.column(batch.schema.get_field_index("spans"))
            flat = spans.flatten()
            doc = np.repeat(np.arange(batch.num_rows), np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
            if len(flat):
                begin = bounds[doc] + flat.field(0).to_numpy(zero_copy_only=False)
                np.add.at(gone, begin, 1)
                np.add.at(gone, begin + flat.field(1).to_numpy(zero_copy_only=False) + length - 1, -1)
            keep = np.cumsum(gone[:-1]) == 0
            n_words = np.diff(bounds)
            kept_before = np.concatenate([[0], np.cumsum(keep)])[bounds]
            # The bytes of kept words and one blank after each; the blank after a text's last one goes.
            s, e = starts[keep], ends[keep]
            sizes = e - s + 1
            to = np.cumsum(sizes)
            out = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
            ink = np.zeros(len(data) + 1, np.int64)
            np.add.at(ink, s, 1)
            np.add.at(ink, e, -1)
            body = np.ones(len(out), bool)
            body[to - 1] = False
            out[body] = data[np.cumsum(ink[:-1]) > 0]
            edges = np.concatenate([[0], to])[kept_before]
            view = memoryview(out)
            texts = [bytes(view[a : max(a, b - 1)]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            removed = n_words - np.diff(kept_before)
            if whole:
                for i in np.flatnonzero(removed == 0).tolist():
                    texts[i] = data[offsets[i] : offsets[i + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(n_words.astype(np.int64)), pa.array(removed.astype(np.int64)),
                pa.array(texts, pa.binary()).cast(pa.string()), batch.column(batch.schema.get_field_index("rest"))],
                names=["k1", "k2", "n_words", "n_removed", "kept", "rest"])

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, first: int = 10, hot: int = 1_000,
    carry: list[str] | None = None, whole: bool = False,
) -> DataFrame:
    """(k1, k2, n_words, n_removed, kept, rest): one row per row of ``docs``.

    ``kept``: the kept words joined by one space, or the text as it is if ``whole`` and nothing
    goes.  ``rest``: a struct of the columns ``carry``.
    """
    spans = repeated_windows(docs, id_col, text_col, length, first, hot)
    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    rows = squeeze(keyed(docs, id_col, text_col, rest.alias("rest")))
    kind = rows.schema["rest"].dataType.simpleString()
    return rows.join(spans, ["k1", "k2"], "left").select("k1", "k2", "z", "spans", "rest").mapInArrow(
        _cut(length, whole), f"k1 long, k2 long, n_words long, n_removed long, kept string, rest {kind}")


def substring_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    return remove_repeats(docs).select(
        plain_id(), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
