"""Counts of sentencepiece tokens; huge texts are encoded as overlapping chunks.

A text of more than ``chunk`` bytes is cut into chunks that reach ``overlap`` bytes past each
border, so that chunks of one text are encoded by different tasks.  At a border the two
encodings are spliced in front of a token that both hold at the same place.

Why that place is sound: merges are tried in the order of the merged piece alone, so a sequence
of pieces is the encoding of its text exactly if each two neighbours, encoded together, stay
these two pieces.  Neighbours before the shared token come from the left encoding, those from
it on from the right one, and the pair at the splice stands in the left encoding.

Where the overlap shares no token (long runs of one letter, say), the document is cut again
with four times the overlap, and longer chunks once the overlap fills them, until it aligns or
is one chunk.  Offsets are sums of piece lengths; where they do not add up to the text, because
a model rewrites it, nothing aligns and the document ends as one chunk too.

Cases: null text is empty and has no tokens; rows that repeat an id or agree in everything are
counted each by itself, though equal huge rows are encoded once a task; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from votespan.llm.common import keyed, longs, slices, stash, text_bytes, worker_cache

SLICE = 2 << 20
CHUNK, OVERLAP, WIDER = 1 << 15, 256, 4


class Pieces:
    """The library with the length of each piece in characters."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.library.get_piece_size()
        self.length, self.opens = np.ones(n, np.int64), np.ones(n, bool)
        for i in range(n):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                # The bytes of one character: the first one stands for it.
                self.opens[i] = int(piece[3:5], 16) & 0xC0 != 0x80
                self.length[i] = self.opens[i]
            elif not self.library.is_unknown(i):
                self.length[i] = len(piece)
        #: Characters the library puts in front of a text.
        self.extra = int(self.length[self.library.encode("a")].sum()) - 1

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


def pieces(model: bytes) -> Pieces:
    kept = worker_cache()
    if kept.get("pieces_of") != hash(model):
        kept["pieces"], kept["pieces_of"] = Pieces(model), hash(model)
    return kept["pieces"]


def _count(model):
    def run(batches):
        code = pieces(model.value)
        for batch in slices(batches, "text", SLICE):
            found = code.encode(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(list(map(len, found)), pa.int64())],
                names=["k1", "k2", "n_bytes", "n_tokens"])

    return run


def char_start(data: np.ndarray, at: int) -> int:
    """The last place up to ``at`` where a character begins."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def cuts(data: np.ndarray, chunk: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, border before, border after, end) of each chunk, in bytes."""
    borders = [char_start(data, at) for at in range(0, len(data), chunk)] + [len(data)]
    if len(borders) > 2 and borders[-1] - borders[-2] < 2 * overlap:
        del borders[-2]
    out = []
    for left, right in zip(borders[:-1], borders[1:]):
        start = char_start(data, max(0, left - overlap)) if left else 0
        end = char_start(data, min(len(data), right + overlap))
        out.append((start, left, right, end))
    return out


CHUNKS = "k1 long, k2 long, chunk int, of int, lead int, reach int, text string"


def _chunks(chunk: int, overlap: int):
    """Chunks with their borders: ``lead`` and ``reach`` count characters from the chunk's start."""

    def run(batches):
        seen = set()
        for batch in slices(batches, "text", SLICE):
            ids = list(zip(longs(batch, "k1").tolist(), longs(batch, "k2").tolist()))
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
            for key, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist()):
                if key in seen:
                    continue
                seen.add(key)
                own = data[a:b]
                parts = cuts(own, chunk, overlap)
                for i in range(0, len(parts), 64):
                    rows = []
                    for at, (start, left, right, end) in enumerate(parts[i : i + 64], i):
                        opens = (own[start:end] & 0xC0) != 0x80
                        rows.append((*key, at, len(parts), int(opens[: left - start].sum()), int(opens[: right - start].sum()),
                                     own[start:end].tobytes().decode()))
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in CHUNKS.split(", ")])

    return run


CODED = "k1 long, k2 long, chunk int, of int, n int, before array<long>, before_at array<int>, after array<long>, after_at array<int>"


def around(code: Pieces, ids: np.ndarray, chars: int, border: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens near a border: (place and id as one number, how many tokens come before each).

    Tokens at the chunk's own start are left out: what the library puts in front may be part
    of them.
    """
    ends = np.cumsum(code.length[ids]) - code.extra
    if len(ids) == 0 or ends[-1] != chars:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    starts = ends - code.length[ids]
    near = np.flatnonzero(code.opens[ids] & (starts > 0) & (np.abs(starts - border) <= overlap))
    return (starts[near] - border) * (1 << 32) + ids[near], near.astype(np.int32)


def _encode_chunks(model, overlap: int):
    def run(batches):
        code = pieces(model.value)
        last = None
        for batch in slices(batches, "text", SLICE):
            rows = []
            for row in batch.to_pylist():
                key = (row["k1"], row["k2"], row["chunk"])
                if key == last:
                    continue
                last, text = key, row["text"]
                ids = np.array(code.encode([text])[0], np.int64)
                nothing = np.zeros(0, np.int64), np.zeros(0, np.int32)
                before = around(code, ids, len(text), row["lead"], overlap) if row["chunk"] else nothing
                after = around(code, ids, len(text), row["reach"], overlap) if row["chunk"] + 1 < row["of"] else nothing
                rows.append((*key, row["of"], len(ids), *before, *after))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(),
                         pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in CODED.split(", ")])

    return run


def splice(coded: DataFrame) -> DataFrame:
    """(k1, k2, n_tokens): null where some border shares no token."""
    order = Window.partitionBy("k1", "k2").orderBy("chunk")
    index = lambda at, codes, code: F.get(at, F.array_position(codes, code).cast("int") - 1)
    pairs = coded.dropDuplicates(["k1", "k2", "chunk"]).select(
        "k1", "k2", "chunk", "of", "n", "after", "after_at",
        F.lead("before").over(order).alias("next"), F.lead("before_at").over(order).alias("next_at")
    ).withColumn("code", F.get(F.array_intersect("after", "next"), 0))
    # Tokens kept of this chunk end where those of the next begin.
    kept = F.when(F.col("chunk") + 1 == F.col("of"), F.col("n")).otherwise(
        index("after_at", F.col("after"), F.col("code")) - index("next_at", F.col("next"), F.col("code")))
    return pairs.groupBy("k1", "k2").agg(
        F.when(F.count(kept) == F.max("of"), F.sum(kept.cast("long"))).alias("n_tokens"))


def count_pieces(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """(k1, k2, n_bytes, n_tokens): one row for each row of ``docs``.

    ``chunk`` and ``overlap`` are in bytes; they change the work, not the counts.
    """
    if overlap < 4 or chunk < 4 * overlap:
        raise ValueError("a chunk must hold four overlaps, of four bytes at least")
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = keyed(docs, id_col, text_col)
    rows = rows.select("k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    out = "k1 long, k2 long, n_bytes long, n_tokens long"
    counted = rows.where(F.col("n_bytes") <= chunk).mapInArrow(_count(model), out)
    huge = rows.where(F.col("n_bytes") > chunk)

    done, todo, size, width = None, huge, chunk, overlap
    while True:
        coded = todo.select("k1", "k2", "text").mapInArrow(_chunks(size, width), CHUNKS).repartition(
            "k1", "k2", "chunk").sortWithinPartitions("k1", "k2", "chunk").mapInArrow(_encode_chunks(model, width), CODED)
        found = stash(splice(coded), "piece-counts")
        good = found.where("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        open_ = found.where("n_tokens is null").select("k1", "k2")
        if open_.isEmpty():
            break
        todo = huge.join(open_, ["k1", "k2"], "left_semi")
        width *= WIDER
        size = max(size, 4 * width)
    huge_rows = huge.select("k1", "k2", "n_bytes").join(done, ["k1", "k2"])
    return counted.unionByName(huge_rows.select("k1", "k2", "n_bytes", "n_tokens"))
