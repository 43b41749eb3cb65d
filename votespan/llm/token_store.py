"""A store of token ids: one zstandard frame a document, with a shared dictionary.

Documents lie in ascending order in parts, the parts in blocks of about a megabyte.  A row of
the ``blocks`` table is one block: the frames on end (``payload``), the hash of the dictionary
they need, and the offset index (documents, where their frames begin, how many ids they have,
ids of the part before the block).  Parquet keeps the smallest and largest document of each row
group, so a single document is found without reading the others.  The tables ``dictionary``
(one row) and ``parts`` (first id number of each part) lie beside it.  Everything is written by
Spark's own writers: a lost executor leaves no half-written file behind.

The dictionary is trained on the serialised ids of a bounded sample (``sample`` documents by
hash of the id, at most ``sample_bytes`` of each).  Only the size of the files depends on it.

Cases: null text is empty and has only the end id; null ids come first; rows that repeat an id
come in the order of their texts' hashes, and rows that agree in both one after the other in
no stated order (they hold the same ids); other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from votespan.llm.common import keyed, shuffle_partitions, slices, stash
from votespan.llm.tokens import encoder, id_width, read_vocabulary

SLICE = 2 << 20
BLOCK = 1 << 20
BLOCKS = (
    "part int, block int, dictionary_hash string, first_k1 long, last_k1 long, k1 array<long>, k2 array<long>, "
    "offsets array<int>, counts array<int>, before long, payload binary")


def _serialised(vocabulary, end_id: int | None, most: int | None = None):
    """(k1, k2, text) to (k1, k2, ids): little-endian ids, two or four bytes each."""

    def run(batches):
        code = encoder(vocabulary.value)
        tail = b"" if end_id is None else np.array([end_id], code.width).tobytes()
        for batch in slices(batches, "text", SLICE, ("encoders",)):
            ids = [x + tail for x in code.encode(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[:most] for x in ids], pa.binary())], names=["k1", "k2", "ids"])

    return run


def _coder(dictionary: bytes, trained: bool, level: int | None):
    import zstandard

    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    shared = zstandard.ZstdCompressionDict(dictionary, dict_type=kind) if dictionary else None
    if level is None:
        return zstandard.ZstdDecompressor(dict_data=shared)
    return zstandard.ZstdCompressor(level=level, dict_data=shared)


def train_dictionary(samples: list[bytes], size: int) -> tuple[bytes, bool]:
    """(dictionary, whether it is a trained one): too few samples serve as they are."""
    import zstandard

    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(samples)[:size], False


def _frames(vocabulary, end_id, dictionary: bytes, trained: bool, level: int):
    serialise = _serialised(vocabulary, end_id)

    def run(batches):
        coder = _coder(dictionary, trained, level)
        width = np.dtype(encoder(vocabulary.value).width).itemsize
        for batch in serialise(batches):
            ids = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(x) // width for x in ids], pa.int32()),
                pa.array([coder.compress(x) for x in ids], pa.binary())], names=["k1", "k2", "n", "frame"])

    return run


def _blocks(dictionary_hash: str, most: int):
    def run(batches):
        part, block, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def row():
            k1, k2, counts, frames = zip(*held)
            starts = np.cumsum([0, *map(len, frames)])[:-1].tolist()
            return pa.RecordBatch.from_pylist([{
                "part": part, "block": block, "dictionary_hash": dictionary_hash, "first_k1": k1[0], "last_k1": k1[-1],
                "k1": list(k1), "k2": list(k2), "offsets": starts, "counts": list(counts), "before": before,
                "payload": b"".join(frames)}], pa.schema([
                    ("part", pa.int32()), ("block", pa.int32()), ("dictionary_hash", pa.string()), ("first_k1", pa.int64()),
                    ("last_k1", pa.int64()), ("k1", pa.list_(pa.int64())), ("k2", pa.list_(pa.int64())),
                    ("offsets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("before", pa.int64()),
                    ("payload", pa.binary())]))

        for batch in batches:
            for one in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and size + len(one[3]) > most:
                    yield row()
                    before += sum(x[2] for x in held)
                    held, size, block = [], 0, block + 1
                held.append(one)
                size += len(one[3])
        if held:
            yield row()

    return run


def write_store(
    docs: DataFrame, path: str, vocabulary_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text",
    sample: int = 1000, sample_bytes: int = 8192, dictionary_size: int = 64 << 10, level: int = 3,
) -> None:
    """Writes the ids of every text in ascending document order."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    rows = keyed(docs, id_col, text_col)
    share = min(1.0, sample / max(1, docs.count()))
    chosen = rows.where(F.pmod(F.xxhash64(F.col("k1"), F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30)))
    samples = chosen.mapInArrow(
        _serialised(vocabulary, end_id, sample_bytes), "k1 long, k2 long, ids binary").select("ids").collect()
    dictionary, trained = train_dictionary(sorted(bytes(r["ids"]) for r in samples)[: 2 * sample], dictionary_size)
    name = hashlib.sha256(dictionary).hexdigest()
    width = id_width(_vocabulary_size(vocabulary.value))
    spark.createDataFrame(
        [(name, bytearray(dictionary), trained, width)], "hash string, dictionary binary, trained boolean, width string",
    ).coalesce(1).write.parquet(f"{path}/dictionary")

    frames = stash(rows.mapInArrow(
        _frames(vocabulary, end_id, dictionary, trained, level), "k1 long, k2 long, n int, frame binary"), "token-frames")
    ordered = frames.repartitionByRange(shuffle_partitions(spark), "k1", "k2").sortWithinPartitions("k1", "k2")
    ordered.mapInArrow(_blocks(name, BLOCK), BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    totals = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # One row for each part: as many as there are shuffle partitions.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")).coalesce(1).write.parquet(f"{path}/parts")


def _vocabulary_size(vocabulary: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(vocabulary).get_vocab_size()


def _dictionary(spark: SparkSession, path: str):
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row["dictionary"]).hexdigest() != row["hash"]:
        raise ValueError("the dictionary is not the one that was written")
    return row["hash"], bytes(row["dictionary"]), row["trained"], row["width"]


def _open(expected: str, dictionary: bytes, trained: bool, width: str, wanted: list[int] | None):
    def run(batches):
        coder = _coder(dictionary, trained, None)
        chosen = None if wanted is None else set(wanted)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_hash"] != expected:
                    raise ValueError("a block needs another dictionary")
                counts = np.array(row["counts"], np.int64)
                starts = row["first"] + row["before"] + np.cumsum(counts) - counts
                ends = [*row["offsets"][1:], len(row["payload"])]
                frames = memoryview(row["payload"])
                take = [i for i, k in enumerate(row["k1"]) if chosen is None or k in chosen]
                ids = []
                for i in take:
                    raw = coder.decompress(frames[row["offsets"][i] : ends[i]])
                    ids.append(np.frombuffer(raw, width).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["k1"][i] for i in take], pa.int64()), pa.array([row["k2"][i] for i in take], pa.int64()),
                    pa.array(starts[take], pa.int64()), pa.array(counts[take], pa.int64()), pa.array(ids, pa.binary())],
                    names=["k1", "k2", "start", "n_tokens", "ids"])

    return run


def read_store(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """(k1, k2, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers.

    ``wanted``: only these documents; only the row groups that may hold them are read, and of
    a block only their frames are opened.
    """
    known = _dictionary(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    if wanted is not None:
        either = F.lit(False)
        for k in wanted:
            either = either | ((F.col("first_k1") <= k) & (F.col("last_k1") >= k))
        blocks = blocks.where(either)
    return blocks.join(spark.read.parquet(f"{path}/parts"), "part").mapInArrow(
        _open(*known, wanted), "k1 long, k2 long, start long, n_tokens long, ids binary")
