"""What several operators share: row keys, shared-folder tables, text as numpy arrays.

Row keys.  A row is known by ``k1`` (its id; null becomes the smallest long) and ``k2`` (a
hash of its text), so rows that repeat an id are told apart by their texts, and rows that
agree in both are one document that is listed several times: each listing gets the same
result.  Order among documents is (k1, k2).
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from votespan.sources.scratch import scratch_path

NULL_ID = -(2**63)


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(k1, k2, text, ...): null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("k1"), F.xxhash64(text).alias("k2"),
        text.alias("text"), *more)


def plain_id(name: str = "doc_id") -> Column:
    """``k1`` as the id it stands for."""
    return F.when(F.col("k1") != NULL_ID, F.col("k1")).alias(name)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and rereads it: cuts the lineage, survives executors.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a stashed table that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, whatever tasks it runs."""
    home = sys.modules.setdefault("_votespan_worker", types.ModuleType("_votespan_worker"))
    return home.__dict__.setdefault("cache", {})


#: What an operator keeps in a worker and others have no use for.
LARGE = ("encoders", "coder", "ranks_of", "token_bytes", "bytes_of")


def begin(*keep: str) -> None:
    """Drops what another operator left in this worker."""
    kept = worker_cache()
    for name in LARGE:
        if name not in keep:
            kept.pop(name, None)


def finish() -> None:
    """Gives free memory back: idle workers stay, and executors have a limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def slices(batches: Iterator[pa.RecordBatch], text_col: str, most: int, keep: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``most`` bytes of text, or of one row."""
    begin(*keep)
    try:
        yield from _cut(batches, text_col, most)
    finally:
        finish()


def _cut(batches, text_col, most):
    for batch in batches:
        at = batch.schema.get_field_index(text_col)
        if batch.num_rows == 0:
            continue
        sizes = np.diff(text_offsets(batch.column(at)))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    raw = np.frombuffer(texts.buffers()[1], kind)
    return raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts on end, offsets of the texts)."""
    offsets = text_offsets(texts)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Blanks are the bytes 0x20 and 0x09 to 0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

_STEP = 0x9E3779B97F4A7C15
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    h = h + np.uint64((salt * _STEP) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to n, kept by the worker."""
    kept = worker_cache().setdefault("powers", {})
    if base not in kept or len(kept[base][0]) < n + 1:
        size = max(n + 1, 1 << 16)
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, np.uint64(b), np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        kept[base] = tuple(tables)
    return kept[base][0][: n + 1], kept[base][1][: n + 1]


#: Longest range for the polynomial below: of two letters alone, strings of 1,024 can be built that agree under every base.
SHORT_RANGE = 64


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A polynomial hash (modulo 2^64, then mixed) of values[start:end] for every range, of ``SHORT_RANGE`` values at most."""
    up, down = powers(base, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def byte_values() -> np.ndarray:
    kept = worker_cache()
    if "bytes" not in kept:
        kept["bytes"] = mix(np.arange(1, 257, dtype=np.uint64), 7)
    return kept["bytes"]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of all runs of non-blanks, and where each text's words begin among them."""
    ink = ~BLANK[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[edges] = ink[edges]
    last[edges - 1] = ink[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each range of bytes: all short ones together, long ones by xxh3."""
    found = ranges_hash(byte_values()[data], starts, ends, BASES[0])
    long = np.flatnonzero(ends - starts > SHORT_RANGE)
    if len(long):
        import xxhash

        view = memoryview(np.ascontiguousarray(data))
        found[long] = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return found


def window_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hashes of all windows of ``size`` values, across text borders too."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return ranges_hash(mix(words, salt) if salt else words, starts, starts + size, BASES[1])


def inside(bounds: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the n window starts lie in one text with all their words."""
    ok = np.ones(max(n, 0), bool)
    for back in range(1, size):
        at = bounds[1:-1] - back
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def text_of_rows(bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The text each row of words belongs to."""
    return np.searchsorted(bounds, rows, "right") - 1


def packed(values: np.ndarray, starts: np.ndarray, width: int) -> pa.Array:
    """Binary array over consecutive stretches of ``values`` that begin at ``starts``."""
    ends = np.append(starts, len(values)) * width
    if ends[-1] >= 2**31:
        raise ValueError("a batch is over 2 GB")
    return pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def squeeze(df: DataFrame, level: int = 1, most: int = 4 << 20) -> DataFrame:
    """Replaces ``text`` by ``z``, each text as a zstandard frame: a third of the bytes to shuffle."""
    rest = [c for c in df.columns if c != "text"]
    out = df.select(*rest, F.lit(b"").alias("z")).schema

    def run(batches):
        import zstandard

        coder = zstandard.ZstdCompressor(level=level)
        for batch in slices(batches, "text", most):
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
            view = memoryview(data)
            frames = [coder.compress(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(frames, pa.binary())], names=[*rest, "z"])

    return df.select(*rest, "text").mapInArrow(run, out)


def unsqueezed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts on end, offsets) of at most ``most`` bytes of text, or one row."""
    import zstandard

    begin()
    coder = zstandard.ZstdDecompressor()
    try:
        for batch in batches:
            texts, size, start = [], 0, 0
            for i, frame in enumerate(batch.column(batch.schema.get_field_index("z"))):
                text = coder.decompress(frame.as_buffer())
                if texts and size + len(text) > most:
                    yield batch.slice(start, i - start), *_joined(texts)
                    texts, size, start = [], 0, i
                texts.append(text)
                size += len(text)
            if texts:
                yield batch.slice(start), *_joined(texts)
    finally:
        finish()


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
