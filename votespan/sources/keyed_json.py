"""JSON files that hold one object keyed by id."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

# Executors need no copy of what runs in their Python workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Raw annotated posts: fixed field names and types of the input format.
ANNOTATED = T.StructType([
    T.StructField("post_id", T.StringType()),
    T.StructField("annotators", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()),
        T.StructField("annotator_id", T.IntegerType()),
        T.StructField("target", T.ArrayType(T.StringType())),
    ]))),
    T.StructField("rationales", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("post_tokens", T.ArrayType(T.StringType())),
])


def read_keyed_json(spark: SparkSession, path: str, value_schema: T.StructType = ANNOTATED, first_member: str | None = None) -> DataFrame:
    """The values of the keyed object(s) as rows of a fixed schema.

    Files of any size are cut and parsed in parallel (see ``keyed_entries``); a file may hold
    several objects one after another.  Broken text fails the read.

    If every value starts with the same member, naming it as ``first_member`` saves the scan
    for brackets: Spark then cuts the files at its occurrences.  (A quoted member name cannot
    occur inside a JSON string, where quotes are escaped.)  A piece that does not stop at the
    opening brace of the next value, or at the end, fails the read: some value starts with
    another member then.
    """
    if first_member is None:
        entries = F.from_json("entry", T.MapType(T.StringType(), value_schema), {"mode": "FAILFAST"})
        return keyed_entries(spark, path).select(F.explode(F.map_values(entries)).alias("v")).select("v.*")
    name = f'"{first_member}"'
    pieces = spark.read.option("lineSep", name).text(path)
    whole = F.col("value").rlike(r"\{\s*$|\}\s*\}\s*$|^\s*(\{\s*\})?\s*$")
    checked = F.when(whole, F.col("value")).otherwise(F.raise_error(F.lit(f"a value does not start with {name}")))
    pieces = pieces.select(checked.alias("value")).filter(F.col("value").rlike(r"^\s*:"))
    # The parser stops at the end of the first object, so what follows it may stay.
    value = F.from_json(F.concat(F.lit("{" + name), F.col("value")), value_schema, {"mode": "FAILFAST"})
    return pieces.select(value.alias("v")).select("v.*")


#: Bytes of text in one range.
RANGE = 1 << 20
RANGES = "file string, at long, nth int, quotes long, plain long, quoted long, text binary"


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of brackets and of quotes that open or close a string, those that are quotes)."""
    places = np.flatnonzero(SIGNS[data])
    quote = data[places] == ord('"')
    slashed = places[quote & (places > 0)]
    slashed = slashed[data[slashed - 1] == ord("\\")]
    if len(slashed):
        # A quote after an odd number of backslashes is part of its string.
        slashes = np.flatnonzero(data == ord("\\"))
        first = np.ones(len(slashes), bool)
        first[1:] = np.diff(slashes) > 1
        begin = np.maximum.accumulate(np.where(first, slashes, 0))
        run = slashed - begin[np.searchsorted(slashes, slashed - 1)]
        kept = ~np.isin(places, slashed[run % 2 == 1])
        places, quote = places[kept], quote[kept]
    return places, quote


SIGNS = np.zeros(256, bool)
SIGNS[list(b'{}[]"')] = True
STEP = np.zeros(256, np.int64)
STEP[list(b"{[")], STEP[list(b"}]")] = 1, -1


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces between closing braces, as they follow one another, to ranges of about a megabyte.

    A range tells how many quotes its part of the file has before it, and how far those change
    the depth if the part begins outside of a string (``plain``) or inside one (``quoted``).  A
    last row without text tells the same of the whole part.
    """
    names = [f.split()[0] for f in RANGES.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def row(key, nth, state, text):
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, nth, *state, text), kinds)], names=names)

    def ended(key, nth, state, pieces):
        text = b"}".join(pieces) + b"}"
        data = np.frombuffer(text, np.uint8)
        places, quote = marks(data)
        inside = (np.cumsum(quote) + state[0]) % 2 == 1
        step = STEP[data[places]]
        after = state[0] + int(quote.sum()), state[1] + int(step[~inside].sum()), state[2] + int(step[inside].sum())
        return row(key, nth, state, text), after

    key, nth, held, size, state = None, 0, [], 0, (0, 0, 0)
    for batch in batches:
        for file, at, piece in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if held and ((file, at) != key or size >= RANGE):
                out, state = ended(key, nth, state, held)
                yield out
                nth, held, size = nth + 1, [], 0
            if (file, at) != key:
                if key is not None:
                    yield row(key, nth, state, None)
                key, nth, state = (file, at), 0, (0, 0, 0)
            held.append(piece.encode())
            size += len(held[-1]) + 1
    if held:
        out, state = ended(key, nth, state, held)
        yield out
        yield row(key, nth + 1, state, None)


def part_states(parts: DataFrame) -> DataFrame:
    """(file, at, inside, depth): the state at the start of every part of a file, one row a part.

    Quotes before a part say whether it begins in a string, and that says which of its two
    changes of depth counts; both are sums over the parts before it.
    """
    def with_sum(rows: DataFrame, column: str) -> DataFrame:
        every = Window.partitionBy("file")
        before = F.sum(column).over(every.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumns({f"{column}_before": F.coalesce(before, F.lit(0)), f"{column}_all": F.sum(column).over(every)})

    rows = with_sum(parts, "quotes").withColumn("inside", F.col("quotes_before") % 2 == 1)
    rows = with_sum(rows.withColumn("change", F.when(F.col("inside"), F.col("quoted")).otherwise(F.col("plain"))), "change")
    # Blank text after the last brace looks like one brace more.
    whole = (F.col("quotes_all") % 2 == 0) & F.col("change_all").isin(0, -1)
    checked = F.when(whole, F.col("change_before")).otherwise(
        F.raise_error(F.concat(F.lit("brackets or quotes do not match in "), F.col("file"))))
    return rows.select("file", "at", "inside", checked.alias("depth"))


ENTRIES = "file string, at long, nth int, kind int, text string"
WHOLE, HEAD, MIDDLE, TAIL = range(4)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges with the state at their start to the entries in them and the pieces at their ends.

    An entry ends where a brace brings the depth back to one, or to none: the end of its object.
    """
    for batch in batches:
        for row in batch.to_pylist():
            text = row["text"]
            data = np.frombuffer(text, np.uint8)
            places, quote = marks(data)
            outside = (np.cumsum(quote) + row["inside"]) % 2 == 0
            depth = row["depth"] + np.cumsum(np.where(outside, STEP[data[places]], 0))
            ends = places[outside & (data[places] == ord("}")) & (depth <= 1)] + 1
            edges = [0, *ends.tolist()]
            found = [(WHOLE if a else HEAD, text[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            found.append((TAIL if len(ends) else MIDDLE, text[edges[-1] :]))
            kinds, texts = zip(*found)
            n = len(found)
            yield pa.RecordBatch.from_arrays([
                pa.array([row["file"]] * n), pa.array([row["at"]] * n), pa.array([row["nth"]] * n, pa.int32()),
                pa.array(kinds, pa.int32()), pa.array([t.decode() for t in texts])], names=[f.split()[0] for f in ENTRIES.split(", ")])


def _joined(pieces: DataFrame) -> DataFrame:
    """Entries that go over the end of a range: a tail, what lies between, and a head.

    Pieces are numbered by the tails before them in their part of the file; what comes before
    a part's first tail belongs to the last part before it that has one.
    """
    part = Window.partitionBy("file", "at").orderBy("nth", "kind")
    numbered = pieces.withColumn("region", F.sum((F.col("kind") == TAIL).cast("int")).over(part))
    tails = numbered.groupBy("file", "at").agg(F.max("region").alias("tails"))
    earlier = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("tails") > 0, F.struct("at", "tails")), ignorenulls=True).over(earlier)
    linked = numbered.join(tails.select("file", "at", last.alias("open")), ["file", "at"])
    home = F.when(F.col("region") > 0, F.struct("at", F.col("region").alias("tails"))).otherwise(F.col("open"))
    return linked.groupBy("file", home.alias("home")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "nth", "kind", "text"))), lambda p: p["text"]), "").alias("text"))


def keyed_entries(spark: SparkSession, path: str) -> DataFrame:
    """(entry): the entries of keyed JSON objects, each as an object of its own.

    Spark cuts the files at closing braces, wherever they stand.  Whether such a brace ends an
    entry depends on the strings and brackets open there.  Each range of text is a function
    from the state before it to the state after it; they are composed within each part of a file,
    and sums over the parts compose those, so that every range then knows its state and finds its
    entries by itself.  Only the pieces at its
    two ends meet those of its neighbours.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    ranges = pieces.mapInArrow(_ranges, RANGES)
    states = part_states(ranges.where("text is null").select("file", "at", "quotes", "plain", "quoted"))
    # A part that begins in a string has its quotes the other way round.
    known = ranges.where("text is not null").join(states, ["file", "at"]).select(
        "file", "at", "nth", (F.col("inside") != (F.col("quotes") % 2 == 1)).alias("inside"),
        (F.col("depth") + F.when(F.col("inside"), F.col("quoted")).otherwise(F.col("plain"))).alias("depth"), "text")
    cut = known.mapInArrow(_entries, ENTRIES)
    texts = cut.where(F.col("kind") == WHOLE).select("text").unionByName(
        _joined(cut.where(F.col("kind") != WHOLE)).select("text"))
    # Without what stands in front of its key; the last brace closes the value, or ends the object.
    bare = F.regexp_replace("text", r"^[\s,]*\{?\s*", "")
    body = F.regexp_replace(bare, r"\s*\}\s*$", "")
    named = texts.select(bare.alias("bare"), body.alias("body")).where(F.col("body").startswith('"'))
    return named.select(F.concat(F.lit("{"), F.col("bare"), F.lit("}")).alias("entry"))


def json_to_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
