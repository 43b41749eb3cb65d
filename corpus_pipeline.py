"""From documents to packed training sequences.

Each stage works on all rows the one before it kept: texts the classifier rejects go, then
exact copies, then near copies but one of each group, then words of passages that occur
before, and what is left is packed.  All but the last return the columns of ``documents``.

Cases: null ids and texts pass through (a null text is compared and packed as an empty one);
rows that repeat an id with another text are documents of their own, rows that agree in both
are copies, of which the first by its other columns stays; other columns are carried along,
``n_chars`` is counted anew where words go; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from votespan.llm.common import keyed, plain_id, stash
from votespan.llm.exact import keep_best
from votespan.llm.jaccard import jaccard_links
from votespan.llm.packing import pack, token_pieces
from votespan.llm.quality import fit, good, graded, rate
from votespan.llm.substring import remove_repeats

ROOM = 2048


def _rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (k1, k2) are in ``kept``, one for each: the first by its other columns."""
    rows = keyed(docs, "doc_id", "text", F.struct(*docs.columns).alias("row")).drop("text")
    # Null texts come after empty ones; then the other columns decide, written out so that any type can.
    others = F.to_json(F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != "text"]), {"ignoreNullFields": "false"})
    once = Window.partitionBy("k1", "k2").orderBy(F.col("row.text").isNull(), others)
    return rows.join(kept, ["k1", "k2"]).withColumn("nth", F.row_number().over(once)).where("nth = 1").select("row.*")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier finds good."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), graded(), 3)
    into = "_tails"
    while into in docs.columns:
        into += "_"
    return rate(docs, model, into=into).where(good(into)).drop(into)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks, the longest row stays."""
    best = keep_best(docs).where("kept").select(
        F.coalesce("id", F.lit(-(2**63))).alias("k1"), "k2").distinct()
    return _rows_of(docs, best)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest id stays."""
    links = stash(jaccard_links(docs), "pipeline-links")
    first = links.where("label is not null").groupBy("label").agg(F.min(F.struct("k1", "k2")).alias("f")).select("f.*")
    alone = links.where("label is null").select("k1", "k2").distinct()
    return _rows_of(docs, first.unionByName(alone))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of twenty words or more that occur before go; untouched rows stay as they are, null texts too."""
    there = "_there"
    while there in docs.columns:
        there += "_"
    cut = remove_repeats(docs.withColumn(there, F.col("text").isNotNull()), carry=[c for c in docs.columns if c != "text"] + [there], whole=True)
    of = {c: F.col(f"rest.`{c}`") for c in docs.columns}
    of["text"] = F.when(F.col(f"rest.{there}"), F.col("kept"))
    if "n_chars" in docs.columns:
        of["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(of["n_chars"])
    return cut.select(*[v.alias(c) for c, v in of.items()])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, most=ROOM)
    return pack(pieces, ROOM).select(
        plain_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", drop_poor),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("best-fit packing", pack_sequences),
]
#: The classifier, the near copies and the packing are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
