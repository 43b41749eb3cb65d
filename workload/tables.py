"""Stand-ins for the corpora and predictions, derived from the given tables.

Each comes twice: as a DataFrame and as the body of a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from votespan.functions.arrays import bind
from votespan.functions.text import split_words
from votespan.sources.keyed_json import ANNOTATED
from workload.registry import table

FLAGS = ["A", "N", "R"]
FLAG_TARGETS = ["A", "N", "R", "F", "O"]
CATEGORIES = {
    "target": [f"Group{c}" for c in "ABCDEFGHIJK"],
    "label": ["harmful", "rude", "plain"],
}
TARGETS = [t.lower() for t in CATEGORIES["target"]]
LABELS = CATEGORIES["label"]


def votes(spark: SparkSession, sf: str) -> DataFrame:
    """One order is a post, one of its lines an annotator's vote."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("post_id"), F.col("l_linenumber").alias("annotator_id"),
        F.col("l_returnflag").alias("label"), F.array("l_returnflag", "l_linestatus").alias("targets"))


VOTES = """votes as (select l_orderkey as post_id, l_linenumber as annotator_id, l_returnflag as label,
  [l_returnflag, l_linestatus] as targets from lineitem)"""


#: Rows and characters of text a task gets, at most about.
TASK_ROWS, TASK_CHARS = 20_000, 8 << 20


def document_parts(spark: SparkSession, sf: str) -> int:
    """How many parts ``documents`` come in."""
    n, chars = table(spark, sf, "documents").agg(F.count(F.lit(1)), F.coalesce(F.sum("n_chars"), F.lit(0))).first()
    return max(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS), -(-chars // TASK_CHARS))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text), dealt out to the cores, in more parts the longer the texts are in all.

    The given file is a single row group and so a single task; a table of many files needs
    no such step, and no operator takes it.  Words, marks and spans are many times their text, so
    what a task holds must not grow with the table.
    """
    return table(spark, sf, "documents").select("doc_id", "text").repartition(document_parts(spark, sf), "doc_id")


def word_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as word lists."""
    return documents(spark, sf).select("doc_id", "text", split_words(F.col("text")).alias("words"))


WORDS = r"""docs as (select doc_id, text, list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> '') as words
  from documents)"""


def _digit(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 1)


def mark(doc: Column, a: Column, pos: Column, word: Column) -> Column:
    """Annotator a's 0/1 mark of a word, from cheap arithmetic both engines share."""
    return mark_by_length(doc, a, pos, F.length(word))


def mark_by_length(doc: Column, a: Column, pos: Column, length: Column) -> Column:
    return _flag(doc * 7919 + a * 104729 + pos * 7 + length * 31)


def _flag(mixed: Column) -> Column:
    return F.when(mixed % 16 < 3, F.lit(1)).otherwise(F.lit(0))


def marks_of(doc: Column, annotators: Column, words: Column) -> Column:
    """``mark`` of every word for each annotator; the word's share of the sum is computed once for all."""
    places = F.transform(words, lambda w, p: p * 7 + F.length(w) * 31)
    return bind(places, lambda each: F.transform(annotators, lambda a: bind(
        doc * 7919 + a * 104729, lambda own: F.transform(each, lambda x: _flag(own + x)))))


def rationales(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, annotator, flags): three annotators mark words of every document."""
    return word_lists(spark, sf).select(
        "doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("annotator"), "words").select(
        "doc_id", "annotator",
        F.transform("words", lambda w, p: mark(F.col("doc_id"), F.col("annotator"), p, w)).alias("flags"))


MARKS = WORDS + """, marks as (
  select doc_id, cast(a as int) as annotator, cast(i - 1 as int) as pos,
    case when (doc_id * 7919 + a * 104729 + (i - 1) * 7 + len(w) * 31) % 16 < 3 then 1 else 0 end as flag
  from (select doc_id, unnest(words) as w, unnest(range(1, len(words) + 1)) as i from docs), range(0, 3) x(a))"""


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as annotated posts in the nested input format."""
    doc, a = F.col("doc_id"), F.sequence(F.lit(0), F.lit(2))

    def annotator(i: Column) -> Column:
        d = _digit(doc, F.lit("L"), i)
        label = F.when(d < "5", LABELS[0]).when(d < "a", LABELS[1]).otherwise(LABELS[2])
        named = F.filter(F.array(*[F.lit(c) for c in CATEGORIES["target"]]), lambda c: _digit(doc, i, c) < "3")
        return F.struct(label.alias("label"), i.alias("annotator_id"), named.alias("target"))

    return word_lists(spark, sf).select(
        doc.cast("string").alias("post_id"),
        F.transform(a, annotator).alias("annotators"),
        marks_of(doc, a, F.col("words")).alias("rationales"),
        F.col("words").alias("post_tokens")).to(ANNOTATED)


#: ``marked`` (doc_id, entries): the words somebody marked, with their value.
ENTRIES_SQL = """marked as (select doc_id, string_agg(pos || ':1.0', ',' order by pos) as entries
  from (select distinct doc_id, pos from marks where flag <> 0) group by 1)"""


def entries_of(col: str) -> Column:
    """Every entry of a map in key order, as text."""
    pairs = F.transform(F.sort_array(F.map_entries(col)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return F.array_join(pairs, ",")


_cats = "[" + ", ".join(f"'{c}'" for c in CATEGORIES["target"]) + "]"
POST_VOTES = f"""post_votes as (
  select doc_id, cast(a as int) as annotator_id,
    case when substr(md5(concat(doc_id, ':L:', a)), 1, 1) < '5' then '{LABELS[0]}'
         when substr(md5(concat(doc_id, ':L:', a)), 1, 1) < 'a' then '{LABELS[1]}' else '{LABELS[2]}' end as label,
    list_filter({_cats}, lambda c: substr(md5(concat(doc_id, ':', a, ':', c)), 1, 1) < '3') as targets
  from documents, range(0, 3) x(a))"""


def split_of(key: Column) -> Column:
    digits = F.substring(F.md5(key.cast("string")), 1, 4)
    return F.when(digits < "cccd", "train").when(digits < "e666", "valid").otherwise("test")


def split_sql(key: str) -> str:
    digits = f"substr(md5(cast({key} as varchar)), 1, 4)"
    return f"case when {digits} < 'cccd' then 'train' when {digits} < 'e666' then 'valid' else 'test' end"


def _at(i) -> Column:
    return F.get("embedding", i).cast("double")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Eleven logits, truths and token masks per embedding, in long form."""
    k = F.col("item")
    return table(spark, sf, "embeddings").select(
        "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("item")).select(
        "vec_id", "item", _at(k).alias("logit"),
        F.when(_at(k + 11) > F.lit(0.05), 1.0).otherwise(0.0).alias("truth"),
        (_at(k + 22) > F.lit(-0.1)).alias("mask"),
        split_of(F.col("vec_id")).alias("split"))


PRED = f"""pred as (select vec_id, cast(k - 1 as int) as item, embedding[k]::double as logit,
    case when embedding[k + 11]::double > 0.05::double then 1.0::double else 0.0::double end as truth,
    embedding[k + 22]::double > (-0.1)::double as mask, {split_sql('vec_id')} as split
  from embeddings, range(1, 12) r(k))"""

CELLS = PRED + """, cells as (select item,
    count(*) filter (where truth <= 0.5 and logit <= 0) as neg_neg, count(*) filter (where truth <= 0.5 and logit > 0) as neg_pos,
    count(*) filter (where truth > 0.5 and logit <= 0) as pos_neg, count(*) filter (where truth > 0.5 and logit > 0) as pos_pos
  from pred group by item)"""

SPLIT_CELLS = CELLS.replace("(select item,", "(select split, item,").replace("group by item", "group by split, item")

F1_SQL = "coalesce(2.0::double * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0)"


def f1_sql(tp: str = "pos_pos", fp: str = "neg_pos", fn: str = "pos_neg") -> str:
    return F1_SQL.format(tp=tp, fp=fp, fn=fn)


def class_predictions(spark: SparkSession, sf: str) -> DataFrame:
    scores = F.slice("embedding", 1, 10)
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").alias("truth"),
        (F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("pred"),
        split_of(F.col("vec_id")).alias("split"))


CLASSES = f"""classes as (select vec_id, label as truth,
    cast(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 as int) as pred, {split_sql('vec_id')} as split
  from embeddings)"""


def score_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", _at(22).alias("pred"), _at(23).alias("truth"), split_of(F.col("vec_id")).alias("split"))


SCORES = f"""scores as (select vec_id, embedding[23]::double as pred, embedding[24]::double as truth,
    {split_sql('vec_id')} as split from embeddings)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as training-run records."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("experiment"),
        F.col("user_id").alias("owner"), F.col("ts").alias("start_time"))


def doc_sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.col("lang").alias("source"), "n_chars")


def hash_sql(seed, *cols: str) -> str:
    return "md5(concat_ws(':', " + ", ".join([f"'{seed}'", *[f"cast({c} as varchar)" for c in cols]]) + "))"
