"""Runs, alignment of words and remapping of spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from votespan.functions.arrays import indices, map_to_pairs, runs_of_true, span
from votespan.functions.text import align_words, detokenize, remap_spans
from votespan.operators.joins import remap_span_rows
from votespan.operators.positions import offset_index, runs_table
from workload.registry import query, table
from workload.tables import MARKS, WORDS, document_parts, mark_by_length, word_lists
from workload.text import DETOKENIZED, spans_digest

RUNS_SQL = """flags as (select {key}, {pos} as pos, {flag} as flag from {rows}),
  islands as (select {key}, pos - row_number() over (partition by {key} order by pos) as island, pos from flags where flag)
  select {key}, cast(min(pos) as bigint) as "start", cast(max(pos) + 1 as bigint) as "end" from islands group by {key}, island"""


@query("w4_runs_of_true", f"with {WORDS}, tok as (select doc_id, unnest(words) as w, unnest(range(0, len(words))) as i from docs), "
       + RUNS_SQL.format(key="doc_id", pos="i", flag="len(w) > 4", rows="tok"))
def w4(spark, sf):
    runs = runs_of_true(F.transform("words", lambda w: F.length(w) > 4))
    return word_lists(spark, sf).select("doc_id", F.inline(runs)).select(
        "doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query("w4_runs_table", "with seq as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events), "
       + RUNS_SQL.format(key="user_id", pos="i", flag="value > 50", rows="seq"))
def w4_table(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    placed = offset_index(events, ["user_id"], F.date_trunc("minute", "ts"), [F.col("ts"), F.col("event_id")], "pos")
    return runs_table(placed.withColumn("flag", F.col("value") > 50), ["user_id"], "pos", "flag")


def walk_sql(docs: str, key: str = "doc_id") -> str:
    """CTEs from ``docs`` (key, words, text) to ``found`` (key, i, s, e): word by word from the left."""
    return f"""walk as (select {key}, 0 as i, 0 as cursor, -1 as s, -1 as e from {docs}
    union all select {key}, i + 1, case when p > 0 then cursor + p - 1 + n else cursor end,
      case when p > 0 then cursor + p - 1 else -1 end, case when p > 0 then cursor + p - 1 + n else -1 end from (
      select w.{key}, w.i, w.cursor, len(d.words[w.i + 1]) as n, strpos(substr(d.text, w.cursor + 1), d.words[w.i + 1]) as p
      from walk w join {docs} d using ({key}) where w.i < len(d.words))),
  found as (select {key}, i, s, e from walk where i > 0)"""


_SPANS = """select doc_id, cast(count(s) as int) as n, md5(coalesce(string_agg(cast(s as bigint) || '-' || cast(e as bigint), ',' order by i), '')) as spans"""


@query("w5_align_words", rf"""with parts as (
    select doc_id, list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> '') as words,
      string_split_regex(text, '[^ \t\n\r]+') as gaps from documents),
  tok as (select doc_id, unnest(words) as w, unnest(range(1, len(words) + 1)) as i, gaps from parts),
  placed as (select doc_id, i, len(w) as n, sum(len(w)) over (partition by doc_id order by i) - len(w)
    + sum(len(gaps[i])) over (partition by doc_id order by i) as s from tok),
  found as (select doc_id, i, s, s + n as e from placed)
  {_SPANS} from (select doc_id from documents) left join found using (doc_id) group by 1""")
def w5(spark, sf):
    """Words found back in the text they were cut from."""
    rows = word_lists(spark, sf).select("doc_id", align_words(F.col("words"), F.col("text")).alias("spans"))
    return rows.select("doc_id", F.size("spans").alias("n"), spans_digest(F.col("spans")).alias("spans"))


@query("w5_align_detokenized", f"""with recursive {WORDS}, joined as (select doc_id, words, {DETOKENIZED} as text from docs), {walk_sql('joined')}
  {_SPANS} from (select doc_id from documents) left join found using (doc_id) group by 1""")
def w5_detokenized(spark, sf):
    """Words found back in their de-tokenised text, where quotes and brackets have moved."""
    rows = word_lists(spark, sf).select("doc_id", align_words(F.col("words"), detokenize(F.col("words"))).alias("spans"))
    return rows.select("doc_id", F.size("spans").alias("n"), spans_digest(F.col("spans")).alias("spans"))


def _word_spans(spark, sf):
    """Words and their spans in the blank-joined text."""
    words = word_lists(spark, sf).select("doc_id", "words", F.array_join("words", " ").alias("joined"))
    return words.select("doc_id", "words", align_words(F.col("words"), F.col("joined")).alias("old"))


def _value(doc, pos, length):
    """A number for the word and, in thousands, how many annotators mark it."""
    return (pos % 97 + sum(mark_by_length(doc, F.lit(a), pos, length) for a in range(3)) * 1000).cast("double")


def _old_and_new(spark, sf):
    """Word spans with the number of annotators who mark a word in the values, and new spans that
    cut every word in pieces of four characters."""
    rows = _word_spans(spark, sf)
    pieces = F.flatten(F.transform("old", lambda s: F.transform(
        indices(F.ceil((s["end"] - s["start"]) / 4).cast("int")),
        lambda k: span(s["start"] + k * 4, F.least(s["start"] + k * 4 + 4, s["end"])))))
    marked = F.filter(
        F.transform("words", lambda w, i: F.struct(i.alias("key"), _value(F.col("doc_id"), i, F.length(w)).alias("value"))),
        lambda e: e["value"] >= 1000)
    return rows.select("doc_id", "old", pieces.alias("new"), F.map_from_entries(marked).alias("values"))


REMAP_SQL = f"""with {MARKS}, votes as (select doc_id, pos, sum(flag) as flag from marks group by 1, 2),
  tok as (select d.doc_id, m.pos, len(d.words[m.pos + 1]) as n, m.flag from docs d join votes m on d.doc_id = m.doc_id),
  pieces as (select doc_id, pos, flag, unnest(range(0, cast(ceil(n / 4.0) as bigint))) as k from tok),
  numbered as (select doc_id, flag, pos % 97 + 1000 * flag as value, row_number() over (partition by doc_id order by pos, k) - 1 as new_pos from pieces)
  select doc_id, cast(new_pos as int) as pos, value::double as value from numbered where flag > 0"""


@query("j4_remap_spans", REMAP_SQL)
def j4(spark, sf):
    rows = _old_and_new(spark, sf)
    moved = rows.select("doc_id", remap_spans(F.col("values"), F.col("old"), F.col("new")).alias("m"))
    return map_to_pairs(moved, "doc_id", "m").select("doc_id", F.col("k").alias("pos"), F.col("v").alias("value"))


@query("j4_remap_span_rows", REMAP_SQL)
def j4_rows(spark, sf):
    """Old and new spans as rows.

    Words and pieces become rows before anything is computed for them: inside a lambda Spark
    interprets an expression for every element, on rows it runs compiled.  Documents are dealt
    out again when they are aligned, a start and a length a word, and spans are joined where they
    are made.  Each part goes into two, by the hash it came by, for spans take more room than texts.
    """
    parts = 2 * document_parts(spark, sf)
    rows = _word_spans(spark, sf).select(
        "doc_id", F.pmod(F.hash("doc_id"), F.lit(parts)).alias("part"), F.col("old.start").alias("starts"),
        F.transform("words", F.length).alias("lengths")).repartitionById(parts, "part")

    def end_of(start, length):
        """A word that was found keeps its length."""
        return F.when(start < 0, start).otherwise(start + length)

    start, length = F.col("_w.starts"), F.col("_w.lengths")
    old = rows.select("doc_id", "part", F.posexplode(F.arrays_zip("starts", "lengths")).alias("pos", "_w")).select(
        "doc_id", "part", "pos", start.alias("start"), end_of(start, length).alias("end"),
        _value(F.col("doc_id"), F.col("pos"), length).alias("value")).where("value >= 1000")

    def pieces(start, length):
        """Where each piece starts, in the upper half of a long, next to the end of its word."""
        end = end_of(start, length)

        def packed(at):
            return F.shiftleft(at.cast("bigint"), 32) + end

        return F.when(end > start, F.sequence(packed(start), packed(end - 1), F.lit(4 << 32))).otherwise(F.array().cast("array<bigint>"))

    at = F.shiftright("_p", 32).cast("int")
    new = rows.select("doc_id", "part", F.posexplode(F.flatten(F.zip_with("starts", "lengths", pieces))).alias("pos", "_p")).select(
        "doc_id", "part", "pos", at.alias("start"),
        F.least(at + 4, F.col("_p").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("end"))
    return remap_span_rows(old, new, ["doc_id", "part"]).drop("part")
