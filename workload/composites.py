"""The composite jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from votespan.functions.arrays import pairs_to_map, span
from votespan.functions.text import align_words, split_words
from votespan.operators.tokenizer import build_vocab, vocab_dict
from votespan.plans.batches import build_batches
from votespan.plans.evaluate import evaluate
from votespan.plans.inspect import inspection_report
from votespan.plans.prepare import (
    Preparation, join_labelled, label_votes, prepare_annotated, prepare_scored, run_prepare,
)
from votespan.plans.report import partition_report
from votespan.operators.votes import rationale_consensus
from votespan.sources.datasets import Catalog, write_input
from votespan.sources.scratch import scratch_path
from workload.aggregates import IS_LABEL, NAMES, share_sql
from workload.evaluation import REPORT_SQL, class_f1_sql, focal_sql, masked_f1_sql, metrics_sql, r6
from workload.registry import query, table
from workload.sources import partition_files
from workload.tables import (
    CATEGORIES, ENTRIES_SQL, FLAGS, FLAG_TARGETS, LABELS, MARKS, POST_VOTES, SPLIT_CELLS, TARGETS, VOTES, WORDS, entries_of, hash_sql, mark, posts, rationales,
    split_of, split_sql, votes, word_lists,
)
from workload.spans import walk_sql
from workload.text import DETOKENIZED, corpus_vocab, ids_digest, spans_digest, vocab_sql, wordpiece_sql

_flag_cats = {"label": FLAGS, "target": FLAG_TARGETS}


@query("c1_label_votes", f"""with {VOTES} select post_id, {share_sql(FLAGS, 'label', IS_LABEL, 'round({})')}, {share_sql(FLAG_TARGETS, 'target', NAMES, 'round({})')}
  from votes group by 1""")
def c1_votes(spark, sf):
    """Labels and targets of a long vote table in one grouping."""
    return label_votes(votes(spark, sf), "post_id", _flag_cats)


@query("c1_join_labelled", f"""with {MARKS}, {ENTRIES_SQL},
  l as (select doc_id, round(avg(quality), 6) as quality, round(avg(toxic), 6) as toxic from labels group by 1)
  select d.doc_id, quality, toxic, coalesce(entries, '') as entries from documents d left join l on d.doc_id = l.doc_id left join marked m on d.doc_id = m.doc_id""")
def c1_join(spark, sf):
    maps = pairs_to_map(rationale_consensus(rationales(spark, sf), "doc_id"), "doc_id", "pos", "value", "rationale")
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("quality", "toxic")])
    joined = join_labelled(table(spark, sf, "documents").select("doc_id"), labels, maps, "doc_id")
    return joined.select("doc_id", "quality", "toxic", entries_of("rationale").alias("entries"))


_prepared = (share_sql(LABELS, "label", IS_LABEL, "round({})") + ", "
             + share_sql(CATEGORIES["target"], "target", NAMES, "round({})"))


def _prepare(spark, sf):
    return prepare_annotated(posts(spark, sf), corpus_vocab(spark, sf), CATEGORIES, strip_accents=False)


@query("c1_prepare_annotated", f"""with recursive {vocab_sql('documents')}, {WORDS}, {POST_VOTES},
  src as (select doc_id, {DETOKENIZED} as text from docs), {wordpiece_sql('doc_id')},
  labelled as (select doc_id, {_prepared} from post_votes group by 1)
  select cast(doc_id as varchar) as post_id, l.* exclude (doc_id), n as n_tokens, ids, n as valid
  from labelled l join tokenized using (doc_id)""")
def c1(spark, sf):
    """Whole documents from votes and words to labels and tokens."""
    return _prepare(spark, sf).select(
        "post_id", *[f"label_{c}" for c in LABELS], *[f"target_{c}" for c in CATEGORIES["target"]],
        F.size("tokens").alias("n_tokens"), F.element_at("mask", 1)["end"].alias("valid"),
        ids_digest().alias("ids"))


_MOVED = f"""with recursive {vocab_sql('documents')}, {MARKS}, src as (select doc_id, words, {DETOKENIZED} as text from docs),
  {wordpiece_sql('doc_id')}, {walk_sql('src')},
  marked as (select f.doc_id, f.i, f.s, f.e from found f join (select distinct doc_id, pos from marks where flag <> 0) m
    on f.doc_id = m.doc_id and f.i = m.pos + 1 where f.s >= 0),
  spans as (select doc_id, i, unnest(starts) + place as s, unnest(ends) + place as e, unnest(range(1, len(ids) + 1)) as k from pieces),
  numbered as (select doc_id, s, e, row_number() over (partition by doc_id order by i, k) as pos from spans
    union all select doc_id, 0, 0, 0 from src union all select doc_id, 0, 0, n - 1 from tokenized),
  moved as (select distinct t.doc_id, t.pos from numbered t join marked m on t.doc_id = m.doc_id and t.s >= m.s and t.e <= m.e)"""


@query("c1_prepare_rationale", f"""{_MOVED}
  select cast(doc_id as varchar) as post_id, count(*) as n, md5(string_agg(pos || ':1.0', ',' order by pos)) as entries from moved group by 1""")
def c1_rationale(spark, sf):
    """The same, with the marks moved from words to tokens."""
    rows = _prepare(spark, sf).where(F.size("rationale") > 0)
    return rows.select("post_id", F.size("rationale").cast("bigint").alias("n"), F.md5(entries_of("rationale")).alias("entries"))


@query("c2_prepare_scored", f"""with recursive {vocab_sql('conversations')}, src as (select conv_id, min(text) as text, avg(turn) as score from conversations group by 1),
  {wordpiece_sql('conv_id')}
  select conv_id as comment_id, round(score, 6) as score, n as n_tokens, n as valid, ids, offsets from tokenized join src using (conv_id)""")
def c2(spark, sf):
    """A conversation is a comment, each of its turns a rating of it."""
    talk = table(spark, sf, "conversations")
    rated = talk.select(F.col("conv_id").alias("comment_id"), F.col("turn").cast("double").alias("score"), "text")
    ready = prepare_scored(rated, vocab_dict(build_vocab(talk, size=20_000)), strip_accents=False)
    return ready.select(
        "comment_id", F.round("score", 6).alias("score"), F.size("tokens").alias("n_tokens"),
        F.element_at("mask", 1)["end"].alias("valid"), ids_digest().alias("ids"), spans_digest(F.col("offsets")).alias("offsets"))


_PREPARED_ALL = f"""{_MOVED}, {POST_VOTES}, labelled as (select doc_id, {_prepared} from post_votes group by 1),
  entries as (select doc_id, string_agg(pos || ':1.0', ',' order by pos) as entries from moved group by 1)
  select cast(l.doc_id as varchar) as post_id, {split_sql('l.doc_id')} as split, l.* exclude (doc_id), ids, coalesce(md5(entries), md5('')) as rationale
  from labelled l join tokenized t on l.doc_id = t.doc_id left join entries e on l.doc_id = e.doc_id"""


@query("c3_run_prepare", _PREPARED_ALL)
def c3(spark, sf):
    catalog = Catalog(scratch_path(spark, "prepared"))
    write_input(posts(spark, sf), catalog, "documents")
    plan = Preparation("annotated", "post_id", {"cats": CATEGORIES, "strip_accents": False})
    written = run_prepare(spark, catalog, "documents", corpus_vocab(spark, sf), plan)
    return written.select(
        "post_id", "split", *[f"label_{c}" for c in LABELS], *[f"target_{c}" for c in CATEGORIES["target"]],
        ids_digest().alias("ids"), F.md5(entries_of("rationale")).alias("rationale"))


BATCHES_SQL = rf"""with every as (
    select 'documents' as source, cast(doc_id as varchar) as key, list_transform(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> ''), lambda w: len(w)) as tokens from documents
    union all select 'conversations', conv_id || '-' || turn, list_transform(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> ''), lambda w: len(w)) from conversations),
  sizes as (select source, count(*) as c, row_number() over (order by source) - 1 as nth from every group by 1),
  quota as (select source, (select min(c) from sizes) // 2 + case when nth < (select min(c) from sizes) % 2 then 1 else 0 end as q from sizes),
  ranked as (select *, row_number() over (partition by source order by {hash_sql(0, 'key')}, key) as rn from every),
  kept as (select r.* from ranked r join quota t on r.source = t.source where rn <= q),
  placed as (select *, row_number() over (order by {hash_sql(0, 'source', 'key')}, source, key) - 1 as i, count(*) over () as n from kept),
  batched as (select *, cast(i // 32 as bigint) as batch from placed where i < n - n % 32),
  whole as (select *, max(len(tokens)) over (partition by batch, source) as length, count(*) over (partition by batch, source) as size from batched
    where batch in (select batch from batched group by 1 having count(distinct source) = 2))
  select source, key, batch, size, cast(length as int) as length, md5(array_to_string(list_resize(tokens, length, 0), ',')) as tokens, cast(len(tokens) as int) as valid from whole"""


@query("c4_build_batches", BATCHES_SQL)
def c4(spark, sf):
    def dataset(name, key):
        words = split_words(F.col("text"))
        rows = table(spark, sf, name).select(key.alias("key"), F.transform(words, F.length).alias("tokens"))
        return rows.withColumn("mask", F.array(F.struct(F.lit(0).alias("start"), F.size("tokens").alias("end"))))

    batches = build_batches({
        "documents": dataset("documents", F.col("doc_id").cast("string")),
        "conversations": dataset("conversations", F.concat_ws("-", "conv_id", "turn")),
    }, ["key"], size=32)
    return batches.select(
        "source", "key", "batch", "size", "length", F.md5(F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",")).alias("tokens"),
        F.size(F.filter("mask", lambda m: m)).alias("valid"))


C5_TOKENS = f"""tokens as (select vec_id, {split_sql('vec_id')} as split, embedding[k]::double as logit, embedding[k + 11]::double as truth,
    embedding[k + 22]::double > (-0.1)::double and (embedding[51] > 0 or embedding[52] > 0) as mask from embeddings, range(1, 12) r(k)),
  masked as (select split,
    sum(case when mask and truth <= 0.5 and logit <= 0 then 1.0 else 0 end)::double as tn, sum(case when mask and truth <= 0.5 and logit > 0 then 1.0 else 0 end)::double as fp,
    sum(case when mask and truth > 0.5 and logit <= 0 then 1.0 else 0 end)::double as fn, sum(case when mask and truth > 0.5 and logit > 0 then 1.0 else 0 end)::double as tp
  from tokens group by split),
  classes as (select vec_id, {split_sql('vec_id')} as split, cast(list_position(embedding[51:53], list_max(embedding[51:53])) - 1 as int) as truth,
    cast(list_position(embedding[31:33], list_max(embedding[31:33])) - 1 as int) as pred from embeddings),
  scores as (select {split_sql('vec_id')} as split, embedding[23]::double as pred, embedding[24]::double as truth from embeddings)"""


@query("c5_evaluate", f"""with {SPLIT_CELLS}, {C5_TOKENS}, {class_f1_sql('split')}
  {metrics_sql()}
  union all select split, split || '_label_f1', round(avg(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) from per_class group by split
  union all select split, split || '_label_loss', round(avg(y * ln(1 + exp(-z)) + (1 - y) * ln(1 + exp(z))), 6) from (
    select {split_sql('vec_id')} as split, embedding[k + 30]::double as z, embedding[k + 50]::double as y from embeddings, range(1, 4) r(k))
    where split <> 'test' group by split
  union all select split, split || '_score_mse', round(avg((pred - truth) * (pred - truth)), 6) from scores group by split
  union all select split, split || '_score_loss', round(avg((pred - truth) * (pred - truth)), 6) from scores where split <> 'test' group by split
  union all select split, split || '_rationale_f1', round({masked_f1_sql()}, 6) from masked
  union all {focal_sql('tokens')}""")
def c5(spark, sf):
    """Every task's metrics from one table of raw model outputs."""
    def dims(first, n):
        return F.transform(F.slice("embedding", first, n), lambda x: x.cast("double"))

    outputs = table(spark, sf, "embeddings").select(
        split_of(F.col("vec_id")).alias("split"),
        dims(1, 11).alias("target_logits"),
        F.transform(dims(12, 11), lambda x: (x > F.lit(0.05)).cast("double")).alias("target"),
        dims(31, 3).alias("label_logits"), dims(51, 3).alias("label"),
        F.get("embedding", F.lit(22)).cast("double").alias("score_pred"), F.get("embedding", F.lit(23)).cast("double").alias("score"),
        dims(1, 11).alias("rationale_logits"), dims(12, 11).alias("rationale"),
        F.transform(dims(23, 11), lambda x: x > F.lit(-0.1)).alias("mask"))
    return r6(evaluate(outputs, TARGETS), "value")


def _scores_sql(n: int, factor: int) -> str:
    return "[" + ", ".join(f"((doc_id * {factor} + {i * i}) % 11) / 11.0::double" for i in range(n)) + "]"


def _scores(n: int, factor: int):
    return F.array(*[((F.col("doc_id") * factor + i * i) % 11) / F.lit(11.0) for i in range(n)])


def _marks_of(annotator: int):
    return F.transform("words", lambda w, i: mark(F.col("doc_id"), F.lit(annotator), i, w) == 1)


@query("c7_inspection_report", f"""with {MARKS}, picked as (select doc_id, words, array_to_string(words, ' ') as text from docs order by {hash_sql(4, 'doc_id')}, doc_id limit 40),
  tok as (select doc_id, unnest(words) as w, unnest(range(0, len(words))) as i from picked),
  spans as (select doc_id, i, sum(len(w) + 1) over (partition by doc_id order by i) - len(w) - 1 as s, sum(len(w) + 1) over (partition by doc_id order by i) + 1 as e from tok),
  flags as (select doc_id, pos, max(flag) filter (where annotator = 0) as t, max(flag) filter (where annotator = 1) as p from marks where doc_id in (select doc_id from picked) group by 1, 2),
  signs as (select doc_id, unnest(range(0, cast(max(e) as bigint))) as place from spans group by 1),
  under as (select distinct doc_id, place, t, p from (select s.doc_id, unnest(range(cast(s.s as bigint), cast(s.e as bigint))) as place, t, p
    from spans s join flags f on s.doc_id = f.doc_id and s.i = f.pos)),
  lit as (select doc_id, place, max(t) as t, max(p) as p from under group by 1, 2),
  lines as (select doc_id, string_agg(case when t = 1 then 'X' else ' ' end, '' order by place) as true_line,
    string_agg(case when p = 1 then 'X' else ' ' end, '' order by place) as pred_line from signs left join lit using (doc_id, place) group by 1)
  select doc_id, md5(text) as text, md5(true_line) as true_line, md5(pred_line) as pred_line,
    {LABELS}[list_position({_scores_sql(3, 3)}, list_max({_scores_sql(3, 3)}))] as true_label, {LABELS}[list_position({_scores_sql(3, 5)}, list_max({_scores_sql(3, 5)}))] as pred_label,
    array_to_string(list_filter({TARGETS}, lambda x, i: {_scores_sql(11, 3)}[i] > 0.5), ',') as true_targets,
    array_to_string(list_filter({TARGETS}, lambda x, i: {_scores_sql(11, 5)}[i] > 0.5), ',') as pred_targets
  from picked join lines using (doc_id)""")
def c7(spark, sf):
    """Marks of two annotators as truth and prediction, under spans that reach into the next word."""
    words = word_lists(spark, sf).withColumn("text", F.array_join("words", " "))
    rows = words.withColumn("spans", align_words(F.col("words"), F.col("text"))).withColumns({
        "spans": F.transform("spans", lambda s: span(s["start"], s["end"] + 2)),
        "true_marks": _marks_of(0), "pred_marks": _marks_of(1),
        "true_label": _scores(3, 3), "pred_label": _scores(3, 5), "true_targets": _scores(11, 3), "pred_targets": _scores(11, 5)})
    report = inspection_report(rows, 40, ["doc_id"], LABELS, TARGETS, seed=4)
    return report.withColumns({
        **{c: F.md5(c) for c in ("text", "true_line", "pred_line")},
        **{c: F.array_join(c, ",") for c in ("true_targets", "pred_targets")}})


@query("c6_partition_report", REPORT_SQL)
def c6(spark, sf):
    return r6(partition_report(spark, partition_files(spark, sf)), "f1")
