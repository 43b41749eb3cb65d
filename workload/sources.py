"""Reading and writing: keyed JSON, datasets by name, statistics, results, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from votespan.functions.columns import label_slice, onehot, prefix_cols
from votespan.operators.metrics import results, task_metrics
from votespan.operators.sampling import with_split
from votespan.sources.datasets import (
    Catalog, read_dataset, read_stats, scan_columns, write_splits, write_stats,
)
from votespan.sources.keyed_json import json_to_parquet, read_keyed_json
from votespan.sources.results import read_results, read_runs, write_results
from votespan.sources.scratch import scratch_path
from workload.aggregates import DOC_COLS, LABELLED_DOCS, STATS_SQL, doc_stats, freq_rows, labelled_docs, rate_sql, stats_rows
from workload.evaluation import metrics_sql, r6
from workload.registry import query, table
from workload.tables import (
    FLAGS, LABELS, MARKS, POST_VOTES, SPLIT_CELLS, TARGETS, VOTES, f1_sql, posts, predictions, runs, split_sql, votes,
)


def _keyed_json(spark, sf) -> str:
    """The posts as JSON text: objects of up to a hundred posts, keyed by post id."""
    path = scratch_path(spark, "keyed-json")
    rows = posts(spark, sf)
    entry = F.concat(F.lit('"'), F.col("post_id"), F.lit('": '), F.to_json(F.struct(*rows.columns)))
    group = F.floor(F.col("post_id").cast("bigint") / 100)
    objects = rows.groupBy(group.alias("g")).agg(F.array_join(F.collect_list(entry), ", ").alias("entries"))
    objects.select(F.concat(F.lit("{"), F.col("entries"), F.lit("}")).alias("value")).write.text(path)
    return path


POSTS_SQL = f"""with {MARKS}, {POST_VOTES},
  m as (select doc_id, cast(sum(flag) as bigint) as marks from marks group by 1),
  v as (select doc_id, cast(sum(len(targets)) as bigint) as named, string_agg(label, ',' order by annotator_id) as labels from post_votes group by 1)
  select cast(d.doc_id as varchar) as post_id, labels, named, marks, len(words) as n_tokens, md5(array_to_string(words, ' ')) as tokens
  from docs d join m on d.doc_id = m.doc_id join v on d.doc_id = v.doc_id"""


def _post_digest(df):
    zero = F.lit(0).cast("bigint")
    return df.select(
        "post_id", F.array_join(F.transform("annotators", lambda a: a["label"]), ",").alias("labels"),
        F.aggregate("annotators", zero, lambda acc, a: acc + F.size(a["target"])).alias("named"),
        F.aggregate(F.flatten("rationales"), zero, lambda acc, m: acc + m).alias("marks"),
        F.size("post_tokens").cast("bigint").alias("n_tokens"), F.md5(F.array_join("post_tokens", " ")).alias("tokens"))


@query("s1_read_keyed_json", POSTS_SQL)
def s1(spark, sf):
    return _post_digest(read_keyed_json(spark, _keyed_json(spark, sf)))


@query("s2_json_to_parquet", POSTS_SQL)
def s2(spark, sf):
    path = scratch_path(spark, "posts")
    json_to_parquet(read_keyed_json(spark, _keyed_json(spark, sf), first_member="post_id"), path)
    return _post_digest(spark.read.parquet(path))


def _written_docs(spark, sf) -> Catalog:
    catalog = Catalog(scratch_path(spark, "datasets"))
    docs = with_split(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), ["doc_id"])
    write_splits(docs, catalog, "documents")
    return catalog


@query("s3_read_dataset", f"""select doc_id, lang, n_chars, {split_sql('doc_id')} as split from documents""")
def s3(spark, sf):
    catalog = _written_docs(spark, sf)
    parts = [read_dataset(spark, catalog, "documents", s) for s in ("train", "valid", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s4_write_splits", f"""select {split_sql('doc_id')} as split, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by 1""")
def s4(spark, sf):
    written = read_dataset(spark, _written_docs(spark, sf), "documents")
    return written.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("s5_write_stats", STATS_SQL)
def s5(spark, sf):
    catalog = Catalog(scratch_path(spark, "stats"))
    write_stats(doc_stats(spark, sf), catalog, "documents")
    return stats_rows(read_stats(spark, catalog, ["documents"]))


_votes_freq = " union all ".join(
    f"select 'label_freqs' as part, {i} as item, round(avg(case when label = '{c}' then 1.0::double else 0.0::double end), 6) as freq from votes"
    for i, c in enumerate(FLAGS))


@query("s6_read_stats", f"with {MARKS}, {POST_VOTES}, {LABELLED_DOCS}, {VOTES} {_votes_freq} union all {freq_rows(DOC_COLS[3:], 'target_freqs')} union all {rate_sql}")
def s6(spark, sf):
    """Orders give their label frequencies, documents whatever is still missing."""
    catalog = Catalog(scratch_path(spark, "stats"))
    hot = prefix_cols(onehot(votes(spark, sf), "post_id", "label", FLAGS), FLAGS, "label_")
    write_stats(hot.agg(F.array(*[F.avg(f"label_{c}") for c in FLAGS]).alias("label_freqs")), catalog, "orders")
    write_stats(doc_stats(spark, sf), catalog, "documents")
    return stats_rows(read_stats(spark, catalog, ["orders", "documents"]))


@query("s7_scan_columns", f"with {POST_VOTES}, {LABELLED_DOCS} select doc_id, {', '.join(DOC_COLS[:3])} from labelled")
def s7(spark, sf):
    catalog = Catalog(scratch_path(spark, "datasets"))
    rows = with_split(labelled_docs(spark, sf).withColumn("doc_id", F.col("post_id").cast("bigint")), ["doc_id"])
    write_splits(rows, catalog, "documents")
    return scan_columns(read_dataset(spark, catalog, "documents"), {"label": LABELS}, ["doc_id"])


def partition_files(spark, sf) -> str:
    """Test metrics of four label slices, a wide CSV each; the glob of the four."""
    root = scratch_path(spark, "results")
    pred = predictions(spark, sf)
    for part in range(1, 5):
        names = label_slice(TARGETS, part, 4)
        first = TARGETS.index(names[0])
        of_part = pred.filter(F.col("item").isin([TARGETS.index(n) for n in names])).withColumn("item", F.col("item") - first)
        columns = [f"test_target_{m}_f1" for m in ("macro", "micro")] + [f"test_target_f1_{n}" for n in names] + [
            f"test_target_confusion_{n}_{c}" for n in names for c in ("neg_neg", "neg_pos", "pos_neg", "pos_pos")]
        write_results(results(task_metrics(of_part, "target", names)), f"{root}/part_{part}", columns)
    return f"{root}/*/*.csv"


_names = "[" + ", ".join(f"'{t}'" for t in TARGETS) + "]"
_cells = " union all ".join(
    f"select 'test_target_confusion_' || {_names}[item + 1] || '_{c}' as name, {c}::double as value from test" for c in ("neg_neg", "neg_pos", "pos_neg", "pos_pos"))


_scores = f" union all select 'test_target_f1_' || {_names}[item + 1], round({f1_sql()}, 6) from test"


@query("s8_read_results", f"with {SPLIT_CELLS}, test as (select * from cells where split = 'test') {_cells} {_scores}")
def s8(spark, sf):
    """Every name that says which target it is of."""
    rows = read_results(spark, partition_files(spark, sf)).select("name", F.round("value", 6).alias("value"))
    return rows.filter(~F.col("name").rlike("_(macro|micro)_f1$"))


_part_of = "[" + ", ".join(str(p) for p in range(1, 5) for _ in label_slice(TARGETS, p, 4)) + "]"
_averages = f"""select part, 'test_target_macro_f1' as name, round(avg({f1_sql()}), 6) as value from test group by part
  union all select part, 'test_target_micro_f1', round({f1_sql('sum(pos_pos)', 'sum(neg_pos)', 'sum(pos_neg)')}, 6) from test group by part"""


@query("s8_read_averages", f"with {SPLIT_CELLS}, test as (select *, {_part_of}[item + 1] as part from cells where split = 'test') {_averages}")
def s8_averages(spark, sf):
    """The names that are in every file: macro and micro F1 of each slice, told apart by the file."""
    rows = read_results(spark, partition_files(spark, sf)).filter(F.col("name").rlike("_(macro|micro)_f1$"))
    return rows.select(F.regexp_extract("file", r"/part_(\d+)/", 1).cast("int").alias("part"), "name", F.round("value", 6).alias("value"))


_wide_names = [f"test_target_{m}_f1" for m in ("macro", "micro")] + [f"test_target_f1_{n}" for n in TARGETS] + [
    f"test_target_confusion_{n}_{c}" for n in TARGETS for c in ("neg_neg", "neg_pos", "pos_neg", "pos_pos")]
_where = "where split = 'test'"


@query("s9_write_results", f"with {SPLIT_CELLS}, m as ({metrics_sql(_where)}) select " + ", ".join(
    f"max(case when name = '{n}' then value end) as {n}" for n in _wide_names) + " from m")
def s9(spark, sf):
    path = scratch_path(spark, "results")
    write_results(r6(results(task_metrics(predictions(spark, sf), "target", TARGETS)), "value"), path, _wide_names)
    return spark.read.schema(", ".join(f"{n} double" for n in _wide_names)).option("header", True).csv(path)


@query("s10_read_runs", "select event_id as run_id, user_id as owner from events where event_type = 'purchase'")
def s10(spark, sf):
    return read_runs(runs(spark, sf), "purchase").select("run_id", "owner")
