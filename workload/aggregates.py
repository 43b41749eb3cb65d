"""Vote shares, consensus, statistics and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from votespan.functions.arrays import map_to_pairs, pairs_to_map, runs_of_true
from votespan.functions.columns import argmax, category_columns, prefix_cols, onehot
from votespan.operators.stats import avg_cols, avg_map, dataset_stats, pos_weights, sum_map_values, sum_span_widths
from votespan.operators.votes import (
    agg_cols, dedupe_mean, is_tie, majority, nested_consensus, rationale_consensus, vote_share, vote_share_multi,
)
from votespan.plans.prepare import label_posts
from workload.registry import query, table
from workload.tables import (
    CATEGORIES, FLAGS, FLAG_TARGETS, LABELS, MARKS, POST_VOTES, PRED, VOTES, WORDS, posts, predictions, rationales, votes, word_lists,
)

LABEL_COLS = category_columns(FLAGS, "label")
TARGET_COLS = category_columns(FLAG_TARGETS, "target")


def share_sql(cats, prefix, test, fn="round({}, 6)"):
    return ", ".join(f"{fn.format(f'avg(cast({test.format(c)} as int)::double)')} as {prefix}_{c}" for c in cats)


IS_LABEL, NAMES = "label = '{}'", "list_contains(targets, '{}')"


def rounded(df, cols, keys=()):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in cols])


@query("a1_agg_cols", """select l_orderkey, l_returnflag, max(l_quantity) as l_quantity, max(l_extendedprice) as l_extendedprice, max(l_tax) as l_tax
  from lineitem group by 1, 2""")
def a1(spark, sf):
    return agg_cols(table(spark, sf, "lineitem"), F.max, ["l_orderkey", "l_returnflag"], ["l_quantity", "l_extendedprice", "l_tax"])


@query("a2_vote_share", f"with {VOTES} select post_id, {share_sql(FLAGS, 'label', IS_LABEL)} from votes group by 1")
def a2(spark, sf):
    return rounded(vote_share(votes(spark, sf), "post_id", "label", FLAGS), LABEL_COLS, ["post_id"])


@query("a2_label_counts", f"""with {VOTES}, m as (select post_id, {share_sql(FLAGS, 'label', IS_LABEL, 'round({})')} from votes group by 1)
  select case when label_A >= label_N and label_A >= label_R then 'A' when label_N >= label_R then 'N' else 'R' end as label, count(*) as posts
  from m group by 1""")
def label_counts(spark, sf):
    """Votes to shares to majority to best label to posts per label."""
    won = majority(vote_share(votes(spark, sf), "post_id", "label", FLAGS), LABEL_COLS)
    best = F.get(F.array(*[F.lit(c) for c in FLAGS]), argmax(F.array(*LABEL_COLS)))
    return won.select(best.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("posts"))


@query("a3_vote_share_multi", f"with {VOTES} select post_id, {share_sql(FLAG_TARGETS, 'target', NAMES)} from votes group by 1")
def a3(spark, sf):
    return rounded(vote_share_multi(votes(spark, sf), "post_id", "targets", FLAG_TARGETS), TARGET_COLS, ["post_id"])


_docs_cats = (share_sql(LABELS, 'label', IS_LABEL, 'round({})') + ", "
              + share_sql(CATEGORIES["target"], 'target', NAMES, 'round({})'))
DOC_COLS = category_columns(LABELS, "label") + category_columns(CATEGORIES["target"], "target")


@query("a3_nested_vote_share", f"with {POST_VOTES} select doc_id, {_docs_cats} from post_votes group by 1")
def a3_nested(spark, sf):
    """The in-row form, on posts that carry their votes."""
    return label_posts(posts(spark, sf), CATEGORIES).select(F.col("post_id").cast("bigint").alias("doc_id"), *DOC_COLS)


@query("a4_majority", f"""with {VOTES}, m as (select post_id, {share_sql(FLAGS, 'label', IS_LABEL, 'round({})')} from votes group by 1)
  select *, label_A = 0 and label_N = 0 and label_R = 0 as is_tie from m""")
def a4(spark, sf):
    return majority(vote_share(votes(spark, sf), "post_id", "label", FLAGS), LABEL_COLS).withColumn("is_tie", is_tie(LABEL_COLS))


@query("a5_rationale_consensus", f"""with {MARKS} select doc_id, pos, round(avg(flag), 6) as value from marks group by 1, 2 having sum(flag) > 0""")
def a5(spark, sf):
    means = rationale_consensus(rationales(spark, sf), "doc_id", denominator="annotators")
    return means.withColumn("value", F.round("value", 6))


@query("a5_nested_consensus", f"""with {MARKS} select doc_id, pos as k, avg(flag) as v from marks where flag <> 0 group by 1, 2""")
def a5_nested(spark, sf):
    rows = posts(spark, sf).select(F.col("post_id").cast("bigint").alias("doc_id"), nested_consensus(F.col("rationales")).alias("m"))
    return map_to_pairs(rows, "doc_id", "m")


@query("a6_pairs_to_map", f"""with {MARKS}, c as (select doc_id, pos, sum(flag) as s from marks group by 1, 2 having sum(flag) > 0)
  select doc_id, pos as k, (s / 3.0::double) as v from c""")
def a6(spark, sf):
    pairs = rationale_consensus(rationales(spark, sf), "doc_id", denominator="annotators")
    return map_to_pairs(pairs_to_map(pairs, "doc_id", "pos", "value", "m"), "doc_id", "m")


@query("a7_dedupe_mean", "select user_id as comment_id, round(avg(value), 6) as score, min(event_type) as text from events group by 1")
def a7(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("comment_id"), F.col("value").alias("score"), F.col("event_type").alias("text"))
    return dedupe_mean(rows, "comment_id").withColumn("score", F.round("score", 6))


@query("a8_avg_cols", f"with {VOTES} select {share_sql(FLAGS, 'label', IS_LABEL)} from votes")
def a8(spark, sf):
    hot = prefix_cols(onehot(votes(spark, sf), "post_id", "label", FLAGS), FLAGS, "label_")
    return rounded(avg_cols(hot, LABEL_COLS), LABEL_COLS)


@query("a9_avg_map", f"""with {MARKS}, c as (select doc_id, pos, avg(flag) as v from marks where flag <> 0 group by 1, 2)
  select pos as key, round(sum(v) / (select count(*) from documents), 6) as value from c group by 1""")
def a9(spark, sf):
    rows = posts(spark, sf).select("post_id", nested_consensus(F.col("rationales")).alias("m"))
    return avg_map(rows, "m").withColumn("value", F.round("value", 6))


@query("a10_sum_map_values", f"""with {MARKS} select cast(count(*) as double) as total from (select distinct doc_id, pos from marks where flag <> 0)""")
def a10(spark, sf):
    return sum_map_values(posts(spark, sf).select(nested_consensus(F.col("rationales")).alias("m")), "m")


@query("a11_sum_span_widths", f"""with {WORDS} select count(*) as total from (select unnest(words) as w from docs) where len(w) > 4""")
def a11(spark, sf):
    rows = word_lists(spark, sf).select(runs_of_true(F.transform("words", lambda w: F.length(w) > 4)).alias("runs"))
    return sum_span_widths(rows, "runs")


def labelled_docs(spark, sf):
    """Documents with labels, targets, rationale per word and one valid run over the words."""
    return label_posts(posts(spark, sf), CATEGORIES).select(
        "post_id", *DOC_COLS, nested_consensus(F.col("rationales")).alias("rationale"),
        F.array(F.struct(F.lit(0).alias("start"), F.size("post_tokens").alias("end"))).alias("mask"))


LABELLED_DOCS = f"""labelled as (select doc_id, {_docs_cats} from post_votes group by 1)"""


def freq_rows(cols, name):
    return " union all ".join(
        f"select '{name}' as part, {i} as item, round(avg({c}), 6) as freq from labelled" for i, c in enumerate(cols))


rate_sql = f"""select 'rationale_freq' as part, 0 as item, round(
  (select count(*) from (select distinct doc_id, pos from marks where flag <> 0))::double / (select sum(len(words)) from docs), 6) as freq"""
STATS_SQL = (f"with {MARKS}, {POST_VOTES}, {LABELLED_DOCS} {freq_rows(DOC_COLS[:3], 'label_freqs')} union all "
             f"{freq_rows(DOC_COLS[3:], 'target_freqs')} union all {rate_sql}")


def stats_rows(stats):
    """A statistics record as rows (part, item, freq).

    Laid out inside the record's row: a union would compute the record once per part.
    """
    def entry(part, item, freq):
        return F.struct(F.lit(part).alias("part"), F.lit(item).alias("item"), F.round(freq, 6).alias("freq"))

    entries = [entry("label_freqs", i, F.get("label_freqs", F.lit(i))) for i in range(3)]
    entries += [entry("target_freqs", i, F.get("target_freqs", F.lit(i))) for i in range(len(DOC_COLS) - 3)]
    entries.append(entry("rationale_freq", 0, F.col("rationale_freq")))
    return stats.select(F.inline(F.array(*entries)))


def doc_stats(spark, sf):
    return dataset_stats(labelled_docs(spark, sf), DOC_COLS[:3], DOC_COLS[3:])


@query("a12_dataset_stats", STATS_SQL)
def a12(spark, sf):
    return stats_rows(doc_stats(spark, sf))


@query("a13_pos_weights", f"""with {PRED} select item, round((1 - f) / (f + 1e-8::double), 6) as pos_weight from (
  select item, avg(truth) as f from pred group by 1)""")
def a13(spark, sf):
    freqs = [F.avg(F.when(F.col("item") == i, F.col("truth"))) for i in range(11)]
    stats = predictions(spark, sf).agg(F.array(*freqs).alias("target_freqs"))
    return pos_weights(stats).withColumn("pos_weight", F.round("pos_weight", 6))
