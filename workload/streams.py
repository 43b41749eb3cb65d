"""Metrics over streams of files written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from votespan.operators.metrics import masked_binary_f1, mse, multilabel_confusion
from votespan.sources.scratch import scratch_path
from votespan.streaming.metrics import read_latest, read_newest_batch, start_metrics, start_updates, window_summary, windowed
from workload.evaluation import metrics_sql, r6
from workload.registry import query, table
from workload.tables import SPLIT_CELLS, TARGETS, f1_sql, predictions, score_predictions, split_of, split_sql


def _arriving(rows, name: str, order: str, files: int = 4, each: int = 2):
    """The rows as files in the order of a column, read as a stream of ``each`` files a batch."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    rows.repartitionByRange(files, order).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path)


@query("st_target_metrics", f"with {SPLIT_CELLS} {metrics_sql()}")
def st_targets(spark, sf):
    """Every multi-label metric of all predictions so far, in complete mode."""
    stream = _arriving(predictions(spark, sf), "stream-predictions", "vec_id")
    path = scratch_path(spark, "stream-metrics")
    start_metrics(stream, "target", f"{path}/rows", f"{path}/checkpoint", TARGETS).awaitTermination()
    return r6(read_newest_batch(spark, f"{path}/rows").select("split", "name", "value"), "value")


_SCORES = f"""select split, round(avg((pred - truth) * (pred - truth)), 6) as mse from (
  select embedding[23]::double as pred, embedding[24]::double as truth, {split_sql('vec_id')} as split from embeddings) group by 1"""


@query("st_score_mse", _SCORES)
def st_scores(spark, sf):
    """Squared error by split in update mode: the last value each split was given."""
    stream = _arriving(score_predictions(spark, sf), "stream-scores", "vec_id")
    path = scratch_path(spark, "stream-mse")
    start_updates(mse(stream, by="split"), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return r6(read_latest(spark, f"{path}/rows", "split"), "mse")


def event_predictions(spark, sf):
    """Events as predictions of three labels, with the time they were made."""
    events = table(spark, sf, "events")
    return events.select(
        "event_id", "ts", split_of(F.col("event_id")).alias("split"),
        F.posexplode(F.array(*[F.lit(t) for t in ("click", "purchase", "view")])).alias("item", "kind"), "value", "event_type").select(
        "event_id", "ts", "split", "item", (F.col("event_type") == F.col("kind")).cast("double").alias("truth"),
        (F.col("value") - 10.0 * (F.col("item") + 1)).alias("logit"), (F.col("event_id") % 3 > 0).alias("mask"))


_EVENTS = f"""pred as (select event_id, ts, {split_sql('event_id')} as split, cast(k - 1 as int) as item, event_id % 3 > 0 as mask,
    case when event_type = ['click', 'purchase', 'view'][k] then 1.0::double else 0.0::double end as truth, value - 10.0::double * k as logit
  from events, range(1, 4) r(k)),
  cells as (select time_bucket(interval '1 day', ts) as start, split, item,
    count(*) filter (where truth <= 0.5 and logit <= 0) as neg_neg, count(*) filter (where truth <= 0.5 and logit > 0) as neg_pos,
    count(*) filter (where truth > 0.5 and logit <= 0) as pos_neg, count(*) filter (where truth > 0.5 and logit > 0) as pos_pos
    from pred group by all)"""


def _daily_cells(spark, sf):
    """Confusion counts by day, split and label under a watermark, as update mode leaves them.

    Files written side by side arrive in any order, so rows may come as late as the table is long.
    """
    stream = windowed(_arriving(event_predictions(spark, sf), "stream-events", "ts", each=1), "ts", "1 day", "400 days")
    path = scratch_path(spark, "stream-days")
    start_updates(multilabel_confusion(stream, ["window", "split", "item"]), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return read_latest(spark, f"{path}/rows", ["window", "split", "item"])


@query("st_window_confusion", f"with {_EVENTS} select epoch(start)::bigint as day, * exclude (start) from cells")
def st_windows(spark, sf):
    return _daily_cells(spark, sf).select(
        F.unix_timestamp("window.start").alias("day"), "split", "item", "neg_neg", "neg_pos", "pos_neg", "pos_pos")


@query("st_window_summary", f"""with {_EVENTS}, scores as (select start, split, avg({f1_sql()}) as macro_f1,
    {f1_sql('sum(pos_pos)', 'sum(neg_pos)', 'sum(pos_neg)')} as micro_f1 from cells group by 1, 2)
  select epoch(start)::bigint as day, split, round(macro_f1, 6) as macro_f1, round(micro_f1, 6) as micro_f1,
    round(macro_f1 - lag(macro_f1) over (partition by split order by start), 6) as macro_change from scores""")
def st_summary(spark, sf):
    found = window_summary(_daily_cells(spark, sf), by=["split"]).withColumn("day", F.unix_timestamp("start")).drop("start")
    return r6(found, "macro_f1", "micro_f1", "macro_change")


@query("st_token_f1", """with cells as (select split, count(*) filter (where truth > 0.5 and logit > 0)::double as tp, count(*) filter (where truth <= 0.5 and logit <= 0)::double as tn,
    count(*) filter (where truth <= 0.5 and logit > 0)::double as fp, count(*) filter (where truth > 0.5 and logit <= 0)::double as fn
    from pred where mask group by 1)""".replace("with cells", f"with {_EVENTS.split('  cells as')[0].rstrip().rstrip(',')}, cells") + """
  select split, round((2 * (tp / (tp + fp + 1e-8::double)) * (tp / (tp + fn + 1e-8::double)) / (tp / (tp + fp + 1e-8::double) + tp / (tp + fn + 1e-8::double) + 1e-8::double)
    + 2 * (tn / (tn + fn + 1e-8::double)) * (tn / (tn + fp + 1e-8::double)) / (tn / (tn + fn + 1e-8::double) + tn / (tn + fp + 1e-8::double) + 1e-8::double)) / 2, 6) as f1 from cells""")
def st_tokens(spark, sf):
    """Masked F1 by split in complete mode."""
    stream = _arriving(event_predictions(spark, sf), "stream-tokens", "event_id")
    path = scratch_path(spark, "stream-token-f1")
    start_updates(masked_binary_f1(stream, by="split"), f"{path}/rows", f"{path}/checkpoint", "complete").awaitTermination()
    return r6(read_newest_batch(spark, f"{path}/rows"), "f1")
