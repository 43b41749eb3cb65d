"""What the plans must look like."""

import re

import pytest
from pyspark.sql import functions as F

from votespan.operators.metrics import task_metrics, weighted_bce
from votespan.operators.stats import dataset_stats
from votespan.operators.votes import nested_consensus
from votespan.plans.evaluate import evaluate
from votespan.plans.prepare import label_posts, prepare_annotated
from workload import QUERIES
from workload.tables import CATEGORIES, posts, predictions

PYTHON = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow")
# Sub-word tokenising, alignment, the scan of JSON for brackets and the user's model leave the JVM; nothing else does.
LEAVES_JVM = {
    "s1_read_keyed_json",
    "c7_inspection_report",
    "x2_tokenize", "f4_map_batches", "c1_prepare_annotated", "c1_prepare_rationale", "c2_prepare_scored", "c3_run_prepare", "r1_score",
    "w5_align_words", "w5_align_detokenized", "j4_remap_spans", "j4_remap_span_rows", "x11_render_spans"}


def nodes(plan, *names):
    return sum(len(re.findall(rf"\b{n}\b", plan)) for n in names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LEAVES_JVM))
def test_no_python_and_no_cross_join(spark, sf, plan_of, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert nodes(plan, *PYTHON) == 0
    assert nodes(plan, "CartesianProduct", "BroadcastNestedLoopJoin") == 0


def test_preparing_nested_posts_needs_no_shuffle(spark, sf, tmp_path, plan_of):
    posts(spark, sf).write.parquet(str(tmp_path / "posts"))
    read = spark.read.parquet(str(tmp_path / "posts"))
    assert nodes(plan_of(label_posts(read, CATEGORIES)), "Exchange") == 0
    plan = plan_of(prepare_annotated(read, {"[CLS]": 0, "[SEP]": 1, "[UNK]": 2}, CATEGORIES))
    assert nodes(plan, "Exchange") == 0 and nodes(plan, "MapInArrow") == 1


def test_a_filter_does_not_prepare_twice(spark, sf, tmp_path, plan_of):
    posts(spark, sf).write.parquet(str(tmp_path / "posts"))
    read = spark.read.parquet(str(tmp_path / "posts"))
    ready = prepare_annotated(read, {"[CLS]": 0, "[SEP]": 1, "[UNK]": 2}, CATEGORIES)
    for kept in (F.size("rationale") > 0, F.size("tokens") > 3, F.col("label_plain") > 0):
        plan = plan_of(ready.where(kept).select("post_id", F.size("rationale")))
        assert nodes(plan, "MapInArrow") == 1 and nodes(plan, "ArrowEvalPython") == 0 and nodes(plan, "FileScan") == 1


def test_statistics_are_one_pass(spark, sf, plan_of):
    read = label_posts(posts(spark, sf), CATEGORIES).select(
        "label_plain", "target_GroupA", F.create_map(F.lit(0), F.lit(1.0)).alias("rationale"),
        F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"))).alias("mask"))
    plan = plan_of(dataset_stats(read, ["label_plain"], ["target_GroupA"]))
    assert nodes(plan, "FileScan") == 1


def test_all_label_metrics_are_one_pass(spark, sf, plan_of):
    plan = plan_of(task_metrics(predictions(spark, sf), "target"))
    assert nodes(plan, "FileScan") == 1


def test_weights_join_after_the_fold(spark, sf, plan_of):
    pred = predictions(spark, sf)
    weights = spark.createDataFrame([(i, 1.0) for i in range(11)], "item int, pos_weight double")
    plan = plan_of(weighted_bce(pred, weights))
    join = re.search(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin)", plan).start()
    assert "HashAggregate(keys=[item" in plan[join:]


def test_scans_read_what_they_need(spark, sf, plan_of):
    plan = plan_of(QUERIES["a2_vote_share"](spark, sf))
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan
    plan = plan_of(QUERIES["s10_read_runs"](spark, sf))
    assert "EqualTo(event_type,purchase)" in plan and "TakeOrderedAndProject" not in plan


def test_costly_arrays_are_computed_once(spark, sf):
    """No inferred filter repeats the projection below a generator."""
    for name in ("a5_nested_consensus", "j4_remap_spans", "w4_runs_of_true", "a9_avg_map"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"Filter \(?\(?size\(", plan), name


@pytest.mark.parametrize("name", ["w1_beyond_n_latest", "w9_source_index", "u3_balanced_sample", "u3_balanced_draws", "c4_build_batches"])
def test_planning_runs_no_job(spark, sf, name):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    QUERIES[name](spark, sf)
    new = set(tracker.getJobIdsForGroup(None)) - before
    # Reading a table's schema is a job of one task.
    assert all(sum(tracker.getStageInfo(s).numTasks for s in tracker.getJobInfo(j).stageIds) == 1 for j in new)


def test_evaluation_reads_its_table_once(spark, sf, plan_of):
    plan = plan_of(QUERIES["c5_evaluate"](spark, sf))
    assert nodes(plan, "FileScan") == 1 and nodes(plan, "Join", "Union") == 0


def test_evaluation_does_not_grow_with_the_labels(spark, plan_of):
    df = spark.createDataFrame([], "split string, target_logits array<double>, target array<double>, label_logits array<double>, label array<double>")

    def without_names(n):
        plan = plan_of(evaluate(df, [f"label{i}" for i in range(n)], n_labels=n))
        return len(re.sub(r"label\d+,? ?", "", plan))

    assert without_names(200) < 1.05 * without_names(5)


def test_batches_rank_keys_only(spark, tmp_path, plan_of):
    from votespan.operators.positions import assign_batches

    spark.range(1000).withColumn("wide", F.lit("x")).write.parquet(str(tmp_path / "t"))
    plan = plan_of(assign_batches(spark.read.parquet(str(tmp_path / "t")), ["id"], 10))
    window = plan[plan.index("Window"):]
    assert "wide" not in window


def test_a_source_does_not_meet_its_limit_in_one_task(spark, tmp_path, plan_of):
    from votespan.operators.sampling import balanced_sample

    spark.range(1000).select("id", (F.col("id") % 2).cast("string").alias("source"), F.lit("x").alias("wide")).write.parquet(str(tmp_path / "t"))
    # As if every table were large: only what is sent by hand goes to all tasks.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(balanced_sample(spark.read.parquet(str(tmp_path / "t")), "source", ["id"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The counts of the cuts meet their own kind; rows do not.
    assert "SortMergeJoin" not in plan[:plan.index("BroadcastHashJoin")] and nodes(plan, "BroadcastHashJoin") == 2


def test_spans_are_not_sent_to_all_tasks(spark, sf, plan_of):
    """Spans are many more than the rows whose size Spark's estimate goes by."""
    plan = plan_of(QUERIES["j4_remap_span_rows"](spark, sf))
    assert nodes(plan, "BroadcastExchange", "BroadcastHashJoin") == 0 and nodes(plan, "SortMergeJoin") == 1


def test_spans_are_not_written_to_disk(spark, sf, plan_of):
    """Aligned documents are dealt out once, and spans are joined where they are made."""
    df = QUERIES["j4_remap_span_rows"](spark, sf)
    assert "ENSURE_REQUIREMENTS" not in plan_of(df)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert re.search(r"ReusedExchange .*shufflepartitionidpassthrough", final) and nodes(final, "ArrowEvalPython") == 1


def test_marks_are_not_folded_word_by_word(spark, sf, plan_of):
    """Positions without a mark cost a look at each mark, and no struct."""
    for df in (posts(spark, sf).select(nested_consensus(F.col("rationales"))), QUERIES["a5_nested_consensus"](spark, sf)):
        assert "zip_with" not in plan_of(df)
