"""One table from the results of several partial evaluations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from votespan.functions.columns import extract_groups
from votespan.operators.metrics import f1
from votespan.operators.positions import sort_by
from votespan.operators.sampling import append_rows
from votespan.sources.results import read_results

# The names the evaluation gives its metrics.
CONFUSION_NAME = r"^test_target_confusion_(\w+)_(\w+)_(\w+)$"
F1_NAME = r"^test_target_f1_(\w+)$"
AVERAGES = ["micro", "macro"]


def merge_partition_results(
    metrics: DataFrame, confusion_name: str = CONFUSION_NAME, f1_name: str = F1_NAME,
) -> DataFrame:
    """(name, f1): every target by name, then ``micro`` from the pooled confusion
    counts and ``macro`` as the mean of the targets."""
    found = metrics.filter(F.col("value").isNotNull())
    found = extract_groups(found, "name", confusion_name, ["counted", "label", "pred"])
    found = extract_groups(found, "name", f1_name, ["target"])

    def cell(label: str, pred: str):
        return F.sum(F.when((F.col("label") == label) & (F.col("pred") == pred), F.col("value")).otherwise(0.0))

    targets = found.filter(F.col("target").isNotNull()).select(F.col("target").alias("name"), F.col("value").alias("f1"))
    pooled = f1(cell("pos", "pos"), cell("neg", "pos"), cell("pos", "neg"))
    summary = found.agg(
        pooled.alias("micro"), F.avg(F.when(F.col("target").isNotNull(), F.col("value"))).alias("macro"))
    summary = summary.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).alias("f1")) for n in AVERAGES])))
    return sort_by(append_rows(targets, summary, ["name", "f1"]), "name", last=AVERAGES)


def partition_report(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The table over every results file that the path, glob or list of them names."""
    return merge_partition_results(read_results(spark, paths))
