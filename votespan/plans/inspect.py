"""A sample of posts with what is true and what a model said, side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from votespan.functions.arrays import render_spans
from votespan.functions.columns import decode_above, decode_top
from votespan.operators.sampling import sample_n


def inspection_report(
    rows: DataFrame, n: int, key: Sequence[str], label_names: Sequence[str], target_names: Sequence[str], seed=0,
    threshold: float = 0.5,
) -> DataFrame:
    """(keys, text, true_line, pred_line, true_label, pred_label, true_targets, pred_targets) of n rows.

    ``rows`` has ``text``, ``spans``, the flags ``true_marks`` and ``pred_marks`` of each span,
    and scores ``true_label``, ``pred_label``, ``true_targets`` and ``pred_targets`` in the order
    of the names.  Lines have an X under marked text; labels are the best, targets all above
    the threshold.  Only the sampled rows are rendered.
    """
    def named(scores: str) -> Column:
        return F.transform(decode_above(F.col(scores), target_names, threshold), lambda x: x["name"])

    return sample_n(rows, n, key, seed).select(
        *key, "text", render_spans(F.col("true_marks"), F.col("spans")).alias("true_line"),
        render_spans(F.col("pred_marks"), F.col("spans")).alias("pred_line"),
        decode_top(F.col("true_label"), label_names)["name"].alias("true_label"),
        decode_top(F.col("pred_label"), label_names)["name"].alias("pred_label"),
        named("true_targets").alias("true_targets"), named("pred_targets").alias("pred_targets"))
