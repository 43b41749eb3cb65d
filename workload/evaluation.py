"""Metrics over predictions, and the model-facing operators."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from votespan.operators.heads import (
    class_weight, fit_label_head, fit_score_head, fit_target_heads, predict_label, predict_score, predict_targets, score,
)
from votespan.operators.metrics import (
    evaluate_splits, focal_loss, masked_binary_accuracy, masked_binary_f1, masked_cells, masked_mean, mse, multiclass_macro_f1,
    multilabel_confusion, multilabel_f1, name_metrics, results, softplus, task_metrics, weighted_bce,
)
from votespan.operators.stats import pos_weight
from votespan.plans.report import merge_partition_results
from workload.registry import query, table
from workload.tables import (
    CELLS, CLASSES, PRED, SCORES, SPLIT_CELLS, TARGETS, class_predictions, f1_sql, predictions, score_predictions,
)


# The user's model below travels with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("e1_multilabel_confusion", f"with {CELLS} select * from cells")
def e1(spark, sf):
    return multilabel_confusion(predictions(spark, sf))


@query("e2_multilabel_f1_none", f"with {CELLS} select item, round({f1_sql()}, 6) as f1 from cells")
def e2(spark, sf):
    return r6(multilabel_f1(predictions(spark, sf), "none"), "f1")


@query("e3_multilabel_f1_macro", f"with {CELLS} select round(avg({f1_sql()}), 6) as f1 from cells")
def e3(spark, sf):
    return r6(multilabel_f1(predictions(spark, sf), "macro"), "f1")


@query("e4_multilabel_f1_micro", f"with {CELLS} select round({f1_sql('sum(pos_pos)', 'sum(neg_pos)', 'sum(pos_neg)')}, 6) as f1 from cells")
def e4(spark, sf):
    return r6(multilabel_f1(predictions(spark, sf), "micro"), "f1")


def class_f1_sql(by: str = "") -> str:
    """Per class: hits, false alarms and misses, classes seen on either side."""
    g = f"{by}, " if by else ""
    return f"""sides as (select {g}truth as c, case when truth = pred then 1 else 0 end as tp, 0 as fp, case when truth <> pred then 1 else 0 end as fn from classes
    union all select {g}pred, 0, 1, 0 from classes where truth <> pred),
  per_class as (select {g}c, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from sides group by {g}c)"""


@query("e5_multiclass_macro_f1", f"with {CLASSES}, {class_f1_sql()} select round(avg({f1_sql('tp', 'fp', 'fn')}), 6) as f1 from per_class")
def e5(spark, sf):
    return r6(multiclass_macro_f1(class_predictions(spark, sf)), "f1")


@query("e6_mse", f"with {SCORES} select round(avg((pred - truth) * (pred - truth)), 6) as mse from scores")
def e6(spark, sf):
    return r6(mse(score_predictions(spark, sf)), "mse")


MASKED = CELLS.replace("from pred group by item", "from pred where mask group by item").replace("count(*) filter", "count(*) filter")
MASKED = MASKED + """, total as (select sum(neg_neg)::double as tn, sum(neg_pos)::double as fp, sum(pos_neg)::double as fn, sum(pos_pos)::double as tp from cells)"""


def masked_f1_sql() -> str:
    def side(hit, extra, missed):
        p, r = f"({hit} / ({hit} + {extra} + 1e-8::double))", f"({hit} / ({hit} + {missed} + 1e-8::double))"
        return f"(2 * {p} * {r} / ({p} + {r} + 1e-8::double))"

    return f"({side('tp', 'fp', 'fn')} + {side('tn', 'fn', 'fp')}) / 2"


@query("e7_masked_binary_f1", f"with {MASKED} select round({masked_f1_sql()}, 6) as f1 from total")
def e7(spark, sf):
    return r6(masked_binary_f1(predictions(spark, sf)), "f1")


@query("e8_masked_binary_accuracy", f"with {MASKED} select round((tp + tn) / (tp + tn + fp + fn + 1e-8::double), 6) as accuracy from total")
def e8(spark, sf):
    return r6(masked_binary_accuracy(predictions(spark, sf)), "accuracy")


@query("f6_masked_state", f"with {MASKED} select item, neg_neg, neg_pos, pos_neg, pos_pos from cells")
def f6(spark, sf):
    return masked_cells(predictions(spark, sf), "item")


def _weights(spark, sf):
    return predictions(spark, sf).groupBy("item").agg(F.avg("truth").alias("f")).select("item", pos_weight(F.col("f")).alias("pos_weight"))


BCE = f"""with {PRED}, w as (select item, (1 - avg(truth)) / (avg(truth) + 1e-8::double) as w from pred group by 1),
  l as (select item, w * truth * ln(1 + exp(-logit)) + (1 - truth) * ln(1 + exp(logit)) as loss from pred join w using (item))"""


@query("e9_weighted_bce", BCE + " select round(avg(loss), 6) as loss from l")
def e9(spark, sf):
    return r6(weighted_bce(predictions(spark, sf), _weights(spark, sf)), "loss")


@query("e9_weighted_bce_per_item", BCE + " select item, round(avg(loss), 6) as loss from l group by 1")
def e9_item(spark, sf):
    return r6(weighted_bce(predictions(spark, sf), _weights(spark, sf), reduce="item"), "loss")


FOCAL = f"""with {PRED}, p as (select *, 1.0::double / (1 + exp(-logit)) as p from pred),
  l as (select item, mask, (0.8 * truth + 0.2 * (1 - truth))::double * pow(1 - (p * truth + (1 - p) * (1 - truth)), 2)
    * (truth * ln(1 + exp(-logit)) + (1 - truth) * ln(1 + exp(logit))) as loss from p)"""


@query("e10_focal_loss", FOCAL + " select round(sum(case when mask then loss else 0 end) / (count(*) filter (where mask) + 1e-8::double), 6) as loss from l")
def e10(spark, sf):
    return r6(focal_loss(predictions(spark, sf)), "loss")


@query("e11_masked_mean", f"""with {PRED} select item, round(sum(case when mask then ln(1 + exp(logit)) else 0 end) / (count(*) filter (where mask) + 1e-8::double), 6) as mean
  from pred group by 1""")
def e11(spark, sf):
    return r6(masked_mean(predictions(spark, sf), softplus(F.col("logit")), F.col("mask"), "item"), "mean")


_target_names = "[" + ", ".join(f"'{t}'" for t in TARGETS) + "]"
_cell_names = [("neg_neg", 0, 0), ("neg_pos", 0, 1), ("pos_neg", 1, 0), ("pos_pos", 1, 1)]


@query("e12_name_metrics", f"with {CELLS} " + " union all ".join(
    f"select 'target_confusion_' || {_target_names}[item + 1] || '_{c}' as name, {c}::double as value from cells" for c, _, _ in _cell_names))
def e12(spark, sf):
    cells = multilabel_confusion(predictions(spark, sf))
    # Eleven rows to one nested array: item by truth by prediction.
    nested = F.array(F.array("neg_neg", "neg_pos"), F.array("pos_neg", "pos_pos"))
    whole = cells.agg(F.transform(F.sort_array(F.collect_list(F.struct("item", nested.alias("m")))), lambda x: x["m"]).alias("value"))
    return name_metrics(whole, "target_confusion_{}_{}_{}", [TARGETS, ["neg", "pos"], ["neg", "pos"]])


def metrics_sql(split_filter: str = "") -> str:
    name = f"{_target_names}[item + 1]"
    cells = f"(select * from cells {split_filter})"
    rows = [f"select split, split || '_target_macro_f1' as name, round(avg({f1_sql()}), 6) as value from {cells} group by split",
            f"select split, split || '_target_micro_f1', round({f1_sql('sum(pos_pos)', 'sum(neg_pos)', 'sum(pos_neg)')}, 6) from {cells} group by split",
            f"select split, split || '_target_f1_' || {name}, round({f1_sql()}, 6) from {cells}"]
    rows += [f"select split, split || '_target_confusion_' || {name} || '_{c}', {c}::double from {cells}" for c, _, _ in _cell_names]
    rows += [f"""select split, split || '_target_loss_' || item, round(avg(truth * ln(1 + exp(-logit)) + (1 - truth) * ln(1 + exp(logit))), 6)
      from (select * from pred {split_filter}) where split <> 'test' group by split, item"""]
    return " union all ".join(rows)


@query("e14_task_metrics", f"with {SPLIT_CELLS} {metrics_sql()}")
def e14_task(spark, sf):
    return r6(task_metrics(predictions(spark, sf), "target", TARGETS), "value")


SPLIT_MASKED = """, masked as (select split,
    sum(case when mask and truth <= 0.5 and logit <= 0 then 1.0 else 0 end)::double as tn, sum(case when mask and truth <= 0.5 and logit > 0 then 1.0 else 0 end)::double as fp,
    sum(case when mask and truth > 0.5 and logit <= 0 then 1.0 else 0 end)::double as fn, sum(case when mask and truth > 0.5 and logit > 0 then 1.0 else 0 end)::double as tp
  from pred group by split)"""

def focal_sql(tokens: str) -> str:
    p = "(1.0::double / (1 + exp(-logit)))"
    loss = f"""(0.8 * truth + 0.2 * (1 - truth))::double * pow(1 - ({p} * truth + (1 - {p}) * (1 - truth)), 2)
      * (truth * ln(1 + exp(-logit)) + (1 - truth) * ln(1 + exp(logit)))"""
    return f"""select split, split || '_rationale_loss', round(sum(case when mask then {loss} else 0 end) / (count(*) filter (where mask) + 1e-8::double), 6)
    from {tokens} where split <> 'test' group by split"""


EVALUATE_SQL = f"""with {SPLIT_CELLS}{SPLIT_MASKED}, {CLASSES}, {class_f1_sql('split')}, {SCORES}
  {metrics_sql()}
  union all select split, split || '_label_f1', round(avg({f1_sql('tp', 'fp', 'fn')}), 6) from per_class group by split
  union all select split, split || '_score_mse', round(avg((pred - truth) * (pred - truth)), 6) from scores group by split
  union all select split, split || '_score_loss', round(avg((pred - truth) * (pred - truth)), 6) from scores where split <> 'test' group by split
  union all select split, split || '_rationale_f1', round({masked_f1_sql()}, 6) from masked
  union all {focal_sql('pred')}"""


@query("e14_evaluate_splits", EVALUATE_SQL)
def e14(spark, sf):
    tokens = predictions(spark, sf)
    return r6(evaluate_splits(
        target=tokens, rationale=tokens, label=class_predictions(spark, sf), score=score_predictions(spark, sf),
        target_names=TARGETS), "value")


REPORT_SQL = f"""with {SPLIT_CELLS}, test as (select * from cells where split = 'test')
  select {_target_names}[item + 1] as name, round({f1_sql()}, 6) as f1 from test
  union all select 'micro', round({f1_sql('sum(pos_pos)', 'sum(neg_pos)', 'sum(pos_neg)')}, 6) from test
  union all select 'macro', round(avg({f1_sql()}), 6) from test"""


@query("e13_merge_partition_results", REPORT_SQL)
def e13(spark, sf):
    return r6(merge_partition_results(results(task_metrics(predictions(spark, sf), "target", TARGETS))), "f1")


# ---- model-facing

def linear_model():
    """A user's model: eleven logits from the first and last dimensions."""
    def predict(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["embedding"].to_numpy()).astype("float64")
        logits = 2.0 * x[:, :11] - x[:, 53:64] + 0.1
        return pd.DataFrame({"logits": list(logits)})

    return predict


@query("r1_score", """select vec_id, cast(k - 1 as int) as item, round(2.0::double * embedding[k]::double - embedding[k + 53]::double + 0.1::double, 6) as logit
  from embeddings, range(1, 12) r(k)""")
def r1(spark, sf):
    out = score(table(spark, sf, "embeddings"), linear_model, ["vec_id"], ["embedding"], "logits array<double>")
    return out.select("vec_id", F.posexplode("logits").alias("item", "logit")).withColumn("logit", F.round("logit", 6))


# The best of three lines through all dimensions, where it leads by a margin.
RULE_MARGIN = 0.15
LINES = """lines as (select vec_id, list_transform(range(0, 3), lambda c: list_sum(list_transform(range(0, 64),
    lambda i: case when i % 3 = c then embedding[i + 1]::double else 0::double end))) as s from embeddings),
  ordered as (select vec_id, s, list_reverse_sort(s) as o from lines)"""


def ruled_labels(spark, sf):
    def line(c):
        terms = F.transform("embedding", lambda x, i: F.when(i % 3 == c, x.cast("double")).otherwise(0.0))
        return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)

    lines = [line(c) for c in range(3)]
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", F.array(*lines).alias("s"))
    best = F.array_position("s", F.array_max("s")) - 1
    second = F.get(F.reverse(F.array_sort("s")), F.lit(1))
    return rows.where(F.array_max("s") - second > RULE_MARGIN).select("vec_id", "embedding", best.cast("int").alias("label"))


@query("r2_fit_label_head", f"""with {LINES} select vec_id, cast(list_position(s, o[1]) - 1 as int) as pred from ordered where o[1] - o[2] > {RULE_MARGIN}""")
def r2(spark, sf):
    """The label is a rule with a margin, so the fitted head must give it back."""
    rows = ruled_labels(spark, sf)
    share = rows.groupBy(F.col("label").alias("item")).agg(F.count(F.lit(1)).alias("c"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    freqs = share.select("item", pos_weight(F.col("c") / total).alias("pos_weight"))
    model = fit_label_head(rows, "embedding", "label", class_weight("label", freqs), max_iter=200, reg=0.0)
    return predict_label(model, rows, "embedding", ["vec_id"]).select("vec_id", "pred")


def _side(i, k):
    """-2 .. 2: the weight of dimension i in the rule of target k."""
    return (i * 7 + k * 3 + i * k) % 5 - 2


def target_rows(spark, sf):
    """Embeddings with eleven 0/1 targets, each the side of a plane with a margin; null within it."""
    def target(k):
        terms = F.transform("embedding", lambda x, i: x.cast("double") * _side(i, k))
        side = F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)
        return F.when(F.abs(side) > RULE_MARGIN, (side > 0).cast("double"))

    return table(spark, sf, "embeddings").withColumns({f"target_{t}": target(k) for k, t in enumerate(TARGETS)})


@query("r3_fit_target_heads", f"""with sides as (select vec_id, cast(k as int) as item,
    list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::double * ((i * 7 + k * 3 + i * k) % 5 - 2))) as s from embeddings, range(0, 11) r(k))
  select vec_id, item, s > 0 as pred from sides where abs(s) > {RULE_MARGIN}""")
def r3(spark, sf):
    """The targets are rules with a margin, so the fitted heads must give them back."""
    rows = target_rows(spark, sf)
    names = [f"target_{t}" for t in TARGETS]
    heads = fit_target_heads(rows, "embedding", names, max_iter=200, reg=0.0)
    known = rows.select("vec_id", F.posexplode(F.array(*names)).alias("item", "truth")).where("truth is not null")
    out = predict_targets(heads, rows, "embedding", ["vec_id"]).select("vec_id", "item", (F.col("logit") > 0).alias("pred"))
    return out.join(known.select("vec_id", "item"), ["vec_id", "item"], "left_semi")


@query("r4_fit_score_head", """select vec_id, round(0.5::double + list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::double * i)), 3) as pred
  from embeddings""")
def r4(spark, sf):
    """The score is a line in the features, so the fitted head must give it back."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", F.aggregate(
        F.transform("embedding", lambda x, i: x.cast("double") * i), F.lit(0.5), lambda acc, v: acc + v).alias("score"))
    model = fit_score_head(rows, "embedding", "score")
    return predict_score(model, rows, "embedding", ["vec_id"]).withColumn("pred", F.round("pred", 3))
