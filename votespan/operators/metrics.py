"""Evaluation metrics as sums over a prediction table.

A long prediction table has one row per (row, item) with ``logit``, ``truth`` and
optionally ``mask``.  Every metric is a grouped sum followed by a formula on the few
rows left, so hot items are folded before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from votespan.functions.columns import as_list, harden

EPS = 1e-8
CELLS = ("neg_neg", "neg_pos", "pos_neg", "pos_pos")  # truth, prediction


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2TP / (2TP + FP + FN), 0 where nothing was true or predicted."""
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def cell_f1() -> Column:
    return f1(F.col("pos_pos"), F.col("neg_pos"), F.col("pos_neg"))


def cell_counts(hard: Column, pred: Column, mask: Column | None = None) -> list[Column]:
    """The four confusion counts, over masked rows if there is a mask."""
    on = F.lit(True) if mask is None else mask
    truths = {"neg": ~hard, "pos": hard}
    preds = {"neg": ~pred, "pos": pred}
    return [
        F.count_if(truths[c[:3]] & preds[c[4:]] & on).alias(c) for c in CELLS
    ]


def multilabel_confusion(pred: DataFrame, by="item", mask: str | None = None) -> DataFrame:
    """Confusion counts per group, named ``<truth>_<prediction>``."""
    rows = harden(pred)
    return rows.groupBy(*as_list(by)).agg(
        *cell_counts(F.col("hard"), F.col("pred"), F.col(mask) if mask else None))


def multilabel_f1(pred: DataFrame, average: str = "none", item: str = "item", by=()) -> DataFrame:
    """F1 per label (``none``), their mean (``macro``) or from pooled counts (``micro``)."""
    cells = multilabel_confusion(pred, [*as_list(by), item])
    if average == "none":
        return cells.select(*as_list(by), item, cell_f1().alias("f1"))
    if average == "macro":
        return cells.groupBy(*as_list(by)).agg(F.avg(cell_f1()).alias("f1"))
    if average == "micro":
        return cells.groupBy(*as_list(by)).agg(
            f1(F.sum("pos_pos"), F.sum("neg_pos"), F.sum("pos_neg")).alias("f1"))
    raise ValueError(average)


def multiclass_macro_f1(pred: DataFrame, truth: str = "truth", guess: str = "pred", by=()) -> DataFrame:
    """Mean F1 over the classes that occur as truth or prediction."""
    by = as_list(by)
    cells = pred.groupBy(*by, truth, guess).agg(F.count(F.lit(1)).alias("n"))
    same = F.col(truth) == F.col(guess)
    sides = F.array(
        F.struct(F.col(truth).alias("class"), F.when(same, F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("fp"), F.when(~same, F.col("n")).otherwise(0).alias("fn")),
        F.struct(F.col(guess).alias("class"), F.lit(0).cast("bigint").alias("tp"),
                 F.when(~same, F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("bigint").alias("fn")))
    per_class = (cells.select(*by, F.inline(sides)).groupBy(*by, "class")
                 .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))
    return per_class.groupBy(*by).agg(
        F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("f1"))


def mse(pred: DataFrame, guess: str = "pred", truth: str = "truth", by=()) -> DataFrame:
    gap = F.col(guess).cast("double") - F.col(truth).cast("double")
    return pred.groupBy(*as_list(by)).agg(F.avg(gap * gap).alias("mse"))


def masked_cells(pred: DataFrame, by=(), mask: str = "mask") -> DataFrame:
    """Sum-reduced state of the masked token metrics."""
    return multilabel_confusion(pred, by, mask)


def _ratio(a: Column, b: Column) -> Column:
    return a / (b + F.lit(EPS))


def binary_f1(of: Callable[[str], Column] = F.col) -> Column:
    """Mean of the positive and the negative class's F1 from the four counts."""
    tp, tn, fp, fn = (of(c).cast("double") for c in ("pos_pos", "neg_neg", "neg_pos", "pos_neg"))

    def score(hit: Column, extra: Column, missed: Column) -> Column:
        precision, recall = _ratio(hit, hit + extra), _ratio(hit, hit + missed)
        return _ratio(2.0 * precision * recall, precision + recall)

    return (score(tp, fp, fn) + score(tn, fn, fp)) / 2.0


def masked_binary_f1(pred: DataFrame, by=(), mask: str = "mask") -> DataFrame:
    """Mean of the positive and the negative class's F1 over masked tokens."""
    return masked_cells(pred, by, mask).select(*as_list(by), binary_f1().alias("f1"))


def masked_binary_accuracy(pred: DataFrame, by=(), mask: str = "mask") -> DataFrame:
    right = F.col("pos_pos") + F.col("neg_neg")
    wrong = F.col("neg_pos") + F.col("pos_neg")
    return masked_cells(pred, by, mask).select(
        *as_list(by), _ratio(right, right + wrong).alias("accuracy"))


def softplus(z: Column) -> Column:
    """ln(1 + e^z) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def weighted_bce(
    pred: DataFrame, weights: DataFrame | None = None, item: str = "item", reduce: str = "all", mask: str | None = None,
) -> DataFrame:
    """Log loss from logits, positives weighted per item; the mean over all or per item.

    An item's weight factors out of its sums, so the weights meet the one row per item
    that is left after the grouping, never the predictions.  An item without a weight has
    weight 1.  With ``mask`` only the masked rows count; the mean over none of them is null.
    """
    if reduce not in ("all", "item"):
        raise ValueError(reduce)
    z, y = F.col("logit"), F.col("truth")
    rows = pred if mask is None else pred.filter(F.col(mask))
    sums = rows.groupBy(item).agg(
        F.sum(y * softplus(-z)).alias("pos"), F.sum((1.0 - y) * softplus(z)).alias("neg"),
        F.count(z * y).alias("n"))
    if weights is not None:
        sums = sums.join(weights.select(item, "pos_weight"), item, "left").withColumn(
            "pos_weight", F.coalesce("pos_weight", F.lit(1.0)))
    else:
        sums = sums.withColumn("pos_weight", F.lit(1.0))
    loss = F.col("pos_weight") * F.col("pos") + F.col("neg")
    if reduce == "item":
        return sums.select(item, F.try_divide(loss, F.col("n")).alias("loss"))
    return sums.agg(F.try_divide(F.sum(loss), F.sum("n")).alias("loss"))


def focal(z: Column, y: Column, alpha: float = 0.8, gamma: float = 2.0) -> Column:
    """Focal loss of a row: alpha_t (1 - p_t)^gamma bce; truths may be soft."""
    p = F.lit(1.0) / (1.0 + F.exp(-z))
    p_t = p * y + (1.0 - p) * (1.0 - y)
    alpha_t = alpha * y + (1.0 - alpha) * (1.0 - y)
    bce = y * softplus(-z) + (1.0 - y) * softplus(z)
    return alpha_t * F.pow(1.0 - p_t, F.lit(float(gamma))) * bce


def masked_mean(df: DataFrame, value: Column, mask: Column | None = None, by=(), out: str = "mean") -> DataFrame:
    """sum(v·m) / (sum(m) + 1e-8); the plain mean without a mask."""
    if mask is None:
        return df.groupBy(*as_list(by)).agg(F.avg(value).alias(out))
    on = mask.cast("double")
    return df.groupBy(*as_list(by)).agg(
        (F.sum(value * on) / (F.sum(on) + F.lit(EPS))).alias(out))


def focal_loss(
    pred: DataFrame, alpha: float = 0.8, gamma: float = 2.0, mask: str | None = "mask", by=(),
) -> DataFrame:
    value = focal(F.col("logit"), F.col("truth"), alpha, gamma)
    return masked_mean(pred, value, F.col(mask) if mask else None, by, "loss")


def name_metrics(df: DataFrame, template: str, axes: Sequence[Sequence[str]], value: str = "value", keys=()) -> DataFrame:
    """A scalar, array or nested array of metrics to rows (name, value).

    ``template`` has one ``{}`` per axis, filled with the axis's label at each position.
    An axis whose size differs from its labels fails the query.
    """
    if template.count("{}") != len(axes):
        raise ValueError(f"{template!r} does not have {len(axes)} axes")
    keys = as_list(keys)
    rows = df.select(*keys, F.col(value).cast("double") if not axes else F.col(value))
    rows = rows.withColumnRenamed(rows.columns[-1], "value")
    for axis, labels in enumerate(axes):
        checked = F.when(F.size("value") == len(labels), F.col("value")).otherwise(
            F.raise_error(F.concat(F.lit(f"axis {axis} has {len(labels)} labels, not "), F.size("value").cast("string"))))
        names = F.array(*[F.lit(x) for x in labels])
        at, kept = f"_at{axis}", [f"_at{i}" for i in range(axis)]
        rows = (rows.select(*keys, *kept, F.posexplode(checked).alias("_i", "value"))
                .select(*keys, *kept, F.get(names, F.col("_i")).alias(at), "value"))
    name = F.format_string(template.replace("%", "%%").replace("{}", "%s"), *[F.col(f"_at{i}") for i in range(len(axes))]) \
        if axes else F.lit(template)
    return rows.select(*keys, name.alias("name"), F.col("value").cast("double").alias("value"))


#: Splits whose loss is not reported.
UNTRAINED = ("test",)


def _weight_of(freqs: Sequence[float] | None, item: Column) -> Column:
    """Weight of a positive: negatives over positives, 1 without shares."""
    if freqs is None:
        return F.lit(1.0)
    return F.get(F.array(*[F.lit((1.0 - f) / (f + EPS)) for f in freqs]), item)


def item_sums(pred: DataFrame, by: Sequence[str], mask: str | None = None) -> DataFrame:
    """What all multi-label metrics are made of, a row per group: confusion counts, both halves of
    the log loss and the number of rows.  One aggregation, so streams take it too."""
    z, y = F.col("logit"), F.col("truth")
    rows = harden(pred if mask is None else pred.filter(F.col(mask)))
    return rows.groupBy(*as_list(by)).agg(
        *cell_counts(F.col("hard"), F.col("pred")), F.sum(y * softplus(-z)).alias("pos_loss"),
        F.sum((1.0 - y) * softplus(z)).alias("neg_loss"), F.count(z * y).alias("n"))


def metrics_of(
    cells: DataFrame, task: str, names: Sequence[str] | None = None, split: str = "split", item: str = "item",
    freqs: Sequence[float] | None = None, no_loss: Sequence[str] = UNTRAINED,
) -> DataFrame:
    """(split, name, value) of every multi-label metric, from ``item_sums`` by split and item."""
    label = F.get(F.array(*[F.lit(n) for n in names]), F.col(item)) if names else F.col(item).cast("string")

    def entry(name: Column, value: Column) -> Column:
        prefix = F.concat(F.col(split), F.lit(f"_{task}_"))
        return F.struct(F.concat(prefix, name).alias("name"), value.cast("double").alias("value"))

    loss = F.try_divide(_weight_of(freqs, F.col(item)) * F.col("pos_loss") + F.col("neg_loss"), F.col("n"))
    # One element per label and split: as long as the list of labels.
    per_label = F.collect_list(F.struct(
        label.alias("label"), cell_f1().alias("f1"), loss.alias("loss"), F.col(item).cast("string").alias("item"), *CELLS))
    pooled = f1(F.sum("pos_pos"), F.sum("neg_pos"), F.sum("pos_neg"))
    folded = cells.groupBy(split).agg(
        F.avg(cell_f1()).alias("macro"), pooled.alias("micro"), per_label.alias("labels"))
    losses = F.transform("labels", lambda x: entry(F.concat(F.lit("loss_"), x["item"]), x["loss"]))
    entries = F.concat(
        F.array(entry(F.lit("macro_f1"), F.col("macro")), entry(F.lit("micro_f1"), F.col("micro"))),
        F.transform("labels", lambda x: entry(F.concat(F.lit("f1_"), x["label"]), x["f1"])),
        F.flatten(F.transform("labels", lambda x: F.array(*[
            entry(F.concat(F.lit("confusion_"), x["label"], F.lit(f"_{c}")), x[c]) for c in CELLS]))),
        F.when(~F.col(split).isin(*no_loss), losses).otherwise(F.slice(losses, 1, 0)))
    return folded.select(split, F.inline(entries))


def task_metrics(
    pred: DataFrame, task: str, names: Sequence[str] | None = None, split: str = "split", item: str = "item",
    freqs: Sequence[float] | None = None, no_loss: Sequence[str] = UNTRAINED,
) -> DataFrame:
    """(split, name, value) of every multi-label metric, from one pass over the predictions.

    Names are ``<split>_<task>_macro_f1``, ``…_micro_f1``, ``…_f1_<label>``,
    ``…_confusion_<label>_<truth>_<prediction>`` and, but for the splits ``no_loss``,
    ``…_loss_<item>``; labels are ``names`` by item or the item.  ``freqs`` are the shares of
    positives that weigh the log loss.
    """
    return metrics_of(item_sums(pred, [split, item]), task, names, split, item, freqs, no_loss)


def evaluate_splits(
    target: DataFrame | None = None, label: DataFrame | None = None,
    score: DataFrame | None = None, rationale: DataFrame | None = None,
    target_names: Sequence[str] | None = None, split: str = "split", target_freqs: Sequence[float] | None = None,
    no_loss: Sequence[str] = UNTRAINED,
) -> DataFrame:
    """Metrics and losses of every given task per split, as rows (split, name, value).

    ``target`` and ``rationale`` are long predictions, ``label`` has classes ``truth`` and
    ``pred`` (and so no loss), ``score`` has numbers ``truth`` and ``pred``.  The splits
    ``no_loss`` report no losses.
    """
    def named(df: DataFrame, *values: tuple[str, str, bool]) -> DataFrame:
        """A row for each (name, column, whether it is a loss)."""
        rows = df.select(split, F.inline(F.array(*[F.struct(
            F.concat(F.col(split), F.lit(f"_{name}")).alias("name"), F.col(value).cast("double").alias("value"),
            F.lit(loss).alias("loss")) for name, value, loss in values])))
        return rows.filter(~F.col("loss") | ~F.col(split).isin(*no_loss)).drop("loss")

    parts = []
    if target is not None:
        parts.append(task_metrics(target, "target", target_names, split, freqs=target_freqs, no_loss=no_loss))
    if label is not None:
        parts.append(named(multiclass_macro_f1(label, by=split), ("label_f1", "f1", False)))
    if score is not None:
        parts.append(named(mse(score, by=split), ("score_mse", "mse", False), ("score_loss", "mse", True)))
    if rationale is not None:
        rows = harden(rationale)
        on = F.col("mask")
        sums = rows.groupBy(split).agg(
            *cell_counts(F.col("hard"), F.col("pred"), on),
            F.sum(focal(F.col("logit"), F.col("truth")) * on.cast("double")).alias("_focal"), F.sum(on.cast("double")).alias("_masked"))
        scores = sums.select(split, binary_f1().alias("f1"), (F.col("_focal") / (F.col("_masked") + F.lit(EPS))).alias("loss"))
        parts.append(named(scores, ("rationale_f1", "f1", False), ("rationale_loss", "loss", True)))
    if not parts:
        raise ValueError("no predictions given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def results(metrics: DataFrame, split: str = "test") -> DataFrame:
    """The final record: every metric of one split as (name, value)."""
    return metrics.filter(F.col("split") == split).select("name", "value")
