"""From raw model outputs to the metrics record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from votespan.functions.arrays import bind
from votespan.functions.columns import argmax, gate_tokens
from votespan.operators.metrics import CELLS, EPS, UNTRAINED, binary_f1, f1, focal, softplus


#: What is summed for every item of a task; the tasks use them as they need.
SUMS = "task string, item int, " + ", ".join(f"{c} bigint" for c in CELLS) + ", pos_loss double, neg_loss double, n double"


def _cells(hard: Column, pred: Column, on: Column) -> list[Column]:
    """1 in the confusion cell a pair falls in, 0 in the others."""
    sides = {"neg": lambda x: ~x, "pos": lambda x: x}
    return [(sides[c[:3]](hard) & sides[c[4:]](pred) & on).cast("bigint").alias(c) for c in CELLS]


def _entry(task: str, item: Column, cells: Sequence[Column] | None = None, pos_loss=0.0, neg_loss=0.0, n=0.0) -> Column:
    """An element with the fields of ``SUMS``."""
    number = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    cells = cells or [F.lit(0).cast("bigint")] * len(CELLS)
    return F.struct(
        F.lit(task).alias("task"), item.cast("int").alias("item"), *[c.alias(k) for c, k in zip(cells, CELLS)],
        number(pos_loss).alias("pos_loss"), number(neg_loss).alias("neg_loss"), number(n).alias("n"))


def _item_entries(task: str, n: int, logits: str, truths: str) -> Column:
    """Per item of two arrays the confusion cell and both halves of the log loss."""
    def one(i: Column) -> Column:
        def of(pair: Column) -> Column:
            z, y = pair["z"], pair["y"]
            return _entry(task, i, _cells(y > 0.5, z > 0, F.lit(True)), y * softplus(-z), (1.0 - y) * softplus(z), (z * y).isNotNull())

        # Bound once: an expression inside a lambda is evaluated wherever it stands.
        return bind(F.struct(F.get(logits, i).cast("double").alias("z"), F.get(truths, i).cast("double").alias("y")), of)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


def _token_entry(logits: str, truths: str, mask: Column, alpha: float, gamma: float) -> Column:
    """Confusion counts, focal loss and number of a row's masked tokens."""
    zero = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in CELLS], F.lit(0.0).alias("loss"), F.lit(0.0).alias("n"))
    tokens = F.transform(logits, lambda z, i: F.struct(
        z.cast("double").alias("z"), F.get(truths, i).cast("double").alias("y"), F.coalesce(F.get(mask, i), F.lit(False)).alias("m")))

    def add(acc: Column, t: Column) -> Column:
        counted = _cells(t["y"] > 0.5, t["z"] > 0, t["m"])
        return F.struct(
            *[(acc[c] + F.coalesce(x, F.lit(0))).alias(c) for c, x in zip(CELLS, counted)],
            (acc["loss"] + F.when(t["m"], F.coalesce(focal(t["z"], t["y"], alpha, gamma), F.lit(0.0))).otherwise(0.0)).alias("loss"),
            (acc["n"] + t["m"].cast("double")).alias("n"))

    return bind(F.aggregate(tokens, zero, add), lambda t: _entry("rationale", F.lit(0), [t[c] for c in CELLS], t["loss"], 0.0, t["n"]))


def _total(rows: Column, of) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda a, x: a + F.coalesce(of(x).cast("double"), F.lit(0.0)))


def _f1_of(x: Column) -> Column:
    return f1(x["pos_pos"].cast("double"), x["neg_pos"].cast("double"), x["pos_neg"].cast("double"))


def evaluate(
    outputs: DataFrame, target_names: Sequence[str] | None = None, split: str = "split", n_labels: int = 3,
    target_freqs: Sequence[float] | None = None, label_freqs: Sequence[float] | None = None,
    alpha: float = 0.8, gamma: float = 2.0, no_loss: Sequence[str] = UNTRAINED,
) -> DataFrame:
    """(split, name, value) of the tasks whose output columns are there, from one reading.

    Columns by task: ``target_logits``/``target`` (as many as ``target_names``),
    ``label_logits``/``label`` (``n_labels``), ``score_pred``/``score`` and
    ``rationale_logits``/``rationale``/``mask`` (dense token arrays, with ``label`` scores).
    A row becomes one small row of sums for each of its items; those are added up by split and
    item before the shuffle, and every metric and loss follows from the sums.  The plan is as
    long for a thousand labels as for three.  Shares of positives weigh the log losses; the
    splits ``no_loss`` report no losses.
    """
    have, names = set(outputs.columns), list(target_names or [])
    entries, values = [], []

    def of_task(task: str) -> Column:
        return F.filter("_sums", lambda x: x["task"] == task)

    def told(name: Column, value: Column, loss: bool = False) -> Column:
        return F.struct(
            F.concat(F.col(split), F.lit("_"), name).alias("name"), value.cast("double").alias("value"), F.lit(not loss).alias("always"))

    def log_loss(x: Column, freqs: Sequence[float] | None) -> Column:
        weight = F.lit(1.0) if freqs is None else F.get(F.array(*[F.lit((1.0 - f) / (f + EPS)) for f in freqs]), x["item"])
        return weight * x["pos_loss"] + x["neg_loss"]

    if {"target_logits", "target"} <= have:
        if not names:
            raise ValueError("targets need their names")
        entries.append(_item_entries("target", len(names), "target_logits", "target"))
        items, named = of_task("target"), F.array(*[F.lit(n) for n in names])
        pooled = f1(*[_total(items, lambda x, c=c: x[c]) for c in ("pos_pos", "neg_pos", "pos_neg")])
        values += [
            F.array(told(F.lit("target_macro_f1"), _total(items, _f1_of) / len(names)), told(F.lit("target_micro_f1"), pooled)),
            F.flatten(F.transform(items, lambda x: F.array(
                told(F.concat(F.lit("target_f1_"), F.get(named, x["item"])), _f1_of(x)),
                *[told(F.concat(F.lit("target_confusion_"), F.get(named, x["item"]), F.lit(f"_{c}")), x[c]) for c in CELLS],
                told(F.concat(F.lit("target_loss_"), x["item"].cast("string")), F.try_divide(log_loss(x, target_freqs), x["n"]), True))))]
    if {"label_logits", "label"} <= have:
        entries.append(_item_entries("label", n_labels, "label_logits", "label"))
        # Which class was taken for which.
        entries.append(F.array(_entry("seen", argmax(F.col("label")) * n_labels + argmax(F.col("label_logits")), n=1.0)))
        seen, items = of_task("seen"), of_task("label")

        def class_f1(i: Column) -> Column:
            def count(hit) -> Column:
                return _total(F.filter(seen, hit), lambda x: x["n"])

            true, taken = (lambda x: F.floor(x["item"] / n_labels) == i), (lambda x: x["item"] % n_labels == i)
            counts = F.struct(
                count(lambda x: true(x) & taken(x)).alias("tp"), count(lambda x: ~true(x) & taken(x)).alias("fp"),
                count(lambda x: true(x) & ~taken(x)).alias("fn"))
            return bind(counts, lambda c: F.when(c["tp"] + c["fp"] + c["fn"] > 0, f1(c["tp"], c["fp"], c["fn"])))

        scores = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_labels - 1)), class_f1), lambda x: x.isNotNull())
        values.append(F.array(
            told(F.lit("label_f1"), F.try_divide(_total(scores, lambda x: x), F.size(scores))),
            told(F.lit("label_loss"), F.try_divide(_total(items, lambda x: log_loss(x, label_freqs)), _total(items, lambda x: x["n"])), True)))
    if {"score_pred", "score"} <= have:
        gap = F.col("score_pred").cast("double") - F.col("score").cast("double")
        entries.append(F.array(_entry("score", F.lit(0), None, gap * gap, 0.0, gap.isNotNull())))
        squares = F.try_divide(_total(of_task("score"), lambda x: x["pos_loss"]), _total(of_task("score"), lambda x: x["n"]))
        values.append(F.array(told(F.lit("score_mse"), squares), told(F.lit("score_loss"), squares, True)))
    if {"rationale_logits", "rationale", "mask", "label"} <= have:
        gated = gate_tokens(F.col("mask"), [F.get("label", F.lit(i)) for i in (0, 1)])
        entries.append(F.array(_token_entry("rationale_logits", "rationale", gated, alpha, gamma)))
        tokens = F.get(of_task("rationale"), F.lit(0))
        values.append(F.array(
            told(F.lit("rationale_f1"), binary_f1(lambda c: tokens[c])),
            told(F.lit("rationale_loss"), tokens["pos_loss"] / (tokens["n"] + EPS), True)))
    if not entries:
        raise ValueError("no task has its columns")
    fields = [f.split()[0] for f in SUMS.split(", ")]
    per_item = outputs.select(split, F.inline(F.concat(*entries))).groupBy(split, "task", "item").agg(
        *[F.sum(c).alias(c) for c in fields[2:]])
    folded = per_item.groupBy(split).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_sums"))
    return folded.select(split, F.inline(F.concat(*values))).filter(
        F.col("always") | ~F.col(split).isin(*no_loss)).drop("always")
