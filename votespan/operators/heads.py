"""Scoring with a user's model, and simple heads on fixed features."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def score(
    df: DataFrame, load_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    keys: Sequence[str], inputs: Sequence[str], out_schema: str,
) -> DataFrame:
    """Batch inference: ``load_model`` runs once per task and gives the prediction function.

    That function maps a frame of the inputs to a frame of ``out_schema``'s columns, row
    by row alike; the keys are put back next to it.
    """
    keys, inputs = list(keys), list(inputs)
    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load_model()
        for frame in frames:
            out = predict(frame[inputs])
            yield pd.concat([frame[keys].reset_index(drop=True), out.reset_index(drop=True)], axis=1)

    return df.select(*dict.fromkeys([*keys, *inputs])).mapInPandas(run, f"{key_schema}, {out_schema}")


def _features(df: DataFrame, features: str, *cols: Column) -> DataFrame:
    return df.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), *cols)


def class_weight(label: str, freqs: DataFrame) -> Column:
    """Weight column of a class column, from rows (item, pos_weight): one row per class."""
    table = freqs.agg(F.map_from_entries(F.collect_list(F.struct("item", "pos_weight")))).scalar()
    return F.try_element_at(table, F.col(label).cast("int"))


def fit_label_head(
    df: DataFrame, features: str, label: str, weight: Column | None = None, max_iter: int = 50, reg: float = 1e-3,
) -> Model:
    """Class head: multinomial logistic regression on a feature array."""
    rows = _features(df, features, F.col(label).cast("double").alias("label"),
                     (F.lit(1.0) if weight is None else weight).alias("weight"))
    return LogisticRegression(
        family="multinomial", weightCol="weight", maxIter=max_iter, regParam=reg).fit(rows)


@dataclass(frozen=True)
class Head:
    """A fitted binary head: logit = coefficients · features + intercept."""

    coefficients: np.ndarray
    intercept: float
    rounds: int


class _Blocks:
    """Rows as (x, y, w) and what one pass over them sums up for all targets together."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def summed(self, of: Callable, n: int, given=None) -> np.ndarray:
        """The sum over all rows of the ``n`` numbers that ``of(x, y, w, given)`` makes of a block."""
        sent = self.rows.sparkSession.sparkContext.broadcast(given)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n)
            for batch in batches:
                x, y, w = (c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in batch.columns)
                if len(x):
                    total += of(x, y, w, sent.value)
            # What a task has seen, a row for each number; equal numbers are added on the way.
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(total)], names=["i", "v"])

        found = self.rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        sent.destroy()
        out = np.zeros(n)
        out[found["i"].to_numpy()] = found["v"].to_numpy()
        return out


def _moments(x, y, w, _):
    """Per target: weight, weighted sum and weighted squares of the features; then positives' weight and squared weights."""
    return np.concatenate([w.sum(axis=0), (w.T @ x).ravel(), (w.T @ (x * x)).ravel(), (w * y).sum(axis=0), (w * w).sum(axis=0)])


def _slopes(x, y, w, given):
    """Per target: loss, gradient and, with ``curved``, the upper half of the curvature, at ``beta``.

    The last feature is the constant.  One product gives all logits, one all gradients.
    """
    beta, curved = given
    x = np.hstack([x, np.ones((len(x), 1))])
    z = x @ beta
    p = 0.5 * (1.0 + np.tanh(0.5 * z))
    loss = (w * (np.logaddexp(0.0, z) - y * z)).sum(axis=0)
    out = [loss, (x.T @ (w * (p - y))).T.ravel()]
    if curved:
        upper = np.triu_indices(x.shape[1])
        out += [((x * (w * p * (1.0 - p))[:, t : t + 1]).T @ x)[upper] for t in range(w.shape[1])]
    return np.concatenate(out)


def _bound(x, y, w, _):
    """Upper half of the products of the features, each row with its largest weight: four times a bound of every curvature."""
    x = np.hstack([x, np.ones((len(x), 1))])
    return ((x * w.max(axis=1, keepdims=True)).T @ x)[np.triu_indices(x.shape[1])]


def _full(upper: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    out[np.triu_indices(n)] = upper
    return out + np.triu(out, 1).T


def fit_target_heads(
    df: DataFrame, features: str, targets: Sequence[str], weights: dict[str, float] | None = None,
    max_iter: int = 50, reg: float = 1e-3, tolerance: float = 1e-8, most_curvature: int = 1 << 22,
) -> dict[str, Head]:
    """One binary head per target column; positives weighted if weights are given.

    All heads are fitted together: a round is one pass over the rows, whose features meet the
    coefficients of every target in one product.  Steps are Newton's, halved for a head whose
    loss would grow; where the curvatures of all targets would be more than ``most_curvature``
    numbers, one common bound of them is summed up once and steps are taken by that.  The mean
    loss has half of ``reg`` times the squared coefficients of standardised features added.
    Rows whose target is null, or whose features are, take no part in its fit; a target without
    rows of both sides gets its share's log odds (bounded) and no coefficients.
    """
    targets = list(targets)
    k = len(targets)
    positive = [F.coalesce((F.col(t) > 0.5).cast("double"), F.lit(0.0)) for t in targets]
    weight = [F.when(F.col(t).isNull(), 0.0).when(F.col(t) > 0.5, (weights or {}).get(t, 1.0)).otherwise(1.0) for t in targets]
    shared = df.select(
        F.col(features).cast("array<double>").alias("x"), F.array(*positive).alias("y"), F.array(*weight).alias("w")).where("x is not null").persist()
    try:
        first = shared.select(F.size("x")).first()
        if first is None:
            return {t: Head(np.zeros(0), 0.0, 0) for t in targets}
        d = first[0]
        blocks = _Blocks(shared)
        total, sums, squares, hits, doubled = np.split(
            blocks.summed(_moments, 3 * k + 2 * k * d), np.cumsum([k, k * d, k * d, k]))
        safe = np.maximum(total, 1e-300)[:, None]
        sums, squares = sums.reshape(k, d), squares.reshape(k, d)
        # The unbiased variance under weights, by which features are standardised.
        free = np.maximum(safe - doubled[:, None] / safe, 1e-300)
        spread = np.maximum(squares - sums * sums / safe, 0.0) / free
        penalty = np.hstack([reg * spread, np.zeros((k, 1))])
        share = np.clip(hits / safe[:, 0], 1e-9, 1.0 - 1e-9)
        open_ = (hits > 0) & (hits < total)

        n, half = d + 1, (d + 1) * (d + 2) // 2
        curved = k * half <= most_curvature
        common = None if curved else _full(blocks.summed(_bound, half), n) / 4.0
        beta = np.zeros((k, n))
        beta[:, -1] = np.log(share / (1.0 - share))
        kept, kept_loss = beta.copy(), np.full(k, np.inf)
        step, direction, rounds = np.ones(k), np.zeros((k, n)), np.zeros(k, int)
        for _ in range(max_iter):
            out = blocks.summed(_slopes, k + k * n + (k * half if curved else 0), (beta.T, curved))
            loss = out[:k] / safe[:, 0] + 0.5 * (penalty * beta * beta).sum(axis=1)
            slope = out[k : k + k * n].reshape(k, n) / safe + penalty * beta
            worse = open_ & ~(loss <= kept_loss + 1e-12 * np.abs(kept_loss))
            for t in np.flatnonzero(open_):
                if worse[t]:
                    step[t] /= 2.0
                else:
                    drop = kept_loss[t] - loss[t]
                    kept[t], kept_loss[t], step[t] = beta[t], loss[t], 1.0
                    curvature = _full(out[k + k * n + t * half :][:half], n) if curved else common
                    curvature = curvature / safe[t] + np.diag(penalty[t])
                    # A trace of the diagonal keeps directions without curvature finite.
                    curvature[np.diag_indices(n)] += 1e-10 * max(np.trace(curvature) / n, 1e-300)
                    direction[t] = np.linalg.solve(curvature, -slope[t])
                    open_[t] = np.abs(slope[t]).max() > tolerance and not drop < tolerance * 1e-4 * kept_loss[t]
                rounds[t] += 1
                open_[t] &= step[t] > 1e-6
                beta[t] = kept[t] + step[t] * direction[t] if open_[t] else kept[t]
            if not open_.any():
                break
        return {t: Head(kept[i, :-1], float(kept[i, -1]), int(rounds[i])) for i, t in enumerate(targets)}
    finally:
        shared.unpersist()


def fit_score_head(df: DataFrame, features: str, target: str) -> Model:
    """Regression head with squared error, solved from the normal equations."""
    rows = _features(df, features, F.col(target).cast("double").alias("label"))
    return LinearRegression(solver="normal").fit(rows)


def predict_label(model: Model, df: DataFrame, features: str, keys: Sequence[str]) -> DataFrame:
    """(keys, logits, pred) of a class head."""
    out = model.transform(_features(df, features, *keys))
    return out.select(*keys, vector_to_array("rawPrediction").alias("logits"), F.col("prediction").cast("int").alias("pred"))


def predict_targets(heads: dict[str, Head], df: DataFrame, features: str, keys: Sequence[str]) -> DataFrame:
    """(keys, item, target, logit): every head's logit in one pass over the features."""
    def logit(model: Head) -> Column:
        terms = F.zip_with(
            F.col(features).cast("array<double>"), F.array(*[F.lit(float(c)) for c in model.coefficients]),
            lambda a, b: a * b)
        return F.aggregate(terms, F.lit(float(model.intercept)), lambda acc, t: acc + t)

    entries = F.array(*[
        F.struct(F.lit(i).alias("item"), F.lit(t).alias("target"), logit(m).alias("logit"))
        for i, (t, m) in enumerate(heads.items())])
    return df.select(*keys, F.inline(entries))


def predict_score(model: Model, df: DataFrame, features: str, keys: Sequence[str]) -> DataFrame:
    out = model.transform(_features(df, features, *keys))
    return out.select(*keys, F.col("prediction").alias("pred"))
