import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from votespan.operators.heads import (
    class_weight, fit_label_head, fit_score_head, fit_target_heads, predict_label, predict_score, predict_targets, score,
)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = x @ np.array([1.0, -2.0, 0.5]) + 0.25
    label = np.argmax(x, axis=1)
    data = [(i, [float(v) for v in x[i]], float(y[i]), int(label[i]), float(x[i, 0] > 0), float(x[i, 1] > 0.3)) for i in range(300)]
    return spark.createDataFrame(data, "id int, x array<double>, y double, label int, t0 double, t1 double").cache()


def test_score_loads_once_per_task(points):
    def load():
        def predict(frame):
            return pd.DataFrame({"total": np.stack(frame["x"].to_numpy()).sum(axis=1)})
        return predict

    got = score(points, load, ["id"], ["x"], "total double")
    want = points.select("id", F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"))
    assert [r[1] for r in rows(got)] == pytest.approx([r[1] for r in rows(want)])
    assert got.columns == ["id", "total"]


def test_score_head_solves_the_line(points):
    model = fit_score_head(points, "x", "y")
    assert list(model.coefficients) == pytest.approx([1.0, -2.0, 0.5]) and model.intercept == pytest.approx(0.25)
    gap = predict_score(model, points, "x", ["id", "y"]).select(F.max(F.abs(F.col("pred") - F.col("y")))).first()[0]
    assert gap < 1e-9


def test_label_head(points, spark):
    weights = spark.createDataFrame([(0, 2.0), (1, 1.0), (2, 1.0)], "item int, pos_weight double")
    model = fit_label_head(points, "x", "label", class_weight("label", weights))
    right = predict_label(model, points, "x", ["id", "label"]).filter("pred = label").count()
    assert right > 270


def test_target_heads(points):
    heads = fit_target_heads(points, "x", ["t0", "t1"], weights={"t0": 1.5})
    got = predict_targets(heads, points, "x", ["id", "t0", "t1"])
    assert got.count() == 600
    right = got.filter(((F.col("logit") > 0).cast("double")) == F.when(F.col("item") == 0, F.col("t0")).otherwise(F.col("t1"))).count()
    assert right > 560
    mine = got.filter("item = 0 and id = 5").first().logit
    x = points.filter("id = 5").first().x
    assert mine == pytest.approx(float(np.dot(heads["t0"].coefficients, x) + heads["t0"].intercept))


def alone(df, features, target, weight, reg):
    """The same head by the library's own fit, one target at a time."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows_ = df.where(F.col(target).isNotNull()).select(
        array_to_vector(features).alias("features"), F.col(target).alias("label"), F.when(F.col(target) > 0.5, weight).otherwise(1.0).alias("weight"))
    return LogisticRegression(family="binomial", weightCol="weight", maxIter=500, tol=1e-12, regParam=reg).fit(rows_)


@pytest.mark.parametrize("most_curvature", [1 << 22, 0])
def test_heads_fitted_together_equal_heads_fitted_alone(spark, most_curvature):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) * np.array([1.0, 10.0, 0.1, 1.0]) + np.array([0.0, 5.0, 0.0, -1.0])
    logit = np.stack([x @ [1.0, 0.1, 3.0, 0.0] + 0.3, x @ [0.0, -0.2, 1.0, 1.0] - 1.0], axis=1)
    y = (rng.random(logit.shape) < 1 / (1 + np.exp(-logit))).astype(float)
    data = [([float(v) for v in x[i]], float(y[i, 0]), None if i % 5 == 0 else float(y[i, 1]), 1.0, None) for i in range(400)]
    df = spark.createDataFrame(data, "x array<double>, a double, b double, every double, none double").repartition(3)
    heads = fit_target_heads(df, "x", ["a", "b", "every", "none"], {"b": 2.5}, max_iter=3000, reg=0.01, most_curvature=most_curvature)
    for target, weight in (("a", 1.0), ("b", 2.5)):
        model = alone(df, "x", target, weight, 0.01)
        assert list(heads[target].coefficients) == pytest.approx(list(model.coefficients), abs=2e-4)
        assert heads[target].intercept == pytest.approx(model.intercept, abs=2e-4)
    # A target without both sides has nothing to tell apart.
    assert not heads["every"].coefficients.any() and heads["every"].intercept > 20
    assert not heads["none"].coefficients.any() and heads["none"].intercept < -20


def test_rounds_are_passes(points, monkeypatch):
    from votespan.operators import heads as module

    passes = []
    summed = module._Blocks.summed
    monkeypatch.setattr(module._Blocks, "summed", lambda self, of, n, given=None: passes.append(of) or summed(self, of, n, given))
    heads = fit_target_heads(points, "x", ["t0", "t1"])
    assert len(passes) == 1 + max(h.rounds for h in heads.values()) <= 20


def test_heads_of_no_rows(spark):
    df = spark.createDataFrame([], "x array<double>, a double")
    assert fit_target_heads(df, "x", ["a"])["a"].coefficients.size == 0
