import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from votespan.operators.metrics import (
    evaluate_splits, focal_loss, masked_binary_accuracy, masked_binary_f1, masked_mean, mse, multiclass_macro_f1,
    multilabel_confusion, multilabel_f1, name_metrics, results, task_metrics, weighted_bce,
)
from votespan.plans.evaluate import evaluate

N, K = 300, 4


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(N, K)) * 3
    truths = (rng.random((N, K)) < 0.3).astype(float)
    truths[:, 3] = 0.0
    logits[:, 3] = -1.0  # a label nobody has and nobody predicts
    return logits, truths, rng.random((N, K)) < 0.7


@pytest.fixture(scope="module")
def pred(spark, data):
    logits, truths, mask = data
    flat = [(i, j, float(logits[i, j]), float(truths[i, j]), bool(mask[i, j]), ["train", "valid", "test"][i % 3])
            for i in range(N) for j in range(K)]
    return spark.createDataFrame(flat, "row int, item int, logit double, truth double, mask boolean, split string").cache()


def f1_of(p, t):
    tp, fp, fn = (p & t).sum(), (p & ~t).sum(), (~p & t).sum()
    return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0


def test_multilabel(pred, data):
    p, t = data[0] > 0, data[1] > 0.5
    got = rows(multilabel_confusion(pred), "item", "neg_neg", "neg_pos", "pos_neg", "pos_pos")
    assert got == [(j, int((~p & ~t)[:, j].sum()), int((p & ~t)[:, j].sum()), int((~p & t)[:, j].sum()), int((p & t)[:, j].sum())) for j in range(K)]
    each = [f1_of(p[:, j], t[:, j]) for j in range(K)]
    assert [r[1] for r in rows(multilabel_f1(pred))] == pytest.approx(each) and each[3] == 0.0
    assert multilabel_f1(pred, "macro").first()[0] == pytest.approx(np.mean(each))
    assert multilabel_f1(pred, "micro").first()[0] == pytest.approx(f1_of(p, t))
    with pytest.raises(ValueError):
        multilabel_f1(pred, "other")


def test_part_counts_add_up(pred):
    whole = rows(multilabel_confusion(pred))
    parts = multilabel_confusion(pred, ["split", "item"]).groupBy("item").agg(
        *[F.sum(c).alias(c) for c in ("neg_neg", "neg_pos", "pos_neg", "pos_pos")])
    assert rows(parts) == whole
    assert rows(multilabel_confusion(pred.repartition(7))) == whole


def test_multiclass_leaves_absent_classes_out(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 2), (2, 2)], "truth int, pred int")
    assert multiclass_macro_f1(df).first()[0] == pytest.approx((2 / 3 + 0.0 + 1.0) / 3)


def test_mse(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 3.0)], "pred double, truth double")
    assert mse(df).first()[0] == 5.0


def test_masked(pred, data):
    p, t, m = data[0] > 0, data[1] > 0.5, data[2]
    tp, tn, fp, fn = (x[m].sum() for x in (p & t, ~p & ~t, p & ~t, ~p & t))

    def side(hit, extra, missed):
        a, b = hit / (hit + extra + 1e-8), hit / (hit + missed + 1e-8)
        return 2 * a * b / (a + b + 1e-8)

    assert masked_binary_f1(pred).first()[0] == pytest.approx((side(tp, fp, fn) + side(tn, fn, fp)) / 2)
    assert masked_binary_accuracy(pred).first()[0] == pytest.approx((tp + tn) / (tp + tn + fp + fn + 1e-8))
    nothing = pred.filter("row < 0")
    assert masked_binary_f1(nothing).first()[0] == 0.0


def test_losses(spark, pred, data):
    z, y, m = data
    w = np.array([2.0, 0.5, 1.0, 3.0])
    soft = lambda v: np.logaddexp(0, v)
    bce = w * y * soft(-z) + (1 - y) * soft(z)
    weights = spark.createDataFrame([(j, float(w[j])) for j in range(K)], "item int, pos_weight double")
    assert weighted_bce(pred, weights).first()[0] == pytest.approx(bce.mean())
    assert [r[1] for r in rows(weighted_bce(pred, weights, reduce="item"))] == pytest.approx(list(bce.mean(axis=0)))
    plain = y * soft(-z) + (1 - y) * soft(z)
    assert weighted_bce(pred).first()[0] == pytest.approx(plain.mean())
    prob = 1 / (1 + np.exp(-z))
    p_t = prob * y + (1 - prob) * (1 - y)
    focal = (0.8 * y + 0.2 * (1 - y)) * (1 - p_t) ** 2 * plain
    assert focal_loss(pred).first()[0] == pytest.approx((focal * m).sum() / (m.sum() + 1e-8))
    assert focal_loss(pred, mask=None).first()[0] == pytest.approx(focal.mean())
    assert masked_mean(pred, F.col("logit"), F.col("mask")).first()[0] == pytest.approx((z * m).sum() / (m.sum() + 1e-8))
    with pytest.raises(ValueError):
        weighted_bce(pred, reduce="?")


def test_bce_without_some_weights(spark, pred, data):
    """An item without a weight weighs 1; a mask leaves rows out."""
    z, y, mask = data
    some = spark.createDataFrame([(0, 3.0)], "item int, pos_weight double")
    w = np.array([3.0, 1, 1, 1])
    loss = w * y * np.log1p(np.exp(-z)) + (1 - y) * np.log1p(np.exp(z))
    assert weighted_bce(pred, some).first()[0] == pytest.approx(loss.mean())
    assert weighted_bce(pred, some, mask="mask").first()[0] == pytest.approx(loss[mask].mean())
    assert weighted_bce(pred.withColumn("mask", F.lit(False)), mask="mask").first()[0] is None


def test_losses_do_not_overflow(spark):
    df = spark.createDataFrame([(0, 800.0, 0.0, True), (0, -800.0, 1.0, True)], "item int, logit double, truth double, mask boolean")
    assert weighted_bce(df).first()[0] == 800.0
    assert math.isfinite(focal_loss(df).first()[0])


def test_names(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "value array<array<double>>")
    assert rows(name_metrics(df, "m_{}_{}", ["ab", "xy"])) == [("m_a_x", 1.0), ("m_a_y", 2.0), ("m_b_x", 3.0), ("m_b_y", 4.0)]
    assert rows(name_metrics(spark.createDataFrame([(0.5,)], "value double"), "m", [])) == [("m", 0.5)]
    with pytest.raises(ValueError):
        name_metrics(df, "m_{}", ["ab", "xy"])
    with pytest.raises(Exception, match="axis 1"):
        name_metrics(df, "m_{}_{}", ["ab", "xyz"]).collect()


def test_record(pred, data):
    names = list("abcd")
    got = {r.name: r.value for r in results(task_metrics(pred, "target", names)).collect()}
    test = [i for i in range(N) if i % 3 == 2]
    p, t = data[0][test] > 0, data[1][test] > 0.5
    assert len(got) == 2 + K + 4 * K
    assert got["test_target_micro_f1"] == pytest.approx(f1_of(p, t))
    assert got["test_target_f1_b"] == pytest.approx(f1_of(p[:, 1], t[:, 1]))
    assert got["test_target_confusion_c_pos_neg"] == (~p & t)[:, 2].sum()
    with pytest.raises(ValueError):
        evaluate_splits()


def test_evaluate_bundle(spark):
    rng = random.Random(6)
    draw = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    outputs = [(["train", "test"][i % 2], draw(3), [float(rng.random() < 0.4) for _ in range(3)], draw(3),
                [float(rng.random() < 0.4) for _ in range(3)], rng.random(), rng.random(),
                draw(5), [rng.random() for _ in range(5)], [rng.random() < 0.8 for _ in range(5)]) for i in range(120)]
    df = spark.createDataFrame(
        outputs, "split string, target_logits array<double>, target array<double>, label_logits array<double>, label array<double>, "
                 "score_pred double, score double, rationale_logits array<double>, rationale array<double>, mask array<boolean>")
    got = {r.name: r.value for r in evaluate(df, list("xyz")).collect()}
    # The test split reports no losses: one for each target and three more.
    assert len(got) == 2 * (2 + 3 + 12 + 3) + 3 + 3
    test = [o for o in outputs if o[0] == "test"]
    assert got["test_score_mse"] == pytest.approx(np.mean([(o[5] - o[6]) ** 2 for o in test]))
    cells = [0, 0, 0, 0]
    for o in test:
        if o[4][0] > 0 or o[4][1] > 0:
            for z, y, m in zip(*o[7:]):
                if m:
                    cells[2 * (y > 0.5) + (z > 0)] += 1
    tn, fp, fn, tp = cells

    def side(hit, extra, missed):
        a, b = hit / (hit + extra + 1e-8), hit / (hit + missed + 1e-8)
        return 2 * a * b / (a + b + 1e-8)

    assert got["test_rationale_f1"] == pytest.approx((side(tp, fp, fn) + side(tn, fn, fp)) / 2)
    only = {r.name for r in evaluate(df.select("split", "score_pred", "score")).collect()}
    assert only == {"train_score_mse", "train_score_loss", "test_score_mse"}


def test_stream_counts_equal_batch(spark, pred, tmp_path):
    pred.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pred.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (multilabel_confusion(stream).writeStream.outputMode("complete").format("memory").queryName("running")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    assert rows(spark.table("running")) == rows(multilabel_confusion(pred))
