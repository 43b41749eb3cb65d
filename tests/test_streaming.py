"""Metrics of streams equal those of the same rows in one batch."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from votespan.operators.metrics import (
    focal_loss, masked_binary_accuracy, masked_binary_f1, masked_mean, mse, multilabel_confusion, multilabel_f1, task_metrics, weighted_bce,
)
from votespan.streaming.metrics import read_latest, read_newest_batch, start_metrics, start_updates, window_summary, windowed

SCHEMA = "row long, item int, logit double, truth double, mask boolean, split string, ts timestamp, pred double"
DAY = dt.datetime(2024, 1, 1)


def made(seed, n=90, day=0):
    draw = random.Random(seed)
    return [(i, i % 3, draw.gauss(0, 3), float(draw.random() < 0.4), draw.random() < 0.7, ["train", "valid", "test"][i % 7 % 3],
             DAY + dt.timedelta(days=day, minutes=draw.randrange(1440)), draw.gauss(0, 1)) for i in range(n)]


@pytest.fixture
def folder(spark, tmp_path):
    """(path, function that adds a file of rows, those rows so far)."""
    path, every = str(tmp_path / "in"), []

    def add(data):
        every.extend(data)
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)

    return path, add, every


def stream_of(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def in_memory(df, mode, name):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def near(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert [x for x in a if not isinstance(x, float)] == [x for x in b if not isinstance(x, float)]
        assert [x for x in a if isinstance(x, float)] == pytest.approx([x for x in b if isinstance(x, float)])


ONE_STEP = {
    "confusion": lambda p: multilabel_confusion(p, ["split", "item"]),
    "f1": lambda p: multilabel_f1(p, "none", by="split"),
    "mse": lambda p: mse(p, by="split"),
    "bce": lambda p: weighted_bce(p, reduce="item", mask="mask"),
    "focal": lambda p: focal_loss(p, by="split"),
    "masked_f1": lambda p: masked_binary_f1(p, "split"),
    "accuracy": lambda p: masked_binary_accuracy(p, "split"),
    "mean": lambda p: masked_mean(p, F.col("pred"), F.col("mask"), "split"),
}


@pytest.mark.parametrize("name", ONE_STEP)
@pytest.mark.parametrize("mode", ["update", "complete"])
def test_streamed_sums_equal_the_batch(spark, folder, name, mode):
    path, add, every = folder
    for seed in range(3):
        add(made(seed))
    metric = ONE_STEP[name]
    sink = in_memory(metric(stream_of(spark, path)), mode, f"{name}_{mode}")
    batch = metric(spark.createDataFrame(every, SCHEMA))
    got, want = rows(sink), rows(batch)
    if mode == "update":
        # The sink holds every change; each of the final rows is among them.
        keys = [i for i, f in enumerate(batch.schema) if f.dataType.simpleString() in ("string", "int")]
        assert len(got) > len(want) and {tuple(r[i] for i in keys) for r in got} == {tuple(r[i] for i in keys) for r in want}
        for w in want:
            assert any(r == pytest.approx(w) if not keys else [r[i] for i in keys] == [w[i] for i in keys] and [
                x for x in r if isinstance(x, (float, int))] == pytest.approx([x for x in w if isinstance(x, (float, int))]) for r in got)
    else:
        near(got, want)


def test_a_restart_goes_on_from_the_checkpoint(spark, folder, tmp_path):
    path, add, every = folder
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for seed in range(2):
        add(made(seed))
    start_metrics(stream_of(spark, path), "target", out, checkpoint).awaitTermination()
    near(rows(read_newest_batch(spark, out)), rows(task_metrics(spark.createDataFrame(every, SCHEMA), "target")))
    add(made(9))
    again = start_metrics(stream_of(spark, path), "target", out, checkpoint)
    again.awaitTermination()
    # Only the new file was read; the sums of the others came from the state.
    assert sum(p["numInputRows"] for p in again.recentProgress) == 90
    near(rows(read_newest_batch(spark, out)), rows(task_metrics(spark.createDataFrame(every, SCHEMA), "target")))
    # Nothing new: nothing changes.
    start_metrics(stream_of(spark, path), "target", out, checkpoint).awaitTermination()
    near(rows(read_newest_batch(spark, out)), rows(task_metrics(spark.createDataFrame(every, SCHEMA), "target")))


def test_a_batch_that_runs_again_counts_once(spark, folder, tmp_path):
    path, add, every = folder
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    add(made(1))
    start_updates(mse(stream_of(spark, path), by="split"), out, checkpoint).awaitTermination()
    want = rows(read_latest(spark, out, "split"))
    # As if the driver had been lost after writing: the commit is gone, the rows are there.
    for commit in (tmp_path / "checkpoint" / "commits").iterdir():
        if commit.name.lstrip(".").startswith("0"):
            commit.unlink()
    start_updates(mse(stream_of(spark, path), by="split"), out, checkpoint).awaitTermination()
    near(rows(read_latest(spark, out, "split")), want)
    near(want, rows(mse(spark.createDataFrame(every, SCHEMA), by="split")))


def test_windows_close_under_the_watermark(spark, folder):
    """Append mode gives each day once, when the watermark has passed its end; a row that is too late is dropped."""
    path, add, every = folder
    for day in range(3):
        add(made(day, day=day))
    late = [(*made(50, 1)[0][:6], DAY + dt.timedelta(hours=2), 0.0)]
    add(late)
    add(made(3, day=5))
    cells = multilabel_confusion(windowed(stream_of(spark, path), "ts", "1 day", "1 hour"), ["window", "split", "item"])
    sink = in_memory(cells, "append", "days").select("window.start", "split", "item", "neg_neg", "neg_pos", "pos_neg", "pos_pos")
    kept = [r for r in every if r not in late and r[6] < DAY + dt.timedelta(days=3)]
    want = multilabel_confusion(windowed(spark.createDataFrame(kept, SCHEMA), "ts", "1 day", "1 hour"), ["window", "split", "item"]).select(
        "window.start", "split", "item", "neg_neg", "neg_pos", "pos_neg", "pos_pos")
    assert rows(sink) == rows(want)


def test_a_mean_over_labels_follows_in_append_mode(spark, folder):
    """Two aggregations in one stream: per label, then over labels, by window."""
    path, add, every = folder
    for day in (0, 1, 4):
        add(made(day, day=day))
    macro = multilabel_f1(windowed(stream_of(spark, path), "ts", "1 day", "1 hour"), "macro", by=["window"])
    got = in_memory(macro, "append", "macro").select("window.start", "f1")
    kept = [r for r in every if r[6] < DAY + dt.timedelta(days=2)]
    want = multilabel_f1(windowed(spark.createDataFrame(kept, SCHEMA), "ts", "1 day", "1 hour"), "macro", by=["window"])
    near(rows(got), rows(want.select("window.start", "f1")))


def test_window_summary_and_an_empty_stream(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(str(tmp_path / "none"))
    start_metrics(stream_of(spark, str(tmp_path / "none")), "target", str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    cells = multilabel_confusion(windowed(spark.createDataFrame(made(1) + made(2, day=1), SCHEMA), "ts", "1 day", "1 hour"), ["window", "item"])
    got = window_summary(cells).orderBy("start").collect()
    assert got[0]["macro_change"] is None and got[1]["macro_change"] == pytest.approx(got[1]["macro_f1"] - got[0]["macro_f1"])
