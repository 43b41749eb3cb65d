"""The stand-ins are dealt out by size."""

from workload import tables


def parts(spark, path, n_chars):
    spark.createDataFrame([(i, "some text", n_chars) for i in range(40)], "doc_id long, text string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return tables.documents(spark, str(path)).rdd.getNumPartitions()


def test_documents_come_in_more_parts_the_longer_they_are(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    assert parts(spark, tmp_path / "short", 9) == cores
    assert parts(spark, tmp_path / "long", 8 << 20) == 40
    assert parts(spark, tmp_path / "unknown", None) == cores


def test_documents_come_in_more_parts_the_more_there_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 4)
    assert parts(spark, tmp_path / "many", 9) == 10

