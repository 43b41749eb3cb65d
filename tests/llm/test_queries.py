"""Every registered query of the subpackage runs, and equals its twin where it has one."""

import os
import subprocess
import sys

import duckdb
import pytest
from check_oracle import TABLES, duck_rows, spark_rows
from conftest import ROOT, rows
from pyspark.sql import functions as F

import corpus_pipeline
from votespan.llm import queries
from votespan.llm.jaccard import link_classes
from votespan.llm.quality import OrdinalModel, rate
from votespan.llm.substring import substring_digests

DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_twin(spark, sf, con, name):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == duck_rows(con, queries.ORACLE[name])


#: Rows each query gives for a document or a vector; None: as many as the data asks for.
PER_ROW = {"op1": 1, "op4": 1, "op7": 1, "op9": None, "op11": 1, "op12": None, "op13": 8}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_a_twin_gives_every_row(spark, sf, name):
    op = name.split("_")[0]
    read = spark.read.parquet(f"{sf}/{'embeddings' if op == 'op13' else 'documents'}.parquet")
    got = queries.QUERIES[name](spark, sf)
    if PER_ROW[op]:
        assert got.count() == PER_ROW[op] * read.count()
    else:
        assert got.count() > 0
    if op == "op9":
        assert got.select("doc_id").distinct().count() == read.count()


def alike(n):
    """Two strings of n letters that every polynomial hash modulo 2^64 takes for one another from 1,024 on."""
    signs = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[s] for s in signs), "".join("ba"[s] for s in signs)


@pytest.mark.parametrize("n", [64, 65, 512, 1024, 2048, 4096])
def test_long_words_built_to_agree_stay_apart(spark, n):
    x, y = alike(n)
    rest = [f"w{i}" for i in range(19)]
    docs = spark.createDataFrame([(1, " ".join([x, *rest])), (2, " ".join([y, *rest])), (3, " ".join([x, *rest]))], DOC)
    assert {r["doc_id"]: r["n_removed"] for r in substring_digests(docs).collect()} == {1: 0, 2: 0, 3: 20}
    pair = spark.createDataFrame([(1, " ".join([x, *rest[:8]])), (2, " ".join([y, *rest[:8]]))], DOC)
    assert rows(link_classes(pair), "doc_id", "class_id", "n_links") == [(1, 1, 0), (2, 2, 0)]


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import public_tokenizers
from votespan.session import build_session
spark = build_session("elsewhere", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false", spark__checkpoint__dir={shared!r})

def importable(batches):
    import importlib.util
    for batch in batches:
        yield batch
    if importlib.util.find_spec("votespan") is not None:
        raise RuntimeError("the worker has the package")

spark.range(2).mapInArrow(importable, "id long").collect()
from votespan.llm.queries import QUERIES
for name in {names!r}:
    print(name, QUERIES[name](spark, {sf!r}).count())
"""


def test_workers_need_no_copy_of_the_package(sf, tmp_path):
    names = [n for n in sorted(queries.QUERIES) if n.split("_")[0] in ("op4", "op11", "op12", "op13")]
    script = SCRIPT.format(root=ROOT, shared=str(tmp_path / "shared"), names=names, sf=sf)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == names


def test_rating_refuses_to_lose_a_column(spark):
    import numpy as np

    from votespan.llm.quality import BITS, DENSE

    model = OrdinalModel(np.zeros((1 << BITS) + DENSE), np.array([-1.0, 1.0]))
    with pytest.raises(ValueError):
        rate(spark.createDataFrame([("a", 1)], "text string, tails int"), model)


# The pipeline's own choices


FULL = "doc_id long, text string, lang string, source string, n_chars long"


def test_of_equal_rows_the_first_by_its_columns_stays(spark, sf):
    docs = [(1, "same words", lang, source, 10) for lang, source in [("fr", "b"), ("de", "z"), ("de", "a"), (None, "q")]]
    kept = corpus_pipeline.drop_copies(spark, spark.createDataFrame(docs, FULL).repartition(3), sf).collect()
    assert [tuple(r) for r in kept] == [(1, "same words", "de", "a", 10)]


def test_repeats_leave_null_texts_and_untouched_rows_alone(spark, sf):
    passage = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, None, "a", "s", 7), (2, "", "a", "s", 9), (3, passage, "a", "s", 1), (4, "x " + passage, "a", "s", None)], FULL)
    docs = docs.withColumns({"_tails": F.lit("t"), "_there": F.lit("h"), "kept": F.lit("k"), "n_removed": F.lit(3)})
    got = corpus_pipeline.drop_repeats(spark, docs, sf)
    assert got.columns == docs.columns
    assert rows(got, *docs.columns) == [
        (1, None, "a", "s", 7, "t", "h", "k", 3), (2, "", "a", "s", 9, "t", "h", "k", 3), (3, passage, "a", "s", 1, "t", "h", "k", 3),
        (4, "x", "a", "s", 1, "t", "h", "k", 3)]


def test_an_empty_table_gives_an_empty_result(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_the_pipeline_runs(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    filled = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("first"))
    assert filled.where("n > 2048 or first <> 0").count() == 0 and out.count() > 0
