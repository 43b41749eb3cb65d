import pytest
from conftest import rows
from pyspark.sql import functions as F

from votespan.functions.columns import (
    above, argmax, as_list, category_columns, coalesce_map, decode_above, decode_top, drop_cols, extract_groups,
    flatten_struct, gate_tokens, harden, keep_matching, label_slice, multihot, onehot, prefix_cols, slice_bounds,
    slice_number, with_key,
)


def test_category_columns_and_prefix(spark):
    assert category_columns(["a", "b"], "label") == ["label_a", "label_b"]
    df = spark.createDataFrame([(1, 2, 3)], "id int, a int, b int")
    assert prefix_cols(df, ["a", "b"], "x_").columns == ["id", "x_a", "x_b"]
    assert as_list(None) == [] and as_list("a") == ["a"] and as_list(("a", "b")) == ["a", "b"]


def test_onehot_null_and_unknown(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "zzz")], "id int, c string")
    assert rows(onehot(df, "id", "c", ["a", "b"])) == [(1, 1.0, 0.0), (2, None, None), (3, 0.0, 0.0)]


def test_multihot_null_array_and_unknown(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, ["None"]), (4, [])], "id int, c array<string>")
    assert rows(multihot(df, "id", "c", ["a", "b"])) == [
        (1, 1.0, 1.0), (2, None, None), (3, 0.0, 0.0), (4, 0.0, 0.0)]


def test_drop_ignores_absent_and_flatten(spark):
    df = spark.createDataFrame([(1, (2, "x"))], "id int, s struct<a:int,b:string>")
    assert drop_cols(df, "no", "s").columns == ["id"]
    assert flatten_struct(df, "s").columns == ["id", "a", "b"]
    assert flatten_struct(df, "s", ["b"]).columns == ["id", "b"]


def test_coalesce_map(spark):
    df = spark.createDataFrame([(1, {1: 2.0}), (2, None)], "id int, m map<int,double>")
    assert rows(coalesce_map(df, "m")) == [(1, {1: 2.0}), (2, {})]


def test_slices_partition_the_classes():
    cats = [str(i) for i in range(11)]
    assert [len(label_slice(cats, i, 4)) for i in (1, 2, 3, 4)] == [3, 3, 3, 2]
    assert sum((label_slice(cats, f"{i} 4") for i in (1, 2, 3, 4)), []) == cats
    for n in range(1, 30):
        for parts in range(1, 12):
            cuts = [slice_bounds(n, i, parts) for i in range(1, parts + 1)]
            assert cuts[0][0] == 0 and cuts[-1][1] == n
            assert all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    with pytest.raises(ValueError):
        label_slice(cats, "1,4")
    with pytest.raises(ValueError):
        label_slice(cats, 5, 4)


def test_slice_number(spark):
    df = spark.range(11).select(F.col("id").cast("int").alias("i"))
    got = [r[1] for r in sorted(df.select("i", slice_number(F.col("i"), 11, 4)).collect())]
    assert got == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4]


def test_harden_is_strict(spark):
    df = spark.createDataFrame([(0.0, 0.5), (0.1, 0.6)], "logit double, truth double")
    assert rows(harden(df), "pred", "hard") == [(False, False), (True, True)]


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0],), ([1.0, 3.0, 3.0],)], "a array<double>")
    assert rows(df.select(argmax(F.col("a")))) == [(0,), (1,)]


def test_gate_needs_label_and_mask(spark):
    df = spark.createDataFrame(
        [([True, False], 0.0, 0.4), ([True, True], 0.0, 0.0)], "m array<boolean>, l0 double, l1 double")
    got = [r[0] for r in df.select(gate_tokens(F.col("m"), [F.col("l0"), F.col("l1")])).collect()]
    assert got == [[True, False], [False, False]]


def test_decode(spark):
    df = spark.createDataFrame([([0.2, 0.9, 0.6],), ([0.5, 0.1, 0.1],)], "p array<double>")
    got = df.select(decode_top(F.col("p"), "abc").alias("t"), decode_above(F.col("p"), "abc").alias("a")).collect()
    assert (got[0].t.name, got[0].t.prob) == ("b", 0.9)
    assert [(x.name, x.prob) for x in got[0].a] == [("b", 0.9), ("c", 0.6)]
    assert got[1].t.name == "a" and got[1].a == []


def test_above_has_slack(spark):
    df = spark.createDataFrame([([0.5, 0.4],)], "p array<double>")
    assert df.select(above(F.col("p"), 0.5)).first()[0] == [True, False]


def test_keep_matching_and_groups(spark):
    df = spark.createDataFrame([("f1_x", 1.0), ("f1_y", None), ("other", 2.0)], "name string, value double")
    assert rows(keep_matching(df, "name", "^f1_", "value")) == [("f1_x", 1.0)]
    got = rows(extract_groups(df, "name", r"^(f1)_(\w*)$", ["m", "t"]), "m", "t")
    assert sorted(got, key=repr) == sorted([("f1", "x"), ("f1", "y"), (None, None)], key=repr)


def test_key_depends_on_content_only(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("x"))
    a = rows(with_key(df, ["id", "x"]))
    assert a == rows(with_key(df.repartition(7), ["id", "x"]))
    assert len({r[2] for r in a}) == 100
