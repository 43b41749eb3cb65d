"""Keyed JSON cut at any brace gives the rows that parsing it whole gives."""

import json
import random

import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F, types as T

from votespan.sources import keyed_json
from votespan.sources.keyed_json import _entries, _ranges, keyed_entries, read_keyed_json

VALUE = T.StructType([
    T.StructField("a", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("inner", T.ArrayType(T.StructType([T.StructField("a", T.StringType()), T.StructField("post_id", T.StringType())])))])
NASTY = ['}', '{', '"', '\\', '\\"', '}}"', '{"a": {', ' ', '\n', 'é🙂', '[', ']', '\\\\', ',', ':', '"}, "k": {"a"', 'plain', '']


def made(draw):
    text = lambda: "".join(draw.choice(NASTY) for _ in range(draw.randrange(6)))
    value = {"a": text(), "n": draw.randrange(100), "inner": [{"a": text(), "post_id": text()} for _ in range(draw.randrange(4))], "more": {"x": [{}, [text()]]}}
    for k in [k for k in value if draw.random() < 0.2]:
        value[k] = None
    return draw.choice([value, value, value, value, None, {}])


def wanted(objects):
    out = []
    for v in (v for o in objects for v in o.values()):
        out.append(None if v is None else (v.get("a"), v.get("n"), None if v.get("inner") is None else [(e["a"], e["post_id"]) for e in v["inner"]]))
    return sorted([(None, None, None) if v is None else v for v in out], key=repr)


def plain(df):
    return sorted(((r["a"], r["n"], None if r["inner"] is None else [(e["a"], e["post_id"]) for e in r["inner"]]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("indent,ascii_only", [(None, True), (2, False), (0, False)])
def test_rows_equal_parsing_whole(spark, tmp_path, monkeypatch, indent, ascii_only):
    draw = random.Random(indent)
    objects = [{f'{i} {draw.choice(NASTY)}': made(draw) for i in range(n)} for n in (120, 0, 1, 300)]
    for i, o in enumerate(objects):
        (tmp_path / f"{i}.json").write_text(json.dumps(o, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    monkeypatch.setattr(keyed_json, "RANGE", 64)
    whole = wanted(objects)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        cut = read_keyed_json(spark, str(tmp_path), VALUE)
        assert plain(cut) == whole
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert plain(read_keyed_json(spark, str(tmp_path), VALUE)) == whole


def test_several_objects_in_one_file_and_blanks_around(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n {"x": {"a": "1"} , "y":{"a":"2"}}\n\n{}{"z": {"a": "}"}, "w": null} \n\t')
    assert sorted(r["a"] or "" for r in read_keyed_json(spark, str(tmp_path), VALUE).collect()) == ["", "1", "2", "}"]


def test_empty_files(spark, tmp_path):
    for i, text in enumerate(["", " \n", "{}", " { } \n"]):
        (tmp_path / f"{i}.json").write_text(text)
    assert read_keyed_json(spark, str(tmp_path), VALUE).collect() == []


@pytest.mark.parametrize("text", ['{"x": {"a": "1"}', '{"x": {"a": "1}}', '{"x": {"a": "1"}}}}', '{"x": {"a" 1}}', '{"x": {"a": "1"}} {"y"'])
def test_broken_text_fails(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        read_keyed_json(spark, str(tmp_path), VALUE).collect()


def test_a_long_value_over_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed_json, "RANGE", 100)
    value = {"a": "x" * 5000 + "}" * 5000, "n": 1, "inner": [{"a": "y", "post_id": str(i)} for i in range(2000)]}
    (tmp_path / "a.json").write_text(json.dumps({"1": value, "2": {"a": "short"}}))
    got = {r["a"]: r["inner"] for r in read_keyed_json(spark, str(tmp_path), VALUE).collect()}
    assert set(got) == {value["a"], "short"} and [e["post_id"] for e in got[value["a"]]] == [str(i) for i in range(2000)]


def test_every_brace_may_be_a_cut():
    """Without Spark: every way to end parts and ranges gives the same entries."""
    text = json.dumps({"k}": {"a": '"}{\\'}, "l": {"inner": [{"a": "}"}, {}]}, "m": None, "n": {}})
    pieces = text.split("}")[:-1]
    for mask in range(1 << (len(pieces) - 1)):
        at, rows_ = 0, []
        for i, piece in enumerate(pieces):
            rows_.append(("f", at, piece))
            at += mask >> i & 1
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows_)], names=["file", "at", "value"])
        every = [r for b in _ranges(iter([batch])) for r in b.to_pylist()]
        quotes = depth = 0
        found = ""
        for part in sorted({r["at"] for r in every}):
            own = [r for r in every if r["at"] == part]
            inside = quotes % 2 == 1
            for r in (r for r in own if r["text"] is not None):
                change = r["quoted"] if inside else r["plain"]
                state = dict(r, inside=inside != (r["quotes"] % 2 == 1), depth=depth + change)
                given = pa.RecordBatch.from_pylist([{k: state[k] for k in ("file", "at", "nth", "inside", "depth", "text")}])
                for out in _entries(iter([given])):
                    for e in out.to_pylist():
                        found += e["text"] + ("|" if e["kind"] in (0, 1) else "")
            end = next(r for r in own if r["text"] is None)
            depth += end["quoted"] if inside else end["plain"]
            quotes += end["quotes"]
        assert depth == 0 and quotes % 2 == 0
        assert found.replace("|", "") == text and len(found.split("|")) == 5


def test_nested_members_of_the_same_name(spark, tmp_path):
    value = {"post_id": "1", "post_tokens": ['{"post_id": "2"}', "}"], "annotators": [], "rationales": [[1]]}
    (tmp_path / "a.json").write_text(json.dumps({"1": value, "2": dict(value, post_id="2")}))
    assert rows(read_keyed_json(spark, str(tmp_path)), "post_id") == [("1",), ("2",)]


def test_no_cross_joins(spark, tmp_path, plan_of):
    (tmp_path / "a.json").write_text('{"x": {"a": "1"}}')
    plan = keyed_entries(spark, str(tmp_path)).select(F.length("entry"))
    assert plan.count() == 1 and "CartesianProduct" not in plan_of(plan) and "BroadcastNestedLoop" not in plan_of(plan)
