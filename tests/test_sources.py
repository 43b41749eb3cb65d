import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from votespan.operators.sampling import with_split
from votespan.plans.report import merge_partition_results, partition_report
from votespan.sources.datasets import (
    Catalog, read_dataset, read_input, read_stats, scan_columns, write_input, write_splits, write_stats,
)
from votespan.sources.keyed_json import ANNOTATED, json_to_parquet, read_keyed_json
from votespan.sources.results import long_to_wide, read_results, read_runs, wide_to_long, write_results
from votespan.sources.scratch import scratch_path
from workload import QUERIES
from workload.sources import partition_files

POSTS = {
    f"{i}_x": {
        "post_id": f"{i}_x",
        "annotators": [{"label": "normal", "annotator_id": i, "target": ["None", "Women"]}],
        "rationales": [] if i % 3 else [[0, 1], [1, 1]],
        "post_tokens": ["a", 'tricky "post_id" : {', "}\\", "é"],
    }
    for i in range(200)
}


@pytest.mark.parametrize("indent", [None, 2])
def test_keyed_json(spark, tmp_path, indent):
    path = tmp_path / "dirty.json"
    path.write_text(json.dumps(POSTS, indent=indent))
    whole = rows(read_keyed_json(spark, str(path)))
    assert len(whole) == 200
    assert read_keyed_json(spark, str(path)).schema == ANNOTATED
    assert rows(read_keyed_json(spark, str(path), first_member="post_id")) == whole
    row = read_keyed_json(spark, str(path), first_member="post_id").filter("post_id = '3_x'").first()
    assert row.annotators[0].target == ["None", "Women"] and row.rationales == [[0, 1], [1, 1]]
    assert row.post_tokens == POSTS["3_x"]["post_tokens"]


def test_keyed_json_is_cut_into_tasks(spark, tmp_path):
    path = tmp_path / "dirty.json"
    path.write_text(json.dumps(POSTS))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        cut = read_keyed_json(spark, str(path), first_member="post_id")
        assert cut.rdd.getNumPartitions() > 4
        assert sorted(r.post_id for r in cut.collect()) == sorted(POSTS)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_broken_json_fails(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"1": {"post_id": "1", "annotators": [}')
    with pytest.raises(Exception):
        read_keyed_json(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(Exception):
        read_keyed_json(spark, str(tmp_path / "bad.json"), first_member="post_id").collect()


def test_json_to_parquet(spark, tmp_path):
    path = tmp_path / "dirty.json"
    path.write_text(json.dumps(POSTS))
    df = read_keyed_json(spark, str(path))
    json_to_parquet(df, str(tmp_path / "p"))
    json_to_parquet(df, str(tmp_path / "p"))
    assert rows(spark.read.parquet(str(tmp_path / "p"))) == rows(df)


def test_datasets(spark, tmp_path, plan_of):
    catalog = Catalog(str(tmp_path))
    df = with_split(spark.range(500).select("id", (F.col("id") % 2).alias("label_a"), F.lit(1).alias("other")), ["id"])
    write_input(df, catalog, "d")
    assert rows(read_input(spark, catalog, "d")) == rows(df)
    write_splits(df, catalog, "d")
    parts = [rows(read_dataset(spark, catalog, "d", s), "id") for s in ("train", "valid", "test")]
    assert sorted(sum(parts, []), key=repr) == rows(df, "id") and all(parts)
    one = scan_columns(read_dataset(spark, catalog, "d", "test"), {"label": ["a"]}, ["id"])
    plan = plan_of(one)
    assert "PartitionFilters: [isnotnull(split" in plan
    assert "other" not in plan.split("ReadSchema")[1]


def test_stats_first_wins(spark, tmp_path):
    catalog = Catalog(str(tmp_path))
    write_stats(spark.sql("select array(0.1D) as label_freqs"), catalog, "a")
    write_stats(spark.sql("select array(0.9D) as label_freqs, array(0.2D) as target_freqs, 0.3D as rationale_freq"), catalog, "b")
    assert rows(read_stats(spark, catalog, ["a", "b"])) == [([0.1], [0.2], 0.3)]
    assert rows(read_stats(spark, catalog, ["b", "a"])) == [([0.9], [0.2], 0.3)]
    assert rows(read_stats(spark, catalog, ["a"])) == [([0.1], None, None)]


# Confusion counts (neg_neg, neg_pos, pos_neg, pos_pos) of a published
# evaluation in four label slices, and the F1 printed for it.
PUBLISHED = [
    {"african": (1350, 142, 14, 294), "arab": (1639, 79, 8, 74), "asian": (1736, 30, 3, 31)},
    {"caucasian": (1623, 118, 14, 45), "hispanic": (1756, 18, 1, 25), "homosexual": (1554, 79, 1, 166)},
    {"islam": (1495, 125, 8, 172), "jewish": (1570, 43, 3, 184), "other": (1561, 173, 27, 39)},
    {"refugee": (1654, 67, 9, 70), "women": (1463, 178, 24, 135)},
]
PRINTED = {
    "african": 0.7903, "arab": 0.6298, "asian": 0.6526, "caucasian": 0.4054, "hispanic": 0.7246, "homosexual": 0.8058,
    "islam": 0.7212, "jewish": 0.8889, "other": 0.2806, "refugee": 0.6481, "women": 0.5720, "micro": 0.6797, "macro": 0.6472,
}


def wide(part):
    out = {"test_target_macro_f1": 0.5, "test_target_micro_f1": 0.5}
    for t, (_, fp, fn, tp) in part.items():
        out[f"test_target_f1_{t}"] = 2 * tp / (2 * tp + fp + fn)
    for t, cells in part.items():
        for name, n in zip(("neg_neg", "neg_pos", "pos_neg", "pos_pos"), cells):
            out[f"test_target_confusion_{t}_{name}"] = n
    return out


def test_published_report(spark, tmp_path):
    for i, part in enumerate(PUBLISHED):
        folder = tmp_path / f"part_{i}"
        folder.mkdir()
        record = wide(part)
        # Written as the csv module does, with carriage returns.
        (folder / "results.csv").write_text(",".join(record) + "\r\n" + ",".join(map(str, record.values())) + "\r\n")
    long = read_results(spark, f"{tmp_path}/*/results.csv")
    assert long.select("file").distinct().count() == 4 and long.count() == sum(len(wide(p)) for p in PUBLISHED)
    report = partition_report(spark, f"{tmp_path}/*/results.csv").collect()
    assert [r.name for r in report] == [*sorted(set(PRINTED) - {"micro", "macro"}), "micro", "macro"]
    assert {r.name: round(r.f1, 4) for r in report} == PRINTED


def test_results_round_trip(spark, tmp_path):
    long = spark.createDataFrame([("a", 1.5), ("b", 2.0), ("n", None)], "name string, value double")
    write_results(long, str(tmp_path / "r"), ["b", "a", "n"])
    assert rows(read_results(spark, str(tmp_path / "r/*.csv")), "name", "value") == [("a", 1.5), ("b", 2.0), ("n", None)]
    assert long_to_wide(long).columns == ["a", "b", "n"]
    assert rows(wide_to_long(long_to_wide(long))) == [("a", 1.5), ("b", 2.0), ("n", None)]
    merged = merge_partition_results(long).collect()
    assert [(r.name, r.f1) for r in merged] == [("micro", 0.0), ("macro", None)]


def test_results_with_quotes_and_several_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"a,b",c\n1,2\n3,4\n')
    (tmp_path / "b.csv").write_text('c,"say ""x"""\n5,\n')
    got = rows(read_results(spark, str(tmp_path / "*.csv")), "name", "value")
    assert got == sorted([("a,b", 1.0), ("a,b", 3.0), ("c", 2.0), ("c", 4.0), ("c", 5.0), ('say "x"', None)], key=repr)
    (tmp_path / "c.csv").write_text("a\nword\n")
    with pytest.raises(Exception, match="word"):
        read_results(spark, str(tmp_path / "c.csv")).collect()


def test_keyed_json_with_members_in_another_order(spark, tmp_path):
    moved = {"1": POSTS["0_x"], "2": dict(reversed(POSTS["1_x"].items())), "3": POSTS["2_x"]}
    (tmp_path / "moved.json").write_text(json.dumps(moved))
    assert read_keyed_json(spark, str(tmp_path / "moved.json")).count() == 3
    with pytest.raises(Exception, match="does not start with"):
        read_keyed_json(spark, str(tmp_path / "moved.json"), first_member="post_id").collect()


def test_read_runs(spark):
    df = spark.createDataFrame([(i, "e" if i % 2 else "f", i % 5) for i in range(40)], "run_id int, experiment string, start_time int")
    got = [tuple(r) for r in read_runs(df, "e", 3).collect()]
    assert got == [(9, "e", 4), (19, "e", 4), (29, "e", 4)]
    assert read_runs(df, "e").count() == 20


def test_scratch_follows_the_session(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_queries_return_every_result_that_is_read(spark, sf):
    read = [tuple(r) for r in read_results(spark, partition_files(spark, sf)).select("name", F.round("value", 6)).collect()]
    got = [tuple(r) for q in ("s8_read_results", "s8_read_averages") for r in QUERIES[q](spark, sf).select("name", "value").collect()]
    assert sorted(read) == sorted(got) and sum("_macro_f1" in n for n, _ in got) == 4


def test_results_of_many_headers_are_one_plan(spark, tmp_path, plan_of):
    for i in range(60):
        (tmp_path / f"d{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 3}" / f"{i}.csv").write_text(f'"m,{i}",n_{i},both\n{i}.5,,"1e2"\r\n\n-1,2,3,4\n' if i % 2 else f'a""b,"c""d{i}"\n{i}')
    got = read_results(spark, str(tmp_path / "d*/*.csv"))
    assert plan_of(got).count("FileScan") == 2 and "Union" not in plan_of(got)
    want = []
    for i in range(60):
        if i % 2:
            want += [(f"m,{i}", i + 0.5), (f"n_{i}", None), ("both", 100.0), (f"m,{i}", -1.0), (f"n_{i}", 2.0), ("both", 3.0)]
        else:
            want += [('a""b', float(i)), (f'c"d{i}', None)]
    assert rows(got, "name", "value") == sorted(want, key=repr)


def test_results_by_braces_and_by_lists(spark, tmp_path):
    for part in (1, 2, 3):
        (tmp_path / f"part_{part}").mkdir()
        (tmp_path / f"part_{part}" / "r.csv").write_text(f"x\n{part}\n")
    one_two = [("x", 1.0), ("x", 2.0)]
    assert rows(read_results(spark, f"{tmp_path}/part_{{1,2}}/*.csv"), "name", "value") == one_two
    assert rows(read_results(spark, [f"{tmp_path}/part_1/r.csv", f"{tmp_path}/part_2/*.csv"]), "name", "value") == one_two
    assert {r["file"].rsplit("/", 2)[1] for r in read_results(spark, f"{tmp_path}/*/r.csv").collect()} == {"part_1", "part_2", "part_3"}
