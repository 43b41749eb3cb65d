"""Datasets by name: input, splits and statistics under one root."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

STATS_SCHEMA = "label_freqs array<double>, target_freqs array<double>, rationale_freq double"


@dataclass(frozen=True)
class Catalog:
    """Path templates of the datasets."""

    root: str
    input_path: str = "{root}/{name}/input.parquet"
    output_path: str = "{root}/{name}/output.parquet"
    stats_path: str = "{root}/{name}/stats.json"

    def input(self, name: str) -> str:
        return self.input_path.format(root=self.root, name=name)

    def output(self, name: str) -> str:
        return self.output_path.format(root=self.root, name=name)

    def stats(self, name: str) -> str:
        return self.stats_path.format(root=self.root, name=name)


def read_input(spark: SparkSession, catalog: Catalog, name: str) -> DataFrame:
    return spark.read.parquet(catalog.input(name))


def write_input(df: DataFrame, catalog: Catalog, name: str) -> None:
    df.write.mode("overwrite").parquet(catalog.input(name))


def write_splits(df: DataFrame, catalog: Catalog, name: str, split: str = "split") -> None:
    """All splits in one pass, a folder each; rows meet by split, a large one in several tasks."""
    df.hint("rebalance", F.col(split)).write.mode("overwrite").partitionBy(split).parquet(catalog.output(name))


def read_dataset(spark: SparkSession, catalog: Catalog, name: str, split: str | None = None) -> DataFrame:
    """A prepared dataset; naming a split reads its folder only."""
    df = spark.read.parquet(catalog.output(name))
    return df if split is None else df.filter(F.col("split") == split)


def scan_columns(df: DataFrame, groups: dict[str, Sequence[str]], singles: Sequence[str]) -> DataFrame:
    """Only the columns of the named groups and the single ones."""
    return df.select(*[f"{g}_{c}" for g, cats in groups.items() for c in cats], *singles)


def write_stats(stats: DataFrame, catalog: Catalog, name: str) -> None:
    """The one-row statistics record as JSON."""
    stats.coalesce(1).write.mode("overwrite").json(catalog.stats(name))


def no_stats(spark: SparkSession, schema: str = STATS_SCHEMA) -> DataFrame:
    """The record of a dataset that has no statistics; JSON leaves its nulls out."""
    empty = spark.createDataFrame([], schema)
    return spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema])


def read_stats(spark: SparkSession, catalog: Catalog, names: Sequence[str], schema: str = STATS_SCHEMA) -> DataFrame:
    """One record of several datasets' statistics; of a repeated key the first one counts."""
    records = None
    for i, name in enumerate(names):
        one = spark.read.schema(schema).json(catalog.stats(name)).withColumn("_at", F.lit(i))
        records = one if records is None else records.unionByName(one)
    cols = [c for c in records.columns if c != "_at"]
    return records.agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in cols])
