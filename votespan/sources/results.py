"""Result files: one wide CSV row per evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def wide_to_long(df: DataFrame, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Every other column as a row (keys, name, value)."""
    cols = [c for c in df.columns if c not in keys]
    return df.select(*keys, *[F.col(c).cast("double") for c in cols]).unpivot(
        [F.col(k) for k in keys], cols, "name", value)


def long_to_wide(metrics: DataFrame, names: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, name, value) to one row per key; naming the columns saves the pass that lists them."""
    return metrics.groupBy(*keys).pivot("name", list(names) if names else None).agg(F.first("value"))


def write_results(metrics: DataFrame, path: str, names: Sequence[str] | None = None) -> None:
    """One wide CSV row with a header."""
    long_to_wide(metrics, names).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


#: A cell and the comma after it; quotes inside a quoted cell are doubled.
CELL = r'("(?:[^"]|"")*"|[^,]*),'


def csv_cells(line: Column) -> Column:
    """The cells of a CSV line, empty ones null."""
    cells = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(CELL), F.lit(1))

    def bare(c: Column) -> Column:
        inner = F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
        return F.nullif(F.when(c.startswith('"'), inner).otherwise(c), F.lit(""))

    return F.transform(cells, bare)


def read_results(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """CSVs with a header each, of different columns, as rows (file, name, value).

    ``paths`` is a path, a glob (braces included) or a list of them.  All files are read as one
    table of lines, and each line meets the header of its own file, so the plan is the same for
    any number of files and headers.  Cells that are no numbers fail the read, empty ones are
    null; cells beyond the header are left out, blank lines too.
    """
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("nth")).alias("place"),
        "value").where(F.trim("value") != "")
    headers = lines.groupBy("file").agg(F.min(F.struct("place", "value")).alias("first")).select(
        "file", F.col("first.place").alias("first"), csv_cells(F.col("first.value")).alias("names"))
    rows = lines.join(headers, "file").where(F.col("place") != F.col("first"))
    cells = rows.select("file", "names", csv_cells(F.col("value")).alias("cells"))
    pairs = F.transform("names", lambda n, i: F.struct(n.alias("name"), F.get("cells", i).cast("double").alias("value")))
    return cells.select("file", F.inline(pairs))


def read_runs(runs: DataFrame, experiment, limit: int | None = None) -> DataFrame:
    """The runs of an experiment; with ``limit`` only so many of the newest."""
    found = runs.filter(F.col("experiment") == experiment)
    return found if limit is None else found.orderBy(F.desc("start_time"), "run_id").limit(limit)
