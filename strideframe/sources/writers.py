"""Sinks: partitioned Parquet tables and the run manifest."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

import strideframe
from strideframe.functions import columns as X

# Fixed values of the layout: the folder column of tables by athlete, and how many folders.
BUCKET = "athlete_bucket"
BUCKETS = 64


def parquet_safe(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, empty ones as NULL."""
    nested = {c: k for c, k in df.dtypes if k.split("<")[0] in ("array", "map", "struct")}
    return df.withColumns({c: X.to_json_or_null(f"`{c}`", k) for c, k in nested.items()})


def _spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Few files per partition value: adaptive execution merges small partitions and splits
    the one of an athlete that holds much of the data."""
    return df.hint("rebalance", *columns)


def athlete_bucket(athlete: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(athlete, F.lit("")).cast("binary")), F.lit(BUCKETS)).cast("int")


def _stored(df: DataFrame, path: str, kind: str) -> DataFrame | None:
    """The table at `path`, or None where there is none yet."""
    reader = df.sparkSession.read
    try:
        old = (reader.schema(df.schema) if kind == "json" else reader).format(kind).load(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    if BUCKET not in old.columns:
        raise ValueError(f"{path} holds a table that is not laid out by {BUCKET}")
    return old


def _write_athletes(df: DataFrame, path: str, kind: str, overwrite: bool) -> None:
    """Rows of many athletes in BUCKETS folders by a digest of the athlete.

    Overwriting replaces the rows of the athletes in `df`: the other athletes' rows of the
    folders concerned are read and written again with them, and other folders are not touched.
    """
    rows = df.withColumn(BUCKET, athlete_bucket(F.col("athlete_id")))
    old = _stored(df, path, kind) if overwrite else None
    if old is not None:
        ids = rows.select(F.col("athlete_id").alias("_id"), F.col(BUCKET).alias("_bucket")).distinct()
        others = (old.withColumn("athlete_id", F.col("athlete_id").cast("string"))
                  .join(ids.select("_bucket").distinct(), F.col(BUCKET) == F.col("_bucket"), "left_semi")
                  .join(ids, F.col("athlete_id").eqNullSafe(F.col("_id")), "left_anti"))
        rows = rows.unionByName(others, allowMissingColumns=True)
    writer = _spread(rows, [BUCKET]).write.format(kind).partitionBy(BUCKET)
    if overwrite:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode("errorifexists")
    writer.save(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("athlete_id",),
                overwrite: bool = True) -> str:
    """Write one table. Overwriting replaces only the partitions present in `df`; without
    it an existing path is an error.

    A table by athlete does not get a folder an athlete, whose number grows with the data, but
    BUCKETS folders of athletes; overwriting still replaces whole athletes and keeps the others.
    """
    if tuple(partition_by) == ("athlete_id",):
        _write_athletes(parquet_safe(df), path, "parquet", overwrite)
        return path
    writer = _spread(parquet_safe(df), partition_by).write.partitionBy(*partition_by)
    if overwrite:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode("errorifexists")
    writer.parquet(path)
    return path


def write_blocks(series: DataFrame, path: str, overwrite: bool = True) -> str:
    return write_table(series, path, ("block_name",), overwrite)


def _date_bounds(df: DataFrame) -> tuple[Column, Column]:
    if "date" not in df.columns:
        nothing = F.lit(None).cast("date")
        return nothing, nothing
    day = X.normalize_date("date") if dict(df.dtypes)["date"] == "string" else F.col("date").cast("date")
    return F.min(day), F.max(day)


def _entry(name: str, table: DataFrame, columns: Sequence[str], path: str) -> DataFrame:
    first, last = _date_bounds(table)
    return table.groupBy("athlete_id").agg(
        F.count(F.lit(1)).alias("rows"), first.alias("first_date"), last.alias("last_date")
    ).select("athlete_id", F.lit(name).alias("dataset"), F.lit(path).alias("path"), "rows",
             F.lit(len(columns)).alias("columns"),
             F.array(*[F.lit(c) for c in columns]).alias("column_names"),
             "first_date", "last_date")


def _no_table_reason(value) -> str | None:
    if value is None:
        return "DataFrame is None"
    if not isinstance(value, DataFrame):
        return "Object is not a DataFrame"
    return None


def manifest(tables: dict[str, object], paths: dict[str, str],
             original_columns: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per athlete and dataset: size and date range, or why it was not saved."""
    frames = {n: t for n, t in tables.items() if _no_table_reason(t) is None}
    if not frames:
        raise ValueError("no table to describe")
    columns = original_columns or {n: t.columns for n, t in frames.items()}
    counted = reduce(DataFrame.unionByName,
                     [_entry(n, t, columns[n], paths.get(n, "")) for n, t in frames.items()])
    expected = F.array(*[
        F.struct(F.lit(n).alias("dataset"), F.lit(_no_table_reason(t)).cast("string").alias("why"))
        for n, t in tables.items()])
    athletes = counted.select("athlete_id").distinct()
    wanted = athletes.select("athlete_id", F.inline(expected))
    saved = F.coalesce(F.col("rows") > 0, F.lit(False))
    return wanted.join(counted, ["athlete_id", "dataset"], "left").select(
        "athlete_id", "dataset", saved.alias("saved"),
        F.when(~saved, F.coalesce("why", F.lit("DataFrame is empty"))).alias("reason"),
        "path", "rows", "columns", "column_names", "first_date", "last_date",
        F.lit(strideframe.__version__).alias("engine_version"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                      "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("processed_at_utc"))


def save_tables(tables: dict[str, object], out_dir: str, overwrite: bool = True) -> DataFrame:
    """Write every table below `out_dir` and the manifest next to them.

    The manifest counts what was written, from Parquet statistics-sized scans of the result,
    so that no source is computed twice. Returns the manifest as written.
    """
    base = out_dir.rstrip("/")
    frames = {n: t for n, t in tables.items() if _no_table_reason(t) is None}
    paths = {n: f"{base}/{n}" for n in frames}
    stored: dict[str, object] = dict(tables)
    for name, table in frames.items():
        write_table(table, paths[name], overwrite=overwrite)
        spark = table.sparkSession
        schema = parquet_safe(table).schema
        stored[name] = spark.read.schema(schema).parquet(paths[name]).select(schema.names)
    described = manifest(stored, paths, {n: t.columns for n, t in frames.items()})
    where = f"{base}/manifest"
    _write_athletes(described, where, "json", overwrite)
    return described.sparkSession.read.schema(described.schema).json(where).select(described.columns)
