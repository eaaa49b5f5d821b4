"""Readers for the export files: one lazy scan per file family, all athletes at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from strideframe.functions import columns as X
from strideframe.operators import clean
from strideframe.sources import schemas, writers

# File name rules, tried in this order; the first that holds names the family.
FAMILY_RULES = (
    ("activities", "contains", "summarizedactivities"),
    ("maxmet", "starts", "metricsmaxmetdata"),
    ("metrics", "starts", "metrics"),
    ("predictions", "starts", "runracepredictions"),
    ("readiness", "starts", "trainingreadinessdto"),
    ("history", "starts", "traininghistory"),
)
FAMILIES = tuple(rule[0] for rule in FAMILY_RULES)
CORRUPT = "_corrupt_record"


def family_of(file_name: Column) -> Column:
    """Family of a file by its lower-cased name; NULL for other files."""
    name = F.lower(file_name)
    return F.coalesce(*[
        F.when(name.contains(text) if kind == "contains" else name.startswith(text), family)
        for family, kind, text in FAMILY_RULES])


def _any_case(text: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in text)


def name_glob(family: str) -> str:
    """A listing filter a little wider than the rule; `family_of` makes the exact cut."""
    kind, text = next((k, t) for f, k, t in FAMILY_RULES if f == family)
    return f"{'*' if kind == 'contains' else ''}{_any_case(text)}*.json"


def _plain_path(path: Column) -> Column:
    """File paths arrive percent-encoded; a literal plus sign must survive decoding."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def athlete_of(path: Column, root: str, layout: str = "athletes") -> Column:
    """Athlete id from the path: the directory below the root, or the root itself.

    With the layout "athletes", files directly in the root belong to nobody and give NULL.
    """
    name = root.rstrip("/").rsplit("/", 1)[-1]
    if layout == "single":
        return F.lit(name)
    if layout != "athletes":
        raise ValueError("layout must be 'athletes' or 'single'")
    below = F.substring_index(_plain_path(path), f"{root.rstrip('/').split('://')[-1]}/", -1)
    return F.nullif(F.regexp_extract(below, "^([^/]+)/.+", 1), F.lit(""))


def list_files(spark: SparkSession, root: str, layout: str = "athletes") -> DataFrame:
    """Every JSON file below the root with its athlete and family (contents are not read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.json").load(root).select("path", "length"))
    path = _plain_path(F.col("path"))
    name = F.substring_index(path, "/", -1)
    return files.select(
        athlete_of(F.col("path"), root, layout).alias("athlete_id"), name.alias("source_file"),
        family_of(name).alias("family"), "length", path.alias("path"))


def _scan(spark: SparkSession, root: str, family: str, schema: T.StructType, layout: str,
          athlete_ids: Sequence[str] | None) -> DataFrame:
    """Rows of one family with lineage columns and, for unreadable input, CORRUPT set.

    The athlete and family filters use only file metadata, so files they exclude are not
    opened. A file is one JSON document and is read by one task.
    """
    wide = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    raw = (spark.read.schema(wide).option("multiLine", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).option("recursiveFileLookup", True)
           .option("pathGlobFilter", name_glob(family)).json(root))
    name = F.substring_index(_plain_path(F.col("_metadata.file_path")), "/", -1)
    athlete = athlete_of(F.col("_metadata.file_path"), root, layout)
    kept = raw.where((family_of(name) == family) & athlete.isNotNull())
    if athlete_ids is not None:
        kept = kept.where(athlete.isin(list(athlete_ids)))
    return kept.select(athlete.alias("athlete_id"), name.alias("source_file"),
                       *[F.col(f"`{f.name}`") for f in wide.fields])


def _split(scan: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    good = scan.where(F.col(CORRUPT).isNull() | F.col(key).isNotNull()).drop(CORRUPT)
    bad = (scan.where(F.col(CORRUPT).isNotNull() & F.col(key).isNull())
           .select("athlete_id", "source_file", F.lit("malformed JSON").alias("reason"),
                   F.octet_length(CORRUPT).cast("bigint").alias("bytes")))
    return good, bad


def read_activities(spark: SparkSession, root: str, layout: str = "athletes",
                    athlete_ids: Sequence[str] | None = None,
                    extra: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw activities, one row each, and the rejected files.

    `extra` names further activity fields to keep.
    """
    scan = _scan(spark, root, "activities", schemas.activities_file(extra), layout, athlete_ids)
    good, bad = _split(scan, "summarizedActivitiesExport")
    rows = good.select("athlete_id", "source_file",
                       F.explode("summarizedActivitiesExport").alias("a"))
    return X.nan_to_null(rows.select("athlete_id", "source_file", "a.*")), bad


def read_daily(spark: SparkSession, root: str, family: str, layout: str = "athletes",
               athlete_ids: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """One daily family with its parsed `date`, and the rejected files."""
    scan = _scan(spark, root, family, schemas.DAILY[family], layout, athlete_ids)
    good, bad = _split(scan, "calendarDate")
    return X.nan_to_null(good).withColumn("date", X.calendar_date("calendarDate")), bad


def read_export(spark: SparkSession, root: str, layout: str = "athletes",
                athlete_ids: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """All six families of an export, by name, and the `rejects` of all of them."""
    tables: dict[str, DataFrame] = {}
    tables["activities"], rejects = read_activities(spark, root, layout, athlete_ids)
    for family in schemas.DAILY:
        tables[family], bad = read_daily(spark, root, family, layout, athlete_ids)
        rejects = rejects.unionByName(bad)
    tables["rejects"] = rejects
    return tables


def read_events(spark: SparkSession, path: str, fallback: str | None = None,
                athlete_id: str | None = None) -> DataFrame:
    """The race calendar CSV (`M/d/yy` dates); the fallback is read if the path is absent.

    Two-digit years are read as 20yy. The file has no athlete, so it is given here unless
    it has an `athlete_id` column of its own as first column.
    """
    schema = schemas.EVENTS_CSV
    if athlete_id is None:
        schema = T.StructType([T.StructField("athlete_id", T.StringType()), *schema.fields])

    def load(where: str) -> DataFrame:
        return spark.read.schema(schema).option("header", True).csv(where)

    try:
        rows = load(path)
    except AnalysisException as error:
        if fallback is None or error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = load(fallback)
    if athlete_id is not None:
        rows = rows.select(F.lit(athlete_id).alias("athlete_id"), "*")
    return rows.withColumn("date", F.try_to_date("date", "M/d/yy"))


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
               athlete_ids: Sequence[str] | None = None) -> DataFrame:
    """A saved table; columns and athletes are pruned at the scan."""
    df = spark.read.parquet(path)
    if dict(df.dtypes).get("athlete_id", "string") != "string":
        # ids such as 001 are directory names, which must not be read back as numbers
        text = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "athlete_id" else f
                             for f in df.schema.fields])
        df = spark.read.schema(text).parquet(path)
    if athlete_ids is not None:
        df = df.where(F.col("athlete_id").isin(list(athlete_ids)))
        if writers.BUCKET in df.columns:
            df = df.where(F.col(writers.BUCKET).isin([writers.athlete_bucket(F.lit(a)) for a in athlete_ids]))
    df = df.drop(writers.BUCKET)
    return clean.select_existing(df, columns) if columns is not None else df


def union_tables(*frames: DataFrame) -> DataFrame:
    """Union by column name; a column a frame lacks is NULL there."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def load_bundle(spark: SparkSession, base: str, names: Sequence[str],
                cache: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Saved tables as DataFrames and temporary views of the same names.

    `cache` lists the tables that several queries of a session read again.
    """
    tables = {}
    for name in names:
        table = read_table(spark, f"{base.rstrip('/')}/{name}")
        tables[name] = table.cache() if name in cache else table
        tables[name].createOrReplaceTempView(name)
    return tables
