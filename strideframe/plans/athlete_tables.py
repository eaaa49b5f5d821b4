"""From an export folder to the cleaned tables and the daily master table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from strideframe.functions import constants as K
from strideframe.operators import clean, daily
from strideframe.operators.rolling import rolling_volatility
from strideframe.sources import readers, writers


def build_tables(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Raw families -> runs, metrics, predictions, readiness, maxmet, history, daily_master."""
    runs = clean.runs_table(raw["activities"])
    tables = {
        "runs": runs,
        "metrics": clean.dedup_dates(raw["metrics"], "first"),
        "predictions": daily.prediction_labels(clean.dedup_dates(raw["predictions"], "last")),
        "readiness": raw["readiness"],
        "maxmet": raw["maxmet"],
        "history": raw["history"],
    }
    # the master deduplicates for itself, on the few columns it takes
    tables["daily_master"] = daily.daily_master(**{**raw_daily(raw), "runs": runs})
    return tables


def raw_daily(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: raw[name] for name in ("metrics", "predictions", "maxmet", "readiness", "history")}


def without_identifiers(df: DataFrame) -> DataFrame:
    return clean.drop_columns(df, K.IDENTIFYING_COLUMNS)


def analysis_series(master: DataFrame) -> DataFrame:
    """Daily master ready for analysis: HRV cleaned, minutes, rolling deviations."""
    return rolling_volatility(daily.analysis_days(master))


def process_export(spark: SparkSession, root: str, out_dir: str, layout: str = "athletes",
                   athlete_ids: Sequence[str] | None = None, overwrite: bool = True) -> DataFrame:
    """Read an export, write all tables and return the manifest."""
    raw = readers.read_export(spark, root, layout, athlete_ids)
    tables = build_tables(raw)
    return writers.save_tables({**tables, "rejects": raw["rejects"]}, out_dir, overwrite)
