"""Run atlas: map rows, filters, layers and footprint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.functions import columns as X
from strideframe.operators import clean, temporal


def map_rows(runs: DataFrame, ranges: DataFrame, unit: str = "mi") -> DataFrame:
    """Runs with a start point, with labels, marker size, block and chord flag.

    `ranges` holds athlete_id, block_name, start_date, end_date and priority.
    """
    located = clean.not_null(runs, ["startLatitude", "startLongitude"])
    started = F.col("start_time").cast("date")
    shown = located.select(
        "athlete_id", "activityId", "activityType", started.alias("date"),
        X.year_of("start_time").alias("year"), "distance_miles",
        X.in_unit("distance_miles", unit).alias("distance_display"),
        F.concat(X.fixed_text("distance_miles"), F.lit(" mi")).alias("distance_label"),
        F.coalesce("avg_pace_mile", F.lit("N/A")).alias("pace_label"),
        F.coalesce("locationName", F.lit("Unknown")).alias("location_label"),
        F.coalesce("name", F.lit("Run")).alias("run_name"),
        X.marker_radius("distance_miles").alias("radius_m"),
        "startLatitude", "startLongitude", "endLatitude", "endLongitude",
        X.has_route_chord().alias("has_route_chord"))
    return temporal.label_intervals(shown, ranges)


def filter_rows(rows: DataFrame, years: Sequence[int] | None = None,
                blocks: Sequence[str] | None = None, types: Sequence[str] | None = None,
                distance: tuple[float, float] | None = None) -> DataFrame:
    """Conjunction of the chosen filters; a filter that is not given keeps every row."""
    chosen = {"year": years, "marathon_block": blocks, "activityType": types}
    for column, values in chosen.items():
        if values is not None:
            rows = rows.where(F.col(column).isin(list(values)))
    if distance is not None:
        rows = rows.where(F.col("distance_display").between(*distance))
    return rows


def _span(column: str) -> Column:
    return F.max(column) - F.min(column)


def footprint() -> Column:
    lat, lon = _span("startLatitude"), _span("startLongitude")
    span = F.sqrt(lat * lat + lon * lon)
    return (F.when(F.count(F.lit(1)) == 0, "No mapped runs").when(span > 20, "Global footprint")
            .when(span > 2, "Regional footprint").otherwise("Local footprint"))


def headline(rows: DataFrame, keys: Sequence[str] = ("athlete_id",)) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("mapped_runs"), F.sum("distance_display").alias("mapped_distance"),
        F.max("distance_display").alias("longest_run"), footprint().alias("footprint"))


def view_state(rows: DataFrame, keys: Sequence[str] = ("athlete_id",)) -> DataFrame:
    """Map centre and zoom class from the bounds of the start points."""
    lat, lon = F.avg("startLatitude"), F.avg("startLongitude")
    span = F.greatest(_span("startLatitude"), _span("startLongitude"))
    unknown = lat.isNull() | lon.isNull()
    return rows.groupBy(*keys).agg(
        F.when(unknown, 20.0).otherwise(lat).alias("latitude"),
        F.when(unknown, 0.0).otherwise(lon).alias("longitude"),
        F.when(unknown, 1.2).when(span > 25, 2.0).when(span > 8, 4.0).when(span > 1, 7.0)
        .otherwise(10.0).alias("zoom"))


def route_chords(rows: DataFrame) -> DataFrame:
    return rows.where("has_route_chord")


def end_points(rows: DataFrame) -> DataFrame:
    return clean.not_null(rows, ["endLatitude", "endLongitude"])
