"""Scalar building blocks as native Column expressions (no Python UDF anywhere)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.functions import constants as K

ColumnOrName = Column | str


def as_col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- missing values -------------------------------------------------------------------

def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every float column: Spark aggregates skip NULL, not NaN."""
    floats = [name for name, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.nullif(F.col(f"`{c}`"), F.lit(float("nan"))) for c in floats})


def null_if(value: ColumnOrName, sentinel) -> Column:
    """Replace a device sentinel such as HRV 511 by NULL."""
    return F.nullif(as_col(value), F.lit(sentinel))


def nested_get(path: str, default=None) -> Column:
    """Nested field by dotted path, with a default when any level is absent."""
    return F.coalesce(F.col(path), F.lit(default))


# --- dates ----------------------------------------------------------------------------

def epoch_ms_to_timestamp(millis: ColumnOrName) -> Column:
    """Epoch milliseconds of a local clock -> timestamp without zone.

    The value is already local time, so it is added to the epoch and never shifted by
    the session time zone.
    """
    seconds = (as_col(millis).cast("decimal(20,3)") / 1000).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        zero, zero, zero, seconds)


def epoch_ms_to_date(millis: ColumnOrName) -> Column:
    days = F.floor(as_col(millis) / F.lit(86400000.0)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def normalize_date(value: ColumnOrName) -> Column:
    """Any date-like column -> DATE; text that is no date becomes NULL."""
    return as_col(value).cast("string").try_cast("timestamp_ntz").cast("date")


def calendar_date(value: ColumnOrName) -> Column:
    """A calendar field holding epoch milliseconds or ISO text -> DATE.

    The choice is made per row. On files holding one form only this equals a choice made
    per file; on mixed files no row is lost.
    """
    text = as_col(value).cast("string")
    number = text.try_cast("double")
    return F.when(number > K.EPOCH_MS_FLOOR, epoch_ms_to_date(number)).otherwise(
        normalize_date(text))


def year_of(value: ColumnOrName) -> Column:
    return F.year(as_col(value)).cast("bigint")


def days_between(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    return F.datediff(as_col(later), as_col(earlier)).cast("bigint")


def date_label(value: ColumnOrName) -> Column:
    """`Nov 08, 2025`, or N/A."""
    return F.coalesce(F.date_format(as_col(value), "MMM dd, yyyy"), F.lit("N/A"))


# --- times and paces ------------------------------------------------------------------

def _positive(value: Column) -> Column:
    return F.when((value > 0) & ~F.isnan(value), value)


def _joined(first: Column, *rest: Column, width: int = 1) -> Column:
    """`first:02:02` text; NULL when any part is. Plain concatenation: format_string would
    parse its pattern for every row."""
    def padded(part: Column, digits: int) -> Column:
        text = part.cast("string")
        return text if digits == 1 else F.when(part < 10, F.concat(F.lit("0"), text)).otherwise(text)

    return F.concat(padded(first, width), *[x for p in rest for x in (F.lit(":"), padded(p, 2))])


def pace_label(speed_mps: ColumnOrName, unit: str = "mile") -> Column:
    """Speed in m/s -> pace `m:ss` per mile or km; NULL when missing or not positive."""
    metres = K.METRES_PER_MILE if unit == "mile" else K.METRES_PER_KM
    pace = F.lit(metres) / _positive(as_col(speed_mps)) / 60
    minutes = F.floor(pace)
    # rint rounds half to even; the sum carries a rounded-up 60th second into the minute.
    total = (minutes * 60 + F.rint((pace - minutes) * 60)).cast("bigint")
    return _joined(F.floor(total / 60), F.pmod(total, F.lit(60)))


def mean_pace(speed_mps: ColumnOrName) -> Column:
    """Aggregate: minutes per mile at the mean speed; NULL when that mean is not positive."""
    return F.lit(K.MILE_PACE_FACTOR) / _positive(F.avg(as_col(speed_mps)))


def _clock_parts(total: Column) -> tuple[Column, Column, Column]:
    return (F.floor(total / 3600), F.floor(F.pmod(total, F.lit(3600)) / 60),
            F.pmod(total, F.lit(60)))


def seconds_to_hms(seconds: ColumnOrName) -> Column:
    """Seconds -> `HH:MM:SS`, rounded half to even; hours are not capped at 24."""
    total = F.rint(as_col(seconds)).cast("bigint")
    return _joined(*_clock_parts(total), width=2)


def minutes_label(minutes: ColumnOrName) -> Column:
    """Minutes -> `h:mm:ss`, or `m:ss` under an hour; N/A when missing."""
    total = F.rint(as_col(minutes) * 60).cast("bigint")
    hours, mins, secs = _clock_parts(total)
    return (F.when(total.isNull(), "N/A")
            .when(hours > 0, _joined(hours, mins, secs)).otherwise(_joined(mins, secs)))


def prediction_minutes(value: ColumnOrName) -> Column:
    """Prediction as number or `HH:MM:SS` text -> minutes; other text becomes NULL."""
    text = as_col(value).cast("string")
    parts = F.split(text, ":")
    hours, mins, secs = (F.get(parts, i).try_cast("double") for i in range(3))
    clock = F.when(F.size(parts) == 3, (hours * 3600 + mins * 60 + secs) / 60)
    return F.coalesce(text.try_cast("double"), clock)


# --- distances ------------------------------------------------------------------------

def unit_factor(unit: str) -> float:
    """Multiplier from miles to the display unit."""
    return K.KM_PER_MILE if unit == "km" else 1.0


def in_unit(miles: ColumnOrName, unit: str) -> Column:
    return as_col(miles) * F.lit(unit_factor(unit))


def fixed_text(value: ColumnOrName, decimals: int = 1, thousands: bool = False) -> Column:
    """Number text with ties rounded to even, as format_number does (printf rounds up)."""
    text = F.format_number(as_col(value), decimals)
    return text if thousands else F.replace(text, F.lit(","), F.lit(""))


def signed_text(value: ColumnOrName, decimals: int = 1) -> Column:
    value = as_col(value)
    return F.concat(F.when(value >= 0, "+").otherwise(""), fixed_text(value, decimals))


def distance_label(miles: ColumnOrName, unit: str = "mi") -> Column:
    """`1,234.5 mi` or `... km`; N/A when missing."""
    text = fixed_text(in_unit(miles, unit), 1, thousands=True)
    return F.coalesce(F.concat(text, F.lit(" km" if unit == "km" else " mi")), F.lit("N/A"))


def standard_distance_miles(race_type: ColumnOrName) -> Column:
    table = F.create_map(*[F.lit(x) for pair in K.RACE_MILES.items() for x in pair])
    return F.try_element_at(table, F.lower(as_col(race_type)))


def ms_to_minutes(value: ColumnOrName) -> Column:
    return as_col(value) / 1000 / 60


# --- labels and classes ---------------------------------------------------------------

def upper_label(value: ColumnOrName, default: str = "race") -> Column:
    return F.upper(F.coalesce(as_col(value), F.lit(default)))


def title_label(value: ColumnOrName) -> Column:
    return F.initcap(as_col(value))


def short_block_name(value: ColumnOrName) -> Column:
    return F.replace(as_col(value), F.lit(" Marathon"), F.lit(""))


def first_word(value: ColumnOrName) -> Column:
    return F.lower(F.get(F.split(F.trim(as_col(value)), r"\s+"), 0))


def error_sign(error: ColumnOrName) -> Column:
    """Per race: below 0 optimistic, above 0 conservative, zero or missing neutral."""
    error = as_col(error)
    return F.when(error < 0, "optimistic").when(error > 0, "conservative").otherwise("neutral")


def error_bias(error: ColumnOrName) -> Column:
    """Per block: as error_sign, with a dead band of two minutes either way."""
    error, band = as_col(error), K.BIAS_DEAD_BAND_MINUTES
    return (F.when(error < -band, "optimistic").when(error > band, "conservative")
            .otherwise("neutral"))


def prediction_for_race_type(race_type: ColumnOrName) -> Column:
    """Choose the prediction column that belongs to the race type; NULL when unknown."""
    race_type = as_col(race_type)
    return F.coalesce(*[F.when(race_type == kind, F.col(f"`{name}`"))
                        for kind, name in K.PREDICTION_BY_RACE_TYPE.items()])


def to_json_or_null(value: ColumnOrName, kind: str) -> Column:
    """Nested value -> JSON text; empty arrays, maps and structs become NULL."""
    value = as_col(value)
    if kind.startswith("struct"):
        return F.nullif(F.to_json(value), F.lit("{}"))
    return F.when(F.size(value) > 0, F.to_json(value))


def race_report(unit: str = "mi", device: str = "the watch") -> Column:
    """The figures of one block as a line of labelled parts, from the columns of the block summary."""
    missing = F.lit("N/A")
    error = fixed_text(F.abs("prediction_error"))
    forecast = (F.when(F.col("prediction_bias") == "conservative", F.concat(error, F.lit(" min too slow")))
                .when(F.col("prediction_bias") == "optimistic", F.concat(error, F.lit(" min too fast")))
                .otherwise(F.lit("on target")))
    parts = {
        "Volume": F.concat(distance_label("avg_weekly_mileage", unit), F.lit(" a week, "),
                           distance_label("peak_weekly_mileage", unit), F.lit(" at most")),
        "Readiness": F.coalesce(fixed_text("avg_readiness"), missing),
        "HRV": F.coalesce(fixed_text("avg_hrv"), missing),
        "VO2 change": F.coalesce(signed_text("vo2_drift"), missing),
        f"Forecast of {device}": forecast,
        "Days settled": F.coalesce(F.col("days_stable_before_race").cast("string"), missing),
    }
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{label}: "), text) for label, text in parts.items()])


# --- map columns ----------------------------------------------------------------------

def marker_radius(miles: ColumnOrName) -> Column:
    return F.sqrt(F.greatest(F.coalesce(as_col(miles), F.lit(0.0)), F.lit(0.2))) * 120


def has_route_chord() -> Column:
    """Both ends known and, at five decimals, not the same point."""
    moved = ((F.bround("startLatitude", 5) != F.bround("endLatitude", 5))
             | (F.bround("startLongitude", 5) != F.bround("endLongitude", 5)))
    ends = F.col("endLatitude").isNotNull() & F.col("endLongitude").isNotNull()
    return ends & F.coalesce(moved, F.lit(False))
