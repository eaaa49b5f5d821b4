"""Grouped statistics: spread, correlation, fits, histograms, quartiles and local trend."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strideframe.functions.columns import as_col


def _both(x: str, y: str) -> Column:
    return F.col(x).isNotNull() & F.col(y).isNotNull()


def value_counts(df: DataFrame, column: str, keys: Sequence[str] = (), out: str = "n") -> DataFrame:
    """Rows per value, missing values left out. Sort the small result where it is shown."""
    return (df.where(F.col(column).isNotNull())
            .groupBy(*keys, column).agg(F.count(F.lit(1)).alias(out)))


def most_frequent(counts: DataFrame, column: str, out: str = "n") -> DataFrame:
    """All counts, the highest first; a caller who wants a few takes the head."""
    return counts.orderBy(F.col(out).desc(), F.col(column))


def spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation and count of the non-null values, without NULL keys."""
    return (df.dropna(subset=list(keys)).groupBy(*keys)
            .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                 F.count(value).alias("count")))


def correlation(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "corr") -> DataFrame:
    """Pearson correlation over the pairs that are complete."""
    pair = _both(x, y)
    return df.groupBy(*keys).agg(
        F.corr(F.when(pair, F.col(x)), F.when(pair, F.col(y))).alias(out))


def linear_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least squares of y on x over complete pairs."""
    return df.where(_both(x, y)).groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


def mean_by(df: DataFrame, keys: Sequence[str], value: str, out: str = "mean") -> DataFrame:
    """Mean of a value at each repeated x (the line drawn through repeated points)."""
    return df.dropna(subset=[*keys, value]).groupBy(*keys).agg(F.avg(value).alias(out))


def distinct_count(df: DataFrame, column: str, keys: Sequence[str] = (), out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(column).alias(out))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The values a filter list offers: distinct, without NULL, sorted."""
    return df.select(column).dropna().distinct().orderBy(column)


def common_range(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest value over two columns, the ends of a reference diagonal."""
    return df.groupBy(*keys).agg(
        F.least(F.min(a), F.min(b)).alias("range_min"),
        F.greatest(F.max(a), F.max(b)).alias("range_max"))


def column_profile(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Per column: rows, nulls, null share, mean, deviation, min, max and the exact quartiles.

    One pass computes the counts and moments of all columns; the single result row is then
    turned into one row per column. Quartiles (linear interpolation, nulls left out) come from
    `exact_percentiles` with the column name as key, at most `len(numeric)` keys, so values are
    counted where they are read. A column without values has null quartiles.
    """
    def of(c: str) -> Column:
        col = F.col(f"`{c}`").cast("double")
        return F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"),
            F.count_if(col.isNull()).alias("nulls"),
            F.avg(col.isNull().cast("int")).alias("null_share"), F.avg(col).alias("mean"),
            F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"))

    moments = df.agg(F.array(*[of(c) for c in numeric]).alias("_all")).select(F.inline("_all"))
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value"))
                                        for c in numeric])))
    quartiles = exact_percentiles(long, ["column"], "value", (0.25, 0.5, 0.75), bounded_keys=len(numeric)).select(
        "column", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    return moments.join(quartiles, "column", "left")


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between the smallest and the largest value, empty bins included.

    The last bin holds the largest value. Where all values are equal the range is widened by
    one half each way. Two passes: the ends of each key, then every row is binned and counted
    on the map side; distinct values are never grouped.
    """
    data = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = data.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    half = F.when(F.col("_lo") == F.col("_hi"), 0.5).otherwise(0.0)
    ends = ends.select(*keys, (F.col("_lo") - half).alias("_lo"), (F.col("_hi") + half).alias("_hi"))
    if keys:
        placed = data.join(ends, list(keys))
        lo, hi = F.col("_lo"), F.col("_hi")
    else:  # one row: used as scalar subqueries rather than joined
        placed = data
        lo, hi = ends.select("_lo").scalar(), ends.select("_hi").scalar()
    bin_no = F.least(F.width_bucket("_v", lo, hi, F.lit(bins)), F.lit(bins))
    # binned where the rows are read: the shuffle holds at most `bins` rows a key and task
    filled = (placed.withColumn("bin", bin_no.cast("bigint"))
              .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_n")))
    slots = ends.withColumn("bin", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return slots.join(filled, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("_lo") + width * (F.col("bin") - 1)).alias("bin_start"),
        (F.col("_lo") + width * F.col("bin")).alias("bin_end"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n"))


STEP = 16  # bits a narrowing round reads: four rounds settle a 64-bit code
ROUNDS = 64 // STEP


def order_code(x: Column) -> Column:
    """A long that orders as the double `x` does: its IEEE-754 bits, negative values reflected.

    The bits come from exponent and fraction, which powers of two give exactly (subnormal values
    included); -0.0 codes as 0.0 and NaN above infinity, the order Spark sorts doubles in.
    """
    a = F.abs(x)
    guess = F.floor(F.log2(a)).cast("int")
    exp = (F.when(a / F.pow(F.lit(2.0), guess) >= 2, guess + 1)
           .when(a / F.pow(F.lit(2.0), guess) < 1, guess - 1).otherwise(guess))
    normal = ((exp + 1023).cast("long") * (1 << 52)
              + ((a / F.pow(F.lit(2.0), exp) - 1) * float(1 << 52)).cast("long"))
    subnormal = (a / F.lit(2.0 ** -1074)).cast("long")
    bits = (F.when(a == 0, F.lit(0).cast("long")).when(a == float("inf"), F.lit(2047 << 52))
            .when(exp < -1022, subnormal).otherwise(normal))
    return (F.when(F.isnan(x), F.lit((2047 << 52) + (1 << 51)))
            .when(x >= 0, bits).otherwise(-1 - bits))


def select_ranks(data: DataFrame, keys: Sequence[str], ranks: DataFrame, bounded_keys: int | None = None) -> DataFrame:
    """The values at given ranks of each key's values, by narrowing rounds over order codes.

    `data` holds `keys` and a double `_v` (no nulls); `ranks` holds `keys`, an id `_j` and a
    0-based rank `_r` below the key's row count. Returns `keys`, `_j` and `_value`.

    Each round counts, for every key and prefix still wanted, the rows by the next 16 bits of
    their order code; the counts combine on the map side, so a key with a third of all rows
    sends at most 65,536 rows a task. The running count over those buckets (at most 65,536 per
    key and prefix) names the bucket that holds the rank, and only that bucket's rows take part
    in the next round. After four rounds a bucket holds one value. No sketch, no window over
    values and no copies of rows. Rows meet the wanted prefixes by a join, or, where the caller
    states that there are at most `bounded_keys` keys, by a lookup in a map of that size.
    """
    keys = list(keys)
    coded = data.select(*keys, "_v", order_code(F.col("_v")).alias("_c"))
    state = ranks.select(*keys, "_j", F.col("_r").cast("long").alias("_rest"), F.lit(None).cast("long").alias("_pre"))
    key_struct = F.struct(*[F.col(c) for c in keys]) if keys else F.lit(0)
    for k in range(ROUNDS):
        shift = 64 - STEP * (k + 1)
        if k == 0:
            rows = coded.withColumn("_pre", F.lit(None).cast("long"))
            bucket = F.shiftright("_c", shift)
        else:
            above = F.shiftright("_c", shift + STEP)
            bucket = F.shiftright("_c", shift).bitwiseAND(F.lit((1 << STEP) - 1))
            if bounded_keys is not None:
                wanted = state.groupBy(key_struct.alias("_key")).agg(F.collect_set("_pre").alias("_pres"))
                lookup = wanted.agg(F.map_from_entries(F.collect_list(F.struct("_key", "_pres")))).scalar()
                rows = coded.where(F.array_contains(F.element_at(lookup, key_struct), above)).withColumn("_pre", above)
            else:
                pres = state.select(*[F.col(c).alias(f"_pk{i}") for i, c in enumerate(keys)], F.col("_pre").alias("_ppre")).distinct()
                match = above == F.col("_ppre")
                for i, c in enumerate(keys):
                    match = match & F.col(c).eqNullSafe(F.col(f"_pk{i}"))
                rows = coded.join(pres, match).select(*keys, "_v", "_c", F.col("_ppre").alias("_pre"))
        counts = rows.groupBy(*keys, "_pre", bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.max("_v").alias("_top"))
        counts = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys, "_pre").orderBy("_b"))).select(
            *[F.col(c).alias(f"_ck{i}") for i, c in enumerate(keys)], F.col("_pre").alias("_cpre"), "_b", "_n", "_top", "_upto")
        meet = F.col("_pre").eqNullSafe(F.col("_cpre"))
        for i, c in enumerate(keys):
            meet = meet & F.col(c).eqNullSafe(F.col(f"_ck{i}"))
        before = F.col("_upto") - F.col("_n")
        chosen = state.join(counts, meet & (before <= F.col("_rest")) & (F.col("_rest") < F.col("_upto")))
        prefix = F.col("_b") if k == 0 else F.shiftleft(F.col("_pre"), STEP).bitwiseOR(F.col("_b"))
        state = chosen.select(*keys, "_j", (F.col("_rest") - before).alias("_rest"), prefix.alias("_pre"), F.col("_top").alias("_value"))
    return state.select(*keys, "_j", "_value")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str,
                      probabilities: Sequence[float], bounded_keys: int | None = None) -> DataFrame:
    """Exact percentiles (linear interpolation) as an array `quantiles` per key.

    For p the values at ranks floor((n-1)p) and ceil((n-1)p) are selected by `select_ranks`
    (four narrowing rounds over order codes) and interpolated. Null values are left out. At
    least one key is needed; `bounded_keys` states a most number of keys (see `select_ranks`).
    """
    keys = list(keys)
    if not keys:
        raise ValueError("exact_percentiles needs at least one key column")
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    sizes = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    place = (F.col("_rows") - 1) * F.col("_p")
    wanted = sizes.select(*keys, "_rows", F.posexplode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("_i", "_p"))
    ranks = wanted.select(*keys, "_i", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.floor(place).alias("r"), (place - F.floor(place)).alias("share")),
        F.struct(F.lit(1).alias("side"), F.ceil(place).alias("r"), (place - F.floor(place)).alias("share")))).alias("_x"))
    ranks = ranks.select(*keys, "_i", (F.col("_i") * 2 + F.col("_x.side")).alias("_j"), F.col("_x.r").alias("_r"), F.col("_x.share").alias("_share"))
    found = select_ranks(data, keys, ranks.select(*keys, "_j", "_r"), bounded_keys)
    both = ranks.join(found, [*keys, "_j"])
    per_rank = both.groupBy(*keys, "_i").agg(
        F.max(F.when(F.col("_j") % 2 == 0, F.col("_value"))).alias("_lo"), F.max(F.when(F.col("_j") % 2 == 1, F.col("_value"))).alias("_hi"),
        F.max("_share").alias("_share"))
    per_rank = per_rank.withColumn("_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_share"))
    # one entry per probability: the list has the fixed length of `probabilities`
    return per_rank.groupBy(*keys).agg(F.array(*[
        F.max(F.when(F.col("_i") == i, F.col("_q"))) for i in range(len(probabilities))
    ]).alias("quantiles"))


def box_statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers (the furthest values within 1.5 interquartile ranges), outliers.

    The keys and the value are written to the checkpoint folder once: the rounds of the exact
    quartiles read them again and again, and what stands before them is not computed each time.
    """
    keys = list(keys)
    data = _checkpointed(df.select(*keys, value).dropna())
    q = exact_percentiles(data, keys, value, (0.25, 0.5, 0.75)).select(
        *keys, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    low, high = F.col("q1") - reach, F.col("q3") + reach
    inside = (F.col(value) >= low) & (F.col(value) <= high)
    return data.join(q, keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


def _checkpointed(df: DataFrame) -> DataFrame:
    """The frame written to the session's checkpoint folder (spark.checkpoint.dir), if one is set.

    Without a shared folder the lineage is kept and recomputed where read again; no local
    folder is ever used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", "")
        if not shared:
            return df
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def local_trend(df: DataFrame, x: str, y: str, points: int = 21, share: float = 2 / 3, passes: int = 3) -> DataFrame:
    """Robust local linear trend of y on x at `points` evenly spaced x values.

    Each point is a straight-line fit weighted by the tricube of the distance, over a
    neighbourhood that reaches the nearest `share` of all rows: its reach is the distance of rank
    ceil(n * share) (1-based) from the point, selected exactly by `select_ranks` with the grid
    point as key (at most `points` keys, so the wanted prefixes are a bounded lookup and the
    distances are counted where they are made).

    Then `passes` robust passes, as the plotting convention does: each row's fitted value is
    read off the grid fits by linear interpolation, s is the exact median of the absolute
    residuals, and every row's weight is multiplied by the bisquare (1 - u^2)^2 of u = residual /
    (6 s) (0 from |u| >= 1). Where s is 0 or a row has no fitted value its weight stays 1.
    The ends, the reaches, every fit and every scale are at most `points` numbers; they are
    fetched and handed on as literals, which keeps each pass one flat plan. No pairs of rows are
    formed. The two columns are written to the checkpoint folder once, since every pass reads them.
    """
    data = _checkpointed(df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where(
        F.col("_x").isNotNull() & F.col("_y").isNotNull()))
    lo, hi, n = data.agg(F.min("_x"), F.max("_x"), F.count(F.lit(1))).first()
    if not n:
        return data.sparkSession.createDataFrame([], "point bigint, x double, trend double")
    grid = [lo + (hi - lo) * (i / (points - 1)) for i in range(points)]
    distances = data.select(F.posexplode(F.array(*[F.abs(F.col("_x") - F.lit(g)) for g in grid])).alias("_point", "_v"))
    wanted = data.sparkSession.createDataFrame([(i, 0, math.ceil(n * share) - 1) for i in range(points)], "_point int, _j int, _r long")
    reach = {r["_point"]: r["_value"] for r in select_ranks(distances, ["_point"], wanted, bounded_keys=points).collect()}

    def sums(i: int, g: float, robust: Column) -> Column:
        dx = F.col("_x") - F.lit(g)
        ratio = F.least(F.abs(dx) / F.nullif(F.lit(reach[i]), F.lit(0.0)), F.lit(1.0))
        w = F.pow(1 - F.pow(ratio, 3), 3) * robust
        return F.struct(
            F.lit(i).cast("bigint").alias("point"), F.lit(g).alias("x"), F.sum(w).alias("w"),
            F.sum(w * dx).alias("wx"), F.sum(w * F.col("_y")).alias("wy"),
            F.sum(w * dx * dx).alias("wxx"), F.sum(w * dx * F.col("_y")).alias("wxy"))

    # centred on the grid point, the intercept of the weighted line is the trend there
    det = F.nullif(F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"), F.lit(0.0))
    trend = (F.col("wxx") * F.col("wy") - F.col("wx") * F.col("wxy")) / det

    def fit(robust: Column) -> DataFrame:
        return data.agg(F.array(*[sums(i, g, robust) for i, g in enumerate(grid)]).alias("_all")).select(
            F.inline("_all")).select("point", "x", trend.alias("trend"))

    def fitted(line: list) -> Column:
        """Each row's value on the broken line through the grid fits."""
        points_line = F.array(*[F.lit(v).cast("double") for v in line])
        at = (F.col("_x") - F.lit(lo)) / F.lit(hi - lo) * (points - 1) if hi > lo else F.lit(0.0)
        i = F.least(F.floor(at), F.lit(points - 2)).cast("int")
        a, b = F.get(points_line, i), F.get(points_line, i + 1)
        return a + (b - a) * (at - i)

    fits = fit(F.lit(1.0))
    for _ in range(passes):
        # the fits and the scale are `points` numbers and one: handed on as literals
        line = [r["trend"] for r in sorted(fits.collect(), key=lambda r: r["point"])]
        residual = F.col("_y") - fitted(line)
        scale = exact_percentiles(data.select(F.lit(0).alias("_one"), F.abs(residual).alias("_r")), ["_one"], "_r", (0.5,), bounded_keys=1).first()
        s = scale["quantiles"][0] if scale else None
        if not s:
            robust = F.lit(1.0)
        else:
            u = residual / (6 * s)
            robust = F.when(residual.isNull(), F.lit(1.0)).when(F.abs(u) < 1, F.pow(1 - u * u, 2)).otherwise(F.lit(0.0))
        fits = fit(robust)
    return fits


def totals(df: DataFrame, keys: Sequence[str] = (), **named: Column) -> DataFrame:
    """Several grand totals in one pass."""
    return df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in named.items()])


def head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows in the order of a digest of seed and key, which no partitioning changes.

    Each task keeps its own n smallest digests before they are merged.
    """
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


def extremes(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    c = as_col(column)
    return df.groupBy(*keys).agg(F.min(c).alias("first"), F.max(c).alias("last"))
