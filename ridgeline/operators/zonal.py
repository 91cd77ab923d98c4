"""Zonal statistics as mergeable partials: pixels to tiles, tiles to zones, zones to scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ZONE = ("tatort", "kommun")


def extremes(value: str, place: Column, *order: str) -> list[Column]:
    """``local_min``, ``local_max`` and the places of their first occurrence in the given order, for an aggregation."""
    v = F.col(value)
    at = F.when(v.isNotNull(), place)
    return [
        F.min(v).alias("local_min"),
        F.max(v).alias("local_max"),
        F.min_by(at, F.when(v.isNotNull(), F.struct(v, *order))).alias("min_coord"),
        F.min_by(at, F.when(v.isNotNull(), F.struct(-v, *order))).alias("max_coord"),
    ]


def tile_partials(pixels: DataFrame, *keys: str, empty: bool = False) -> DataFrame:
    """A mergeable partial for each (keys): extremes with places, counts and sum of squared slopes; tiles without a valid pixel go unless ``empty``."""
    place = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return (
        pixels.groupBy(*keys)
        .agg(
            *extremes("v", place, "row", "col"),
            F.count("v").alias("n_values"),
            F.coalesce(F.sum(F.col("slope") * F.col("slope")), F.lit(0.0)).alias("slope_sum_squares"),
            F.count("slope").alias("slope_count"),
        )
        .where(F.lit(empty) | (F.col("n_values") > 0))
    )


def merge_partials(partials: DataFrame, *keys: str, order: tuple[str, ...] = ("batch_index", "batch_position")) -> DataFrame:
    """Partials of one key merged; of equal extremes the first in the given order wins."""
    return partials.groupBy(*keys).agg(
        F.min("local_min").alias("min_altitude_m"),
        F.max("local_max").alias("max_altitude_m"),
        F.min_by("min_coord", F.struct("local_min", *order)).alias("min_coord"),
        F.min_by("max_coord", F.struct(-F.col("local_max"), *order)).alias("max_coord"),
        F.sum("n_values").alias("n_values"),
        F.sum("slope_sum_squares").alias("slope_sum_squares"),
        F.sum("slope_count").alias("slope_count"),
        F.count(F.lit(1)).alias("tiles_used"),
    )


def rms(squares: Column, count: Column) -> Column:
    """Root of a mean of squares, 0 of none."""
    return F.coalesce(F.sqrt(squares / F.nullif(count, F.lit(0))), F.lit(0.0))


def enclosing_counts(df: DataFrame, keys: list[str], value: str, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """(keys, _n, _k, _x, _in): for the share of number ``_k``, how often each value ``_x`` near its rank occurs, and all below as one without ``_x``.

    A first read has the number of values of each key and, by its mergeable sketch, two values that enclose each wanted rank: their ranks are at
    most ``4 / accuracy`` of all values away from it, four times the sketch's error. The second read counts how often each value between them occurs.
    Constants, ties and outliers are one row each, and of all different values about ``8 / accuracy`` are rows, or all if a key has at most ``4 * accuracy``.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull()).select(*keys, v.alias("_v"))
    margin = 4 / accuracy
    points = sorted({p for q in shares for p in (q - margin, q + margin) if 0 < p < 1})
    sketch = [F.percentile_approx("_v", points, accuracy).alias("_at")] if points else []
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *sketch)
    small = F.col("_n") <= 4 * accuracy  # a step of one rank is more than the margin
    edge = lambda p, end: F.when(small, F.col(end)).otherwise(F.get("_at", F.lit(points.index(p)))) if p in points else F.col(end)
    around = F.array(*(F.struct(F.lit(k).alias("k"), edge(q - margin, "_lo").alias("low"), edge(q + margin, "_hi").alias("high")) for k, q in enumerate(shares)))
    met = rows.join(ends.select(*keys, "_n", around.alias("_around")), keys)
    places = F.transform(F.filter("_around", lambda e: F.col("_v") <= e["high"]), lambda e: F.struct(e["k"].alias("_k"), F.when(F.col("_v") >= e["low"], F.col("_v")).alias("_x")))
    return met.select(*keys, "_n", F.inline(places)).groupBy(*keys, "_n", "_k", "_x").agg(F.count(F.lit(1)).alias("_in"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """(keys, a column for each share): exact quantiles with linear interpolation, in two reads and without a group in one task.

    Only the counts of the values near a rank are ordered. Nulls are left out. A sketch that broke its promise is an error, not a wrong result.
    """
    counts = enclosing_counts(df, keys, value, list(shares.values()), accuracy)
    before = Window.partitionBy(*keys, "_k").orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0))).where("_x IS NOT NULL")
    at = {name: (F.col("_n") - 1) * F.lit(float(q)) for name, q in shares.items()}

    def found(k: int, name: str, rank: Column) -> Column:
        return F.max(F.when((F.col("_k") == k) & (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_in")), F.col("_x"))).alias(name)

    packed = ranked.groupBy(*keys, "_n").agg(*(found(k, f"_{side}{k}", f(h)) for k, h in enumerate(at.values()) for side, f in (("low", F.floor), ("high", F.ceil))))

    def between(k: int, h: Column) -> Column:
        low, high = F.col(f"_low{k}"), F.col(f"_high{k}")
        return F.coalesce(low + (high - low) * (h - F.floor(h)), F.raise_error(F.lit("a quantile's rank was outside its bounds")).cast("double"))

    return packed.select(*keys, *(between(k, h).alias(name) for k, (name, h) in enumerate(at.items())))


def finalize(merged: DataFrame, quantiles: DataFrame, areas: DataFrame, *keys: str) -> DataFrame:
    """Scores of zones from merged partials, the quantiles relief_q05_m and relief_q95_m and ``area_m2``. A zone of no area is an error."""
    joined = merged.join(quantiles, list(keys)).join(areas.select(*keys, "area_m2"), list(keys))
    km2 = F.col("area_m2") / 1e6
    return (
        joined.withColumn("altitude_range_m", F.col("max_altitude_m") - F.col("min_altitude_m"))
        .withColumn("normalized_relief", (F.col("relief_q95_m") - F.col("relief_q05_m")) / F.sqrt(km2))
        .withColumn("rms_slope_deg", rms(F.col("slope_sum_squares"), F.col("slope_count")))
        .withColumn("hilliness_score", F.col("normalized_relief") * F.col("rms_slope_deg"))
    )


def altitude_stats(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, median and population deviation of altitudes."""
    v = F.col(value).cast("double")
    plain = df.groupBy(*keys).agg(F.avg(v).alias("mean_altitude"), F.stddev_pop(v).alias("std_altitude"), F.count(v).alias("n_values"))
    return plain.join(exact_quantiles(df, list(keys), value, {"median_altitude": 0.5}), list(keys))


def slope_stats(df: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """Mean, median, 90 % quantile and greatest slope, and the share above a threshold."""
    plain = df.where(F.col("slope").isNotNull()).groupBy(*keys).agg(
        F.avg("slope").alias("mean_slope"), F.max("slope").alias("max_slope"), F.avg((F.col("slope") > threshold).cast("double")).alias("share_above")
    )
    return plain.join(exact_quantiles(df, list(keys), "slope", {"median_slope": 0.5, "p90_slope": 0.9}), list(keys))


def ranked(scores: DataFrame, score: Column, *ties: str) -> DataFrame:
    """The rows with ``rank``, their place by score, greatest first; ties keep the order of the given columns.

    For tables of one row for each zone: the places come from one ordered window over them.
    """
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(score.desc_nulls_last(), *map(F.col, ties))))


def places_by(rows: DataFrame, orders: dict[str, list[Column]], *keys: str) -> DataFrame:
    """The rows with their place within each key by every order, a column for each."""
    w = Window.partitionBy(*keys)
    return rows.select("*", *(F.row_number().over(w.orderBy(*order)).cast("bigint").alias(name) for name, order in orders.items()))


def top_by(rows: DataFrame, n: int, orders: dict[str, list[Column]], *keys: str) -> DataFrame:
    """Of each key the rows that are among the first ``n`` by any of the orders, with their places."""
    return places_by(rows, orders, *keys).where(reduce(lambda a, b: a | b, (F.col(name) <= n for name in orders)))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
