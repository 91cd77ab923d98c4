"""Profiles: pixels binned along a zone's main axis, quantiles by bin, gaps filled and smoothed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .zonal import exact_quantiles


def stride_sample(df: DataFrame, most: int, order: list[str], *keys: str) -> DataFrame:
    """Every n-th row of each key in order from the first, with the least n that leaves ``most`` rows."""
    w = Window.partitionBy(*keys)
    step = F.ceil(F.col("_n") / most)
    return (
        df.withColumn("_n", F.count(F.lit(1)).over(w))
        .withColumn("_k", F.row_number().over(w.orderBy(*order)) - 1)
        .where((F.col("_n") <= most) | (F.col("_k") % step == 0))
        .drop("_n", "_k")
    )


def bin_of(d: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of a distance between two ends; what is outside goes to the first or last, all to the first when the ends meet."""
    scale = hi - lo
    place = F.when(scale > 0, ((d - lo) / scale * bins).cast("int")).otherwise(0)
    return F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0))


def binned(df: DataFrame, value: str, bins: int, *keys: str, bin: str = "bin") -> DataFrame:
    """(keys, bin, p10, p50, p90) for all bins of each key; nulls where a bin is empty."""
    found = exact_quantiles(df, [*keys, bin], value, {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    every = df.select(*keys).distinct().withColumn(bin, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(found, [*keys, bin], "left")


def filled(df: DataFrame, value: str, place: str, *keys: str) -> Column:
    """A series with gaps filled linearly by place; ends hold the nearest value, a series of gaps is zero."""
    w = Window.partitionBy(*keys).orderBy(place)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    v, i = F.col(value), F.col(place).cast("double")
    at = F.when(v.isNotNull(), i)
    v0, v1 = F.last(v, True).over(back), F.first(v, True).over(ahead)
    i0, i1 = F.last(at, True).over(back), F.first(at, True).over(ahead)
    between = F.when(i1 > i0, v0 + (v1 - v0) * (i - i0) / (i1 - i0)).otherwise(v0)
    return F.coalesce(v, between, v0, v1, F.lit(0.0))


def smoothed(value: str, place: str, *keys: str, window: int = 7) -> Column:
    """Mean over an odd number of neighbours, where the ends repeat beyond themselves; short series stay as they are."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    k = window // 2
    w = Window.partitionBy(*keys)
    o = w.orderBy(place)
    n, i, v = F.count(F.lit(1)).over(w), F.row_number().over(o) - 1, F.col(value)
    whole = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(v).over(whole), F.last(v).over(whole)
    total = F.sum(v).over(o.rowsBetween(-k, k)) + F.greatest(F.lit(0), k - i) * first + F.greatest(F.lit(0), i + k - (n - 1)) * last
    return F.when(F.lit(window <= 1) | (n < 3), v).otherwise(total / window)


CURVES = ("p10", "p50", "p90")


def series(bins_table: DataFrame, bins: int, *keys: str, window: int = 7) -> DataFrame:
    """(keys, bin, x, p10, p50, p90): curves of profiles from the quantiles of their bins."""
    full = bins_table.select(*keys, "bin", *(filled(bins_table, c, "bin", *keys).alias(c) for c in CURVES))
    x = F.col("bin") / F.lit(float(max(1, bins - 1)))
    return full.select(*keys, "bin", x.alias("x"), *(smoothed(c, "bin", *keys, window=window).alias(c) for c in CURVES))


def packed_profiles(curves: DataFrame, *keys: str) -> DataFrame:
    """One row for each profile: its curves as arrays and their extent."""
    rows = F.array_sort(F.collect_list(F.struct("bin", "x", *CURVES)))
    out = curves.groupBy(*keys).agg(rows.alias("_rows"), F.min("p10").alias("y_min"), F.max("p90").alias("y_max"))
    return out.select(*keys, *(F.col("_rows")[c].alias(c) for c in ("x", *CURVES)), "y_min", "y_max")


def width_km(lo: Column, hi: Column) -> Column:
    return F.greatest(hi - lo, F.lit(0.0)) / 1000


def shared_ranges(profiles: DataFrame) -> DataFrame:
    """One row: the least y_min, the greatest y_max and half of the greatest width of the chosen profiles."""
    return profiles.agg(F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"), (F.max("width_km") / 2).alias("half_width_km"))


def to_unit(v: Column, lo: Column, hi: Column, pad: float = 0.1) -> Column:
    """A value between two ends as a share, with padding; the middle when the ends meet."""
    return F.when(hi <= lo, 0.5).otherwise((v - lo) / (hi - lo) * max(1 - 2 * pad, 0.0) + pad)


def latest(profiles: DataFrame, modified: str, path: str, *keys: str) -> DataFrame:
    """The latest of each key, of equally late ones that of the first path; by rank, those without one last, then by name."""
    w = Window.partitionBy(*keys).orderBy(F.col(modified).desc(), F.col(path))
    kept = profiles.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return kept.orderBy(F.col("rank").asc_nulls_last(), *(F.lower(F.col(k)) for k in keys))


def profiles(pixels: DataFrame, zones: DataFrame, bins: int = 120, samples: int = 12_000) -> DataFrame:
    """Profiles of zones (tatort, kommun, geometry, axis) from their clipped pixels (tatort, kommun, tile, row, col, x, y, v)."""
    from . import geometry as g

    keys = ("tatort", "kommun")
    center = g.centroid(F.col("geometry"))
    shaped = zones.withColumn("_c", center).withColumn("_e", g.extent_along(F.col("geometry"), F.col("_c"), F.col("axis")))
    drawn = stride_sample(pixels.where(F.col("v").isNotNull()), samples, ["row", "col"], *keys, "tile")
    placed = drawn.join(shaped.select(*keys, "_c", "_e", "axis"), list(keys)).withColumn(
        "bin", bin_of(g.along(F.col("x"), F.col("y"), F.col("_c"), F.col("axis")), F.col("_e")["lo"], F.col("_e")["hi"], bins)
    )
    curves = packed_profiles(series(binned(placed, "v", bins, *keys), bins, *keys), *keys)
    return curves.join(
        shaped.select(
            *keys,
            width_km(F.col("_e")["lo"], F.col("_e")["hi"]).alias("width_km"),
            g.outlines(F.col("geometry")).alias("outline_segments"),
            g.axis_segment(F.col("geometry"), F.col("axis")).alias("view_axis_segment"),
        ),
        list(keys),
    )
