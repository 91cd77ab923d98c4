"""Rasters as tall pixel tables (tile, row, col, v), dense, with null for masked cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def is_nodata(v: Column, nodata: float) -> Column:
    """Within the usual tolerance for floats of the value that marks missing cells."""
    return F.abs(v - nodata) <= 1e-8 + 1e-5 * abs(nodata)


def masked(v: Column, nodata: float | None = None) -> Column:
    """The value, or null for NaN, infinite and missing ones."""
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(~(bad | is_nodata(v, nodata)) if nodata is not None else ~bad, v)


def with_slope(pixels: DataFrame, res_x: float | Column = 1.0, res_y: float | Column = 1.0, nodata_defined: bool = False, tile: str = "tile") -> DataFrame:
    """The pixels with ``slope`` in degrees, from central differences, one-sided at the edges of the tile's window.

    Edges are found by place, not by missing neighbours, as those may be masked. A masked cell with four valid
    neighbours has a slope; it counts when a missing value is defined and not when none is. A window of
    one row or column has none. One exchange by tile serves all windows.
    """
    x_res = F.abs(res_x if isinstance(res_x, Column) else F.lit(float(res_x)))
    y_res = F.abs(res_y if isinstance(res_y, Column) else F.lit(float(res_y)))
    whole = Window.partitionBy(tile)
    across, down = Window.partitionBy(tile, "row").orderBy("col"), Window.partitionBy(tile, "col").orderBy("row")
    dealt = pixels.repartition(tile)
    near = dealt.select(
        "*",
        *(f(c).over(whole).alias(f"_{n}_{c}") for c in ("row", "col") for n, f in (("first", F.min), ("last", F.max))),
        F.lag("v").over(across).alias("_w"),
        F.lead("v").over(across).alias("_e"),
        F.lag("v").over(down).alias("_n"),
        F.lead("v").over(down).alias("_s"),
    )

    def change(place: str, before: str, after: str, res: Column) -> Column:
        at, first, last = F.col(place), F.col(f"_first_{place}"), F.col(f"_last_{place}")
        inner = (F.col(after) - F.col(before)) / (2 * res)
        return F.when(first == last, None).when(at == first, (F.col(after) - F.col("v")) / res).when(at == last, (F.col("v") - F.col(before)) / res).otherwise(inner)

    gx, gy = change("col", "_w", "_e", x_res), change("row", "_n", "_s", y_res)
    slope = F.degrees(F.atan(F.sqrt(gx * gx + gy * gy)))
    kept = slope if nodata_defined else F.when(F.col("v").isNotNull(), slope)
    return near.select(*pixels.columns, kept.alias("slope"))
