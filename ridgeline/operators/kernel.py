"""One tile under one zone as arrays: window, polygon fill, slopes, partial and values by cell, in a single Arrow task.

``zone_tiles`` takes a row for each (zone, tile) with the tile's file and yields what is kept of it. Pixels live in the task alone: none
goes through an exchange, and no task holds more than one tile. A tile of any height may come in bands (see ``tables.packed_bands``), of which a task holds one. The fill walks the polygon's edges by row, so that it costs rows crossed plus edges,
not pixels times edges; it decides every pixel centre as ``geometry.contains`` does, by the same formula.

The values that are kept are single floats, by cell: a cell is the upper half of a float's bits as an integer that keeps the order, so that a tile has a
mergeable histogram of at most 2^16 cells beside its values. ``quantiles`` adds up histograms, and reads the values of the wanted cells alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.geotiff import decode

ZONE = ("tatort", "kommun")
#: A row without a cell is the partial of its (zone, tile), which has as many values as ``n``; others are cells with their values.
MEASURED = (
    "tatort string, kommun string, item_id string, cell int, n bigint, lo float, hi float, values array<float>, local_min double, local_max double, "
    "min_x double, min_y double, max_x double, max_y double, slope_sum_squares double, slope_count bigint"
)
BAND = ("part", "above", "below")
SAMPLED = "tatort string, kommun string, tile string, row int, col int, x double, y double, v double"


def window(head: dict, shape: tuple[int, int], points: np.ndarray) -> tuple[slice, slice]:
    """Rows and columns of the cells that share more than a border with the bounds of points."""
    if not len(points):
        return slice(0, 0), slice(0, 0)
    (minx, miny), (maxx, maxy) = points.min(axis=0), points.max(axis=0)
    x = head["x0"] + (np.arange(shape[1]) + 0.5) * head["res_x"]
    y = head["y0"] - (np.arange(shape[0]) + 0.5) * head["res_y"]
    cols = np.flatnonzero((x + head["res_x"] / 2 > minx) & (x - head["res_x"] / 2 < maxx))
    rows = np.flatnonzero((y + head["res_y"] / 2 > miny) & (y - head["res_y"] / 2 < maxy))
    some = len(cols) and len(rows)
    return (slice(int(rows[0]), int(rows[-1]) + 1), slice(int(cols[0]), int(cols[-1]) + 1)) if some else (slice(0, 0), slice(0, 0))


def filled(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which cells have their centre in the polygon of the edges (x1, y1, x2, y2) by the even-odd rule; ``x`` rises, ``y`` falls.

    Every edge meets the rows between its ends, and turns over all cells to the left of where it meets them.
    """
    up = y[::-1]
    x1, y1, x2, y2 = edges.T
    first = np.searchsorted(up, np.minimum(y1, y2), "left")
    count = np.searchsorted(up, np.maximum(y1, y2), "left") - first
    turns = np.zeros((len(y), len(x) + 1), np.int32)
    block = 1 << 20  # crossings at once
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
        part = slice(at, stop)
        k = np.repeat(np.arange(at, stop), count[part])
        row = np.repeat(first[part] - (np.cumsum(count[part]) - count[part]), count[part]) + np.arange(len(k))
        cross = (x2[k] - x1[k]) * (up[row] - y1[k]) / (y2[k] - y1[k]) + x1[k]
        np.add.at(turns, (len(y) - 1 - row, np.searchsorted(x, cross, "left")), 1)
        at = stop
    right = np.cumsum(turns[:, ::-1], axis=1)[:, ::-1]  # crossings at or beyond a column's end
    return right[:, 1:] % 2 == 1


def slopes(v: np.ndarray, res_x: float, res_y: float) -> np.ndarray:
    """Slopes in degrees from central differences, one-sided at the edges; NaN where a value that is needed is missing, and in a window of one row or column."""
    if min(v.shape) < 2:
        return np.full(v.shape, np.nan)
    gy, gx = np.gradient(v, res_y, res_x)
    return np.degrees(np.arctan(np.sqrt(gx * gx + gy * gy)))


def clipped(content: bytes, edges: np.ndarray, nodata: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict, int, int]:
    """(values with NaN outside and where missing, x, y, header with ``height``, first row, first column) of a tile's window under a polygon. The file's own missing value counts if none is given."""
    values, head = decode(content)
    nodata = head["nodata"] if nodata is None else nodata
    rows, cols = window(head, values.shape, edges.reshape(-1, 2))
    v = values[rows, cols].copy()
    x = head["x0"] + (np.arange(cols.start, cols.stop) + 0.5) * head["res_x"]
    y = head["y0"] - (np.arange(rows.start, rows.stop) + 0.5) * head["res_y"]
    if v.size:
        bad = ~np.isfinite(v) | ~filled(edges, x, y)
        if nodata is not None and np.isfinite(nodata):
            bad |= np.abs(v - nodata) <= 1e-8 + 1e-5 * abs(nodata)
        v[bad] = np.nan
    return v, x, y, {**head, "height": len(values)}, rows.start, cols.start


def cell_of(v: np.ndarray) -> np.ndarray:
    """The upper half of the bits of single floats as an integer that keeps their order."""
    bits = (v.astype(np.float32) + np.float32(0)).view(np.int32)  # no negative zero
    return np.where(bits < 0, ~(bits & 0x7FFFFFFF), bits) >> 16


def measured(content: bytes, edges: np.ndarray, nodata: float | None, above: int = 0, below: int = 0) -> tuple[tuple, list[tuple]]:
    """(partial, cells) of a tile under a polygon; of equal extremes the first by row and column counts. So many rows above and below are there for slopes alone."""
    v, x, y, head, top, _ = clipped(content, edges, nodata)
    nodata = head["nodata"] if nodata is None else nodata
    s = slopes(v, head["res_x"], head["res_y"])
    own = slice(max(above - top, 0), max(head["height"] - below - top, 0))
    v, y, s = v[own], y[own], s[own]
    valid = ~np.isnan(v)
    n = int(valid.sum())
    s = s[~np.isnan(s) & (valid if nodata is None or not np.isfinite(nodata) else True)]
    squares = float(np.square(s).sum())
    if not n:
        return (0, *(None,) * 6, squares, len(s)), []
    places = []
    for at in (np.nanargmin(v), np.nanargmax(v)):
        row, col = np.unravel_index(at, v.shape)
        places += [float(x[col]), float(y[row])]
    kept = np.sort(v[valid].astype(np.float32))
    cells = cell_of(kept)
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    parts = [(int(cells[a]), b - a, float(kept[a]), float(kept[b - 1]), kept[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True)]
    return (n, float(np.nanmin(v)), float(np.nanmax(v)), *places, squares, len(s)), parts


def _edges(column: pa.Array, k: int) -> np.ndarray:
    flat = column[k].values
    return np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in range(4)], axis=1)


def zone_tiles(tiles: DataFrame, nodata: float | None = None) -> DataFrame:
    """What is kept of each row (tatort, kommun, item_id, edges, content): its partial, one without values too, and its cells. A tile without a file isn't a row.

    Rows of bands have ``part``, ``above`` and ``below`` besides; what is kept of them has ``part``.
    """
    banded = "part" in tiles.columns
    names = [c.split()[0] for c in MEASURED.split(", ")]
    floats = pa.list_(pa.float32())
    types = [pa.string()] * 3 + [pa.int32(), pa.int64(), pa.float32(), pa.float32(), floats] + [pa.float64()] * 7 + [pa.int64()]
    schema = pa.schema([*zip(names, types, strict=True), *([("part", pa.int32())] if banded else [])])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                key = [batch[c][k].as_py() for c in (*ZONE, "item_id")]
                part, *margins = [batch[c][k].as_py() for c in BAND] if banded else [None]
                partial, cells = measured(batch["content"][k].as_py(), _edges(batch["edges"], k), nodata, *margins)
                last = (part,) if banded else ()
                rows = [(*key, None, partial[0], None, None, None, *partial[1:], *last)]
                size = 0
                for cell in cells:
                    rows.append((*key, *cell, *(None,) * 8, *last))
                    size += cell[1]
                    if size > 1 << 20:
                        yield _batch(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, schema)

    return tiles.select(*ZONE, "item_id", "edges", "content", *(BAND if banded else ())).mapInArrow(run, MEASURED + (", part int" if banded else ""))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def samples(tiles: DataFrame, most: int, nodata: float | None = None) -> DataFrame:
    """Valid pixels of each row (see ``zone_tiles``): every n-th by row and column, with the least n that leaves ``most``."""

    def run(batches):
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]]) for c in SAMPLED.split(", ")])
        for batch in batches:
            for k in range(batch.num_rows):
                key = [batch[c][k].as_py() for c in (*ZONE, "item_id")]
                v, x, y, _, row0, col0 = clipped(batch["content"][k].as_py(), _edges(batch["edges"], k), nodata)
                row, col = np.nonzero(~np.isnan(v))
                step = max(1, -(-len(row) // most))
                row, col = row[::step], col[::step]
                columns = [*([c] * len(row) for c in key), row + row0, col + col0, x[col], y[row], v[row, col]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return tiles.select(*ZONE, "item_id", "edges", "content").mapInArrow(run, SAMPLED)


def partials(found: DataFrame) -> DataFrame:
    """The partials of measured tiles, as ``zonal.tile_partials`` has them; those of a tile's bands are merged, and of equal extremes the upper band's counts."""
    place = lambda k: F.when(F.col("n") > 0, F.struct(F.col(f"{k}_x").alias("x"), F.col(f"{k}_y").alias("y"))).alias(f"{k}_coord")
    rows = found.where("cell IS NULL")
    if "part" in found.columns:
        first = lambda c, v: F.min_by(c, F.when(F.col("n") > 0, F.struct(v, "part"))).alias(c)
        low, high = F.col("local_min"), -F.col("local_max")
        ends = first("min_x", low), first("min_y", low), first("max_x", high), first("max_y", high)
        rows = rows.groupBy(*ZONE, "item_id").agg(*ends, F.min("local_min").alias("local_min"), F.max("local_max").alias("local_max"), *(F.sum(c).alias(c) for c in ("n", "slope_sum_squares", "slope_count")))
    return rows.select(*ZONE, "item_id", "local_min", "local_max", place("min"), place("max"), F.col("n").alias("n_values"), "slope_sum_squares", "slope_count")


WANTED = ("_n", "_base", "_ranks")


def wanted_ranks(shares: list[float]) -> Column:
    """The ranks below and above each share of ``_n`` values, numbered."""
    rank = lambda q, f: f((F.col("_n") - 1) * F.lit(float(q))).cast("bigint")
    return F.array(*(F.struct(F.lit(2 * k + side).alias("r"), rank(q, f).alias("rank")) for k, q in enumerate(shares) for side, f in enumerate((F.floor, F.ceil))))


def held_ranks(counts: DataFrame, order: str, *keys: str) -> DataFrame:
    """Of counts (keys, order, _in, _base, _ranks) those that hold a wanted rank, with these ranks; ``_base`` becomes the number of values before them."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_base", F.col("_base") + F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
    held = F.filter("_ranks", lambda r: (r["rank"] >= F.col("_base")) & (r["rank"] < F.col("_base") + F.col("_in")))
    return before.withColumn("_ranks", held).where(F.size("_ranks") > 0)


def interpolated(low: Column, high: Column, n: Column, share: float) -> Column:
    """The value at a share between those of the ranks below and above it."""
    h = (n - 1) * F.lit(float(share))
    return low + F.when(high == low, 0.0).otherwise((high - low) * (h - F.floor(h)))


def quantiles(cells: DataFrame, shares: dict[str, float], *keys: str) -> DataFrame:
    """(keys, a column for each share): exact quantiles with linear interpolation of the values in cells (keys, cell, n, values).

    The first read adds up the cells' counts alone and finds the cell of each wanted rank; the second reads the values of these cells and counts each of
    at most 2^16 different ones. So a window has at most 2^16 rows whatever the number of values is.
    """
    counts = cells.where("cell IS NOT NULL").groupBy(*keys, "cell").agg(F.sum("n").alias("_in"))
    totals = counts.withColumn("_n", F.sum("_in").over(Window.partitionBy(*keys))).withColumn("_base", F.lit(0).cast("bigint")).withColumn("_ranks", wanted_ranks(list(shares.values())))
    wanted = held_ranks(totals, "cell", *keys).select(*keys, "cell", *WANTED)
    inside = cells.join(wanted, [*keys, "cell"]).select(*keys, "cell", *WANTED, F.explode("values").alias("_x"))
    each = inside.groupBy(*keys, "cell", "_x").agg(F.count(F.lit(1)).alias("_in"), *(F.first(c).alias(c) for c in WANTED))
    found = held_ranks(each, "_x", *keys, "cell").select(*keys, "_n", "_x", F.explode("_ranks").alias("_r"))
    picked = found.groupBy(*keys, "_n").agg(*(F.max(F.when(F.col("_r.r") == r, F.col("_x"))).cast("double").alias(f"_{r}") for r in range(2 * len(shares))))
    return picked.select(*keys, *(interpolated(F.col(f"_{2 * k}"), F.col(f"_{2 * k + 1}"), F.col("_n"), q).alias(name) for k, (name, q) in enumerate(shares.items())))
