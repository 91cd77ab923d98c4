"""Planar geometry on nested arrays: a multipolygon is an array of polygons, each an array of rings of points.

All but the main axis are built-in expressions over one row's geometry. Rings may be open or closed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.struct(minx.cast("double").alias("minx"), miny.cast("double").alias("miny"), maxx.cast("double").alias("maxx"), maxy.cast("double").alias("maxy"))


def vertices(geometry: Column) -> Column:
    """All points of all rings."""
    return F.flatten(F.flatten(geometry))


def bounds(geometry: Column) -> Column:
    return _let(
        vertices(geometry),
        lambda p: box(
            F.array_min(F.transform(p, lambda q: q["x"])),
            F.array_min(F.transform(p, lambda q: q["y"])),
            F.array_max(F.transform(p, lambda q: q["x"])),
            F.array_max(F.transform(p, lambda q: q["y"])),
        ),
    )


def boxes_touch(a: Column, b: Column) -> Column:
    """Whether two boxes share a point; borders count."""
    return (a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"]) & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"])


def ring_edges(ring: Column) -> Column:
    """(x1, y1, x2, y2) from each point of a ring to the next, the last to the first."""
    return F.transform(
        ring,
        lambda p, k: F.struct(
            p["x"].alias("x1"),
            p["y"].alias("y1"),
            F.get(ring, (k + 1) % F.size(ring))["x"].alias("x2"),
            F.get(ring, (k + 1) % F.size(ring))["y"].alias("y2"),
        ),
    )


def edges(geometry: Column) -> Column:
    """Edges of all rings. Taken together, the even-odd rule treats holes and parts rightly."""
    return F.flatten(F.transform(F.flatten(geometry), ring_edges))


def contains(shape_edges: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside by the even-odd rule over all edges."""
    crossed = F.filter(
        shape_edges,
        lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]),
    )
    return F.size(crossed) % 2 == 1


def _side(e: Column, x: Column, y: Column) -> Column:
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])


def meets_box(geometry: Column, b: Column) -> Column:
    """Whether a multipolygon and a box share a point: a vertex in the box, the box's corner in the shape, or an edge through the box.

    An edge meets a box when their bounds overlap and the box's corners aren't all on one side of its line.
    """

    def through(e: Column) -> Column:
        sides = [_side(e, b[x], b[y]) for x in ("minx", "maxx") for y in ("miny", "maxy")]
        overlap = (
            (F.least(e["x1"], e["x2"]) <= b["maxx"]) & (F.greatest(e["x1"], e["x2"]) >= b["minx"]) & (F.least(e["y1"], e["y2"]) <= b["maxy"]) & (F.greatest(e["y1"], e["y2"]) >= b["miny"])
        )
        return overlap & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    return _let(edges(geometry), lambda e: F.exists(e, through) | contains(e, b["minx"], b["miny"]))


def _ring_moments(ring: Column) -> Column:
    """(twice the signed area, the moments of the centroid) of a ring, taken from its first point for accuracy."""
    x0, y0 = ring[0]["x"], ring[0]["y"]
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    moved = F.transform(ring, lambda p: F.struct((p["x"] - x0).alias("x"), (p["y"] - y0).alias("y")))
    crossed = _let(moved, lambda r: F.transform(ring_edges(r), lambda e: F.struct((e["x1"] + e["x2"]).alias("x"), (e["y1"] + e["y2"]).alias("y"), (e["x1"] * e["y2"] - e["x2"] * e["y1"]).alias("cross"))))

    def add(acc: Column, e: Column) -> Column:
        return F.struct((acc["a"] + e["cross"]).alias("a"), (acc["mx"] + e["x"] * e["cross"]).alias("mx"), (acc["my"] + e["y"] * e["cross"]).alias("my"))

    def done(acc: Column) -> Column:
        sign = F.signum(acc["a"])
        area = F.abs(acc["a"]) / 2
        return F.struct(area.alias("area"), (sign * acc["mx"] / 6 + x0 * area).alias("mx"), (sign * acc["my"] / 6 + y0 * area).alias("my"))

    return F.aggregate(crossed, start, add, done)


def _moments(geometry: Column) -> Column:
    """Sums over all rings, holes taken off, whatever way round rings go."""
    rings = F.flatten(F.transform(geometry, lambda rings: F.transform(rings, lambda r, k: F.struct(_ring_moments(r).alias("m"), F.when(k == 0, 1.0).otherwise(-1.0).alias("w")))))
    start = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(rings, start, lambda acc, r: F.struct(*((acc[c] + r["w"] * r["m"][c]).alias(c) for c in ("area", "mx", "my"))))


def area(geometry: Column) -> Column:
    return _moments(geometry)["area"]


def centroid(geometry: Column) -> Column:
    """Area-weighted; null for a shape without area."""
    return _let(_moments(geometry), lambda m: F.when(m["area"] > 0, F.struct((m["mx"] / m["area"]).alias("x"), (m["my"] / m["area"]).alias("y"))))


def pixel_center(row: Column, col: Column, x0: Column, y0: Column, res_x: Column, res_y: Column) -> tuple[Column, Column]:
    """Grid coordinates of a pixel's centre in a north-up raster whose upper left corner is (x0, y0)."""
    return x0 + (col + 0.5) * res_x, y0 - (row + 0.5) * res_y


def along(x: Column, y: Column, center: Column, axis: Column) -> Column:
    """Distance along an axis from a centre."""
    return (x - center["x"]) * axis["x"] + (y - center["y"]) * axis["y"]


def extent_along(geometry: Column, center: Column, axis: Column) -> Column:
    """(lo, hi): the least and greatest distance of any vertex, those of holes too, along an axis.

    Centre and axis are bound once: within the lambda they would be worked out again for every vertex.
    """
    bound = F.struct(center.alias("c"), axis.alias("a"))
    distances = _let(bound, lambda s: F.transform(vertices(geometry), lambda p: along(p["x"], p["y"], s["c"], s["a"])))
    return _let(distances, lambda d: F.struct(F.array_min(d).alias("lo"), F.array_max(d).alias("hi")))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull in order, counter-clockwise, by monotone chains."""
    found = sorted(set(map(tuple, points.tolist())))
    if len(found) < 3:
        return np.array(found).reshape(-1, 2)

    def chain(order: list) -> list:
        kept: list = []
        for x, y in order:
            while len(kept) > 1:
                (ax, ay), (bx, by) = kept[-2:]
                if (bx - ax) * (y - ay) > (by - ay) * (x - ax):
                    break
                kept.pop()
            kept.append((x, y))
        return kept[:-1]

    return np.array(chain(found) + chain(found[::-1]))


def farthest(corners: np.ndarray, turns: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """How far a convex shape reaches in each direction. ``turns`` are the rising angles of its sides: the corner that is met lies where they pass the direction's normal.

    Its neighbours are looked at too, so that rounding of angles does no harm.
    """
    n = len(corners)
    normal = np.arctan2(directions[:, 1], directions[:, 0]) + np.pi / 2
    k = np.searchsorted(turns, turns[0] + np.mod(normal - turns[0], 2 * np.pi))
    near = corners[(k[:, None] + np.arange(-2, 3)) % n]
    return (near * directions[:, None, :]).sum(axis=2).max(axis=1)


def _sides(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sides, their unit vectors, the normals of these) of hulls of equally many corners (..., corner, 2)."""
    sides = np.roll(corners, -1, axis=-2) - corners
    units = sides / np.hypot(sides[..., 0], sides[..., 1])[..., None]
    return sides, units, np.stack([-units[..., 1], units[..., 0]], axis=-1)


def _longer(along: np.ndarray, across: np.ndarray, units: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Of each shape (shape, side) the direction of the longer side of the rectangle that is least, pointing right or else up."""
    best = np.arange(len(along)), np.argmin(np.round(along * across, 9), axis=1)
    rounded = [[round(x, 15), round(y, 15)] for x, y in np.where((along[best] >= across[best])[:, None], units[best], normals[best]).tolist()]
    found = np.array(rounded) + 0.0
    x, y = found.T
    return np.where(((x > 0) | ((x == 0) & (y > 0)))[:, None], found, -found + 0.0)


#: Hulls of at most so many corners are measured together, every side by every corner; larger ones alone.
FEW = 32


def long_sides(shapes: list[np.ndarray]) -> np.ndarray:
    """For each array of points the unit vector of the longer side of the smallest rectangle around them, pointing right or else up; (1, 0) for a single point.

    One side of that rectangle lies on a side of the hull. All sides are tried: those of small hulls of equally many corners in one step, those of a large hull
    each by the corners that it meets, so that no more than the hull is held.
    """
    found = np.tile([1.0, 0.0], (len(shapes), 1))
    alike: dict[int, list[tuple[int, np.ndarray]]] = {}
    for k, points in enumerate(shapes):
        corners = hull(points)
        if len(corners) > 1:
            alike.setdefault(len(corners), []).append((k, corners))
    for n, rows in alike.items():
        step = max(1, (1 << 18) // (n * n)) if n <= FEW else 1
        for part in (rows[at : at + step] for at in range(0, len(rows), step)):
            corners = np.array([c for _, c in part])
            sides, units, normals = _sides(corners)
            if n <= FEW:
                along, across = (np.ptp(v[:, :, None, 0] * corners[:, None, :, 0] + v[:, :, None, 1] * corners[:, None, :, 1], axis=2) for v in (units, normals))
            else:
                turns = np.unwrap(np.arctan2(sides[0, :, 1], sides[0, :, 0]))
                along, across = ((farthest(corners[0], turns, v[0]) + farthest(corners[0], turns, -v[0]))[None] for v in (units, normals))
            found[[k for k, _ in part]] = _longer(along, across, units, normals)
    return found


def long_side(points: np.ndarray) -> tuple[float, float]:
    """``long_sides`` of one array of points."""
    x, y = long_sides([points])[0].tolist()
    return x, y


def with_main_axis(zones: DataFrame, geometry: str = "geometry") -> DataFrame:
    """The rows with ``axis``, the long side of the smallest rectangle around their geometry. Each batch's points are one flat array."""

    @F.arrow_udf("struct<x:double,y:double>")
    def axis(points: pa.Array) -> pa.Array:
        flat = points.flatten()
        at = np.r_[0, np.cumsum(points.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
        xy = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in (0, 1)], axis=1)
        sides = long_sides([xy[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
        return pa.StructArray.from_arrays([pa.array(sides[:, 0]), pa.array(sides[:, 1])], ["x", "y"])

    return zones.withColumn("axis", axis(vertices(F.col(geometry))))


def normalized(p: Column, b: Column) -> Column:
    """A point relative to a box, by the longer of its sides, one unit at least."""
    scale = F.greatest(b["maxx"] - b["minx"], b["maxy"] - b["miny"], F.lit(1.0))
    return F.struct(((p["x"] - b["minx"]) / scale).alias("x"), ((p["y"] - b["miny"]) / scale).alias("y"))


def outlines(geometry: Column) -> Column:
    """Outer rings relative to the shape's bounds."""
    return _let(bounds(geometry), lambda b: F.transform(geometry, lambda rings: F.transform(rings[0], lambda p: normalized(p, b))))


def axis_segment(geometry: Column, axis: Column) -> Column:
    """Both ends of the axis through the centroid, as far as the corner of the bounds that is farthest along it, relative to the bounds."""

    def ends(s: Column) -> Column:
        b, c = s["b"], s["c"]
        reach = F.greatest(*(F.abs((b[x] - c["x"]) * axis["x"] + (b[y] - c["y"]) * axis["y"]) for x in ("minx", "maxx") for y in ("miny", "maxy")))
        end = lambda sign: normalized(F.struct((c["x"] + sign * axis["x"] * reach).alias("x"), (c["y"] + sign * axis["y"] * reach).alias("y")), b)
        return F.array(end(-1), end(1))

    return _let(F.struct(bounds(geometry).alias("b"), centroid(geometry).alias("c")), ends)


def touching_boxes(left: DataFrame, right: DataFrame, left_box: str, right_box: str, cell: float) -> DataFrame:
    """Rows of two tables whose boxes touch, each pair once, by an equi-join on grid cells.

    Boxes of the same corners are one class: each class is in all cells that it reaches, and a pair of classes is kept in the one cell that holds the lower left corner
    of what both share, so no distinct of pairs is needed. Cells should be about as large as the larger boxes. Rows meet by the pairs of their classes: each goes
    through an exchange with its class, not with every cell. The left rows of a pair are held, those of the right go by, and each comes out with all its left rows in turn.
    """
    cells = lambda b, lo, hi: F.sequence(F.floor(F.col(b)[lo] / cell), F.floor(F.col(b)[hi] / cell))
    put = lambda df, b: df.select(b).distinct().withColumn("_gx", F.explode(cells(b, "minx", "maxx"))).withColumn("_gy", F.explode(cells(b, "miny", "maxy")))
    a, b = F.col(left_box), F.col(right_box)
    classes = (
        put(left, left_box)
        .join(put(right, right_box), ["_gx", "_gy"])
        .where(boxes_touch(a, b))
        .where((F.floor(F.greatest(a["minx"], b["minx"]) / cell) == F.col("_gx")) & (F.floor(F.greatest(a["miny"], b["miny"]) / cell) == F.col("_gy")))
        .drop("_gx", "_gy")
    )
    return right.join(left.join(classes, left_box), right_box).select(*left.columns, *right.columns)


def box_level(b: Column, cell: float) -> Column:
    """The least level, from 0 on, whose cells are as large as the longer side of a box; a level's cells are twice as large as those of the one below."""
    side = F.greatest(b["maxx"] - b["minx"], b["maxy"] - b["miny"], F.lit(float(cell)))
    return F.ceil(F.log2(side / cell)).cast("int")


def touching_boxes_of_all_sizes(left: DataFrame, right: DataFrame, left_box: str, right_box: str, cell: float) -> DataFrame:
    """Rows of two tables whose boxes touch, each pair once, where boxes may be of very different size.

    A box is in at most four cells of its own level, and in as many of each greater level that boxes of the other side have. A pair meets at the level of the larger
    one, in the cell with the lower left corner of what both share: one join for pairs whose left box is at least as large, one for the others. So small boxes never
    meet in large cells, and a large box isn't dealt to a cell for each small one. Levels are logarithms: a few dozen rows at most.
    """
    a, b = F.col(left_box), F.col(right_box)
    size = F.pow(F.lit(2.0), F.col("_level")) * F.lit(float(cell))

    def put(df: DataFrame, box_name: str) -> DataFrame:
        reach = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(box_name)[lo] / size), F.floor(F.col(box_name)[hi] / size)))
        return df.withColumn("_gx", reach("minx", "maxx")).withColumn("_gy", reach("miny", "maxy"))

    def own(df: DataFrame, box_name: str) -> DataFrame:
        return put(df.withColumn("_level", box_level(F.col(box_name), cell)), box_name)

    def above(df: DataFrame, box_name: str, other: DataFrame, other_box: str, least: int) -> DataFrame:
        levels = F.broadcast(other.select(box_level(F.col(other_box), cell).alias("_level")).distinct())
        placed = df.withColumn("_own", box_level(F.col(box_name), cell)).join(levels, F.col("_level") >= F.col("_own") + least)
        return put(placed.drop("_own"), box_name)

    def met(one: DataFrame, two: DataFrame) -> DataFrame:
        corner = (F.floor(F.greatest(a["minx"], b["minx"]) / size) == F.col("_gx")) & (F.floor(F.greatest(a["miny"], b["miny"]) / size) == F.col("_gy"))
        return one.join(two, ["_level", "_gx", "_gy"]).where(boxes_touch(a, b) & corner).drop("_level", "_gx", "_gy")

    larger = met(own(left, left_box), above(right, right_box, left, left_box, 0))
    smaller = met(above(left, left_box, right, right_box, 1), own(right, right_box))
    return larger.unionByName(smaller)


def zone_tiles(zones: DataFrame, tiles: DataFrame, cell: float = 5000.0) -> DataFrame:
    """Zone and tile rows whose shape and box meet: bounds by grid cells, then exactly."""
    near = touching_boxes_of_all_sizes(zones.withColumn("_bounds", bounds(F.col("geometry"))), tiles, "_bounds", "bbox_3006", cell)
    return near.where(meets_box(F.col("geometry"), F.col("bbox_3006"))).drop("_bounds")


def zone_collections(zones: DataFrame, collections: DataFrame, cell: float = 50_000.0) -> DataFrame:
    """Zones with the collections whose corner ring ``ring`` meets the zone's bounds: their boxes by grid cells, then exactly."""
    shape = F.array(F.array(F.col("ring")))
    boxed = collections.withColumn("_box", bounds(shape))
    near = touching_boxes_of_all_sizes(zones.withColumn("_bounds", bounds(F.col("geometry"))), boxed, "_bounds", "_box", cell)
    return near.where(meets_box(shape, F.col("_bounds"))).drop("_bounds", "_box")


def clip(pixels: DataFrame, zones: DataFrame, *keys: str) -> DataFrame:
    """Pixels (x, y, v, keys) of zones with their shape: those outside become null, so that the grid stays dense."""
    shaped = zones.select(*keys, edges(F.col("geometry")).alias("_edges"))
    return pixels.join(shaped, list(keys)).withColumn("v", F.when(contains(F.col("_edges"), F.col("x"), F.col("y")), F.col("v"))).drop("_edges")
