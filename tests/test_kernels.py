"""Kernels against numpy and against properties."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import formatting as fmt
from ridgeline.functions import projection as proj
from ridgeline.operators import eta, geometry, planning, profile, raster, zonal
from ridgeline.plans import queries


def grid_rows(grid, tile="t"):
    return [(tile, r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(grid)]


@pytest.mark.parametrize("defined", [True, False])
def test_slope_is_numpys_gradient(spark, defined):
    rng = np.random.default_rng(3)
    grid = rng.normal(size=(9, 12)) * 5
    grid[4, 5] = grid[0, 3] = np.nan
    gy, gx = np.gradient(grid, 1.5, 2.0)
    slope = np.degrees(np.arctan(np.sqrt(gx**2 + gy**2)))
    if not defined:
        slope[np.isnan(grid)] = np.nan
    got = raster.with_slope(spark.createDataFrame(grid_rows(grid), "tile string, row int, col int, v double"), 2.0, -1.5, defined).collect()
    for r in got:
        want = slope[r.row, r.col]
        assert (r.slope is None) == np.isnan(want)
        assert r.slope is None or abs(r.slope - want) < 1e-9


def test_one_wide_window_has_no_slope(spark):
    rows = raster.with_slope(spark.createDataFrame(grid_rows(np.arange(5.0).reshape(5, 1)), "tile string, row int, col int, v double"))
    assert [r.slope for r in rows.collect()] == [None] * 5


def test_masked(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (-9999.05,), (None,)], "v double")
    assert [r[0] for r in df.select(raster.masked(F.col("v"), -9999.0)).collect()] == [1.0, None, None, None, None]


def test_exact_quantiles_are_spread(spark):
    rng = np.random.default_rng(1)
    values = {"outlier": [*rng.random(60_000), 1e9], "constant": [5.0] * 60_000, "steps": list(rng.integers(0, 5, 60_000).astype(float)), "wild": list(np.exp(rng.normal(0, 30, 60_000)))}
    df = spark.createDataFrame(pd.DataFrame([(k, v) for k, x in values.items() for v in x], columns=["k", "v"]))
    shares = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.k: r for r in zonal.exact_quantiles(df, ["k"], "v", shares).collect()}
    for k, x in values.items():
        assert [got[k][c] for c in shares] == pytest.approx(np.quantile(np.array(x), list(shares.values())).tolist(), rel=1e-12)
    ordered = zonal.enclosing_counts(df, ["k"], "v", list(shares.values())).groupBy("k", "_k").count()
    largest = {r["k"]: r["n"] for r in ordered.groupBy("k").agg(F.max("count").alias("n")).collect()}
    assert largest["constant"] == 1 and largest["steps"] <= 6 and max(largest.values()) < 0.002 * 60_000


def test_exact_quantiles_with_ties_and_one_value(spark):
    rng = random.Random(5)
    values = {"a": [rng.choice([0.0, 1.0, 2.5, 1e6]) for _ in range(1000)], "b": [7.0], "c": [rng.random() for _ in range(333)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None]], "k string, v double")
    for r in zonal.exact_quantiles(df, ["k"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.95}).collect():
        assert np.allclose([r.lo, r.mid, r.hi], np.quantile(values[r.k], [0.05, 0.5, 0.95]), rtol=1e-12)


def test_first_extreme_wins_ties(spark):
    rows = [("z", "t", r, c, float(c), float(r), v, None) for r, c, v in [(0, 1, 5.0), (0, 0, 5.0), (1, 0, 1.0), (1, 1, 1.0)]]
    df = spark.createDataFrame(rows, "zone string, tile string, row int, col int, x double, y double, v double, slope double")
    r = zonal.tile_partials(df, "zone", "tile").first()
    assert (r.max_coord.x, r.max_coord.y, r.min_coord.x, r.min_coord.y, r.slope_sum_squares) == (0.0, 0.0, 0.0, 1.0, 0.0)
    both = spark.createDataFrame([("z", 2, 1.0, 9.0), ("z", 1, 1.0, 9.0)], "zone string, batch_index int, local_min double, local_max double")
    parts = both.select("*", *(F.struct(F.col("batch_index").alias("x")).alias(f"{k}_coord") for k in ("min", "max")), F.lit(1).alias("batch_position"), F.lit(1).alias("n_values"), F.lit(0.0).alias("slope_sum_squares"), F.lit(0).alias("slope_count"))
    m = zonal.merge_partials(parts, "zone").first()
    assert (m.min_coord.x, m.max_coord.x, m.tiles_used) == (1, 1, 2)


def numpy_filled(v):
    ok = ~np.isnan(v)
    return np.interp(np.arange(len(v)), np.flatnonzero(ok), v[ok]) if ok.any() else np.zeros(len(v))


@pytest.mark.parametrize("gaps", [[], [0, 1, 5, 6, 11], list(range(12))])
def test_filled_and_smoothed(spark, gaps):
    v = np.sin(np.arange(12.0)) * 10
    v[gaps] = np.nan
    full = numpy_filled(v)
    want = np.convolve(np.pad(full, 3, mode="edge"), np.ones(7) / 7, mode="valid")
    df = spark.createDataFrame([("k", i, *[None if np.isnan(x) else float(x)] * 3) for i, x in enumerate(v)], "k string, bin int, p10 double, p50 double, p90 double")
    got = [r.p50 for r in profile.series(df, 12, "k").orderBy("bin").collect()]
    assert np.allclose(got, want, atol=1e-10)
    with pytest.raises(ValueError):
        profile.smoothed("p50", "bin", "k", window=4)


def test_packing_properties(spark):
    rng = random.Random(1)
    rows = [(z, k, rng.randint(1, 100)) for z in "abc" for k in range(60)]
    out = planning.packed(spark.createDataFrame(rows, "zone string, ordinal long, size_bytes long"), 100, "zone").orderBy("zone", "ordinal").collect()
    batches = {}
    for r in out:
        batches.setdefault((r.zone, r.batch_index), []).append(r)
    assert all(sum(r.size_bytes for r in b) <= 100 for b in batches.values())
    assert all([r.batch_position for r in b] == list(range(1, len(b) + 1)) for b in batches.values())
    assert all((z, k - 1) not in batches or sum(r.size_bytes for r in batches[z, k - 1]) + b[0].size_bytes > 100 for (z, k), b in batches.items())
    with pytest.raises(ValueError):
        planning.packed(spark.createDataFrame(rows, "zone string, ordinal long, size_bytes long"), 0, "zone")
    with pytest.raises(Exception, match="larger than the budget"):
        planning.packed(spark.createDataFrame([("a", 1, 101)], "zone string, ordinal long, size_bytes long"), 100, "zone").collect()


def test_exactly_one_and_empty(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "k string, n int")
    assert planning.exactly_one(df.where("k = 'a'"), "k").count() == 1
    with pytest.raises(Exception, match="expected one zone, found 2"):
        planning.exactly_one(df, "k").collect()
    with pytest.raises(ValueError):
        planning.not_empty(df.where("n > 5"), "none")


def test_formatting(spark):
    df = spark.createDataFrame([(0.125, 3725.5, "Åäö/Ærø Ü"), (1.005, 59.4, "Ö b")], "x double, s double, t string")
    a, b = df.select(fmt.fixed(F.col("x"), 2), fmt.seconds_text(F.col("s")), fmt.slug(F.col("t")), fmt.profile_slug(F.col("t")), fmt.chunk_slug(F.col("t"))).collect()
    assert tuple(a)[:3] == ("0.12", "1h 2m 6s", "aao/r_u")
    assert tuple(b) == ("1.00", "59s", "o_b", "o_b", "ö_b")
    assert spark.range(1).select(fmt.coordinate(F.lit(None).cast("double"), F.lit(1.0))).first()[0] == "N/A"


def test_projection_round_trip(spark):
    df = spark.range(200).select((F.lit(300000.0) + F.col("id") * 1700).alias("x"), (F.lit(6150000.0) + F.col("id") * 7000).alias("y"))
    lon, lat = proj.longitude(F.col("x"), F.col("y")), proj.latitude(F.col("x"), F.col("y"))
    rows = df.select("x", "y", lon.alias("lon"), lat.alias("lat")).select("x", "y", proj.easting(F.col("lon"), F.col("lat")).alias("e"), proj.northing(F.col("lon"), F.col("lat")).alias("n")).collect()
    assert max(abs(r.x - r.e) + abs(r.y - r.n) for r in rows) < 1e-4
    known = spark.range(1).select(fmt.coordinate(F.lit(385000.0), F.lit(6175000.0))).first()[0]
    assert known == "(55.707109, 13.169803)"


def test_projection_equals_another_derivation(spark, duck):
    from ridgeline.plans import grid_sql

    x, y = F.lit(250000.0) + F.col("id") * 977 % 700000, F.lit(6050000.0) + F.col("id") * 1009 % 1700000
    points = spark.range(3000).select(x.alias("x"), y.alias("y"))
    degrees = points.select("x", "y", proj.latitude(F.col("x"), F.col("y")).alias("a"), proj.longitude(F.col("x"), F.col("y")).alias("b")).toPandas()
    metres = spark.createDataFrame(degrees).select("a", "b", proj.northing(F.col("b"), F.col("a")).alias("n"), proj.easting(F.col("b"), F.col("a")).alias("e")).toPandas()
    duck.register("degrees_here", degrees)
    duck.register("metres_here", metres)
    assert max(duck.sql(f"SELECT max(abs(lat - a)), max(abs(lon - b)) FROM {grid_sql.degrees_of('degrees_here', 'x', 'y')}").fetchall()[0]) < 1e-12
    assert max(duck.sql(f"SELECT max(abs(north - n)), max(abs(east - e)) FROM {grid_sql.metres_of('metres_here', 'b', 'a')}").fetchall()[0]) < 2e-8


def test_box_and_shape(spark):
    ring = [(0, 0), (10, 0), (10, 10), (0, 10)]
    hole = [(3, 3), (7, 3), (7, 7), (3, 7)]
    boxes = {(4, 4, 6, 6): False, (10, 10, 12, 12): True, (11, 0, 12, 5): False, (-1, -1, 20, 20): True, (2, 2, 4, 4): True, (1, 1, 2, 2): True, (-5, 5, 15, 5.5): True}
    shape = [[[{"x": float(x), "y": float(y)} for x, y in r] for r in (ring, hole)]]
    df = spark.createDataFrame([(shape, tuple(map(float, b)), w) for b, w in boxes.items()], "geometry array<array<array<struct<x:double,y:double>>>>, b struct<minx:double,miny:double,maxx:double,maxy:double>, w boolean")
    assert all(r.got == r.w for r in df.select("w", geometry.meets_box(F.col("geometry"), F.col("b")).alias("got")).collect())
    assert df.select(geometry.area(F.col("geometry"))).first()[0] == 84.0
    c = df.select(geometry.centroid(F.col("geometry")).alias("c")).first().c
    assert (round(c.x, 9), round(c.y, 9)) == (5.0, 5.0)


def test_extent_works_out_its_centre_once(spark):
    df = spark.createDataFrame([([[[(0.0, 0.0), (10.0, 0.0), (10.0, 4.0), (0.0, 4.0)]]],)], "geometry array<array<array<struct<x:double,y:double>>>>")
    g, axis = F.col("geometry"), F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"))
    sums = lambda c: df.select(c)._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")
    extent = geometry.extent_along(g, geometry.centroid(g), axis)
    assert sums(extent.alias("e")) == sums(geometry.centroid(g).alias("c"))
    assert tuple(df.select(extent.alias("e")).first().e) == (-5.0, 5.0)


def test_shapes_are_dealt_over_all_cores(spark, data):
    assert queries._lots(spark, data).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_long_side():
    assert geometry.long_side(np.array([[0.0, 0.0], [4.0, 0.0], [4.0, 1.0], [0.0, 1.0]])) == (1.0, 0.0)
    assert geometry.long_side(np.array([[0.0, 0.0], [0.0, 5.0], [1.0, 5.0], [1.0, 0.0]])) == (0.0, 1.0)
    assert geometry.long_side(np.array([[2.0, 2.0]])) == (1.0, 0.0)


def test_small_hulls_are_measured_together(monkeypatch):
    rng = np.random.default_rng(5)
    angles = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    large = [np.stack([np.cos(angles) * 3, np.sin(angles)], axis=1)]
    shapes = [rng.integers(-9, 9, size=(rng.integers(0, 9), 2)).astype(float) for _ in range(500)] + large
    want = [geometry.long_side(p) for p in shapes]
    steps = []
    monkeypatch.setattr(geometry, "_sides", lambda corners, sides=geometry._sides: steps.append(corners.shape) or sides(corners))
    assert [tuple(r) for r in geometry.long_sides(shapes).tolist()] == want
    assert len(steps) == len({s[1] for s in steps}) < 12
    # a few corners by the steps for many, too
    monkeypatch.setattr(geometry, "FEW", 1)
    assert [tuple(r) for r in geometry.long_sides(shapes).tolist()] == want


def test_eta_uses_the_rate_seen(spark):
    df = spark.createDataFrame([(0, 0, None, 0, None, None), (200, 100, 10.0, 2, 1, 3.0), (2_000_000, 0, None, 4, None, None)], "left_bytes long, done_bytes long, download_seconds double, left_tiles long, done_tiles long, processing_seconds double")
    assert [r.eta_seconds for r in eta.remaining(df).collect()] == [0.0, 26.0, 3.0]


def clipped(x1, y1, x2, y2, b):
    """Whether a segment has a point in a box, by clipping its parameter at each side."""
    low, high = 0.0, 1.0
    for p, q in ((x1 - x2, x1 - b[0]), (x2 - x1, b[2] - x1), (y1 - y2, y1 - b[1]), (y2 - y1, b[3] - y1)):
        if p == 0:
            if q < 0:
                return False
        elif p < 0:
            low = max(low, q / p)
        else:
            high = min(high, q / p)
    return low <= high


def test_zone_tiles_against_clipping(spark):
    rng = random.Random(8)
    shapes = [[[(rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(rng.randint(3, 6))]] for _ in range(25)]
    boxes = [(x, y, x + rng.uniform(0.5, 9), y + rng.uniform(0.5, 9)) for x, y in ((rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(150))]
    zones = spark.createDataFrame([(k, [[[{"x": x, "y": y} for x, y in r] for r in s]]) for k, s in enumerate(shapes)], "k int, geometry array<array<array<struct<x:double,y:double>>>>")
    tiles = spark.createDataFrame([(k, b) for k, b in enumerate(boxes)], "t int, bbox_3006 struct<minx:double,miny:double,maxx:double,maxy:double>")

    def inside(ring, x, y):
        hits = [(y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)]
        return sum(hits) % 2 == 1

    want = {(k, t) for k, (ring,) in enumerate(shapes) for t, b in enumerate(boxes) if inside(ring, b[0], b[1]) or any(clipped(*p, *q, b) for p, q in zip(ring, ring[1:] + ring[:1], strict=True))}
    rows = [(r.k, r.t) for r in geometry.zone_tiles(zones, tiles, 7.0).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_axis_of_a_million_points():
    turn = np.linspace(0, 2 * np.pi, 1_000_000, endpoint=False)
    circle = np.stack([np.cos(turn), np.sin(turn)], axis=1) * 1e6
    x, y = geometry.long_side(circle)
    assert abs(x * x + y * y - 1) < 1e-9
    assert np.allclose(geometry.long_side(circle * [3, 1]), (1, 0), atol=1e-4)


def test_axis_equals_all_sides():
    def every(points):
        corners = geometry.hull(points)
        sides = np.roll(corners, -1, axis=0) - corners
        units = sides / np.hypot(*sides.T)[:, None]
        normals = np.stack([-units[:, 1], units[:, 0]], axis=1)
        spans = [np.ptp(corners @ v.T, axis=0) for v in (units, normals)]
        return (spans[0] * spans[1]).min()

    rng = np.random.default_rng(3)
    for k in range(300):
        points = rng.normal(size=(rng.integers(3, 40), 2)) * [1, 10 ** rng.uniform(-3, 3)] + rng.normal(size=2) * 1e3
        if k % 3 == 0:
            points = np.round(points)
        if len(geometry.hull(points)) < 3:
            continue
        x, y = geometry.long_side(points)
        area = np.ptp(points @ [x, y]) * np.ptp(points @ [-y, x])
        assert area <= every(points) * (1 + 1e-6) + 1e-6


def test_copies_of_a_box_are_one_class(spark):
    rng = random.Random(4)

    def rows(n):
        boxes = [(x := rng.uniform(-50, 50), y := rng.uniform(-50, 50), x + rng.uniform(0, 9), y + rng.uniform(0, 9)) for _ in range(n)]
        return [(k, boxes[k % n]) for k in range(4 * n)]

    left, right = rows(30), [*rows(40), (999, None)]
    frames = [spark.createDataFrame(r, f"{n} long, {n}_box struct<minx:double,miny:double,maxx:double,maxy:double>") for n, r in (("a", left), ("b", right))]
    met = geometry.touching_boxes(*frames, "a_box", "b_box", 8.0)
    assert met.columns == ["a", "a_box", "b", "b_box"]
    want = [(a, b) for a, p in left for b, q in right if q and p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]]
    assert sorted((r.a, r.b) for r in met.select("a", "b").collect()) == sorted(want)
    # cells are made of classes, not of rows
    plan = [line.strip(" +-:") for line in met._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    assert sum(line.startswith("Aggregate") for line in plan) == 2
    assert all(any(below.startswith("Aggregate") for below in plan[k:]) for k, line in enumerate(plan) if line.startswith("Generate"))


def test_boxes_of_all_sizes(spark):
    rng = random.Random(8)

    def box():
        side = 10 ** rng.uniform(-1, 4)
        x, y = rng.uniform(-5000, 5000), rng.uniform(-5000, 5000)
        return (x, y, x + side * rng.uniform(0.01, 1), y + side)

    left, right = ([(k, box()) for k in range(150)] for _ in range(2))
    frames = [spark.createDataFrame(rows, f"{n} long, {n}_box struct<minx:double,miny:double,maxx:double,maxy:double>") for n, rows in (("a", left), ("b", right))]
    got = [(r.a, r.b) for r in geometry.touching_boxes_of_all_sizes(*frames, "a_box", "b_box", 1.0).select("a", "b").collect()]
    want = [(a, b) for a, p in left for b, q in right if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]]
    assert sorted(got) == sorted(want)


def test_slug_spells_signs_out(spark):
    df = spark.createDataFrame([("Æon… №5 ₨ ﬁn ½ Å",), (None,), ("plain",)], "t string")
    import unicodedata

    want = [None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower().replace(" ", "_") for (t,) in (tuple(r) for r in df.collect())]
    assert [r[0] for r in df.select(fmt.slug(F.col("t"))).collect()] == want
