"""Registered queries: every operator over the driver's tables as surrogates, and the SQL that each must equal.

Nations, customers and suppliers stand for zones, line items and embeddings for pixels, orders for tiles, events for
logs and series, page addresses for files. Each query runs over its whole tables.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions import formatting as fmt
from ..functions import projection as proj
from ..operators import eta, geometry, kernel, planning, profile, raster, state, zonal
from ..sources import tables
from . import grid_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dealt(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """The keys of a table, dealt over all cores: narrow rows are few and small files, whose one or two tasks would do all the work on them."""
    return load(spark, d, name).select(key).repartition(4 * spark.sparkContext.defaultParallelism, key)


def r6(c: Column | str, name: str | None = None) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c)


# zonal statistics

PIXELS = """
px AS (
    SELECT n_name AS tatort, r_name AS kommun, l_returnflag AS tile, l_orderkey * 10 + l_linenumber AS "row", l_partkey * 1000000 + l_suppkey AS col,
        CAST(300000 + l_orderkey % 400000 AS DOUBLE) AS x, CAST(6100000 + l_partkey % 800000 AS DOUBLE) AS y, l_extendedprice AS v, l_discount * 100 AS slope,
        1e6 * (n_nationkey + 1) AS area_m2
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
)"""
SUMMARY = f"""
{PIXELS}, s AS (
    SELECT tatort, kommun, count(DISTINCT tile) AS tiles_used, count(v) AS n_values, min(v) AS min_altitude_m, max(v) AS max_altitude_m,
        arg_min({{'x': x, 'y': y}}, {{'a': v, 'b': tile, 'c': "row", 'd': col}}) AS min_coord, arg_min({{'x': x, 'y': y}}, {{'a': -v, 'b': tile, 'c': "row", 'd': col}}) AS max_coord,
        quantile_cont(v, 0.05) AS relief_q05_m, quantile_cont(v, 0.95) AS relief_q95_m, sqrt(sum(slope * slope) / count(slope)) AS rms_slope_deg, any_value(area_m2) AS area_m2
    FROM px GROUP BY tatort, kommun
), f AS (
    SELECT *, max_altitude_m - min_altitude_m AS altitude_range_m, (relief_q95_m - relief_q05_m) / sqrt(area_m2 / 1e6) AS normalized_relief,
        (relief_q95_m - relief_q05_m) / sqrt(area_m2 / 1e6) * rms_slope_deg AS hilliness_score FROM s
)"""


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = load(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = load(spark, d, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.col("n_name").alias("tatort"),
        F.col("r_name").alias("kommun"),
        F.col("l_returnflag").alias("tile"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("col"),
        (300000 + F.col("l_orderkey") % 400000).cast("double").alias("x"),
        (6100000 + F.col("l_partkey") % 800000).cast("double").alias("y"),
        F.col("l_extendedprice").alias("v"),
        (F.col("l_discount") * 100).alias("slope"),
    )


def _areas(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nation.select(F.col("n_name").alias("tatort"), F.col("r_name").alias("kommun"), (1e6 * (F.col("n_nationkey") + 1)).alias("area_m2"))


def _summary(spark: SparkSession, d: str) -> DataFrame:
    pixels = _pixels(spark, d)
    merged = zonal.merge_partials(zonal.tile_partials(pixels, "tatort", "kommun", "tile"), "tatort", "kommun", order=("tile",))
    quantiles = zonal.exact_quantiles(pixels, ["tatort", "kommun"], "v", {"relief_q05_m": 0.05, "relief_q95_m": 0.95})
    return zonal.finalize(merged, quantiles, _areas(spark, d), "tatort", "kommun")


METRICS = ("altitude_range_m", "relief_q05_m", "relief_q95_m", "normalized_relief", "rms_slope_deg", "hilliness_score")


@query(
    f"""WITH {SUMMARY} SELECT tatort, kommun, tiles_used, n_values, min_altitude_m, max_altitude_m, min_coord.x AS min_x, min_coord.y AS min_y,
    max_coord.x AS max_x, max_coord.y AS max_y, {", ".join(f"round({m}, 6) AS {m}" for m in METRICS)} FROM f"""
)
def zonal_summary(spark, d):
    place = [F.col(f"{k}_coord")[a].alias(f"{k}_{a}") for k in ("min", "max") for a in ("x", "y")]
    return _summary(spark, d).select("tatort", "kommun", "tiles_used", "n_values", "min_altitude_m", "max_altitude_m", *place, *map(r6, METRICS))


def _sql_text(c: str, n: int) -> str:
    return f"printf('%.{n}f', {c})"


def _sql_place(source: str, x: str, y: str, name: str) -> str:
    """The source's rows with the place of the grid point (x, y) as text."""
    return f"(SELECT * EXCLUDE (lat, lon), '(' || {_sql_text('lat', 6)} || ', ' || {_sql_text('lon', 6)} || ')' AS {name} FROM {grid_sql.degrees_of(source, x, y)})"


_RESULT = {
    "rank": "CAST(row_number() OVER (ORDER BY hilliness_score DESC, tatort, kommun) AS VARCHAR)",
    "tatortskod": "substr(tatort, 1, 3)",
    "collections": "kommun",
    "batches": "'1'",
    "total_raw_size_mb": _sql_text("n_values * 4.0 / 1048576", 2),
    "tiles_scanned": "CAST(tiles_used AS VARCHAR)",
    "tiles_used": "CAST(tiles_used AS VARCHAR)",
}
_PLACED = _sql_place(_sql_place("f", "min_coord.x", "min_coord.y", "min_coord_lat_lon"), "max_coord.x", "max_coord.y", "max_coord_lat_lon")


@query(f"WITH {SUMMARY} SELECT {', '.join(f'{_RESULT.get(c) or (_sql_text(c, n) if n else c)} AS {c}' for c, n in tables.RESULT_FIELDS)} FROM {_PLACED}")
def zonal_rank(spark, d):
    return tables.result_rows(
        _summary(spark, d).select(
            "*",
            F.substring("tatort", 1, 3).alias("tatortskod"),
            F.col("kommun").alias("collections"),
            F.lit(1).alias("batches"),
            (F.col("n_values") * 4.0 / 1048576).alias("total_raw_size_mb"),
            F.col("tiles_used").alias("tiles_scanned"),
        )
    )


@query(
    """SELECT o_orderstatus, min(o_totalprice) AS local_min, max(o_totalprice) AS local_max, arg_min(o_orderkey, {'a': o_totalprice, 'b': o_custkey, 'c': o_orderkey}) AS min_key,
    arg_min(o_orderkey, {'a': -o_totalprice, 'b': o_custkey, 'c': o_orderkey}) AS max_key FROM orders GROUP BY 1"""
)
def extreme_locations(spark, d):
    found = load(spark, d, "orders").groupBy("o_orderstatus").agg(*zonal.extremes("o_totalprice", F.col("o_orderkey"), "o_custkey", "o_orderkey"))
    return found.withColumnsRenamed({"min_coord": "min_key", "max_coord": "max_key"})


@query("SELECT l_suppkey AS zone, min(l_extendedprice) AS min_altitude_m, max(l_extendedprice) AS max_altitude_m, count(*) AS n_values, count(DISTINCT l_returnflag) AS tiles_used FROM lineitem GROUP BY 1")
def partial_merge(spark, d):
    rows = load(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("zone"), F.col("l_returnflag").alias("tile"), F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"),
        F.col("l_orderkey").alias("x"), F.col("l_partkey").alias("y"), F.col("l_extendedprice").alias("v"), F.lit(None).cast("double").alias("slope"),
    )
    return zonal.merge_partials(zonal.tile_partials(rows, "zone", "tile"), "zone", order=("tile",)).select("zone", "min_altitude_m", "max_altitude_m", "n_values", "tiles_used")


@query(
    """SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean_altitude, round(stddev_pop(l_extendedprice), 4) AS std_altitude,
    round(quantile_cont(l_extendedprice, 0.5), 4) AS median_altitude, count(*) AS n_values FROM lineitem GROUP BY 1"""
)
def altitude_stats(spark, d):
    found = zonal.altitude_stats(load(spark, d, "lineitem"), "l_extendedprice", "l_returnflag")
    return found.select("l_returnflag", "n_values", *(F.round(c, 4).alias(c) for c in ("mean_altitude", "std_altitude", "median_altitude")))


# rasters

_GRID = """
g AS (
    SELECT CAST(label AS VARCHAR) AS tile, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, generate_subscripts(embedding, 1) - 1 AS c, CAST(unnest(embedding) AS DOUBLE) AS raw FROM embeddings
), m AS (SELECT tile, r, c, {value} AS v FROM g), e AS (SELECT tile, max(r) AS r1, max(c) AS c1 FROM m GROUP BY 1), n AS (
    SELECT m.*, r1, c1, lag(v) OVER a AS w, lead(v) OVER a AS e, lag(v) OVER b AS n, lead(v) OVER b AS s FROM m JOIN e USING (tile)
    WINDOW a AS (PARTITION BY tile, r ORDER BY c), b AS (PARTITION BY tile, c ORDER BY r)
), k AS (
    SELECT *, CASE WHEN c1 = 0 THEN NULL WHEN c = 0 THEN (e - v) / 2.0 WHEN c = c1 THEN (v - w) / 2.0 ELSE (e - w) / 4.0 END AS gx,
        CASE WHEN r1 = 0 THEN NULL WHEN r = 0 THEN s - v WHEN r = r1 THEN v - n ELSE (s - n) / 2 END AS gy FROM n
), slopes AS (SELECT tile, v, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope FROM k)"""


def _grid(spark, d, masked: bool = False) -> DataFrame:
    rows = load(spark, d, "embeddings").withColumn("row", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    v = F.col("v").cast("double")
    cells = rows.select(F.col("label").cast("string").alias("tile"), "row", F.posexplode("embedding").alias("col", "v"))
    return cells.withColumn("v", F.when(v >= -0.2, v) if masked else v)


@query(f"WITH {_GRID.format(value='raw')} SELECT tile, round(sqrt(sum(slope * slope) / count(slope)), 6) AS rms_slope_deg, count(slope) AS slope_count FROM slopes GROUP BY 1")
def slope_rms(spark, d):
    rows = raster.with_slope(_grid(spark, d), 2.0, 1.0)
    return rows.groupBy("tile").agg(r6(zonal.rms(F.sum(F.col("slope") * F.col("slope")), F.count("slope")), "rms_slope_deg"), F.count("slope").alias("slope_count"))


@query(
    f"""WITH {_GRID.format(value="CASE WHEN raw >= -0.2 THEN raw END")} SELECT tile, count(slope) AS n_defined, count(slope) FILTER (v IS NOT NULL) AS n_undefined,
    round(sqrt(sum(slope * slope) / count(slope)), 6) AS rms_defined, round(sqrt(sum(slope * slope) FILTER (v IS NOT NULL) / count(slope) FILTER (v IS NOT NULL)), 6) AS rms_undefined FROM slopes GROUP BY 1"""
)
def slope_rms_masked(spark, d):
    both = [raster.with_slope(_grid(spark, d, True), 2.0, 1.0, nodata_defined=x).withColumn("kind", F.lit(name)) for x, name in ((True, "defined"), (False, "undefined"))]
    one = lambda kind: F.when(F.col("kind") == kind, F.col("slope"))
    return zonal.union_all(*both).groupBy("tile").agg(
        *(F.count(one(k)).alias(f"n_{k}") for k in ("defined", "undefined")),
        *(r6(zonal.rms(F.sum(one(k) * one(k)), F.count(one(k))), f"rms_{k}") for k in ("defined", "undefined")),
    )


@query(
    f"""WITH {_GRID.format(value="raw")} SELECT tile, round(avg(slope), 6) AS mean_slope, round(max(slope), 6) AS max_slope, round(avg(CASE WHEN slope > 5 THEN 1.0 ELSE 0.0 END), 6) AS share_above,
    round(quantile_cont(slope, 0.5), 6) AS median_slope, round(quantile_cont(slope, 0.9), 6) AS p90_slope FROM slopes GROUP BY 1"""
)
def slope_distribution(spark, d):
    found = zonal.slope_stats(raster.with_slope(_grid(spark, d), 2.0, 1.0), 5.0, "tile")
    return found.select("tile", *map(r6, ("mean_slope", "max_slope", "share_above", "median_slope", "p90_slope")))


@query("SELECT tile, count(*) FILTER (ok) AS n_valid, count(*) FILTER (NOT ok) AS n_missing FROM (SELECT label AS tile, abs(x - 0.1) > 1e-8 + 1e-5 * 0.1 AS ok FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)) GROUP BY 1")
def valid_pixels(spark, d):
    cells = load(spark, d, "embeddings").select(F.col("label").alias("tile"), F.explode("embedding").alias("v"))
    v = raster.masked(F.col("v").cast("double"), 0.1)
    return cells.groupBy("tile").agg(F.count(v).alias("n_valid"), F.count_if(v.isNull()).alias("n_missing"))


# selection and planning


@query(
    """SELECT c_custkey AS src_ordinal, c_name AS tatort, c_mktsegment AS kommunnamn, CAST(trunc(c_acctbal) AS BIGINT) AS bef FROM
    (SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND trunc(c_acctbal) >= 0 AND trunc(c_acctbal) <= 5000 ORDER BY c_custkey LIMIT 60 OFFSET 10)"""
)
def select_zones(spark, d):
    zones = load(spark, d, "customer").select(
        F.col("c_custkey").alias("src_ordinal"), F.col("c_name").alias("tatort"), F.col("c_mktsegment").alias("kommunnamn"), F.col("c_acctbal").cast("bigint").alias("bef")
    )
    return planning.select_zones(zones, kommun=["BUILDING", "MACHINERY"], min_population=0, max_population=5000, offset=10, limit=60)


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def lookup_exactly_one(spark, d):
    found = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return planning.exactly_one(found.select("c_custkey", "c_name", "n_name"), "c_custkey", "n_name")


_TILES = """
t AS (
    SELECT o_custkey AS zone, o_orderkey AS item_id, CAST(trunc(o_totalprice) AS BIGINT) AS size_bytes, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 97, o_orderkey % 89, o_orderkey) AS ordinal FROM orders
), b AS (
    SELECT zone, item_id, size_bytes, ordinal, size_bytes AS used, 1 AS batch_index FROM t WHERE ordinal = 1
    UNION ALL
    SELECT t.zone, t.item_id, t.size_bytes, t.ordinal, CASE WHEN used + t.size_bytes > 1000000 THEN t.size_bytes ELSE used + t.size_bytes END,
        batch_index + CASE WHEN used + t.size_bytes > 1000000 THEN 1 ELSE 0 END FROM b JOIN t ON t.zone = b.zone AND t.ordinal = b.ordinal + 1
), p AS (SELECT *, row_number() OVER (PARTITION BY zone, batch_index ORDER BY ordinal) AS batch_position FROM b)"""


def _batches(spark, d) -> DataFrame:
    key = F.col("o_orderkey")
    tiles = load(spark, d, "orders").select(
        F.col("o_custkey").alias("zone"),
        key.alias("item_id"),
        F.col("o_totalprice").cast("bigint").alias("size_bytes"),
        geometry.box(key % 89, key % 97, key % 89 + 1, key % 97 + 1).alias("bbox_3006"),
        key.alias("fetch_ordinal"),
    )
    return planning.packed(planning.tile_order(tiles, "zone"), 1_000_000, "zone")


@query(f"WITH RECURSIVE {_TILES} SELECT zone, item_id, size_bytes, CAST(ordinal AS BIGINT) AS ordinal, batch_index, CAST(batch_position AS INTEGER) AS batch_position FROM p")
def greedy_batches(spark, d):
    return _batches(spark, d).select("zone", "item_id", "size_bytes", "ordinal", "batch_index", "batch_position")


@query(
    f"""WITH RECURSIVE {_TILES} SELECT zone, batch_index, count(*) AS n_tiles, CAST(sum(size_bytes) AS BIGINT) AS batch_bytes, arg_min(item_id, batch_position) AS first_item,
    arg_max(item_id, batch_position) AS last_item FROM p GROUP BY 1, 2"""
)
def batch_description(spark, d):
    return planning.batch_summary(_batches(spark, d), "zone")


@query(
    """WITH p AS (SELECT o_custkey, count(*) AS n, sum(CAST(trunc(o_totalprice) AS BIGINT)) AS b, bool_or(o_orderstatus = 'F') AS done FROM orders GROUP BY 1)
    SELECT count(*) AS zones, count(*) FILTER (done) AS completed, CAST(sum(n) AS BIGINT) AS n_tiles, CAST(sum(b) AS BIGINT) AS total_bytes, round(sum(b / 2000000.0 + n * 0.5), 4) AS seconds FROM p"""
)
def preflight_totals(spark, d):
    orders = load(spark, d, "orders")
    zone = [F.col("o_custkey").alias("tatort"), F.lit("k").alias("kommun")]
    plans = orders.groupBy(*zone).agg(F.count(F.lit(1)).alias("n_tiles"), F.sum(F.col("o_totalprice").cast("bigint")).alias("total_bytes"))
    found = planning.preflight(plans, orders.where("o_orderstatus = 'F'").select(*zone).distinct())
    return found.withColumn("seconds", F.round("seconds", 4))


@query(
    """WITH p AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'O' THEN CAST(trunc(o_totalprice) AS BIGINT) ELSE 0 END) AS l, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(trunc(o_totalprice) AS BIGINT) ELSE 0 END) AS dn,
        count(*) FILTER (o_orderstatus = 'O') AS lt, count(*) FILTER (o_orderstatus = 'F') AS dt, CAST(o_custkey % 7 AS DOUBLE) AS s FROM orders GROUP BY 1)
    SELECT o_custkey, round(CASE WHEN l <= 0 THEN 0 WHEN dn > 0 AND s > 0 THEN l / greatest(dn / s, 1.0) ELSE l / 2000000.0 END
        + CASE WHEN lt <= 0 THEN 0 WHEN dt > 0 AND s > 0 THEN lt * greatest(s / dt, 0.01) ELSE lt * 0.5 END, 4) AS eta_seconds FROM p"""
)
def remaining_eta(spark, d):
    size = F.col("o_totalprice").cast("bigint")
    on = lambda s, x: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, x)), F.lit(0))
    seconds = (F.col("o_custkey") % 7).cast("double")
    rows = load(spark, d, "orders").groupBy("o_custkey").agg(
        on("O", size).alias("left_bytes"), on("F", size).alias("done_bytes"), on("O", F.lit(1)).alias("left_tiles"), on("F", F.lit(1)).alias("done_tiles")
    )
    # ``try`` forms aren't needed: a division is reached only behind its test
    rows = rows.withColumn("download_seconds", F.when(seconds > 0, seconds)).withColumn("processing_seconds", F.col("download_seconds"))
    nonzero = rows.withColumn("done_tiles", F.nullif("done_tiles", F.lit(0)))
    return eta.remaining(nonzero).select("o_custkey", F.round("eta_seconds", 4).alias("eta_seconds"))


# spatial joins and geometry

_BOXES = "(SELECT c_custkey, CAST(c_custkey * 37 % 2000 AS DOUBLE) AS ax, CAST(c_custkey * 53 % 2000 AS DOUBLE) AS ay, CAST(5 + c_custkey % 11 AS DOUBLE) AS s FROM customer)"


def _customer_boxes(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return dealt(spark, d, "customer", "c_custkey").select("c_custkey", geometry.box(k * 37 % 2000, k * 53 % 2000, k * 37 % 2000 + 5 + k % 11, k * 53 % 2000 + 5 + k % 11).alias("zone_box"))


@query(f"SELECT c_custkey, n_nationkey FROM {_BOXES}, nation WHERE ax <= n_nationkey * 80 + 60 AND n_nationkey * 80 <= ax + s AND ay <= n_nationkey * 80 + 60 AND n_nationkey * 80 <= ay + s")
def bbox_join(spark, d):
    n = F.col("n_nationkey")
    boxes = load(spark, d, "nation").select("n_nationkey", geometry.box(n * 80, n * 80, n * 80 + 60, n * 80 + 60).alias("box"))
    return geometry.touching_boxes(_customer_boxes(spark, d), boxes, "zone_box", "box", 64.0).select("c_custkey", "n_nationkey")


@query(
    f"""SELECT c_custkey, n_nationkey FROM (SELECT c_custkey, x0 AS ax, y0 AS ay, a, b FROM (SELECT c_custkey, 100 + c_custkey % 13 AS a, 50 + c_custkey % 7 AS b, 1000 + c_custkey AS x0, 2000 + c_custkey * 2 AS y0 FROM customer)), nation
    WHERE ax <= 1000 + n_nationkey * 97 + 180 AND 1000 + n_nationkey * 97 <= ax + a AND ay <= 2000 + n_nationkey * 131 + 260 AND 2000 + n_nationkey * 131 <= ay + b"""
)
def collection_join(spark, d):
    n = F.col("n_nationkey")
    point = lambda x, y: F.struct((1000 + n * 97 + x).cast("double").alias("x"), (2000 + n * 131 + y).cast("double").alias("y"))
    rings = load(spark, d, "nation").select("n_nationkey", F.array(point(0, 0), point(180, 0), point(180, 260), point(0, 260)).alias("ring"))
    return geometry.zone_collections(_lots(spark, d), rings, 128.0).select("c_custkey", "n_nationkey")


@query(f"SELECT c_custkey, o_orderkey FROM {_BOXES}, (SELECT o_orderkey, o_orderkey * 41 % 2000 AS bx, o_orderkey * 61 % 2000 AS cy FROM orders) WHERE ax <= bx + 7 AND bx <= ax + s AND ay <= cy + 7 AND cy <= ay + s")
def cell_join(spark, d):
    k = F.col("o_orderkey")
    tiles = dealt(spark, d, "orders", "o_orderkey").select("o_orderkey", geometry.box(k * 41 % 2000, k * 61 % 2000, k * 41 % 2000 + 7, k * 61 % 2000 + 7).alias("tile_box"))
    return geometry.touching_boxes(_customer_boxes(spark, d), tiles, "zone_box", "tile_box", 16.0).select("c_custkey", "o_orderkey")


#: Two parts, the first with a hole.
_RINGS = [[[(50, 40), (900, 100), (700, 800), (120, 650)], [(300, 300), (500, 320), (420, 500)]], [[(910, 700), (990, 720), (930, 960)]]]
_EDGES = ", ".join(f"({a[0]}.0, {a[1]}.0, {b[0]}.0, {b[1]}.0)" for part in _RINGS for ring in part for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def _shape() -> Column:
    point = lambda p: F.struct(F.lit(float(p[0])).alias("x"), F.lit(float(p[1])).alias("y"))
    return F.array(*(F.array(*(F.array(*map(point, ring)) for ring in part)) for part in _RINGS))


@query(
    f"""WITH e(x1, y1, x2, y2) AS (VALUES {_EDGES}), p AS (SELECT o_orderkey, o_orderkey * 37 % 1000 + 0.5 AS x, o_orderkey * 71 % 1000 + 0.5 AS y FROM orders)
    SELECT o_orderkey, count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS inside FROM p, e GROUP BY 1"""
)
def point_in_polygon(spark, d):
    k = F.col("o_orderkey")
    shape = spark.range(1).select(geometry.edges(_shape()).alias("e"))
    return load(spark, d, "orders").join(F.broadcast(shape)).select("o_orderkey", geometry.contains(F.col("e"), k * 37 % 1000 + 0.5, k * 71 % 1000 + 0.5).alias("inside"))


_LOTS = """lots AS (SELECT c_custkey, 100 + c_custkey % 13 AS a, 50 + c_custkey % 7 AS b, 1000 + c_custkey AS x0, 2000 + c_custkey * 2 AS y0 FROM customer),
pts AS (SELECT c_custkey, r, k, x0 + px AS x, y0 + py AS y FROM lots, LATERAL (VALUES (0, 0, 0, 0), (0, 1, a, 0), (0, 2, a, b), (0, 3, a / 2.0, b / 2.0), (0, 4, 0, b), (1, 0, 10, 5), (1, 1, 10, 10), (1, 2, 20, 10), (1, 3, 20, 5)) v(r, k, px, py)),
es AS (SELECT c_custkey, r, k, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM pts WINDOW w AS (PARTITION BY c_custkey, r ORDER BY k)),
rings AS (SELECT c_custkey, r, sum(x * y2 - x2 * y) / 2 AS a, sum((x + x2) * (x * y2 - x2 * y)) / 6 AS mx, sum((y + y2) * (x * y2 - x2 * y)) / 6 AS my FROM es GROUP BY 1, 2),
shapes AS (SELECT c_custkey, sum(w * abs(a)) AS area, sum(w * sign(a) * mx) AS mx, sum(w * sign(a) * my) AS my FROM (SELECT *, CASE WHEN r = 0 THEN 1 ELSE -1 END AS w FROM rings) GROUP BY 1)"""


def _lots(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    a, b, x0, y0 = 100 + k % 13, 50 + k % 7, 1000 + k, 2000 + k * 2
    point = lambda x, y: F.struct((x0 + x).cast("double").alias("x"), (y0 + y).cast("double").alias("y"))
    z = F.lit(0)
    outer = F.array(point(z, z), point(a, z), point(a, b), point(a / 2, b / 2), point(z, b))
    hole = F.array(*(point(F.lit(x), F.lit(y)) for x, y in ((10, 5), (10, 10), (20, 10), (20, 5))))
    return dealt(spark, d, "customer", "c_custkey").select("c_custkey", F.array(F.array(outer, hole)).alias("geometry"))


@query(f"WITH {_LOTS} SELECT c_custkey, round(area, 6) AS area, round(mx / area, 6) AS cx, round(my / area, 6) AS cy FROM shapes")
def polygon_area_centroid(spark, d):
    rows = _lots(spark, d).select("c_custkey", geometry.area(F.col("geometry")).alias("area"), geometry.centroid(F.col("geometry")).alias("c"))
    return rows.select("c_custkey", r6("area"), r6(F.col("c.x"), "cx"), r6(F.col("c.y"), "cy"))


@query(
    f"""WITH {_LOTS} SELECT c_custkey, round(min((x - mx / area) * 0.6 + (y - my / area) * 0.8), 6) AS lo, round(max((x - mx / area) * 0.6 + (y - my / area) * 0.8), 6) AS hi,
    min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM pts JOIN shapes USING (c_custkey) GROUP BY 1"""
)
def projection_extent(spark, d):
    g = F.col("geometry")
    axis = F.struct(F.lit(0.6).alias("x"), F.lit(0.8).alias("y"))
    rows = _lots(spark, d).select("c_custkey", geometry.extent_along(g, geometry.centroid(g), axis).alias("e"), geometry.bounds(g).alias("b"))
    return rows.select("c_custkey", r6(F.col("e.lo"), "lo"), r6(F.col("e.hi"), "hi"), "b.*")


@query(
    f"""WITH {_LOTS}, b AS (SELECT c_custkey, min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y), 1) AS s FROM pts GROUP BY 1)
    SELECT c_custkey, CAST(k AS INTEGER) AS k, round((x - x0) / s, 6) AS ux, round((y - y0) / s, 6) AS uy FROM pts JOIN b USING (c_custkey) WHERE r = 0"""
)
def outline_points(spark, d):
    rows = _lots(spark, d).select("c_custkey", geometry.outlines(F.col("geometry"))[0].alias("ring"))
    return rows.select("c_custkey", F.posexplode("ring").alias("k", "p")).select("c_custkey", "k", r6(F.col("p.x"), "ux"), r6(F.col("p.y"), "uy"))


@query("SELECT c_custkey, round(cos(radians(t)), 6) AS ax, round(sin(radians(t)), 6) AS ay FROM (SELECT c_custkey, CAST(c_custkey % 170 - 80 AS DOUBLE) AS t FROM customer)")
def main_axis(spark, d):
    k = F.col("c_custkey")
    turn = F.radians((k % 170 - 80).cast("double"))
    point = lambda u, v: F.struct((k + u * F.cos(turn) - v * F.sin(turn)).alias("x"), (k + u * F.sin(turn) + v * F.cos(turn)).alias("y"))
    ring = F.array(*(point(u, v) for u, v in ((-50.0, -10.0), (50.0, -10.0), (50.0, 10.0), (-50.0, 10.0))))
    rows = geometry.with_main_axis(dealt(spark, d, "customer", "c_custkey").select("c_custkey", F.array(F.array(ring)).alias("geometry")))
    return rows.select("c_custkey", r6(F.col("axis.x"), "ax"), r6(F.col("axis.y"), "ay"))


@query(
    f"""WITH {_LOTS}, t AS (SELECT o_orderkey, 1000 + o_orderkey * 31 % 1600 AS tx, 2000 + o_orderkey * 17 % 3200 AS ty FROM orders),
    b AS (SELECT c_custkey, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pts GROUP BY 1), near AS (SELECT c_custkey, o_orderkey, tx, ty FROM b JOIN t ON x0 <= tx + 9 AND tx <= x1 AND y0 <= ty + 9 AND ty <= y1),
    m AS (SELECT c_custkey, o_orderkey, tx, ty, x, y, x2, y2, (x2 - x) * (ty - y) - (y2 - y) * (tx - x) AS s1, (x2 - x) * (ty + 9 - y) - (y2 - y) * (tx - x) AS s2, (x2 - x) * (ty - y) - (y2 - y) * (tx + 9 - x) AS s3,
        (x2 - x) * (ty + 9 - y) - (y2 - y) * (tx + 9 - x) AS s4 FROM near JOIN es USING (c_custkey))
    SELECT c_custkey, o_orderkey FROM m GROUP BY 1, 2 HAVING bool_or(least(x, x2) <= tx + 9 AND greatest(x, x2) >= tx AND least(y, y2) <= ty + 9 AND greatest(y, y2) >= ty AND least(s1, s2, s3, s4) <= 0 AND greatest(s1, s2, s3, s4) >= 0)
        OR count(*) FILTER ((y > ty) <> (y2 > ty) AND tx < (x2 - x) * (ty - y) / nullif(y2 - y, 0) + x) % 2 = 1"""
)
def zone_tile_join(spark, d):
    lots = _lots(spark, d)
    k = F.col("o_orderkey")
    tiles = load(spark, d, "orders").select("o_orderkey", geometry.box(1000 + k * 31 % 1600, 2000 + k * 17 % 3200, 1000 + k * 31 % 1600 + 9, 2000 + k * 17 % 3200 + 9).alias("bbox_3006"))
    return geometry.zone_tiles(lots, tiles, 128.0).select("c_custkey", "o_orderkey")


_POINTS = "(SELECT c_custkey, CAST(300000 + c_custkey * 977 % 400000 AS DOUBLE) AS x, CAST(6100000 + c_custkey * 1009 % 1500000 AS DOUBLE) AS y FROM customer)"


@query(f"SELECT c_custkey, place FROM {_sql_place(_POINTS, 'x', 'y', 'place')}")
def coord_wgs84(spark, d):
    k = F.col("c_custkey")
    return load(spark, d, "customer").select("c_custkey", fmt.coordinate((300000 + k * 977 % 400000).cast("double"), (6100000 + k * 1009 % 1500000).cast("double")).alias("place"))


_DEGREES = "(SELECT c_custkey, 11 + c_custkey % 130 / 10.0 AS x, 55 + c_custkey % 140 / 10.0 AS y FROM customer)"


@query(f"SELECT c_custkey, round(east, 4) AS east, round(north, 4) AS north FROM {grid_sql.metres_of(_DEGREES, 'x', 'y')}")
def grid_points(spark, d):
    lon, lat = 11 + F.col("c_custkey") % 130 / 10.0, 55 + F.col("c_custkey") % 140 / 10.0
    return load(spark, d, "customer").select("c_custkey", F.round(proj.easting(lon, lat), 4).alias("east"), F.round(proj.northing(lon, lat), 4).alias("north"))


# profiles


@query(
    """WITH c AS (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    b AS (SELECT label, greatest(least(CAST(trunc((i + vec_id % 5 - 10.0) / 50.0 * 20) AS INTEGER), 19), 0) AS bin, v FROM c),
    e AS (SELECT label, unnest(generate_series(0, 19)) AS bin FROM (SELECT DISTINCT label FROM embeddings))
    SELECT e.label, CAST(e.bin AS INTEGER) AS bin, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90
    FROM e LEFT JOIN b ON b.label = e.label AND b.bin = e.bin GROUP BY 1, 2"""
)
def profile_bins(spark, d):
    cells = load(spark, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "v"))
    bin = profile.bin_of((F.col("i") + F.col("vec_id") % 5).cast("double"), F.lit(10.0), F.lit(60.0), 20)
    return profile.binned(cells.select("label", bin.alias("bin"), F.col("v").cast("double").alias("v")), "v", 20, "label").select("label", "bin", *map(r6, profile.CURVES))


_HOURS = """h AS (SELECT event_type AS k, CAST(extract('hour' FROM ts) AS INTEGER) * 60 + CAST(extract('minute' FROM ts) AS INTEGER) AS bin, value FROM events),
m AS (SELECT k, bin, avg(value) AS v FROM h GROUP BY 1, 2), a AS (SELECT k, unnest(generate_series(0, 1439)) AS bin FROM (SELECT DISTINCT k FROM h)),
s AS (SELECT a.k, a.bin, v, CASE WHEN v IS NOT NULL THEN a.bin END AS place FROM a LEFT JOIN m ON m.k = a.k AND m.bin = a.bin),
g AS (SELECT k, bin, v, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER f AS v1, last_value(place IGNORE NULLS) OVER b AS i0, first_value(place IGNORE NULLS) OVER f AS i1 FROM s
    WINDOW b AS (PARTITION BY k ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY k ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT k, bin, coalesce(v, CASE WHEN i1 > i0 THEN v0 + (v1 - v0) * (bin - i0) / (i1 - i0) ELSE v0 END, v0, v1, 0) AS v FROM g)"""


@query(
    f"""WITH {_HOURS} SELECT k, CAST(bin AS INTEGER) AS bin, round(bin / 1439.0, 6) AS x, round((sum(v) OVER (PARTITION BY k ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
    + greatest(0, 3 - bin) * first_value(v) OVER w + greatest(0, bin + 3 - 1439) * last_value(v) OVER w) / 7 + 1e-9, 6) AS v FROM l
    WINDOW w AS (PARTITION BY k ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
)
def profile_smooth(spark, d):
    rows = load(spark, d, "events").select(F.col("event_type").alias("k"), (F.hour("ts") * 60 + F.minute("ts")).alias("bin"), "value")
    means = rows.groupBy("k", "bin").agg(F.avg("value").alias("v"))  # not every minute has events, so that there are gaps
    every = rows.select("k").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(1439))))
    table = every.join(means, ["k", "bin"], "left").select("k", "bin", *(F.col("v").alias(c) for c in profile.CURVES))
    # a little is added, so that sums in another order don't fall on the other side of a half
    return profile.series(table, 1440, "k").select("k", "bin", r6("x"), F.round(F.col("p50") + 1e-9, 6).alias("v"))


@query(
    """WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders)
    SELECT o_orderkey, round((o_totalprice - a) / (b - a) * 0.8 + 0.1, 6) AS u, CAST(0.5 AS DOUBLE) AS same FROM orders, e"""
)
def normalize_unit(spark, d):
    orders = load(spark, d, "orders")
    ends = orders.agg(F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"))
    v, a, b = F.col("o_totalprice"), F.col("a"), F.col("b")
    return orders.join(F.broadcast(ends)).select("o_orderkey", r6(profile.to_unit(v, a, b), "u"), profile.to_unit(v, a, a).alias("same"))


@query(
    """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    WHERE n <= 5 OR k % CAST(ceil(n / 5.0) AS BIGINT) = 0"""
)
def stride_sample(spark, d):
    return profile.stride_sample(load(spark, d, "orders").select("o_custkey", "o_orderkey"), 5, ["o_orderkey"], "o_custkey")


@query(
    """WITH p AS (SELECT n_regionkey, min(s_acctbal) AS y_min, max(s_acctbal) AS y_max, greatest(max(s_suppkey) - min(s_suppkey), 0) / 1000.0 AS width_km
    FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1) SELECT min(y_min) AS y_min, max(y_max) AS y_max, max(width_km) / 2 AS half_width_km FROM p"""
)
def profile_ranges(spark, d):
    rows = load(spark, d, "supplier").join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    width = profile.width_km(F.min("s_suppkey").cast("double"), F.max("s_suppkey").cast("double"))
    return profile.shared_ranges(rows.groupBy("n_regionkey").agg(F.min("s_acctbal").alias("y_min"), F.max("s_acctbal").alias("y_max"), width.alias("width_km")))


# state


@query(
    """WITH o AS (SELECT n_nationkey AS tatort, 'k' AS kommun, n_name AS href, 'processed' AS process_status FROM nation WHERE n_nationkey < 15),
    p AS (SELECT n_nationkey AS tatort, 'k' AS kommun, 'new ' || n_name AS href, 'planned' AS process_status FROM nation WHERE n_nationkey >= 10)
    SELECT coalesce(o.tatort, p.tatort) AS tatort, coalesce(o.kommun, p.kommun) AS kommun, coalesce(p.href, o.href) AS href, coalesce(o.process_status, p.process_status) AS process_status
    FROM o FULL JOIN p ON o.tatort = p.tatort AND o.kommun = p.kommun"""
)
def upsert_plan(spark, d):
    rows = load(spark, d, "nation").select(F.col("n_nationkey").alias("tatort"), F.lit("k").alias("kommun"), F.col("n_name").alias("href"))
    old = rows.where("tatort < 15").withColumn("process_status", F.lit("processed"))
    new = rows.where("tatort >= 10").select("tatort", "kommun", F.concat(F.lit("new "), "href").alias("href"), F.lit("planned").alias("process_status"))
    return state.upserted(old, new, ("tatort", "kommun"), ("href",))


@query(
    """SELECT n_nationkey AS tatort, 'k' AS kommun, CASE WHEN n_nationkey % 3 = 0 THEN 'failed' ELSE 'planned' END AS status, CASE WHEN n_nationkey % 3 = 0 THEN 'no access' END AS error_message FROM nation"""
)
def update_status(spark, d):
    runs = load(spark, d, "nation").select(F.col("n_nationkey").alias("tatort"), F.lit("k").alias("kommun"), F.lit("planned").alias("status"), F.lit(None).cast("string").alias("error_message"))
    return state.set_status(runs, runs.where("tatort % 3 = 0"), "failed", "no access")


@query(
    f"""WITH {PIXELS} SELECT tatort, kommun, count(v) AS n_values, min(v) AS min_altitude_m, max(v) AS max_altitude_m, count(DISTINCT tile) AS tiles_used, round(sum(slope * slope), 4) AS slope_sum_squares,
    arg_min({{'x': x, 'y': y}}, {{'a': v, 'b': tile, 'c': "row", 'd': col}}).x AS min_x FROM px GROUP BY 1, 2"""
)
def resume_equals_full(spark, d):
    pixels = _pixels(spark, d)
    keys = ("tatort", "kommun", "tile")
    stored, fresh = (zonal.tile_partials(pixels.where(c), *keys) for c in ("tile = 'A'", "tile <> 'A'"))
    found = zonal.merge_partials(zonal.union_all(stored, fresh), "tatort", "kommun", order=("tile",))
    return found.select("tatort", "kommun", "n_values", "min_altitude_m", "max_altitude_m", "tiles_used", F.round("slope_sum_squares", 4).alias("slope_sum_squares"), F.col("min_coord.x").alias("min_x"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'planned' ELSE 'processed_empty' END"


@query(
    f"""SELECT o_custkey AS tatort, o_orderkey AS item_id, CAST(trunc(o_totalprice) AS BIGINT) AS size_bytes FROM orders
    WHERE {_STATUS} NOT IN ('processed', 'processed_empty') AND o_orderkey % 4 <> 0"""
)
def pending_tiles(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "planned").otherwise("processed_empty")
    rows = load(spark, d, "orders").select(
        F.col("o_custkey").alias("tatort"), F.lit("k").alias("kommun"), F.col("o_orderkey").alias("item_id"), F.col("o_totalprice").cast("bigint").alias("size_bytes"), status.alias("process_status")
    )
    zone = ("tatort", "kommun", "item_id")
    cached = rows.where("item_id % 2 = 0").select(*zone, F.when(F.col("item_id") % 4 == 0, F.col("size_bytes")).otherwise(F.col("size_bytes") - 1).alias("cached_bytes"))
    return state.pending(rows.select(*zone, "size_bytes"), rows.select(*zone, "process_status"), cached).select("tatort", "item_id", "size_bytes")


@query(
    f"""SELECT o_custkey AS tatort, count(*) FILTER (s <> 'planned') AS tiles_scanned, count(*) FILTER (s = 'processed') AS tiles_used, CAST(coalesce(sum(b) FILTER (s <> 'planned'), 0) AS BIGINT) AS finished_bytes
    FROM (SELECT o_custkey, CAST(trunc(o_totalprice) AS BIGINT) AS b, {_STATUS} AS s FROM orders) GROUP BY 1"""
)
def resume_counts(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "planned").otherwise("processed_empty")
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("tatort"), F.lit("k").alias("kommun"), F.col("o_totalprice").cast("bigint").alias("size_bytes"), status.alias("process_status"))
    return state.resume_counts(rows).drop("kommun")


@query(
    """WITH t AS (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS items FROM orders GROUP BY 1)
    SELECT c_custkey AS tatort, items FROM customer JOIN t ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"""
)
def completed_runs(spark, d):
    runs = load(spark, d, "customer").select(F.col("c_custkey").alias("tatort"), F.lit("k").alias("kommun"), F.when(F.col("c_mktsegment") == "BUILDING", "completed").otherwise("planned").alias("status"))
    tiles = load(spark, d, "orders").select(
        F.col("o_custkey").alias("tatort"), F.lit("k").alias("kommun"), F.lit(1).alias("batch_index"), F.col("o_orderkey").alias("batch_position"), F.col("o_orderkey").cast("string").alias("item_id"), F.lit(1).alias("size_bytes")
    )
    return state.completed_summary(runs, tiles).select("tatort", F.array_join(F.transform("tiles", lambda t: t["item_id"]), ",").alias("items"))


@query(
    """SELECT user_id AS tatort, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) WHERE k = 1"""
)
def latest_profile(spark, d):
    rows = load(spark, d, "events").select(F.col("user_id").alias("tatort"), "event_id", "ts", F.lit(None).cast("int").alias("rank"))
    return profile.latest(rows, "ts", "event_id", "tatort").select("tatort", "event_id")


# texts


@query(
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"k":' || json_extract_string(props, '$.k') || '}' AS again, event_type || ', ' || json_extract_string(props, '$.k') AS listed FROM events"""
)
def json_extract(spark, d):
    parsed = F.from_json("props", "k bigint")
    rows = load(spark, d, "events").select("event_id", "event_type", parsed.alias("p"))
    return rows.select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("again"), fmt.listed(F.array("event_type", F.col("p.k").cast("string"))).alias("listed"))


@query(r"""SELECT page_id, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1) AS file FROM pages""")
def url_filename(spark, d):
    return load(spark, d, "pages").select("page_id", fmt.file_name(F.col("url")).alias("file"))


@query(r"""SELECT doc_id, replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), ' ', '_') AS slug FROM documents""")
def slugify(spark, d):
    return load(spark, d, "documents").select("doc_id", fmt.slug(F.col("text")).alias("slug"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'custom' ELSE CAST(c_custkey AS VARCHAR) END || '_' || translate(lower(c_name), ' #/', '_#_') || '_' || lower(c_mktsegment) || '_120_12000' AS key,
    c_name || ' (' || c_mktsegment || '): ' || CASE WHEN c_custkey % 3 = 0 THEN 'custom selection' ELSE 'rank ' || c_custkey || ', score ' || printf('%.1f', c_acctbal) END AS title FROM customer"""
)
def profile_titles(spark, d):
    rank = F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey"))
    name, part = F.col("c_name"), F.col("c_mktsegment")
    return load(spark, d, "customer").select("c_custkey", fmt.profile_key(rank, name, part, F.lit(120), F.lit(12000)).alias("key"), fmt.title(rank, name, part, F.col("c_acctbal")).alias("title"))


@query(
    """SELECT o_orderkey, printf('%.2f', o_totalprice / 1048576) || ' MB' AS size, printf('%.4f', o_totalprice / 7) AS fixed, CASE WHEN s >= 3600 THEN s // 3600 || 'h ' || s % 3600 // 60 || 'm ' || s % 60 || 's'
    WHEN s >= 60 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s || 's' END AS took FROM (SELECT o_orderkey, o_totalprice, CAST(round_even(o_totalprice / 31, 0) AS BIGINT) AS s FROM orders)"""
)
def format_texts(spark, d):
    v = F.col("o_totalprice")
    return load(spark, d, "orders").select("o_orderkey", fmt.mib(v).alias("size"), fmt.fixed(v / 7, 4).alias("fixed"), fmt.seconds_text(v / 31).alias("took"))


@query(
    """WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS by_max, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS by_min FROM orders)
    SELECT * FROM r WHERE by_max <= 20 OR by_min <= 20"""
)
def topn_by_criterion(spark, d):
    price = F.col("o_totalprice")
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return zonal.top_by(rows, 20, {"by_max": [price.desc(), F.col("o_orderkey")], "by_min": [price, F.col("o_orderkey")]}, "o_orderpriority").drop("o_totalprice")


# pieces of the pipelines


@query("SELECT o_orderkey, o_totalprice FROM orders")
def guarded_rows(spark, d):
    return planning.not_empty(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), "no orders")


@query(f"WITH RECURSIVE {_TILES} SELECT zone, item_id, CAST(batch_position AS INTEGER) AS batch_position FROM p WHERE batch_index = 2")
def second_batches(spark, d):
    return planning.batch(_batches(spark, d), 2).select("zone", "item_id", "batch_position")


@query(f"WITH RECURSIVE {_TILES} SELECT zone, item_id, CAST(ordinal AS BIGINT) AS ordinal, batch_index FROM p")
def plan_from_state(spark, d):
    stored = _batches(spark, d).select(F.col("zone").alias("tatort"), F.lit("k").alias("kommun"), "item_id", "size_bytes", "batch_index", "batch_position")
    again = planning.packed(state.plan_order(stored), 1_000_000, "tatort", "kommun")
    return again.select(F.col("tatort").alias("zone"), "item_id", "ordinal", "batch_index")


@query("SELECT o_custkey, CAST(sum(CAST(trunc(o_totalprice) AS BIGINT)) AS BIGINT) + 1000 AS used FROM orders GROUP BY 1")
def budget_gate(spark, d):
    new = F.sum(F.col("o_totalprice").cast("bigint"))
    return load(spark, d, "orders").groupBy("o_custkey").agg(new.alias("new")).select("o_custkey", planning.within_budget(F.lit(1000).cast("bigint"), F.col("new"), 1 << 50).alias("used"))


@query("SELECT o_orderkey, 300000 + (o_orderkey % 97 + 0.5) * 2 AS x, 6200000 - (o_orderkey % 89 + 0.5) * 2 AS y FROM orders")
def pixel_centers(spark, d):
    k, lit = F.col("o_orderkey"), lambda v: F.lit(float(v))
    x, y = geometry.pixel_center(k % 89, k % 97, lit(300000), lit(6200000), lit(2), lit(2))
    return load(spark, d, "orders").select("o_orderkey", x.alias("x"), y.alias("y"))


@query(
    f"""WITH {SUMMARY}, r AS (SELECT row_number() OVER (ORDER BY hilliness_score DESC, tatort, kommun) AS k, * FROM f)
    SELECT CAST(k AS VARCHAR) AS rank, tatort, {_sql_text("hilliness_score", 4)} AS hilliness_score FROM r WHERE k <= 5"""
)
def top_zones(spark, d):
    return tables.top(_result_fields(spark, d), 5).select("rank", "tatort", "hilliness_score")


def _result_fields(spark, d) -> DataFrame:
    more = {"tatortskod": F.substring("tatort", 1, 3), "collections": F.col("kommun"), "batches": F.lit(1), "total_raw_size_mb": F.col("n_values") * 4.0 / 1048576, "tiles_scanned": F.col("tiles_used")}
    return _summary(spark, d).select("*", *(v.alias(k) for k, v in more.items()))


def _folder(spark) -> str:
    """A new folder where the cluster's executors share files; only a local session without one has a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='ridgeline-')}/{uuid.uuid4().hex}"


@query(
    f"""WITH {SUMMARY} SELECT CAST(row_number() OVER (ORDER BY hilliness_score DESC, tatort, kommun) AS INTEGER) AS rank, tatort, kommun, CAST({_sql_text("hilliness_score", 4)} AS DOUBLE) AS hilliness_score,
    CAST({_sql_text("relief_q05_m", 2)} AS DOUBLE) AS relief_q05_m FROM f"""
)
def result_file(spark, d):
    path = _folder(spark)
    tables.write_results(_result_fields(spark, d), path)
    return tables.results(spark, path).select("rank", "tatort", "kommun", "hilliness_score", "relief_q05_m")


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS item_id, 'c' || o_orderkey % 3 AS collection_id, 'https://x/' || o_orderkey || '.tif' AS href, CAST(trunc(o_totalprice) AS BIGINT) AS size_bytes,
    CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END AS DOUBLE) AS minx FROM orders"""
)
def catalog_items(spark, d):
    k = F.col("o_orderkey")
    own = F.when(k % 2 == 0, F.array(*[k.cast("double")] * 4)).otherwise(F.array().cast("array<double>"))
    data = F.struct(F.concat(F.lit("https://x/"), k, F.lit(".tif")).alias("href"), F.col("o_totalprice").cast("bigint").alias("file:size"), own.alias("proj:bbox"))
    item = F.struct(k.cast("string").alias("id"), F.struct(data.alias("data")).alias("assets"), F.struct(F.array(*[-k.cast("double")] * 4).alias("proj:bbox")).alias("properties"))
    pages = load(spark, d, "orders").groupBy(F.concat(F.lit("c"), k % 3).alias("collection_id"), F.floor(k / 100).alias("page")).agg(F.collect_list(item).alias("features"))
    path = _folder(spark)
    pages.select("collection_id", F.to_json(F.struct("features", F.array().cast("array<struct<rel:string,href:string>>").alias("links")))).write.partitionBy("collection_id").text(path)
    rows = spark.read.schema(f"{schemas.ITEMS}, collection_id string").json(path)
    return tables.items_of(rows).select("item_id", "collection_id", "href", "size_bytes", F.col("bbox_3006.minx").alias("minx"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'n' || event_id END AS href FROM events")
def next_links(spark, d):
    link = lambda rel, href: F.struct(F.lit(rel).alias("rel"), href.cast("string").alias("href"))
    own, n = link("self", F.lit("s")), F.concat(F.lit("n"), F.col("event_id").cast("string"))
    links = F.when(F.col("user_id") % 3 == 0, F.array(own, link("next", n), link("next", F.lit("later")))).otherwise(F.array(own))
    return load(spark, d, "events").select("event_id", tables.next_page(links).alias("href"))


@query(
    """SELECT c_custkey, replace(lower(c_name), ' ', '_') AS chunk, 'root/' || c_mktsegment || '/' || c_custkey || '.tif' AS path, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey AS DOUBLE) END AS px FROM customer"""
)
def names_and_places(spark, d):
    k = F.col("c_custkey")
    p = fmt.point(k.cast("double"), F.when(k % 4 != 0, k.cast("double")))
    url = F.concat(F.lit("https://h/a/"), k, F.lit(".tif?x=1"))
    return load(spark, d, "customer").select("c_custkey", fmt.chunk_slug(F.col("c_name")).alias("chunk"), fmt.tile_path(F.lit("root"), F.col("c_mktsegment"), url).alias("path"), p["x"].alias("px"))


@query(
    """SELECT c_custkey AS tatort, CASE WHEN c_custkey % 2 = 0 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN c_custkey % 2 = 1 THEN 'old' END AS error_message, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS hilliness_score,
    CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS DOUBLE) END AS min_coord_x FROM customer"""
)
def stored_summaries(spark, d):
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("tatort"), F.lit("k").alias("kommun"), "c_acctbal", F.col("c_nationkey").cast("double").alias("x"))
    runs = rows.select("tatort", "kommun", F.lit("failed").alias("status"), F.lit("old").alias("error_message"), *(F.lit(None).cast("double").alias(c) for c in ("hilliness_score", "min_coord_x", "min_coord_y")))
    found = rows.where("tatort % 2 = 0").select("tatort", "kommun", F.col("c_acctbal").alias("hilliness_score"), F.struct("x", F.lit(0.0).alias("y")).alias("min_coord"))
    return state.store_summaries(runs, found).drop("kommun", "min_coord_y")


@query(
    """SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 3 < 2 THEN 'downloaded' ELSE 'planned' END AS download_status, CASE o_orderkey % 3 WHEN 0 THEN 'processed' WHEN 1 THEN 'processed_empty' ELSE 'planned' END AS process_status,
    CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS local_min, CASE WHEN o_orderkey % 3 = 0 THEN 'p' END AS chunk_path FROM orders"""
)
def stored_metrics(spark, d):
    k, zone = F.col("o_orderkey"), (F.col("o_custkey").alias("tatort"), F.lit("k").alias("kommun"), F.col("o_orderkey").alias("item_id"))
    orders = load(spark, d, "orders")
    nothing = [F.lit(None).cast("double").alias(c) for c in ("local_min", "local_max", "min_coord_x", "min_coord_y", "max_coord_x", "max_coord_y", "slope_sum_squares")]
    tiles = orders.select(*zone, F.lit("planned").alias("download_status"), F.lit("planned").alias("process_status"), *nothing, F.lit(None).cast("bigint").alias("slope_count"), F.lit(None).cast("string").alias("chunk_path"))
    some = orders.where(k % 3 < 2)
    full, v = k % 3 == 0, F.when(k % 3 == 0, F.col("o_totalprice"))
    coord = F.struct(v.alias("x"), v.alias("y"))
    partials = some.select(*zone, v.alias("local_min"), v.alias("local_max"), coord.alias("min_coord"), coord.alias("max_coord"), F.when(full, 5).otherwise(0).alias("n_values"), v.alias("slope_sum_squares"), F.lit(1).cast("bigint").alias("slope_count"), F.when(full, "p").alias("chunk_path"))
    found = state.store_metrics(state.mark_downloaded(tiles, some.select(*zone)), partials)
    return found.select("item_id", "download_status", "process_status", "local_min", "chunk_path")


@query("SELECT user_id, event_id, CAST(row_number() OVER (ORDER BY CASE WHEN user_id % 2 = 0 THEN user_id END NULLS LAST, lower('u' || user_id)) AS BIGINT) AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) WHERE k = 1")
def profile_order(spark, d):
    name = F.concat(F.lit("u"), F.col("user_id"))
    rows = load(spark, d, "events").select(name.alias("tatort"), "user_id", "event_id", "ts", F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("rank"))
    # the order that the rows come in, written down
    ordered = profile.latest(rows, "ts", "event_id", "tatort").withColumn("at", F.monotonically_increasing_id())
    return ordered.select("user_id", "event_id", F.row_number().over(Window.orderBy("at")).cast("bigint").alias("place"))


@query(
    """WITH c AS (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    b AS (SELECT label, greatest(least(CAST(trunc((i + vec_id % 5 - 10.0) / 50.0 * 20) AS INTEGER), 19), 0) AS bin, v FROM c), q AS (SELECT label, bin, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90 FROM b GROUP BY 1, 2)
    SELECT label, 20 AS n_bins, round(min(p10), 6) AS y_min, round(max(p90), 6) AS y_max FROM q GROUP BY 1"""
)
def profile_extent(spark, d):
    cells = load(spark, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "v"))
    bin = profile.bin_of((F.col("i") + F.col("vec_id") % 5).cast("double"), F.lit(10.0), F.lit(60.0), 20)
    table = profile.binned(cells.select("label", bin.alias("bin"), F.col("v").cast("double").alias("v")), "v", 20, "label")
    packed = profile.packed_profiles(table.withColumn("x", F.col("bin") / 19.0), "label")
    return packed.select("label", F.size("x").alias("n_bins"), r6("y_min"), r6("y_max"))


#: Published pairs of geographic and grid coordinates (degrees north and east, metres north and east).
_CONTROL = (
    (55.0, 12.75, 6097106.672, 356083.438), (55.0, 14.25, 6095048.642, 452024.069), (57.0, 12.75, 6319636.937, 363331.554),
    (57.0, 19.5, 6326392.707, 773251.054), (59.0, 11.25, 6546096.724, 284626.066), (59.0, 19.5, 6548757.206, 758410.519),
)


@query(
    f"""SELECT c_custkey, CAST(north AS DOUBLE) AS north, CAST(east AS DOUBLE) AS east, printf('(%.6f, %.6f)', lat, lon) AS place
    FROM customer JOIN (VALUES {', '.join(f"({k}, {', '.join(map(str, c))})" for k, c in enumerate(_CONTROL))}) v(k, lat, lon, north, east) ON k = c_nationkey % {len(_CONTROL)}"""
)
def control_points(spark, d):
    points = spark.createDataFrame([(k, *c) for k, c in enumerate(_CONTROL)], "k int, lat double, lon double, n double, e double")
    rows = load(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % len(_CONTROL)).alias("k")).join(F.broadcast(points), "k")
    lon, lat = F.col("lon"), F.col("lat")
    back = fmt.coordinate(F.col("e"), F.col("n"))
    return rows.select("c_custkey", F.round(proj.northing(lon, lat), 3).alias("north"), F.round(proj.easting(lon, lat), 3).alias("east"), back.alias("place"))


# tiles as arrays

#: A polygon over the grid of 64 columns and at least one row that the embeddings of a label are: two parts, the first with a hole.
_CUT = [[[(2.2, 0.0), (61.7, 3.3), (58.4, 900.2), (30.1, 6.0), (3.9, 900.6)], [(40.2, 4.0), (50.8, 4.5), (47.3, 60.1)]], [[(-5.0, 0.6), (1.6, 0.4), (1.4, 500.3), (-4.0, 400.0)]]]
_CUT_EDGES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for part in _CUT for ring in part for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
_CUT_TILES = f"""
e(x1, y1, x2, y2) AS (VALUES {_CUT_EDGES}), g AS (
    SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, generate_subscripts(embedding, 1) - 1 AS c, CAST(unnest(embedding) AS DOUBLE) AS raw FROM embeddings
), z AS (SELECT label, max(r) + 1 AS h FROM g GROUP BY 1), p AS (SELECT g.*, c + 0.5 AS x, h - (r + 0.5) AS y FROM g JOIN z USING (label)),
b AS (SELECT min(least(x1, x2)) AS x0, max(greatest(x1, x2)) AS x9, min(least(y1, y2)) AS y0, max(greatest(y1, y2)) AS y9 FROM e),
w AS (SELECT p.* FROM p, b WHERE x + 0.5 > x0 AND x - 0.5 < x9 AND y + 0.5 > y0 AND y - 0.5 < y9),
i AS (SELECT label, r, c, count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS inside FROM w, e GROUP BY 1, 2, 3),
m AS (SELECT w.label, w.r, w.c, w.x, w.y, CASE WHEN inside AND raw >= -0.2 THEN raw END AS v FROM w JOIN i USING (label, r, c)),
s AS (SELECT m.*, min(r) OVER l AS r0, max(r) OVER l AS r1, min(c) OVER l AS c0, max(c) OVER l AS c1, lag(v) OVER a AS vw, lead(v) OVER a AS ve, lag(v) OVER d AS vn, lead(v) OVER d AS vs FROM m
    WINDOW l AS (PARTITION BY label), a AS (PARTITION BY label, r ORDER BY c), d AS (PARTITION BY label, c ORDER BY r)),
k AS (SELECT *, CASE WHEN r0 = r1 OR c0 = c1 THEN NULL WHEN c = c0 THEN ve - v WHEN c = c1 THEN v - vw ELSE (ve - vw) / 2 END AS gx,
    CASE WHEN r0 = r1 OR c0 = c1 THEN NULL WHEN r = r0 THEN vs - v WHEN r = r1 THEN v - vn ELSE (vs - vn) / 2 END AS gy FROM s),
f AS (SELECT label, r, c, x, y, v, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope FROM k)"""


#: Rows of a band of 64 columns: a quarter of a million pixels.
_CUT_ROWS = 4096


def _cut_files(spark, d) -> DataFrame:
    """The embeddings of each label as a raster with a row for each, values below -0.2 missing, under the polygon, in files of bands: a label has more rows with every copy of the table."""
    rows = load(spark, d, "embeddings").withColumn("row", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    high = rows.withColumn("_h", F.count(F.lit(1)).over(Window.partitionBy("label")))
    v = F.col("v").cast("double")
    cells = high.select(F.col("label").cast("string").alias("tile"), "row", "_h", F.posexplode("embedding").alias("col", "v"))
    one = F.lit(1.0)
    pixels = cells.select(
        "tile", "row", "col", F.when(v >= -0.2, v).alias("v"), (F.col("col") + 0.5).alias("x"), (F.col("_h") - (F.col("row") + 0.5)).alias("y"), one.alias("res_x"), one.alias("res_y"), F.lit(None).cast("double").alias("nodata")
    )
    point = lambda p: F.struct(F.lit(float(p[0])).alias("x"), F.lit(float(p[1])).alias("y"))
    shape = F.array(*(F.array(*(F.array(*map(point, ring)) for ring in part)) for part in _CUT))
    files = tables.packed_bands(pixels, _CUT_ROWS).withColumnRenamed("tile", "item_id")
    return files.select(F.lit("z").alias("tatort"), F.lit("k").alias("kommun"), "item_id", *kernel.BAND, "content", geometry.edges(shape).alias("edges"))


@query(
    f"""WITH {_CUT_TILES} SELECT CAST(label AS VARCHAR) AS item_id, count(v) AS n_values, min(v) AS local_min, max(v) AS local_max, arg_min(x, {{'a': v, 'b': r, 'c': c}}) FILTER (v IS NOT NULL) AS min_x,
    arg_min(y, {{'a': -v, 'b': r, 'c': c}}) FILTER (v IS NOT NULL) AS max_y, round(coalesce(sum(slope * slope) FILTER (v IS NOT NULL), 0), 4) AS slope_sum_squares, count(slope) FILTER (v IS NOT NULL) AS slope_count FROM f GROUP BY 1"""
)
def tile_partials(spark, d):
    found = kernel.partials(kernel.zone_tiles(_cut_files(spark, d)))
    place = F.col("min_coord")["x"].alias("min_x"), F.col("max_coord")["y"].alias("max_y")
    return found.select("item_id", "n_values", "local_min", "local_max", *place, F.round("slope_sum_squares", 4).alias("slope_sum_squares"), "slope_count")


@query(
    f"""WITH {_CUT_TILES} SELECT 'z' AS tatort, {", ".join(f"round(quantile_cont(CAST(CAST(v AS FLOAT) AS DOUBLE), {q}), 6) AS {n}" for n, q in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95)))} FROM f WHERE v IS NOT NULL"""
)
def tile_quantiles(spark, d):
    found = kernel.quantiles(kernel.zone_tiles(_cut_files(spark, d)), {"q05": 0.05, "q50": 0.5, "q95": 0.95}, "tatort")
    return found.select("tatort", *map(r6, ("q05", "q50", "q95")))


@query(
    """WITH p AS (SELECT o_custkey AS zone, o_orderkey AS item_id, CAST(trunc(o_totalprice) AS BIGINT) AS size, o_orderstatus = 'O' AS wave, CASE WHEN o_orderkey % 3 = 0 THEN CAST(trunc(o_totalprice) AS BIGINT) WHEN o_orderkey % 3 = 1 THEN 1000 END AS cached FROM orders)
    SELECT zone, CAST(coalesce(sum(cached), 0) AS BIGINT) AS used, CAST(sum(size) FILTER (wave AND cached IS DISTINCT FROM size) AS BIGINT) AS new,
    coalesce(sum(cached), 0) + coalesce(sum(size) FILTER (wave AND cached IS DISTINCT FROM size), 0) > 500000 AS over FROM p GROUP BY 1 HAVING bool_or(wave)"""
)
def cache_overruns(spark, d):
    k, size = F.col("o_orderkey"), F.col("o_totalprice").cast("bigint")
    planned = load(spark, d, "orders").select(F.col("o_custkey").alias("zone"), k.alias("item_id"), size.alias("size_bytes"), "o_orderstatus")
    cached = planned.where(F.col("item_id") % 3 < 2).select("item_id", F.when(F.col("item_id") % 3 == 0, F.col("size_bytes")).otherwise(1000).alias("cached_bytes"))
    found = planning.cache_use(planned.where("o_orderstatus = 'O'").drop("o_orderstatus"), planned.drop("o_orderstatus"), cached, 500_000, "zone")
    return found.select("zone", "used", F.nullif("new", F.lit(0)).alias("new"), "over")


@query(
    """WITH c AS (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    b AS (SELECT label, greatest(least(CAST(trunc((i + vec_id % 5 - 10.0) / 50.0 * 20) AS INTEGER), 19), 0) AS bin, v FROM c), q AS (SELECT label, bin, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90 FROM b GROUP BY 1, 2),
    z AS (SELECT label, (sum(p10) OVER s + greatest(0, 3 - bin) * first_value(p10) OVER w + greatest(0, bin - 16) * last_value(p10) OVER w) / 7 AS p10,
        (sum(p90) OVER s + greatest(0, 3 - bin) * first_value(p90) OVER w + greatest(0, bin - 16) * last_value(p90) OVER w) / 7 AS p90 FROM q
        WINDOW s AS (PARTITION BY label ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), w AS (PARTITION BY label ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT label, CAST(count(*) AS INTEGER) AS n_bins, round(min(p10), 5) AS y_min, round(max(p90), 5) AS y_max FROM z GROUP BY 1"""
)
def smoothed_extent(spark, d):
    cells = load(spark, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "v"))
    bin = profile.bin_of((F.col("i") + F.col("vec_id") % 5).cast("double"), F.lit(10.0), F.lit(60.0), 20)
    table = profile.binned(cells.select("label", bin.alias("bin"), F.col("v").cast("double").alias("v")), "v", 20, "label")
    packed = profile.packed_profiles(profile.series(table, 20, "label"), "label")
    return packed.select("label", F.size("x").alias("n_bins"), F.round("y_min", 5).alias("y_min"), F.round("y_max", 5).alias("y_max"))


@query(
    """SELECT o_custkey AS tatort, o_orderkey AS item_id, CASE WHEN o_orderstatus = 'F' THEN 'processed' ELSE 'planned' END AS process_status, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS local_min FROM orders"""
)
def committed_tiles(spark, d):
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("tatort"), F.col("o_orderkey").alias("item_id"), "o_orderstatus", "o_totalprice")
    schema = "tatort bigint, item_id bigint, process_status string, local_min double"
    store = state.Journal(spark, _folder(spark), {"tiles": schema}, {"tiles": ("tatort", "item_id")})
    store.commit({"tiles": orders.select("tatort", "item_id", F.lit("planned").alias("process_status"), F.lit(None).cast("double").alias("local_min"))})
    store.commit({"tiles": orders.where("o_orderstatus = 'F'").select("tatort", "item_id", F.lit("processed").alias("process_status"), F.col("o_totalprice").alias("local_min"))})
    return store.read("tiles")


@query(
    """SELECT o_custkey AS tatort, o_orderkey AS item_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderstatus NOT IN ('F', 'P')"""
)
def skipped_work(spark, d):
    key = [F.col("o_custkey").alias("tatort"), F.lit("k").alias("kommun"), F.col("o_orderkey").alias("item_id")]
    orders = load(spark, d, "orders")
    runs = load(spark, d, "customer").select(F.col("c_custkey").alias("tatort"), F.lit("k").alias("kommun"), F.when(F.col("c_mktsegment") == "BUILDING", "completed").otherwise("planned").alias("status"))
    status = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "P", "processed_empty").otherwise("planned")
    work, _ = state.split_by_state(orders.select(*key), runs)
    return state.unfinished(work, orders.select(*key, status.alias("process_status"))).select("tatort", "item_id")
