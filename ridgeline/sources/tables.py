"""Zones, catalogs, results, profiles and rasters as DataFrames; results and profiles as files."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.formatting import coordinate, file_name, fixed
from ..functions.projection import grid_box
from ..operators.zonal import ranked
from .geotiff import decode as decode_geotiff
from .geotiff import encode as encode_geotiff


def zones(spark: SparkSession, path: str) -> DataFrame:
    """Zones of a Parquet folder, in grid coordinates, with their ordinal in the source."""
    return spark.read.schema(schemas.ZONES).parquet(path)


def collections(spark: SparkSession, path: str) -> DataFrame:
    """(collection_id, ring) of catalog files: the first box of each collection as its four grid corners."""
    rows = spark.read.schema(schemas.COLLECTIONS).json(path, multiLine=True).select(F.inline("collections"))
    return rows.select(F.col("id").alias("collection_id"), grid_box(F.col("extent.spatial.bbox")[0]).alias("ring"))


def item_box(item: Column) -> Column:
    """Box of an item: its asset's, or its own if that is missing or empty."""
    own = item["assets"]["data"]["proj:bbox"]
    b = F.coalesce(F.when(F.size(own) > 0, own), item["properties"]["proj:bbox"])
    return F.struct(b[0].alias("minx"), b[1].alias("miny"), b[2].alias("maxx"), b[3].alias("maxy"))


def items(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of saved catalog pages, one folder ``collection_id=...`` for each collection, with their ordinal within the pages."""
    return items_of(spark.read.schema(f"{schemas.ITEMS}, collection_id string").json(path, multiLine=True))


def items_of(pages: DataFrame) -> DataFrame:
    """Tiles of catalog pages (features, links, collection_id) that were read from files."""
    rows = pages.select("collection_id", F.col("_metadata.file_path").alias("_page"), F.posexplode("features").alias("_at", "f"))
    return rows.select(
        F.col("f.id").alias("item_id"),
        "collection_id",
        F.col("f.assets.data.href").alias("href"),
        F.col("f.assets.data.`file:size`").cast("bigint").alias("size_bytes"),
        item_box(F.col("f")).alias("bbox_3006"),
        F.struct("_page", "_at").alias("fetch_ordinal"),
    )


def next_page(links: Column) -> Column:
    """Address of the first link to a next page, null at the end."""
    return F.get(F.filter(links, lambda x: x["rel"] == "next"), F.lit(0))["href"]


#: Fields of the result file, with their decimals.
RESULT_FIELDS = (
    ("rank", None), ("tatort", None), ("kommun", None), ("tatortskod", None), ("collections", None), ("batches", None),
    ("total_raw_size_mb", 2), ("tiles_scanned", None), ("tiles_used", None), ("min_altitude_m", 2), ("min_coord_lat_lon", None),
    ("max_altitude_m", 2), ("max_coord_lat_lon", None), ("altitude_range_m", 2), ("relief_q05_m", 2), ("relief_q95_m", 2),
    ("normalized_relief", 4), ("rms_slope_deg", 4), ("hilliness_score", 4),
)


def result_rows(summaries: DataFrame) -> DataFrame:
    """The result fields as text, ranked by score; ties by name."""
    rows = ranked(summaries, F.col("hilliness_score"), "tatort", "kommun")
    for k in ("min", "max"):
        rows = rows.withColumn(f"{k}_coord_lat_lon", coordinate(F.col(f"{k}_coord")["x"], F.col(f"{k}_coord")["y"]))
    return rows.select(*((F.col(c) if n is None else fixed(F.col(c), n)).cast("string").alias(c) for c, n in RESULT_FIELDS))


def write_results(summaries: DataFrame, path: str) -> None:
    """The result file: a header and one row for each zone, by rank."""
    result_rows(summaries).orderBy(F.col("rank").cast("int")).coalesce(1).write.mode("overwrite").csv(path, header=True)


def results(spark: SparkSession, path: str) -> DataFrame:
    """The ranked zones of a result file; an error if there are none."""
    rows = spark.read.schema(schemas.RESULTS).csv(path, header=True)
    if rows.isEmpty():
        raise ValueError(f"no ranked zones in {path}")
    return rows.orderBy("rank")


def top(summaries: DataFrame, n: int = 20) -> DataFrame:
    """The first zones of the ranking."""
    return result_rows(summaries).orderBy(F.col("rank").cast("int")).limit(n)


def write_profiles(profiles: DataFrame, path: str) -> None:
    """One JSON document for each profile; points are written as pairs."""
    pairs = lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    rows = profiles.withColumn("outline_segments", F.transform("outline_segments", pairs)).withColumn("view_axis_segment", pairs(F.col("view_axis_segment")))
    rows.write.mode("overwrite").json(path)


def profiles(spark: SparkSession, path: str, bins: int | None = None) -> DataFrame:
    """Profiles of JSON files with the path and time of their file; unreadable documents are skipped, and those of other bins."""
    rows = spark.read.schema(schemas.PROFILES).json(path, mode="DROPMALFORMED")
    rows = rows.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))
    return rows if bins is None else rows.where(F.size("x") == bins)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the regular files of a folder, without its subfolders."""
    row = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("n")).first()
    return row["n"] or 0


TILE_PIXELS = "tile string, row int, col int, v double, x double, y double, res_x double, res_y double, nodata double"


def pixel_batches(tile: str, values: np.ndarray, head: dict):
    """The pixels of a raster with their centres, a few rows of pixels at a time."""
    step = max(1, 262_144 // values.shape[1])
    for top_row in range(0, len(values), step):
        part = values[top_row : top_row + step]
        row, col = np.indices(part.shape)
        row, col, n = row.ravel() + top_row, col.ravel(), part.size
        v = pa.array(part.ravel(), from_pandas=True)  # NaN becomes null
        x, y = head["x0"] + (col + 0.5) * head["res_x"], head["y0"] - (row + 0.5) * head["res_y"]
        fixed_ = [pa.array([head[k]] * n, pa.float64()) for k in ("res_x", "res_y", "nodata")]
        columns = [pa.array([tile] * n), pa.array(row, pa.int32()), pa.array(col, pa.int32()), v, pa.array(x), pa.array(y), *fixed_]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in TILE_PIXELS.split(", ")])


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    if files.select("path").isEmpty():
        raise ValueError(f"no {pattern} in {path}")
    return files


def rasters(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """Pixels of all rasters of a folder with their centres, one tile at a time; an error if there are none."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                yield from pixel_batches(name, *decode_geotiff(content.as_py()))

    return _files(spark, path, pattern).select("path", "content").mapInArrow(run, TILE_PIXELS)


def raster_files(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """(tile, content): the rasters of a folder by the name of their file without its ending; an error if there are none."""
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return _files(spark, path, pattern).select(stem.alias("tile"), "content")


def _packed(table: pa.Table, top: int) -> bytes:
    """The pixels of a tile from a row on as a file."""
    row, col = (table[c].to_numpy() for c in ("row", "col"))
    values = np.full((row.max() + 1 - top, col.max() + 1), np.nan)
    values[row - top, col] = table["v"].to_numpy()
    first = table.slice(0, 1).to_pylist()[0]
    x0, y0 = first["x"] - (first["col"] + 0.5) * first["res_x"], first["y"] + (first["row"] - top + 0.5) * first["res_y"]
    return encode_geotiff(values, x0, y0, first["res_x"], first["res_y"], first["nodata"])


def packed_bands(pixels: DataFrame, rows: int) -> DataFrame:
    """(tile, part, above, below, content): the tiles of a dense tall pixel table as files of so many rows each, put together by one task each, whatever the tile's height.

    A band has the last row of the band above it and the first of the one below besides, so that its slopes are those of the whole tile; ``above`` and ``below`` count them.
    """
    own, at = F.floor(F.col("row") / rows).cast("int"), F.col("row") % rows
    parts = F.array_compact(F.array(own, F.when((at == 0) & (own > 0), own - 1), F.when(at == rows - 1, own + 1)))

    def pack(table: pa.Table) -> pa.Table:
        part, row = table["part"][0].as_py(), table["row"].to_numpy()
        above, below = int(row.min() < part * rows), int(row.max() >= (part + 1) * rows)
        n = int(row.max() >= part * rows)  # a band below the last row isn't one
        content = [_packed(table, part * rows - above)] if n else []
        counts = {k: pa.array([v] * n, pa.int32()) for k, v in (("part", part), ("above", above), ("below", below))}
        return pa.table({"tile": table["tile"].slice(0, n), **counts, "content": pa.array(content, pa.binary())})

    dealt = pixels.select(*(c.split()[0] for c in TILE_PIXELS.split(", ")), F.explode(parts).alias("part"))
    return dealt.groupBy("tile", "part").applyInArrow(pack, "tile string, part int, above int, below int, content binary")


def packed_pixels(pixels: DataFrame) -> DataFrame:
    """(tile, content): the tiles of a tall pixel table (see ``rasters``) as files, each put together by one task."""

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({"tile": table["tile"].slice(0, 1), "content": pa.array([_packed(table, 0)], pa.binary())})

    return pixels.select(*(c.split()[0] for c in TILE_PIXELS.split(", "))).groupBy("tile").applyInArrow(pack, "tile string, content binary")


def raster_source(spark: SparkSession, folder: str) -> Callable[[DataFrame], DataFrame]:
    """A function from tiles (item_id, href) to (tile, content) of the files of a folder that have the names of their addresses. Only these are read; a missing one has no row."""

    def read(tiles: DataFrame) -> DataFrame:
        named = tiles.select("item_id", file_name(F.col("href")).alias("_file")).distinct()
        there = spark.read.format("binaryFile").load(folder).select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("_file"))
        # the names of one batch, which Spark's file index holds on the driver anyway
        paths = [r["path"] for r in there.join(named, "_file").select("path").distinct().collect()]
        if not paths:
            return spark.createDataFrame([], "tile string, content binary")
        found = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", "([^/]+)$", 1).alias("_file"), "content")
        return found.join(named, "_file").select(F.col("item_id").alias("tile"), "content")

    return read


def cached_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, cached_bytes) of the tiles of a cache folder, by the name of their file without its ending; none if there is no folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "item_id string, cached_bytes bigint")
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return spark.read.format("binaryFile").load(folder).select(stem.alias("item_id"), F.col("length").alias("cached_bytes"))
