"""The pipelines: plan, preview, summarize, compare, profiles.

A comparison goes through the batches of all zones side by side: the first batch of every zone is one Spark job, then the second, and so on. Each (zone, tile) is measured by
one task (``operators.kernel``). After each batch the values of its tiles and what was measured are stored, so that a run that breaks off goes on with the tiles that are missing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import eta, geometry, kernel, planning, profile, raster, state, zonal
from ..sources import tables

ZONE = ("tatort", "kommun")


@dataclass(frozen=True)
class Options:
    """Choices of a run; the defaults are those of the command line."""

    cache_budget_mb: int = 1024
    download_rate_mbps: float = 16.0
    processing_seconds_per_tile: float = 0.5
    nodata: float | None = None
    bins: int = 120
    samples: int = 12_000
    top: int = 20


def plan(zones: DataFrame, tiles: DataFrame, options: Options = Options()) -> DataFrame:
    return planning.plan(zones, tiles, options.cache_budget_mb * planning.MIB)


def zone_pixels(zones: DataFrame, planned: DataFrame, pixels: DataFrame, options: Options = Options()) -> DataFrame:
    """Pixels of planned tiles, cut to the window of each zone, those outside or missing null, with slopes.

    ``pixels`` has the columns of ``sources.tables.rasters``; a tile is the item of the same file name.
    """
    shapes = zones.select("tatort", F.col("kommunnamn").alias("kommun"), "geometry")
    b = geometry.bounds(F.col("geometry"))
    chosen = planned.select(*ZONE, F.col("item_id").alias("tile"), "batch_index", "batch_position").join(shapes.select(*ZONE, b.alias("_b")), list(ZONE))
    half_x, half_y = F.col("res_x") / 2, F.col("res_y") / 2
    inside = (
        (F.col("x") + half_x > F.col("_b")["minx"]) & (F.col("x") - half_x < F.col("_b")["maxx"]) & (F.col("y") + half_y > F.col("_b")["miny"]) & (F.col("y") - half_y < F.col("_b")["maxy"])
    )
    window = pixels.join(chosen, "tile").where(inside).drop("_b")
    cut = geometry.clip(window.withColumn("v", raster.masked(F.col("v"), options.nodata)), shapes, *ZONE)
    keyed = cut.withColumn("_window", F.struct(*ZONE, "tile"))
    return raster.with_slope(keyed, F.col("res_x"), F.col("res_y"), options.nodata is not None, "_window").drop("_window")


def quantiles_of(values: DataFrame) -> DataFrame:
    """relief_q05_m and relief_q95_m of zones from their values ``v``, which are single floats, as are the quantiles."""
    found = zonal.exact_quantiles(values.withColumn("v", F.col("v").cast("float")), list(ZONE), "v", {"relief_q05_m": 0.05, "relief_q95_m": 0.95})
    return found.select(*ZONE, *(F.col(c).cast("float").cast("double").alias(c) for c in ("relief_q05_m", "relief_q95_m")))


def _areas(zones: DataFrame) -> DataFrame:
    return zones.select("tatort", F.col("kommunnamn").alias("kommun"), "tatortskod", geometry.area(F.col("geometry")).alias("area_m2"))


def summarize(zones: DataFrame, pixels: DataFrame) -> DataFrame:
    """Summaries of zones from their pixels (see zone_pixels); a zone without a valid pixel has none."""
    merged = zonal.merge_partials(zonal.tile_partials(pixels, *ZONE, "tile", "batch_index", "batch_position"), *ZONE)
    areas = _areas(zones)
    return zonal.finalize(merged, quantiles_of(pixels), areas, *ZONE).join(areas.select(*ZONE, "tatortskod"), list(ZONE))


def _store(spark: SparkSession, root: str) -> state.Journal:
    return state.Journal(spark, root, {"runs": schemas.RUNS, "tiles": schemas.TILE_STATE}, {"runs": state.ZONE, "tiles": state.TILE})


def preview(spark: SparkSession, planned: DataFrame, root: str, options: Options = Options()) -> DataFrame:
    """One row: zones, those completed, tiles, bytes and estimated seconds of a plan, next to the tiles and bytes that are done and pending by the snapshots under ``root``."""
    store = _store(spark, root)
    plans = planned.groupBy(*ZONE).agg(F.count(F.lit(1)).alias("n_tiles"), F.sum("size_bytes").alias("total_bytes"))
    totals = planning.preflight(plans, store.read("runs").where("status = 'completed'"), options.download_rate_mbps, options.processing_seconds_per_tile)
    left = state.unfinished(planned, store.read("tiles")).agg(F.count(F.lit(1)).alias("tiles_pending"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes_pending"))
    both = totals.withColumn("_one", F.lit(1)).join(left.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.withColumn("tiles_done", F.col("n_tiles") - F.col("tiles_pending")).withColumn("bytes_done", F.col("total_bytes") - F.col("bytes_pending"))


def stored_or_made(store: state.Journal, zones: DataFrame, tiles: DataFrame, options: Options) -> DataFrame:
    """The plan: the stored one for zones that have one, whose discovery is left out, and a new one for the others. Batches follow the current budget."""
    known = store.read("tiles")
    named = zones.withColumn("kommun", F.col("kommunnamn"))
    old = known.join(named.select(*ZONE, "tatortskod"), list(ZONE))
    fresh = plan(named.join(known.select(*ZONE).distinct(), list(ZONE), "left_anti").drop("kommun"), tiles, options).select(*ZONE, "tatortskod", *PLANNED)
    if known.isEmpty():
        return fresh
    again = planning.packed(state.plan_order(old), options.cache_budget_mb * planning.MIB, *ZONE)
    return again.select(*ZONE, "tatortskod", *PLANNED).unionByName(fresh)


PLANNED = ("item_id", "collection_id", "href", "size_bytes", "batch_index", "batch_position")
NO_TILES, NO_PIXELS = "no tile meets the zone", "no valid pixels"


def registered(store: state.Journal, zones: DataFrame, planned: DataFrame) -> None:
    """One commit of the plans of all zones: those that no tile meets are failed, the others as they were or planned."""
    names = zones.select("tatort", F.col("kommunnamn").alias("kommun"), "tatortskod")
    per_zone = planned.groupBy(*ZONE).agg(
        F.array_sort(F.collect_set("collection_id")).alias("collections"),
        F.max("batch_index").cast("bigint").alias("planned_batches"),
        F.count(F.lit(1)).alias("planned_tiles"),
        F.sum("size_bytes").alias("total_raw_size_bytes"),
    )
    plans = names.join(per_zone, list(ZONE), "left").fillna(0, ["planned_batches", "planned_tiles", "total_raw_size_bytes"])
    rows = state.register_runs(state.touched(store.read("runs"), plans, ZONE), plans)
    none = F.col("planned_tiles") == 0
    rows = rows.withColumn("error_message", F.when(none, NO_TILES).otherwise(F.col("error_message"))).withColumn("status", F.when(none, "failed").otherwise(F.col("status")))
    store.commit({"runs": rows, "tiles": state.register_tiles(state.touched(store.read("tiles"), planned, state.TILE), planned)})


def compare(
    spark: SparkSession,
    zones: DataFrame,
    tiles: DataFrame,
    rasters: DataFrame | Callable[[DataFrame], DataFrame],
    root: str,
    options: Options = Options(),
    cache_folder: str | None = None,
    progress: Callable[[dict], None] | None = None,
) -> DataFrame:
    """Result rows of all zones. What the log under ``root`` has is taken from there: plans, completed zones and finished tiles.

    ``rasters`` has the files of tiles (tile, content), or pixels as ``sources.tables.rasters`` has them, or is a function that gets those of a batch's tiles, as
    ``sources.tables.raster_source`` and ``sources.cache`` make one. A planned tile that isn't among them is an error that names it, and nothing of its batch is stored.
    A batch that would take ``cache_folder`` over a zone's budget is an error. A zone that no tile meets, or without a valid pixel, fails, and the others go on.
    ``progress`` is called after each batch with what this session has done, what is left and the seconds that it should take at this session's rate.
    """
    store = _store(spark, root)
    planned = stored_or_made(store, zones, tiles, options).persist()  # discovery is asked for by both tables
    registered(store, zones, planned)
    planned.unpersist()
    unreferenced(store)
    left = state.unfinished(_work(store, zones), store.read("tiles"))
    started = state.touched(store.read("runs"), left.select(*ZONE).distinct(), ZONE)
    store.commit({"runs": state.set_status(started, started, "running")})
    began, done_tiles = time.monotonic(), 0
    # batches are as many as the budget makes of the largest zone
    for index in [r["batch_index"] for r in left.select("batch_index").distinct().orderBy("batch_index").collect()]:
        wave = planning.batch(state.unfinished(_work(store, zones), store.read("tiles")), index)  # of the last commit, whose files stay
        if cache_folder is not None:
            budget = options.cache_budget_mb * planning.MIB
            planning.gate(planning.cache_use(wave, store.read("tiles"), tables.cached_tiles(spark, cache_folder), budget, *ZONE), budget, *ZONE)
        measured_wave(store, zones, wave, rasters(wave) if callable(rasters) else rasters, options)
        if progress is not None:
            done_tiles += wave.count()
            progress({"batch": index, **progress_of(state.unfinished(_work(store, zones), store.read("tiles")), done_tiles, time.monotonic() - began, options)})
    finished(store, zones, _work(store, zones))
    runs = store.read("runs")
    done = runs.where("status = 'completed'").join(zones.select("tatort", F.col("kommunnamn").alias("kommun")), list(ZONE), "left_semi")
    return tables.result_rows(
        done.select(
            "*",
            F.col("planned_batches").alias("batches"),
            (F.col("total_raw_size_bytes") / planning.MIB).alias("total_raw_size_mb"),
            *(F.struct(F.col(f"{k}_coord_x").alias("x"), F.col(f"{k}_coord_y").alias("y")).alias(f"{k}_coord") for k in ("min", "max")),
        ).withColumn("collections", F.array_join("collections", ", "))
    )


def progress_of(left: DataFrame, done_tiles: int, seconds: float, options: Options = Options()) -> dict:
    """Tiles that are done and left, bytes that are left, and the seconds that they should take, from what this session did alone. Tasks fetch while others measure, so one rate covers both."""
    none = F.lit(0)
    row = left.agg(F.count(none).alias("left_tiles"), F.coalesce(F.sum("size_bytes"), none).alias("bytes_left"))
    row = row.withColumns({"left_bytes": none, "done_bytes": none, "download_seconds": F.lit(None).cast("double"), "done_tiles": F.nullif(F.lit(done_tiles), none), "processing_seconds": F.lit(seconds)})
    found = eta.remaining(row, options.download_rate_mbps, options.processing_seconds_per_tile).first()
    return {"tiles_done": done_tiles, "tiles_left": found["left_tiles"], "bytes_left": found["bytes_left"], "seconds": seconds, "eta_seconds": found["eta_seconds"]}


def _work(store: state.Journal, zones: DataFrame) -> DataFrame:
    """The stored plan of zones that aren't completed."""
    named = zones.select("tatort", F.col("kommunnamn").alias("kommun"), "tatortskod")
    return state.split_by_state(store.read("tiles").join(named, list(ZONE)), store.read("runs"))[0].select(*ZONE, "tatortskod", *PLANNED)


def zone_files(zones: DataFrame, planned: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each planned (zone, tile) that has a file: (tatort, kommun, item_id, edges, content), as the kernel takes it."""
    shapes = zones.select("tatort", F.col("kommunnamn").alias("kommun"), geometry.edges(F.col("geometry")).alias("edges"))
    return planned.select(*ZONE, "item_id").join(shapes, list(ZONE)).join(files.select(F.col("tile").alias("item_id"), "content"), "item_id")


def measured_wave(store: state.Journal, zones: DataFrame, wave: DataFrame, rasters: DataFrame, options: Options = Options()) -> None:
    """Writes the values of a wave's tiles, and commits what was measured of each if all of them were read; values without a commit are never read."""
    name = uuid.uuid4().hex
    files = rasters if "content" in rasters.columns else tables.packed_pixels(rasters)
    kernel.zone_tiles(zone_files(zones, wave, files), options.nodata).write.parquet(f"{store.root}/values/{name}")
    found = kernel.partials(store.spark.read.schema(kernel.MEASURED).parquet(f"{store.root}/values/{name}"))
    lost = [r["item_id"] for r in wave.join(found.select(*ZONE, "item_id"), [*ZONE, "item_id"], "left_anti").select("item_id").distinct().orderBy("item_id").limit(11).collect()]
    if lost:
        raise RuntimeError(f"missing tiles: {', '.join(lost[:10])}{' and more' if len(lost) > 10 else ''}")
    old = state.touched(store.read("tiles"), wave, state.TILE)
    store.commit({"tiles": state.store_metrics(state.mark_downloaded(old, wave), found.withColumn("chunk_path", F.lit(name)))})


def unreferenced(store: state.Journal) -> None:
    """Removes the values of batches that broke off before their commit."""
    kept = {r["chunk_path"] for r in store.read("tiles").select("chunk_path").distinct().collect()}
    for name in store._list("values"):
        if name not in kept:
            path, files = store._path(f"values/{name}")
            files.delete(path, True)


def stored_values(store: state.Journal, tiles: DataFrame) -> DataFrame:
    """The cells of finished tiles with their values."""
    rows = tiles.where("process_status = 'processed'")
    names = [r["chunk_path"] for r in rows.select("chunk_path").distinct().collect()]
    read = store.spark.read.schema(kernel.MEASURED).parquet(*(f"{store.root}/values/{n}" for n in names)) if names else store.spark.createDataFrame([], kernel.MEASURED)
    return read.where("cell IS NOT NULL").join(rows.select(*state.TILE), list(state.TILE), "left_semi")


def finished(store: state.Journal, zones: DataFrame, work: DataFrame) -> None:
    """One commit of the summaries of the zones of ``work`` all of whose tiles are finished, from the stored partials and values; zones without a value fail."""
    open_zones = state.unfinished(work, store.read("tiles")).select(*ZONE).distinct()
    known = store.read("tiles").join(work.select(*state.TILE), list(state.TILE), "left_semi").join(open_zones, list(ZONE), "left_anti")
    counts = state.resume_counts(known)
    merged = zonal.merge_partials(state.stored_partials(known), *ZONE)
    relief = kernel.quantiles(stored_values(store, known), {"relief_q05_m": 0.05, "relief_q95_m": 0.95}, *ZONE)
    single = relief.select(*ZONE, *(F.col(c).cast("float").cast("double").alias(c) for c in ("relief_q05_m", "relief_q95_m")))
    found = zonal.finalize(merged, single, _areas(zones), *ZONE)
    runs = state.touched(store.read("runs"), counts, ZONE)
    done = state.store_summaries(runs, found.drop("tiles_used").join(counts.drop("finished_bytes"), list(ZONE)))
    store.commit({"runs": state.set_status(done, counts.where("tiles_used = 0"), "failed", NO_PIXELS)})


def profiles(zones: DataFrame, pixels: DataFrame, options: Options = Options()) -> DataFrame:
    """Profiles of zones from their pixels (see zone_pixels)."""
    shaped = geometry.with_main_axis(zones.withColumnRenamed("kommunnamn", "kommun"))
    return profile.profiles(pixels, shaped, options.bins, options.samples)


def stored_profiles(spark: SparkSession, zones: DataFrame, rasters: DataFrame | Callable[[DataFrame], DataFrame], root: str, options: Options = Options()) -> DataFrame:
    """Profiles of zones by the plans that the log under ``root`` has, with rank and score of completed ones; an error that names a zone without a stored plan.

    Pixels are drawn by the kernel, so that only the drawn ones are rows.
    """
    store = _store(spark, root)
    named = zones.withColumnRenamed("kommunnamn", "kommun")
    planned = store.read("tiles").join(named.select(*ZONE), list(ZONE), "left_semi")
    bare = named.join(planned, list(ZONE), "left_anti").select(*ZONE).orderBy(*ZONE).limit(1).collect()
    if bare:
        raise ValueError(f"no stored plan for {', '.join(bare[0])}")
    found = rasters(planned.select("item_id", "href", "size_bytes").distinct()) if callable(rasters) else rasters
    files = found if "content" in found.columns else tables.packed_pixels(found)
    drawn = kernel.samples(zone_files(zones, planned, files), options.samples, options.nodata)
    scores = zonal.ranked(store.read("runs").where("status = 'completed'").select(*ZONE, "hilliness_score"), F.col("hilliness_score"), *ZONE)
    return profiles(zones, drawn, options).join(scores.select(*ZONE, "rank", F.col("hilliness_score").alias("score")), list(ZONE), "left")
