"""Which tiles a zone needs, in which batches, and how long that takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIB = 1024 * 1024


def exactly_one(found: DataFrame, *keys: str) -> DataFrame:
    """The rows if each key has one, else an error that names the key, raised as the rows are read."""
    counted = found.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    wrong = F.concat(F.lit("expected one zone, found "), F.col("_n").cast("string"), F.lit(" for "), F.concat_ws(", ", *map(F.col, keys)))
    checked = F.when(F.col("_n") == 1, F.col("_n")).otherwise(F.raise_error(wrong).cast("long"))
    return counted.withColumn("_n", checked).where(F.col("_n") == 1).drop("_n")


def select_zones(
    zones: DataFrame,
    tatort: list[str] | None = None,
    kommun: list[str] | None = None,
    min_population: int | None = None,
    max_population: int | None = None,
    offset: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Zones by names and population, then a slice in source order, then sorted by name.

    Empty lists don't filter; bounds are inclusive and drop zones without a population; the slice is the user's choice.
    """
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("offset and limit must not be negative")
    out = zones
    if tatort:
        out = out.where(F.col("tatort").isin(tatort))
    if kommun:
        out = out.where(F.col("kommunnamn").isin(kommun))
    if min_population is not None:
        out = out.where(F.col("bef") >= min_population)
    if max_population is not None:
        out = out.where(F.col("bef") <= max_population)
    if offset or limit is not None:
        out = out.orderBy("src_ordinal").offset(offset)
        out = out.limit(limit) if limit is not None else out
    return out.orderBy("tatort", "kommunnamn")


def not_empty(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def tile_order(tiles: DataFrame, *keys: str) -> DataFrame:
    """Tiles of each key with ``ordinal``: from south to north, then from west to east, then as fetched."""
    box = F.col("bbox_3006")
    return tiles.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(box["miny"], box["minx"], "fetch_ordinal")))


def packed(tiles: DataFrame, budget: int, *keys: str, size: str = "size_bytes", ordinal: str = "ordinal") -> DataFrame:
    """The tiles with ``batch_index`` and ``batch_position``, both from 1: a new batch begins where the next tile would go over the budget.

    One fold over the sizes of a key's tiles in order; a key's tiles are few, and only their sizes and ordinals are gathered.
    A tile over the budget is an error that names it.
    """
    if budget <= 0:
        raise ValueError("the budget must be positive")
    start = F.struct(F.lit(None).cast("long").alias("used"), F.array().cast("array<bigint>").alias("firsts"))

    def step(acc: Column, t: Column) -> Column:
        """The bytes of the open batch and the first tile of each batch so far: the list grows with the batches, not with the tiles."""
        fresh = acc["used"].isNull() | (acc["used"] + t["s"] > budget)
        return F.struct(F.when(fresh, t["s"]).otherwise(acc["used"] + t["s"]).alias("used"), F.when(fresh, F.array_append(acc["firsts"], t["o"])).otherwise(acc["firsts"]).alias("firsts"))

    checked = F.when(F.col(size) <= budget, F.col(size).cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("a tile is larger than the budget: "), F.col(size).cast("string"))).cast("long")
    )
    listed = F.array_sort(F.collect_list(F.struct(F.col(ordinal).cast("long").alias("o"), checked.alias("s"))))
    folded = tiles.groupBy(*keys).agg(F.aggregate(listed, start, step)["firsts"].alias("_firsts"))
    number = F.size(F.filter("_firsts", lambda f: f <= F.col(ordinal)))
    place = F.row_number().over(Window.partitionBy(*keys, "batch_index").orderBy(ordinal))
    numbered = tiles.withColumn(ordinal, F.col(ordinal).cast("long")).join(folded, list(keys)).withColumn("batch_index", number).drop("_firsts")
    return numbered.withColumn("batch_position", place)


def batch_summary(batches: DataFrame, *keys: str) -> DataFrame:
    """Number of tiles, bytes, first and last tile of each batch."""
    return batches.groupBy(*keys, "batch_index").agg(
        F.count(F.lit(1)).alias("n_tiles"),
        F.sum("size_bytes").alias("batch_bytes"),
        F.min_by("item_id", "batch_position").alias("first_item"),
        F.max_by("item_id", "batch_position").alias("last_item"),
    )


def batch(batches: DataFrame, index: int, *keys: str) -> DataFrame:
    """The tiles of one batch by its number from 1; an error if there is none."""
    return not_empty(batches.where(F.col("batch_index") == index), f"there is no batch {index}")


def within_budget(used: Column, new: Column, budget: int) -> Column:
    """The bytes that would be used, or an error if that is over the budget."""
    return F.when(used + new <= budget, used + new).otherwise(F.raise_error(F.lit("the cache budget would be exceeded")).cast("long"))


def cache_use(wave: DataFrame, planned: DataFrame, cached: DataFrame, budget: int, *keys: str) -> DataFrame:
    """(keys, used, new, over) of each zone of a wave: bytes of its planned tiles in the cache (item_id, cached_bytes), of those it has still to fetch, and whether both are over the budget.

    A cached file of the wrong size takes room and has to be fetched again.
    """
    held = planned.join(cached, "item_id").groupBy(*keys).agg(F.sum("cached_bytes").alias("used"))
    ready = F.coalesce(F.col("cached_bytes") == F.col("size_bytes"), F.lit(False))
    new = wave.join(cached, "item_id", "left").groupBy(*keys).agg(F.coalesce(F.sum(F.when(~ready, F.col("size_bytes"))), F.lit(0)).alias("new"))
    both = new.join(held, list(keys), "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return both.select(*keys, "used", "new", (F.col("used") + F.col("new") > budget).alias("over"))


def gate(use: DataFrame, budget: int, *keys: str) -> None:
    """An error that names the zone whose wave would take the cache over its budget, and the bytes that are there and come."""
    worst = use.where("over").orderBy(*keys).limit(1).collect()
    if worst:
        r = worst[0]
        raise RuntimeError(f"{', '.join(str(r[k]) for k in keys)}: the cache budget of {budget} bytes would be exceeded: {r['used']} are there, {r['new']} would come")


def download_seconds(size: Column, mbps: float) -> Column:
    """Seconds that bytes take at a rate in Mbit/s, which counts as 0.1 at least."""
    return size / F.lit(max(mbps, 0.1) * 1_000_000 / 8)


def processing_seconds(tiles: Column, each: float) -> Column:
    return tiles * F.lit(max(each, 0.01))


def remaining_download_seconds(left: Column, done: Column, seconds: Column, mbps: float) -> Column:
    """Seconds for the bytes that are left, at the rate seen in this session if there is one, else at the given rate."""
    seen = F.greatest(done / seconds, F.lit(1.0))
    return F.when(left <= 0, 0.0).when((done > 0) & (seconds > 0), left / seen).otherwise(download_seconds(left, mbps))


def remaining_processing_seconds(left: Column, done: Column, seconds: Column, each: float) -> Column:
    seen = F.greatest(seconds / done, F.lit(0.01))
    return F.when(left <= 0, 0.0).when((done > 0) & (seconds > 0), left * seen).otherwise(processing_seconds(left, each))


def preflight(plans: DataFrame, completed: DataFrame, mbps: float = 16.0, each: float = 0.5) -> DataFrame:
    """One row: zones, those completed, tiles, bytes and estimated seconds of plans (tatort, kommun, n_tiles, total_bytes)."""
    done = completed.select("tatort", "kommun", F.lit(True).alias("_done"))
    return plans.join(done, ["tatort", "kommun"], "left").agg(
        F.count(F.lit(1)).alias("zones"),
        F.count_if(F.col("_done")).alias("completed"),
        F.sum("n_tiles").alias("n_tiles"),
        F.sum("total_bytes").alias("total_bytes"),
        F.sum(download_seconds(F.col("total_bytes"), mbps) + processing_seconds(F.col("n_tiles"), each)).alias("seconds"),
    )


def plan(zones: DataFrame, tiles: DataFrame, budget: int, cell: float = 5000.0) -> DataFrame:
    """One row for each tile of each zone (tatort, kommun): order, batch and place in it."""
    from .geometry import zone_tiles

    met = zone_tiles(zones.withColumnRenamed("kommunnamn", "kommun"), tiles, cell).drop("geometry")
    return packed(tile_order(met, "tatort", "kommun"), budget, "tatort", "kommun")
