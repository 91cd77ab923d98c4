"""State of runs and tiles: changes by joins, kept as snapshots of a table or as a log of changes whose commits cover all tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ZONE, TILE = ("tatort", "kommun"), ("tatort", "kommun", "item_id")
FINISHED = ("processed", "processed_empty")


def upserted(old: DataFrame, new: DataFrame, keys: tuple[str, ...], updated: tuple[str, ...]) -> DataFrame:
    """Old rows with the updated columns of new rows of the same key, and the new rows of other keys; all other old columns stay."""
    fresh = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in new.columns if c not in keys), F.lit(True).alias("_new"))
    joined = old.withColumn("_old", F.lit(True)).join(fresh, list(keys), "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c not in new.columns:
            return F.col(c)
        take = F.col("_new").isNotNull() & (F.col("_old").isNull() if c not in updated else F.lit(True))
        return F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*(value(c) for c in old.columns))


def updated(old: DataFrame, changes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Old rows with the columns of changes of the same key, nulls included; changes without a row do nothing."""
    fresh = changes.select(*keys, *(F.col(c).alias(f"_{c}") for c in changes.columns if c not in keys), F.lit(True).alias("_new"))
    joined = old.join(fresh, list(keys), "left")
    return joined.select(*(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns and c not in keys else F.col(c) for c in old.columns))


RUN_PLAN = ("tatortskod", "collections", "planned_batches", "planned_tiles", "total_raw_size_bytes")
TILE_PLAN = ("collection_id", "href", "size_bytes", "batch_index", "batch_position")


def register_runs(runs: DataFrame, plans: DataFrame) -> DataFrame:
    """Plan fields of zones inserted or renewed; status and metrics of known zones stay."""
    return upserted(runs, plans.withColumn("status", F.lit("planned")), ZONE, RUN_PLAN)


def register_tiles(tiles: DataFrame, plans: DataFrame) -> DataFrame:
    """Plan fields of tiles inserted or renewed; tiles that a plan no longer has stay."""
    new = plans.withColumn("download_status", F.lit("planned")).withColumn("process_status", F.lit("planned"))
    return upserted(tiles, new, TILE, TILE_PLAN)


def set_status(runs: DataFrame, keys: DataFrame, status: str, error: str | None = None) -> DataFrame:
    return updated(runs, keys.select(*ZONE).withColumn("status", F.lit(status)).withColumn("error_message", F.lit(error).cast("string")), ZONE)


def store_summaries(runs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries of known zones, with the places of extremes as columns; those zones are completed and without error."""
    flat = summaries.select(
        *[c for c in summaries.columns if c in runs.columns and c not in ("status", "error_message")],
        *(F.col(f"{k}_coord")[a].alias(f"{k}_coord_{a}") for k in ("min", "max") for a in ("x", "y") if f"{k}_coord" in summaries.columns),
    )
    return updated(runs, flat.withColumn("status", F.lit("completed")).withColumn("error_message", F.lit(None).cast("string")), ZONE)


def mark_downloaded(tiles: DataFrame, done: DataFrame) -> DataFrame:
    return updated(tiles, done.select(*TILE).withColumn("download_status", F.lit("downloaded")), TILE)


def store_metrics(tiles: DataFrame, partials: DataFrame) -> DataFrame:
    """Partials of tiles, which are processed; tiles in ``partials`` without a value are processed and empty. Their values are in ``chunk_path``, if given."""
    flat = partials.select(
        *TILE,
        *(["chunk_path"] if "chunk_path" in partials.columns else []),
        "local_min",
        "local_max",
        *(F.col(f"{k}_coord")[a].alias(f"{k}_coord_{a}") for k in ("min", "max") for a in ("x", "y")),
        "slope_sum_squares",
        "slope_count",
        F.when(F.col("n_values") > 0, "processed").otherwise("processed_empty").alias("process_status"),
    )
    return updated(tiles, flat, TILE)


def stored_partials(tiles: DataFrame) -> DataFrame:
    """The partials of processed tiles as ``zonal.merge_partials`` takes them. How many values a tile has isn't stored: the values are."""
    coord = lambda k: F.struct(F.col(f"{k}_coord_x").alias("x"), F.col(f"{k}_coord_y").alias("y")).alias(f"{k}_coord")
    rows = tiles.where("process_status = 'processed'")
    return rows.select(*TILE, "batch_index", "batch_position", "local_min", "local_max", coord("min"), coord("max"), F.lit(None).cast("long").alias("n_values"), "slope_sum_squares", "slope_count")


def unfinished(plans: DataFrame, tiles: DataFrame) -> DataFrame:
    """Planned tiles that aren't processed."""
    return plans.join(tiles.where(F.col("process_status").isin(*FINISHED)).select(*TILE), list(TILE), "left_anti")


def plan_order(tiles: DataFrame) -> DataFrame:
    """Stored tiles with ``ordinal``, their place in the stored plan."""
    return tiles.drop("batch_index", "batch_position").join(
        tiles.select(*TILE, F.row_number().over(Window.partitionBy(*ZONE).orderBy("batch_index", "batch_position", "item_id")).alias("ordinal")), list(TILE)
    )


def pending(plan: DataFrame, tiles: DataFrame, cached: DataFrame) -> DataFrame:
    """Planned tiles that are neither processed nor cached (tatort, kommun, item_id, cached_bytes) with their exact size."""
    state = tiles.select(*TILE, F.col("process_status").isin(*FINISHED).alias("_done"))
    joined = plan.join(state, list(TILE), "left").join(cached, list(TILE), "left")
    return joined.where(~F.coalesce("_done", F.lit(False)) & ~F.coalesce(F.col("cached_bytes") == F.col("size_bytes"), F.lit(False))).drop("_done", "cached_bytes")


def split_by_state(plans: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans of zones that are to be worked on, completed runs of planned zones)."""
    done = runs.where("status = 'completed'")
    return plans.join(done.select(*ZONE), list(ZONE), "left_anti"), done.join(plans.select(*ZONE), list(ZONE), "left_semi")


def resume_counts(tiles: DataFrame) -> DataFrame:
    """Of each zone: tiles and bytes that are finished, and those that were scanned and used."""
    finished = F.col("process_status").isin(*FINISHED)
    return tiles.groupBy(*ZONE).agg(
        F.count_if(finished).alias("tiles_scanned"),
        F.count_if(F.col("process_status") == "processed").alias("tiles_used"),
        F.coalesce(F.sum(F.when(finished, F.col("size_bytes"))), F.lit(0)).alias("finished_bytes"),
    )


def completed_summary(runs: DataFrame, tiles: DataFrame) -> DataFrame:
    """Completed runs with their tiles as arrays in plan order; runs without tiles have none."""
    listed = F.array_sort(F.collect_list(F.struct("batch_index", "batch_position", "item_id", "size_bytes")))
    return runs.where("status = 'completed'").join(tiles.groupBy(*ZONE).agg(listed.alias("tiles")), list(ZONE))


def tile_rows(tiles: DataFrame) -> DataFrame:
    """Of each zone a map from tile to its state."""
    rest = [c for c in tiles.columns if c not in TILE]
    return tiles.groupBy(*ZONE).agg(F.map_from_entries(F.collect_list(F.struct("item_id", F.struct(*rest)))).alias("tiles"))


def touched(old: DataFrame, changes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The old rows whose key is among the changes."""
    return old.join(changes.select(*keys), list(keys), "left_semi")


class Journal:
    """Tables as folders of changed rows, and a log of manifests: one commit changes all tables, and is seen as a whole or not at all.

    A commit writes the changed rows alone, with its number. A manifest lists the folders of every table and appears by a rename, which fails
    if another writer was first. Readers take the newest row of each key of the last manifest's folders. Beyond ``most`` folders a commit
    writes the whole table as one. Folders that neither the last manifest nor the one before it lists are removed.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], keys: dict[str, tuple[str, ...]], most: int = 16):
        self.spark, self.root, self.schemas, self.keys, self.most = spark, root.rstrip("/"), schemas, keys, most

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list[str]:
        path, files = self._path(name)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def manifest(self, back: int = 0) -> tuple[int, dict[str, list[str]]]:
        """(number, folders of each table) of the last commit, or of one before it; zero and none before the first."""
        names = [n for n in self._list("log") if n.endswith(".json")]
        if len(names) <= back:
            return 0, {t: [] for t in self.schemas}
        path, files = self._path(f"log/{names[-1 - back]}")
        with_stream = files.open(path)
        try:
            text = bytes(with_stream.readAllBytes()).decode()
        finally:
            with_stream.close()
        return int(names[-1 - back].split(".")[0]), json.loads(text)

    def _rows(self, table: str, folders: list[str]) -> DataFrame:
        schema = f"{self.schemas[table]}, _version bigint"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{table}/{f}" for f in folders))

    def read(self, table: str) -> DataFrame:
        """The table as of the last commit."""
        return self._newest(table, self.manifest()[1].get(table, []))

    def _newest(self, table: str, folders: list[str]) -> DataFrame:
        rows = self._rows(table, folders)
        if len(folders) > 1:
            newest = rows.groupBy(*self.keys[table]).agg(F.max_by(F.struct(*rows.columns), "_version").alias("_row"))
            rows = newest.select("_row.*")
        return rows.drop("_version")

    def commit(self, changes: dict[str, DataFrame]) -> int:
        """Writes the changed rows of tables, then the manifest that has them. An error if another writer committed meanwhile."""
        number, folders = self.manifest()
        folders = {t: list(folders.get(t, [])) for t in self.schemas}
        for table, rows in changes.items():
            name = f"{number + 1:010d}-{uuid.uuid4().hex}"
            columns = self.spark.createDataFrame([], self.schemas[table]).columns
            rows.select(*columns, F.lit(number + 1).cast("bigint").alias("_version")).write.parquet(f"{self.root}/{table}/{name}")
            folders[table].append(name)
            if len(folders[table]) > self.most:
                whole = f"{number + 1:010d}-{uuid.uuid4().hex}"
                self._newest(table, folders[table]).withColumn("_version", F.lit(number + 1).cast("bigint")).write.parquet(f"{self.root}/{table}/{whole}")
                folders[table] = [whole]
        self._publish(number + 1, folders)
        self._clean()
        return number + 1

    def _publish(self, number: int, folders: dict[str, list[str]]) -> None:
        jvm = self.spark._jvm
        draft, files = self._path(f"log/draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        target, _ = self._path(f"log/{number:010d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, target, none)
        except Exception as e:
            files.delete(draft, False)
            raise RuntimeError(f"another writer made commit {number}") from e

    def _clean(self) -> None:
        kept = {(t, f) for back in (0, 1) for t, found in self.manifest(back)[1].items() for f in found}
        first = min(self.manifest(1)[0] or 1, self.manifest()[0])
        for table in self.schemas:
            for name in self._list(table):
                if (table, name) not in kept and int(name.split("-")[0]) < first:
                    path, files = self._path(f"{table}/{name}")
                    files.delete(path, True)


class Snapshots:
    """Tables as folders of snapshots in a shared path; the last complete one is current. One writer at a time.

    A write is seen as a whole or not at all. The snapshot before the current one stays, for readers that began with it; older ones are removed.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas

    def _names(self, table: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in files.listStatus(path) if files.exists(s.getPath().suffix("/_SUCCESS"))) if files.exists(path) else []

    def read(self, table: str) -> DataFrame:
        """The current snapshot, an empty table before the first."""
        names = self._names(table)
        if not names:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(f"{self.root}/{table}/{names[-1]}")

    def write(self, table: str, df: DataFrame) -> DataFrame:
        """A new snapshot, named so that it sorts after all others."""
        names = self._names(table)
        number = int(names[-1].split("-")[1]) + 1 if names else 1
        df.write.parquet(f"{self.root}/{table}/snapshot-{number:010d}-{uuid.uuid4().hex}")
        for name in names[:-1]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return self.read(table)
