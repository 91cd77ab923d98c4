"""A tile catalog behind an address as a data source: a partition for each collection, whose task follows the links from page to page.

    spark.dataSource.register(CatalogSource)
    spark.read.format("tile_catalog").option("url", root).load()

Options: ``url``; ``collections``, names to read, separated by commas, instead of all that the catalog lists; ``box``, four numbers, keeps items whose box touches it;
``attempts`` and ``wait`` for a page that can't be read; ``prune``, where spark.sql.python.filterPushdown.enabled is set, lets conditions on ``collection_id`` leave collections out before any is asked for.
A page that stays unreadable is an error that names it, never fewer items.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .. import schemas

ITEM_SCHEMA = f"{schemas.TILES}, fetch_ordinal struct<page:int,at:int>"


def page_of(url: str, attempts: int = 4, wait: float = 0.5) -> dict:
    """One page as JSON. What the server or the network failed at is tried again after a growing wait; what it refuses isn't."""
    for k in range(attempts):
        try:
            with urllib.request.urlopen(url, timeout=60) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if k + 1 == attempts or (e.code < 500 and e.code != 429):
                raise RuntimeError(f"{url}: status {e.code}") from e
        except (OSError, ValueError) as e:
            if k + 1 == attempts:
                raise RuntimeError(f"{url}: {e}") from e
        time.sleep(wait * 2**k)
    raise ValueError("attempts must be positive")


def next_address(page: dict, url: str) -> str | None:
    """The address of the first link to a next page."""
    found = next((x["href"] for x in page.get("links") or [] if x.get("rel") == "next"), None)
    return found and urllib.parse.urljoin(url, found)


def collections_of(url: str, attempts: int = 4, wait: float = 0.5) -> list[dict]:
    """All collections, however many pages they take."""
    found, at = [], f"{url}/collections"
    while at:
        page = page_of(at, attempts, wait)
        found += page["collections"]
        at = next_address(page, at)
    return found


def item_row(item: dict, collection: str, page: int, at: int) -> tuple:
    asset = item["assets"]["data"]
    box = asset.get("proj:bbox") or item["properties"]["proj:bbox"]
    return item["id"], collection, asset["href"], int(asset["file:size"]), tuple(map(float, box)), (page, at)


class CollectionPart(InputPartition):
    def __init__(self, collection: str):
        self.collection = collection


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url = options["url"].rstrip("/")
        self.chosen = [c for c in options.get("collections", "").split(",") if c] or None
        self.box = [float(x) for x in options["box"].split(",")] if options.get("box") else None
        self.limit = int(options.get("limit", "1000"))
        self.attempts, self.wait = int(options.get("attempts", "4")), float(options.get("wait", "0.5"))

    def partitions(self) -> list[InputPartition]:
        names = self.chosen if self.chosen is not None else [c["id"] for c in collections_of(self.url, self.attempts, self.wait)]
        return [CollectionPart(c) for c in names]

    def read(self, partition: CollectionPart):
        if partition is None:  # no collection is left
            return
        url, number = f"{self.url}/collections/{urllib.parse.quote(partition.collection)}/items?limit={self.limit}", 0
        while url:
            page = page_of(url, self.attempts, self.wait)
            for at, item in enumerate(page.get("features") or []):
                row = item_row(item, partition.collection, number, at)
                b = row[4]
                if self.box is None or (b[0] <= self.box[2] and self.box[0] <= b[2] and b[1] <= self.box[3] and self.box[1] <= b[3]):
                    yield row
            url, number = next_address(page, url), number + 1


class PruningReader(CatalogReader):
    """Leaves out collections by conditions; Spark refuses such a reader where pushing conditions down isn't enabled."""

    def pushFilters(self, filters):
        for f in filters:
            named = isinstance(f, EqualTo | In) and f.attribute == ("collection_id",)
            if named:
                wanted = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.chosen = [c for c in wanted if self.chosen is None or c in self.chosen]
            else:
                yield f


class CatalogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tile_catalog"

    def schema(self) -> str:
        return ITEM_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PruningReader if self.options.get("prune") == "true" else CatalogReader)(self.options)


def items(spark: SparkSession, url: str, box: tuple[float, float, float, float] | None = None, **options: str) -> DataFrame:
    """The catalog's tiles as ``plans.pipeline`` takes them."""
    spark.dataSource.register(CatalogSource)
    prune = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()
    reader = spark.read.format("tile_catalog").option("url", url).option("prune", prune).options(**options)
    return (reader if box is None else reader.option("box", ",".join(map(repr, map(float, box))))).load()


def collections(spark: SparkSession, url: str) -> DataFrame:
    """(collection_id, box): the first box of each collection, in degrees."""
    rows = [(c["id"], [float(x) for x in c["extent"]["spatial"]["bbox"][0]]) for c in collections_of(url.rstrip("/"))]
    return spark.createDataFrame(rows, "collection_id string, box array<double>")
