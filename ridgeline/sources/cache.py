"""Tiles fetched by the tasks that decode them, through a cache folder. Attempts of one task may run side by side: each has files of its own and commits by a rename."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from .remote import tile_bytes
from .tables import TILE_PIXELS, decode_geotiff, pixel_batches


def _each(run_one, folder: str, user: str, password: str, keep: bool, attempts: int, wait: float, mbps: float | None):
    def run(batches):
        for batch in batches:
            for item, href, size in zip(*(batch[c].to_pylist() for c in ("item_id", "href", "size_bytes")), strict=True):
                content = tile_bytes(href, size, folder, user, password, decode_geotiff, keep, attempts, wait, mbps)
                yield from run_one(item, content)

    return run


def fetched_files(folder: str, user: str, password: str, keep: bool = False, parts: int = 64, attempts: int = 4, wait: float = 0.5, mbps: float | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function from tiles (item_id, href, size_bytes) to their files (tile, content).

    Each task downloads its tiles one after another into ``folder``, a path that it can write; a file of the right size that is there
    already and can be decoded is taken. A download that breaks off or can't be decoded is begun again after a growing wait, ``attempts`` times in all, and is an error then.
    ``mbps`` is a rate for all tasks together: each keeps to its share. Files stay if ``keep`` is set; without it the folder holds one file for each running task.
    """

    def one(item, content):
        yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([content], pa.binary())], ["tile", "content"])

    run = _each(one, folder, user, password, keep, attempts, wait, mbps and mbps / parts)
    return lambda tiles: tiles.select("item_id", "href", "size_bytes").distinct().repartition(parts).mapInArrow(run, "tile string, content binary")


def fetched(folder: str, user: str, password: str, keep: bool = False, parts: int = 64, attempts: int = 2, wait: float = 0.0, mbps: float | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function from tiles (item_id, href, size_bytes) to their pixels, with the item as ``tile``; see ``fetched_files``."""

    def one(item, content):
        yield from pixel_batches(item, *decode_geotiff(content))

    run = _each(one, folder, user, password, keep, attempts, wait, mbps and mbps / parts)
    return lambda tiles: tiles.select("item_id", "href", "size_bytes").distinct().repartition(parts).mapInArrow(run, TILE_PIXELS)
