"""Zones of a GeoPackage as a data source: ranges of row ids are partitions, blobs become nested arrays in the tasks.

The file has to be readable by all executors under its path. The layer's reference system decides: grid coordinates are taken as they are, degrees are projected
by built-in expressions, any other is an error. Curves and collections are errors, Z and M are left out.
"""

from __future__ import annotations

import sqlite3
import struct
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas
from ..functions.projection import easting, northing

#: Codes of the reference systems that are read, and of the shapes.
GRID, DEGREES = 3006, 4326
POLYGON, MULTIPOLYGON = 3, 6
#: Doubles in the envelope of a blob's header by its flag.
ENVELOPES = {0: 0, 1: 4, 2: 6, 3: 6, 4: 8}
COLUMNS = "tatort string, kommunnamn string, tatortskod string, bef bigint"
ROW_SCHEMA = f"src_ordinal bigint, {COLUMNS}, geometry {schemas.GEOMETRY}"


def _rings(data: bytes, at: int, order: str, size: int) -> tuple[list, int]:
    rings = []
    (count,) = struct.unpack_from(f"{order}I", data, at)
    at += 4
    for _ in range(count):
        (n,) = struct.unpack_from(f"{order}I", data, at)
        found = struct.unpack_from(f"{order}{n * size}d", data, at + 4)
        rings.append([(found[k], found[k + 1]) for k in range(0, n * size, size)])
        at += 4 + 8 * n * size
    return rings, at


def _shape(data: bytes, at: int) -> tuple[int, int, str, int]:
    """(kind, doubles of a point, byte order, where its content begins) of a shape, in the plain or the extended numbering."""
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(f"{order}I", data, at + 1)
    at += 5
    size, kind = 2 + bool(code & 0x80000000) + bool(code & 0x40000000), code & 0x1FFFFFFF
    if code & 0x20000000:
        at += 4
    if kind >= 1000:
        size, kind = size + (2 if kind >= 3000 else 1), kind % 1000
    return kind, size, order, at


def polygons(wkb: bytes, at: int = 0) -> list:
    """The polygons of a shape as lists of rings of points."""
    kind, size, order, at = _shape(wkb, at)
    if kind == POLYGON:
        rings, _ = _rings(wkb, at, order, size)
        return [rings] if rings else []
    if kind != MULTIPOLYGON:
        raise ValueError(f"shapes of kind {kind} aren't zones")
    (count,) = struct.unpack_from(f"{order}I", wkb, at)
    at, out = at + 4, []
    for _ in range(count):
        part, size, inner, at = _shape(wkb, at)
        if part != POLYGON:
            raise ValueError(f"a part of kind {part} isn't a polygon")
        rings, at = _rings(wkb, at, inner, size)
        if rings:
            out.append(rings)
    return out


def geometry_of(blob: bytes | None) -> tuple[int | None, list | None]:
    """(reference system, polygons) of a stored blob; an empty shape has no polygon."""
    if blob is None:
        return None, None
    if blob[:2] != b"GP" or len(blob) < 8:
        raise ValueError("not a GeoPackage shape")
    flags = blob[3]
    (system,) = struct.unpack_from("<i" if flags & 1 else ">i", blob, 4)
    envelope = ENVELOPES.get(flags >> 1 & 7)
    if envelope is None:
        raise ValueError(f"a shape's header has the envelope {flags >> 1 & 7}")
    try:
        return system, [] if flags >> 4 & 1 else polygons(blob, 8 + 8 * envelope)
    except (struct.error, IndexError) as e:
        raise ValueError(f"a shape is cut short: {e}") from e


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro&immutable=1", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def layer_of(path: str, layer: str | None) -> tuple[str, str, int]:
    """(table, geometry column, reference system) of a layer, the only one if none is named."""
    with closing(_open(path)) as db:
        found = db.execute("SELECT g.table_name, g.column_name, s.organization, s.organization_coordsys_id FROM gpkg_geometry_columns g JOIN gpkg_spatial_ref_sys s USING (srs_id)").fetchall()
    named = [r for r in found if layer is None or r[0] == layer]
    if len(named) != 1:
        raise ValueError(f"expected one layer{'' if layer is None else f' {layer}'}, found {', '.join(sorted(r[0] for r in found)) or 'none'}")
    table, column, organization, system = named[0]
    if str(organization).upper() != "EPSG" or system not in (GRID, DEGREES):
        raise ValueError(f"the layer {table} has the reference system {organization}:{system}")
    return table, column, system


class RowRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class GeoPackageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.rows = options["path"], int(options.get("rows", "10000"))
        self.table, self.column, _ = layer_of(self.path, options.get("layer"))

    def partitions(self) -> list[InputPartition]:
        with closing(_open(self.path)) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        return [] if low is None else [RowRange(k, min(k + self.rows - 1, high)) for k in range(low, high + 1, self.rows)]

    def read(self, partition: RowRange):
        if partition is None:  # an empty layer
            return
        names = ", ".join(_quoted(c.split()[0]) for c in COLUMNS.split(", "))
        with closing(_open(self.path)) as db:
            for row in db.execute(f"SELECT rowid, {names}, {_quoted(self.column)} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last)):
                shape = geometry_of(row[-1])[1]
                yield (*row[:4], None if row[4] is None else int(row[4]), shape)


class GeoPackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zone_package"

    def schema(self) -> str:
        return ROW_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GeoPackageReader(self.options)


def zones(spark: SparkSession, path: str, layer: str | None = None, rows: int = 10_000) -> DataFrame:
    """Zones of a layer in grid coordinates; ``src_ordinal`` is the row id."""
    _, _, system = layer_of(path, layer)
    spark.dataSource.register(GeoPackageSource)
    reader = spark.read.format("zone_package").option("rows", rows)
    read = (reader if layer is None else reader.option("layer", layer)).load(path)
    if system == GRID:
        return read
    point = lambda p: F.struct(easting(p["x"], p["y"]).alias("x"), northing(p["x"], p["y"]).alias("y"))
    return read.withColumn("geometry", F.transform("geometry", lambda rings: F.transform(rings, lambda ring: F.transform(ring, point))))
