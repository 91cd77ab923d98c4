"""The catalog and GeoPackage sources."""

import json
import sqlite3
import struct
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import projection
from ridgeline.operators import geometry
from ridgeline.plans import pipeline
from ridgeline.sources import catalog, geopackage


class Pages(BaseHTTPRequestHandler):
    """Three collections of pages of two items; an address fails as often as ``broken`` says."""

    broken: dict[str, int] = {}
    asked: list[str] = []

    def do_GET(self):
        url = urllib.parse.urlparse(self.path)
        Pages.asked.append(url.path)
        if self.broken.get(self.path, 0):
            self.broken[self.path] -= 1
            self.send_error(503)
            return
        query, parts = urllib.parse.parse_qs(url.query), url.path.strip("/").split("/")
        if parts == ["collections"]:
            body = {"collections": [{"id": f"c{k}", "extent": {"spatial": {"bbox": [[13.0 + k, 55.0, 14.0 + k, 56.0]]}}} for k in range(3)]}
        else:
            c, page = int(parts[1][1:]), int(query.get("page", ["0"])[0])
            if c == 2:
                body = {"features": [], "links": []}
            else:
                box = lambda k: [10.0 * k, 100.0 * c, 10.0 * k + 9, 100.0 * c + 9]
                own = lambda k: {"data": {"href": f"h/{c}-{k}.tif", "file:size": 10 + k, **({"proj:bbox": box(k)} if k % 2 else {})}}
                body = {"features": [{"id": f"{c}-{k}", "assets": own(k), "properties": {"proj:bbox": box(k)}} for k in (2 * page, 2 * page + 1)]}
                body["links"] = [{"rel": "self", "href": "x"}] + ([{"rel": "next", "href": f"/collections/c{c}/items?page={page + 1}"}] if page < 3 + c else [])
        data = json.dumps(body).encode()
        if self.broken.get(url.path, 0):  # breaks off
            data = data[: len(data) // 2]
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    own = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    Pages.broken, Pages.asked = {}, []
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_address[1]}"
    own.shutdown()


def test_catalog_pages_are_read_by_collection(spark, server):
    rows = catalog.items(spark, server, wait="0.01")
    assert rows.rdd.getNumPartitions() == 3
    found = sorted(rows.collect(), key=lambda r: (r.collection_id, r.fetch_ordinal))
    assert [r.item_id for r in found] == [f"0-{k}" for k in range(8)] + [f"1-{k}" for k in range(10)]
    assert (found[9].href, found[9].size_bytes, found[9].bbox_3006.minx, found[9].bbox_3006.maxy) == ("h/1-1.tif", 11, 10.0, 109.0)
    assert sorted(r.item_id for r in catalog.items(spark, server, (15, 0, 25, 5)).collect()) == ["0-1", "0-2"]
    assert [tuple(r) for r in catalog.collections(spark, server).collect()][1] == ("c1", [14.0, 55.0, 15.0, 56.0])


def test_catalog_conditions_leave_collections_out(spark, server):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        Pages.asked = []
        assert catalog.items(spark, server).where("collection_id = 'c1'").count() == 10
        assert "/collections/c0/items" not in Pages.asked
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert catalog.items(spark, server, collections="c0,c2").count() == 8


def test_a_broken_page_is_tried_again_and_then_an_error(spark, server):
    Pages.broken = {"/collections/c0/items?page=2": 2}
    assert catalog.items(spark, server, wait="0.01").count() == 18
    Pages.broken = {"/collections/c0/items?page=2": 99}
    with pytest.raises(Exception, match=r"page=2: status 503"):
        catalog.items(spark, server, wait="0.01").collect()
    Pages.broken = {"/collections/c1/items": 99}  # half a page each time
    with pytest.raises(Exception, match="/collections/c1/items"):
        catalog.items(spark, server, wait="0.01", attempts="2").collect()


def wkb(shape, order="<", code=6, size=2):
    """A multipolygon, or a polygon if ``code`` says so, by hand."""
    mark = b"\1" if order == "<" else b"\0"
    extra = (7.0,) * (size - 2)

    def rings(polygon):
        return struct.pack(f"{order}I", len(polygon)) + b"".join(struct.pack(f"{order}I{len(r) * size}d", len(r), *(v for p in r for v in (*p, *extra))) for r in polygon)

    kind = {2: 3, 3: 1003, 4: 3003}[size]
    if code == 3:
        return mark + struct.pack(f"{order}I", kind) + rings(shape[0])
    return mark + struct.pack(f"{order}II", kind + 3, len(shape)) + b"".join(mark + struct.pack(f"{order}I", kind) + rings(p) for p in shape)


def blob(shape, order="<", envelope=0, empty=False, **more):
    flags = (order == "<") | envelope << 1 | empty << 4
    return b"GP\0" + bytes([flags]) + struct.pack(f"{order}i", 3006) + bytes(8 * geopackage.ENVELOPES[envelope]) + wkb(shape, order, **more)


HOLED = [[[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)], [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 3.0)]], [[(20.0, 20.0), (25.0, 20.0), (20.0, 25.0), (20.0, 20.0)]]]


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("size", [2, 3, 4])
@pytest.mark.parametrize("envelope", [0, 1, 4])
def test_blobs(order, size, envelope):
    assert geopackage.geometry_of(blob(HOLED, order, envelope, size=size)) == (3006, HOLED)
    assert geopackage.geometry_of(blob(HOLED, order, envelope, size=size, code=3)) == (3006, HOLED[:1])
    assert geopackage.geometry_of(blob([], order, envelope, empty=True)) == (3006, [])
    assert geopackage.geometry_of(blob([], order, envelope)) == (3006, [])
    assert geopackage.geometry_of(None) == (None, None)


def test_bad_blobs():
    whole = blob(HOLED)
    for data, fault in ((b"XX" + whole[2:], "not a GeoPackage"), (whole[:40], "cut short"), (whole[:9] + struct.pack("<I", 1) + whole[13:], "kind 1"), (whole[:3] + bytes([5 << 1 | 1]) + whole[4:], "envelope 5")):
        with pytest.raises(ValueError, match=fault):
            geopackage.geometry_of(data)


def package(path, rows, system=3006, layers=("zones",)):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_id INTEGER, organization TEXT, organization_coordsys_id INTEGER)")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INTEGER)")
    db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (7, 'EPSG', ?)", (system,))
    for layer in layers:
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 7)", (layer,))
        db.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB, tatort TEXT, kommunnamn TEXT, tatortskod TEXT, bef REAL)')
        db.executemany(f'INSERT INTO "{layer}" (fid, geom, tatort, kommunnamn, tatortskod, bef) VALUES (?, ?, ?, ?, ?, ?)', rows)
    db.commit()
    db.close()
    return str(path)


def test_zones_of_a_package(spark, tmp_path):
    rows = [(k, blob(HOLED, "<>"[k % 2]) if k % 5 else None if k % 2 else blob([], empty=True), f"T{k}", "K", f"{k:04}", k if k % 3 else None) for k in range(1, 60, 2)]
    path = package(tmp_path / "a.gpkg", rows)
    read = geopackage.zones(spark, path, rows=7)
    assert read.rdd.getNumPartitions() == 9
    found = {r.src_ordinal: r for r in read.withColumn("a", geometry.area(F.col("geometry"))).collect()}
    assert len(found) == len(rows) and (found[1].tatort, found[1].bef, found[3].bef) == ("T1", 1, None)
    assert found[1].a == 81 - 4.5 + 12.5 and found[5].geometry is None
    with pytest.raises(ValueError, match="expected one layer nope, found zones"):
        geopackage.zones(spark, path, "nope")
    with pytest.raises(ValueError, match="reference system EPSG:3857"):
        geopackage.zones(spark, package(tmp_path / "b.gpkg", rows, 3857))
    with pytest.raises(ValueError, match="expected one layer, found x, y"):
        geopackage.zones(spark, package(tmp_path / "c.gpkg", rows, layers=("x", "y")))
    assert geopackage.zones(spark, package(tmp_path / "d.gpkg", [])).count() == 0


def test_degrees_are_projected(spark, tmp_path):
    at = (15.0, 58.0)
    path = package(tmp_path / "a.gpkg", [(1, blob([[[at, (15.1, 58.0), (15.1, 58.1), at]]]), "T", "K", "1", 5)], 4326)
    p = geopackage.zones(spark, path).first().geometry[0][0][0]
    want = spark.range(1).select(projection.easting(F.lit(at[0]), F.lit(at[1])).alias("x"), projection.northing(F.lit(at[0]), F.lit(at[1])).alias("y")).first()
    assert (p.x, p.y) == (want.x, want.y) and abs(p.x - 500_000) < 1


def test_a_comparison_from_a_package_and_a_catalog(spark, tmp_path, server):
    import numpy as np

    from ridgeline.sources import geotiff, tables

    square = lambda x, y, s: [[[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]]
    path = package(tmp_path / "a.gpkg", [(1, blob(square(2.0, 1.0, 6.0)), "A", "K", "1", 5), (2, blob(square(12.0, 101.0, 6.0), ">"), "B", "K", "2", 5)])
    (tmp_path / "tiles").mkdir()
    for c in (0, 1):
        for k in range(10):
            values = np.random.default_rng(k).normal(size=(9, 9)) + 20
            (tmp_path / "tiles" / f"{c}-{k}.tif").write_bytes(geotiff.encode(values, 10.0 * k, 100.0 * c + 9, 1.0, 1.0))
    rows = pipeline.compare(spark, geopackage.zones(spark, path), catalog.items(spark, server), tables.raster_source(spark, f"file://{tmp_path}/tiles"), f"file://{tmp_path}/state").collect()
    assert {(r.tatort, r.collections, r.tiles_used) for r in rows} == {("A", "c0", "1"), ("B", "c1", "1")}
