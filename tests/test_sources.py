"""Sources, sinks, state, streaming and the whole pipeline."""

import io
import struct
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import schemas
from ridgeline.operators import state
from ridgeline.plans import pipeline
from ridgeline.sources import cache, remote, tables
from ridgeline.streaming import incremental


def geotiff(values, x0, y0, res=1.0, nodata="-9999"):
    """A little uncompressed raster."""
    body = values.astype("<f4").tobytes()
    scale, tie, miss = struct.pack("<3d", res, res, 0), struct.pack("<6d", 0, 0, 0, x0, y0, 0), nodata.encode() + b"\0"
    data_at = 8
    extra = data_at + len(body)
    tags = [(256, 4, 1, values.shape[1]), (257, 4, 1, values.shape[0]), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 1, data_at), (278, 4, 1, values.shape[0]), (279, 4, 1, len(body)), (339, 3, 1, 3)]
    tags += [(33550, 12, 3, extra), (33922, 12, 6, extra + 24), (42113, 2, len(miss), extra + 72)]
    directory = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    at = extra + 72 + len(miss)
    return b"II*\0" + struct.pack("<I", at) + body + scale + tie + miss + directory


def test_rasters(spark, tmp_path):
    values = np.arange(12.0).reshape(3, 4)
    (tmp_path / "a.tif").write_bytes(geotiff(values, 100, 200, 2.0))
    (tmp_path / "b.txt").write_text("no raster")
    rows = tables.rasters(spark, f"file://{tmp_path}").orderBy("row", "col").collect()
    assert [r.v for r in rows] == list(range(12))
    assert (rows[0].x, rows[0].y, rows[-1].x, rows[-1].y, rows[0].nodata, rows[0].res_x) == (101.0, 199.0, 107.0, 195.0, -9999.0, 2.0)


def summary(spark):
    point = "struct<x:double,y:double>"
    schema = (
        "tatort string, kommun string, tatortskod string, collections string, batches long, total_raw_size_mb double, tiles_scanned long, tiles_used long, min_altitude_m double, "
        f"max_altitude_m double, min_coord {point}, max_coord {point}, altitude_range_m double, relief_q05_m double, relief_q95_m double, normalized_relief double, rms_slope_deg double, hilliness_score double"
    )
    row = ("Aby", "Aby", "0001", "c-1", 1, 98.19, 12, 12, 5.0, 86.0, (385000.0, 6175000.0), (386000.0, 6176000.0), 81.0, 10.0, 75.0, 12.3456, 4.321, 53.348)
    return spark.createDataFrame([row], schema)


def test_results_file(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    tables.write_results(summary(spark), path)
    row = spark.read.csv(path, header=True).first()
    assert row.__fields__ == [c for c, _ in tables.RESULT_FIELDS]
    assert (row["rank"], row.min_altitude_m, row.max_altitude_m, row.hilliness_score) == ("1", "5.00", "86.00", "53.3480")
    assert row.min_coord_lat_lon.startswith("(") and row.max_coord_lat_lon.startswith("(")
    assert tables.results(spark, path).first()["hilliness_score"] == 53.348
    assert tables.top(summary(spark), 5).count() == 1


def test_state_round_trip(spark, tmp_path):
    store = state.Snapshots(spark, f"file://{tmp_path}", {"runs": schemas.RUNS, "tiles": schemas.TILE_STATE})
    assert store.read("runs").isEmpty()
    plan = spark.createDataFrame([("Aby", "Aby", "c", ["x"], 1, 1, 123)], "tatort string, kommun string, tatortskod string, collections array<string>, planned_batches long, planned_tiles long, total_raw_size_bytes long")
    runs = store.write("runs", state.register_runs(store.read("runs"), plan))
    runs = store.write("runs", state.store_summaries(runs, summary(spark).drop("collections", "tatortskod")))
    again = store.write("runs", state.register_runs(runs, plan.withColumn("planned_batches", F.lit(2).cast("long")))).first()
    assert (again.status, again.planned_batches, again.min_coord_x, again.hilliness_score) == ("completed", 2, 385000.0, 53.348)
    missing = state.store_summaries(store.read("runs"), summary(spark).drop("collections", "tatortskod").withColumn("kommun", F.lit("other")))
    assert missing.count() == 1
    tiles = spark.createDataFrame([("Aby", "Aby", "t1", 123, 1, 1)], "tatort string, kommun string, item_id string, size_bytes long, batch_index int, batch_position int")
    stored = store.write("tiles", state.register_tiles(store.read("tiles"), tiles))
    stored = store.write("tiles", state.mark_downloaded(stored, tiles))
    assert stored.first().download_status == "downloaded"
    assert state.tile_rows(stored).first().tiles["t1"].size_bytes == 123
    assert state.completed_summary(store.read("runs"), stored).first().tiles[0].item_id == "t1"


class Reply(io.BytesIO):
    def __init__(self, status, body=b"x", length="1"):
        super().__init__(body)
        self.status, self.headers = status, {"Content-Length": length}


def test_remote(monkeypatch, tmp_path):
    monkeypatch.setenv("A_USER", "u")
    monkeypatch.delenv("A_PASSWORD", raising=False)
    with pytest.raises(RuntimeError, match="Missing required environment variable.*A_PASSWORD"):
        remote.credentials("A_USER", "A_PASSWORD")
    monkeypatch.setenv("A_PASSWORD", "p")
    assert remote.credentials("A_USER", "A_PASSWORD") == ("u", "p")
    assert remote.probe("http://x/a.tif", "u", "p", lambda *_, **__: Reply(206)) == (206, 1)

    def refuse(*_, **__):
        raise urllib.error.HTTPError("http://x", 401, "no", {}, None)

    with pytest.raises(RuntimeError, match="status 401"):
        remote.probe("http://x/a.tif", "u", "p", refuse)
    with pytest.raises(RuntimeError, match="instead of 5"):
        remote.download("http://x/a.tif?k=1", 5, str(tmp_path), "u", "p", lambda *_: Reply(200))
    assert not list(tmp_path.iterdir())
    assert remote.download("http://x/a.tif?k=1", 1, str(tmp_path), "u", "p", lambda *_: Reply(200)).name == "a.tif"
    replies = iter([Reply(200, b'{"n": 1, "links": [{"rel": "self", "href": "s"}, {"rel": "next", "href": "http://y"}]}'), Reply(200, b'{"n": 2, "links": []}')])
    assert [p["n"] for p in remote.pages("http://x", lambda _: next(replies))] == [1, 2]


def test_catalog(spark, tmp_path):
    folder = tmp_path / "pages" / "collection_id=c1"
    folder.mkdir(parents=True)
    (folder / "1.json").write_text(
        '{"features": [{"id": "a", "assets": {"data": {"href": "h/a.tif", "file:size": 5, "proj:bbox": [1, 2, 3, 4]}}, "properties": {"proj:bbox": [9, 9, 9, 9]}},'
        '{"id": "b", "assets": {"data": {"href": "h/b.tif", "file:size": 6, "proj:bbox": []}}, "properties": {"proj:bbox": [5, 6, 7, 8]}}], "links": [{"rel": "next", "href": "n"}]}'
    )
    a, b = tables.items(spark, f"file://{tmp_path}/pages").orderBy("item_id").collect()
    assert (a.collection_id, a.size_bytes, a.bbox_3006.minx, b.bbox_3006.minx, b.bbox_3006.maxy) == ("c1", 5, 1.0, 5.0, 8.0)
    (tmp_path / "c.json").write_text('{"collections": [{"id": "c1", "extent": {"spatial": {"bbox": [[13.0, 55.0, 14.0, 56.0]]}}}]}')
    assert len(tables.collections(spark, f"file://{tmp_path}/c.json").first().ring) == 4


def square(x0, y0, side):
    return [[[{"x": float(x0 + x), "y": float(y0 + y)} for x, y in ((0, 0), (side, 0), (side, side), (0, side))]]]


def test_compare_and_resume(spark, tmp_path):
    rng = np.random.default_rng(0)
    values = rng.normal(size=(20, 20)) * 3 + 50
    (tmp_path / "t1.tif").write_bytes(geotiff(values, 0, 20))
    pixels = tables.rasters(spark, f"file://{tmp_path}").withColumn("tile", F.lit("t1"))
    zones = spark.createDataFrame([(0, "A", "K", "01", 100, square(2, 2, 10)), (1, "B", "K", "02", 50, square(5, 5, 8))], schemas.ZONES)
    tiles = spark.createDataFrame([("t1", "c", "h/t1.tif", 1000, (0.0, 0.0, 20.0, 20.0), 0)], f"{schemas.TILES}, fetch_ordinal int")
    first = pipeline.compare(spark, zones, tiles, pixels, f"file://{tmp_path}/state").collect()
    assert len(first) == 2 and {r["rank"] for r in first} == {"1", "2"}
    a = next(r for r in first if r.tatort == "A")
    part = values[8:18, 2:12]
    assert (a.min_altitude_m, a.max_altitude_m) == (f"{part.astype('f4').min():.2f}", f"{part.astype('f4').max():.2f}")
    gy, gx = np.gradient(part.astype("f4").astype(float), 1.0, 1.0)
    assert abs(float(a.rms_slope_deg) - np.sqrt((np.degrees(np.arctan(np.hypot(gx, gy))) ** 2).mean())) < 1e-3
    again = pipeline.compare(spark, zones, tiles, pixels.where("false"), f"file://{tmp_path}/state").collect()
    assert sorted(again) == sorted(first)
    cells = pipeline.zone_pixels(zones, pipeline.plan(zones, tiles), pixels)
    options = pipeline.Options(bins=6)
    found = pipeline.profiles(zones, cells, options)
    tables.write_profiles(found.withColumn("rank", F.lit(None).cast("int")), f"file://{tmp_path}/profiles")
    back = tables.profiles(spark, f"file://{tmp_path}/profiles", 6).collect()
    assert len(back) == 2 and all(len(r.p50) == 6 and r.y_min <= r.y_max for r in back)


def test_compare_goes_on_by_tile(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    (tmp_path / "cdn").mkdir()
    rows, zones = [], spark.createDataFrame([(0, "A", "K", "01", 100, square(1, 1, 38)), (1, "B", "K", "02", 50, square(100, 100, 5))], schemas.ZONES)
    for k, (x, y) in enumerate([(0, 0), (20, 0), (0, 20), (20, 20), (95, 95)]):
        values = np.full((20, 20), -9999.0) if k in (2, 4) else rng.normal(size=(20, 20)) * 3 + 50
        data = geotiff(values, x, y + 20)
        (tmp_path / "cdn" / f"t{k}.tif").write_bytes(data)
        rows.append((f"t{k}", "c", f"file://{tmp_path}/cdn/t{k}.tif", len(data), (float(x), float(y), x + 20.0, y + 20.0), k))
    tiles = spark.createDataFrame(rows, f"{schemas.TILES}, fetch_ordinal int")
    options = pipeline.Options(nodata=-9999.0, cache_budget_mb=1)
    monkeypatch.setattr(pipeline.planning, "MIB", rows[0][3] * 2)  # two tiles to a batch
    fetch = cache.fetched(f"{tmp_path}/cache", "u", "p", parts=2)
    whole = pipeline.compare(spark, zones, tiles, fetch, f"file://{tmp_path}/whole", options).collect()
    assert [(r.tatort, r.tiles_scanned, r.tiles_used, r.batches) for r in whole] == [("A", "4", "3", "2")]
    assert not list((tmp_path / "cache").iterdir())  # files are removed as they are decoded
    failed = spark.read.parquet(*sorted(str(p) for p in (tmp_path / "whole" / "runs").iterdir())[-1:]).where("tatort = 'B'").first()
    assert (failed.status, failed.error_message) == ("failed", "no valid pixels")
    # the second batch breaks off: its tiles are missing
    hidden = [tmp_path / "cdn" / f"t{k}.tif" for k in (2, 3)]
    for p in hidden:
        p.rename(p.with_suffix(".gone"))
    with pytest.raises(Exception):
        pipeline.compare(spark, zones, tiles, fetch, f"file://{tmp_path}/broken", options)
    planned = pipeline.plan(zones, tiles, options)
    seen = pipeline.preview(spark, planned, f"file://{tmp_path}/broken", options).first()
    assert (seen.zones, seen.n_tiles, seen.tiles_pending, seen.tiles_done) == (2, 5, 2, 3)
    for p in hidden:
        p.with_suffix(".gone").rename(p)
    for k in (0, 1):
        (tmp_path / "cdn" / f"t{k}.tif").unlink()  # finished tiles aren't asked for again, nor is the catalog
    again = pipeline.compare(spark, zones, tiles.where("false"), fetch, f"file://{tmp_path}/broken", options).collect()
    assert again == whole


def test_a_corrupt_tile_is_fetched_once_more(spark, tmp_path):
    data = geotiff(np.ones((4, 4)), 0, 4)
    (tmp_path / "cdn").mkdir()
    (tmp_path / "cache").mkdir()
    (tmp_path / "cdn" / "a.tif").write_bytes(data)
    (tmp_path / "cache" / "a.tif").write_bytes(b"x" * len(data))
    tiles = spark.createDataFrame([("a", f"file://{tmp_path}/cdn/a.tif", len(data))], "item_id string, href string, size_bytes long")
    assert cache.fetched(f"{tmp_path}/cache", "u", "p", keep=True)(tiles).agg(F.sum("v")).first()[0] == 16
    assert (tmp_path / "cache" / "a.tif").read_bytes() == data
    assert tables.folder_bytes(spark, f"file://{tmp_path}/cache") == len(data)
    (tmp_path / "cdn" / "a.tif").write_bytes(b"y" * len(data))
    (tmp_path / "cache" / "a.tif").unlink()
    with pytest.raises(Exception):
        cache.fetched(f"{tmp_path}/cache", "u", "p")(tiles).collect()
    with pytest.raises(ValueError, match="no "):
        (tmp_path / "none").mkdir()
        tables.rasters(spark, f"file://{tmp_path}/none")


def test_stream_appends_only_new_files(spark, tmp_path):
    rows = [("A", "K", f"t{t}", 1, t, r, 0, float(r), float(t), float(10 * t + r), 1.0) for t in (1, 2) for r in range(5)]
    df = spark.createDataFrame(rows, incremental.PIXELS)
    source, target, log = (f"file://{tmp_path}/{x}" for x in ("in", "out", "log"))
    df.where("tile = 't1'").coalesce(1).write.parquet(source)
    incremental.append_partials(spark, source, target, log)
    df.where("tile = 't2'").coalesce(1).write.mode("append").parquet(source)
    incremental.append_partials(spark, source, target, log)
    r = incremental.merged(spark, target).first()
    assert (r.n_values, r.tiles_used, r.min_altitude_m, r.max_altitude_m) == (10, 2, 10.0, 24.0)
