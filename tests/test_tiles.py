"""The tile kernel, raster files, the log of changes and what a comparison does with lost, missing and dear tiles."""

import struct
import threading
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import schemas
from ridgeline.operators import geometry, kernel, planning, state, zonal
from ridgeline.plans import pipeline
from ridgeline.sources import cache, geotiff, remote, tables


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def square(x0, y0, side):
    return [[ring((x0 + x, y0 + y) for x, y in ((0, 0), (side, 0), (side, side), (0, side)))]]


ODD = [
    [ring([(3.2, 2.1), (27.5, 5.5), (24.0, 28.7), (12.3, 18.0), (4.4, 27.0)]), ring([(10, 8), (15, 8.5), (14, 13), (10, 13)])],
    [ring([(30.5, 30.5), (38, 31), (34, 39.5)])],
]


def raster(seed=0, holes=True):
    v = np.random.default_rng(seed).normal(size=(40, 40)) * 3 + 50
    if holes:
        v[::7, ::5] = -9999.0
        v[3, 4] = np.nan
    return v


def edges_of(spark, shape):
    row = spark.createDataFrame([(shape,)], f"g {schemas.GEOMETRY}").select(geometry.edges(F.col("g")).alias("e")).first()
    return np.array([[e.x1, e.y1, e.x2, e.y2] for e in row.e])


def test_fill_decides_as_contains(spark):
    edges = edges_of(spark, ODD)
    x, y = np.arange(40) + 0.5, 40 - (np.arange(40) + 0.5)
    got = kernel.filled(edges, x, y)
    for j, py in enumerate(y):
        for i, px in enumerate(x):
            met = [(y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in edges]
            assert got[j, i] == (sum(met) % 2 == 1)


@pytest.mark.parametrize("nodata", [None, -9999.0])
def test_kernel_equals_pixel_tables(spark, tmp_path, nodata):
    for k, at in enumerate([(0, 40), (20, 60)]):
        (tmp_path / f"t{k}.tif").write_bytes(geotiff.encode(np.where(raster(k) == -9999.0, np.nan if nodata is None else -9999.0, raster(k)), *at, 1.0, 1.0, nodata))
    zones = spark.createDataFrame([(0, "A", "K", "01", 1, ODD), (1, "B", "K", "02", 1, square(15, 21, 30))], schemas.ZONES)
    boxes = [("t0", "c", "h/t0.tif", 1, (0.0, 0.0, 40.0, 40.0), 0), ("t1", "c", "h/t1.tif", 1, (20.0, 20.0, 60.0, 60.0), 1)]
    planned = pipeline.plan(zones, spark.createDataFrame(boxes, f"{schemas.TILES}, fetch_ordinal int"))
    pixels = tables.rasters(spark, f"file://{tmp_path}").withColumn("tile", F.regexp_extract("tile", r"(t\d)", 1))
    cells = pipeline.zone_pixels(zones, planned, pixels, pipeline.Options(nodata=nodata)).cache()
    want = zonal.tile_partials(cells, "tatort", "kommun", "tile", empty=True).withColumnRenamed("tile", "item_id")
    found = kernel.zone_tiles(pipeline.zone_files(zones, planned, tables.raster_files(spark, f"file://{tmp_path}")), nodata).cache()
    got = {(r.tatort, r.item_id): r for r in kernel.partials(found).collect()}
    assert len(got) == 4
    for r in want.collect():
        own = got[r.tatort, r.item_id]
        assert (own.n_values, own.slope_count, own.min_coord, own.max_coord) == (r.n_values, r.slope_count, r.min_coord, r.max_coord)
        assert (own.local_min, own.local_max) == (r.local_min, r.local_max) and own.slope_sum_squares == pytest.approx(r.slope_sum_squares)
    shares = {"q0": 0.0, "q05": 0.05, "q5": 0.5, "q95": 0.95, "q1": 1.0}
    own = {r.tatort: r for r in kernel.quantiles(found, shares, "tatort", "kommun").collect()}
    for r in cells.where("v IS NOT NULL").groupBy("tatort").agg(F.collect_list(F.col("v").cast("float")).alias("v")).collect():
        for name, q in shares.items():
            assert own[r.tatort][name] == pytest.approx(np.quantile(np.array(r.v, np.float32).astype(float), q), rel=1e-12)
    drawn = kernel.samples(pipeline.zone_files(zones, planned, tables.raster_files(spark, f"file://{tmp_path}")), 50, nodata).groupBy("tatort", "tile").count().collect()
    assert all(0 < r["count"] <= 50 for r in drawn)


def test_no_pixel_is_exchanged(spark, tmp_path):
    (tmp_path / "t0.tif").write_bytes(geotiff.encode(raster(), 0, 40, 1.0, 1.0))
    zones = spark.createDataFrame([(0, "A", "K", "01", 1, ODD)], schemas.ZONES)
    planned = spark.createDataFrame([("A", "K", "t0")], "tatort string, kommun string, item_id string")
    found = kernel.zone_tiles(pipeline.zone_files(zones, planned, tables.raster_files(spark, f"file://{tmp_path}")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")]


def test_cells_keep_the_order():
    v = np.sort(np.r_[np.random.default_rng(1).normal(size=2000) * 10.0 ** np.arange(-10, 10).repeat(100), 0.0, -0.0, 3e38, -3e38].astype(np.float32))
    cells = kernel.cell_of(v)
    assert (np.diff(cells) >= 0).all() and kernel.cell_of(np.array([-0.0], np.float32)) == kernel.cell_of(np.array([0.0], np.float32))


def packed_lzw(data):
    """Codes of the usual width, most significant bit first, written by the book."""
    table, width, out, bits, last = {bytes([k]): k for k in range(256)}, 9, 0, 0, b""
    codes = [(256, 9)]
    for k in range(len(data)):
        now = last + data[k : k + 1]
        if now in table:
            last = now
            continue
        codes.append((table[last], width))
        table[now] = len(table) + 2 if len(table) >= 256 else len(table)
        n = len(table) + 2
        if n == 4094:
            codes.append((256, width))
            table, width = {bytes([j]): j for j in range(256)}, 9
        elif n >= 1 << width:
            width += 1
        last = data[k : k + 1]
    if last:
        codes.append((table[last], width))
        n = len(table) + 3
        width = width + 1 if n >= 1 << width and width < 12 else width
    codes.append((257, width))
    for code, w in codes:
        out, bits = out << w | code, bits + w
    pad = -bits % 8
    return (out << pad).to_bytes((bits + pad) // 8, "big")


def test_lzw_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 300, 5000, 60_000):
        for high in (2, 7, 256):
            data = rng.integers(0, high, n).astype(np.uint8).tobytes()
            assert geotiff.unpacked(packed_lzw(data)) == data
    with pytest.raises(ValueError, match="end code"):
        geotiff.unpacked(packed_lzw(b"abc" * 50)[:-3])


def file_of(values, kind="f4", order="<", pack=1, predictor=1, tile=None, rows=7, big=False):
    """A file written by hand."""
    height, width = values.shape
    form = {"f": 3, "i": 2, "u": 1}[kind[0]]
    blocks = []
    step_y, step_x = tile or (rows, width)
    for top in range(0, height, step_y):
        for left in range(0, width, step_x):
            part = values[top : top + step_y, left : left + step_x]
            if tile:
                part = np.pad(part, ((0, step_y - part.shape[0]), (0, step_x - part.shape[1])))
            part = part.astype(order + kind)
            if predictor == 2:
                part = np.diff(part.astype(np.int64), axis=1, prepend=0).astype(order + kind)
            body = part.tobytes()
            if predictor == 3:
                planes = part.astype(">" + kind).view(np.uint8).reshape(len(part), part.shape[1], -1).transpose(0, 2, 1).reshape(len(part), -1)
                body = np.diff(planes.astype(np.int64), axis=1, prepend=0).astype(np.uint8).tobytes()
            blocks.append(body if pack == 1 else packed_lzw(body) if pack == 5 else zlib.compress(body))
    o, wide = ("Q", 8) if big else ("I", 4)
    at = 16 if big else 8
    places = list(np.cumsum([at, *map(len, blocks)])[:-1])
    body, extra = b"".join(blocks), at + sum(map(len, blocks))
    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [int(kind[1]) * 8]), (259, 3, [pack]), (317, 3, [predictor]), (339, 3, [form]), (33550, 12, [2.0, 3.0, 0.0]), (33922, 12, [0.0, 0, 0, 100.0, 200.0, 0])]
    tags += [(322, 3, [step_x]), (323, 3, [step_y]), (324, 16 if big else 4, places), (325, 4, list(map(len, blocks)))] if tile else [(273, 16 if big else 4, places), (278, 4, [rows]), (279, 4, list(map(len, blocks)))]
    entries, tail = b"", b""
    for tag, code, found in sorted(tags):
        data = struct.pack(f"{order}{len(found)}{ {3: 'H', 4: 'I', 12: 'd', 16: 'Q'}[code]}", *found)
        if len(data) > wide:
            data, tail = struct.pack(order + o, extra + len(tail)), tail + data
        entries += struct.pack(f"{order}HH{o}", tag, code, len(found)) + data.ljust(wide, b"\0")
    start = extra + len(tail)
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, start) if big else struct.pack(order + "HI", 42, start))
    return head + body + tail + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + bytes(wide)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("pack", [1, 5, 8])
@pytest.mark.parametrize(("kind", "predictor"), [("f4", 1), ("f4", 3), ("f8", 3), ("i2", 2), ("u1", 2), ("i4", 1)])
def test_files_of_every_kind(order, tile, pack, kind, predictor):
    values = np.round(np.random.default_rng(3).normal(size=(37, 50)) * 30 + 60).clip(0, 250)
    got, head = geotiff.decode(file_of(values, kind, order, pack, predictor, tile, big=predictor == 3))
    assert (got == values.astype(kind)).all() and (head["x0"], head["y0"], head["res_x"], head["res_y"]) == (100.0, 200.0, 2.0, 3.0)


def test_damage_is_named():
    whole = file_of(raster(holes=False), pack=8)
    for data, fault in (
        (b"PK" + whole, "not a TIFF"), (whole[:60], "cut short|inflated|header"), (file_of(raster(), pack=7), "compression 7"), (file_of(raster(), predictor=4), "predictor 4"), (whole[:8] + bytes(40) + whole[48:], "inflated"),
    ):
        with pytest.raises(ValueError, match=fault):
            geotiff.decode(data)


@pytest.fixture
def two(spark, tmp_path):
    """Two zones, the first of two tiles, and their files in a folder."""
    (tmp_path / "tiles").mkdir()
    rows = []
    for k, x in enumerate((0, 40)):
        data = geotiff.encode(raster(k, holes=False), x, 40, 1.0, 1.0)
        (tmp_path / "tiles" / f"t{k}.tif").write_bytes(data)
        rows.append((f"t{k}", "c", f"https://h/x/t{k}.tif", len(data), (float(x), 0.0, x + 40.0, 40.0), k))
    zones = spark.createDataFrame([(0, "A", "K", "01", 1, square(20, 5, 30)), (1, "B", "K", "02", 1, square(2, 2, 9)), (2, "NoTile", "K", "03", 1, square(500, 500, 9))], schemas.ZONES)
    return zones, spark.createDataFrame(rows, f"{schemas.TILES}, fetch_ordinal int"), tmp_path


def runs_of(spark, root):
    return {r.tatort: r for r in pipeline._store(spark, root).read("runs").collect()}


def test_a_lost_tile_is_an_error_and_a_bare_zone_fails(spark, two):
    zones, tiles, tmp = two
    root = f"file://{tmp}/state"
    (tmp / "tiles" / "t1.tif").rename(tmp / "t1.gone")
    source = tables.raster_source(spark, f"file://{tmp}/tiles")
    with pytest.raises(RuntimeError, match="missing tiles: t1$"):
        pipeline.compare(spark, zones, tiles, source, root)
    assert {r.process_status for r in pipeline._store(spark, root).read("tiles").collect()} == {"planned"}
    (tmp / "t1.gone").rename(tmp / "tiles" / "t1.tif")
    rows = {r.tatort: r for r in pipeline.compare(spark, zones, tiles, source, root).collect()}
    assert (rows["A"].tiles_scanned, rows["A"].tiles_used) == ("2", "2") and set(rows) == {"A", "B"}
    assert len(list((tmp / "state" / "values").iterdir())) == 1  # those of the broken run are gone
    runs = runs_of(spark, root)
    assert (runs["NoTile"].status, runs["NoTile"].error_message, runs["NoTile"].planned_tiles) == ("failed", "no tile meets the zone", 0)
    assert {runs[k].status for k in "AB"} == {"completed"}


def test_the_gate_counts_the_cache(spark, two, monkeypatch):
    zones, tiles, tmp = two
    sizes = [r.size_bytes for r in tiles.orderBy("item_id").collect()]
    monkeypatch.setattr(pipeline.planning, "MIB", sum(sizes) + 10)
    (tmp / "cache").mkdir()
    source, options = tables.raster_source(spark, f"file://{tmp}/tiles"), pipeline.Options(cache_budget_mb=1)
    (tmp / "cache" / "t0.tif").write_bytes(b"x" * 11)  # of the wrong size: it takes room and is fetched again
    with pytest.raises(RuntimeError, match=f"A, K: the cache budget of {sum(sizes) + 10} bytes would be exceeded: 11 are there, {sum(sizes)} would come"):
        pipeline.compare(spark, zones, tiles, source, f"file://{tmp}/state", options, f"file://{tmp}/cache")
    (tmp / "cache" / "t0.tif").write_bytes(b"x" * sizes[0])
    use = planning.cache_use(tiles.withColumn("z", F.lit(1)), tiles.withColumn("z", F.lit(1)), tables.cached_tiles(spark, f"file://{tmp}/cache"), sum(sizes), "z").first()
    assert (use.used, use.new, use.over) == (*sizes, False)
    assert planning.cache_use(tiles.withColumn("z", F.lit(1)), tiles.withColumn("z", F.lit(1)), tables.cached_tiles(spark, f"file://{tmp}/none"), 1, "z").first().over


def test_profiles_of_the_stored_plan(spark, two):
    zones, tiles, tmp = two
    files = tables.raster_files(spark, f"file://{tmp}/tiles")
    pipeline.compare(spark, zones, tiles, files, f"file://{tmp}/state")
    some = zones.where("tatort <> 'NoTile'")
    rows = {r.tatort: r for r in pipeline.stored_profiles(spark, some, files, f"file://{tmp}/state", pipeline.Options(bins=5)).collect()}
    assert set(rows) == {"A", "B"} and {r["rank"] for r in rows.values()} == {1, 2} and all(len(r.p50) == 5 for r in rows.values())
    planned = pipeline._store(spark, f"file://{tmp}/state").read("tiles")
    pixels = tables.rasters(spark, f"file://{tmp}/tiles").withColumn("tile", F.regexp_extract("tile", r"(t\d)", 1))
    want = pipeline.profiles(some, pipeline.zone_pixels(some, planned, pixels), pipeline.Options(bins=5)).collect()
    assert {r.tatort: r.p50 for r in want} == {k: r.p50 for k, r in rows.items()}
    with pytest.raises(ValueError, match="no stored plan for NoTile, K"):
        pipeline.stored_profiles(spark, zones, files, f"file://{tmp}/state")


def test_progress_while_a_comparison_runs(spark, two, monkeypatch):
    zones, tiles, tmp = two
    monkeypatch.setattr(pipeline.planning, "MIB", max(r.size_bytes for r in tiles.collect()))
    seen = []

    def progress(now):
        running = runs_of(spark, f"file://{tmp}/state")["A"].status
        seen.append((running, now))

    pipeline.compare(spark, zones, tiles, tables.raster_source(spark, f"file://{tmp}/tiles"), f"file://{tmp}/state", pipeline.Options(cache_budget_mb=1), progress=progress)
    assert [(state, p["batch"], p["tiles_done"], p["tiles_left"]) for state, p in seen] == [("running", 1, 2, 1), ("running", 2, 3, 0)]
    first, last = (p for _, p in seen)
    assert first["eta_seconds"] == pytest.approx(first["seconds"] / 2) and last["eta_seconds"] == 0 and first["bytes_left"] > last["bytes_left"] == 0
    again = []
    pipeline.compare(spark, zones, tiles, tables.raster_source(spark, f"file://{tmp}/tiles"), f"file://{tmp}/state", progress=again.append)
    assert not again  # nothing is left


KEYS = {"a": ("k",), "b": ("k",)}


def journal(spark, root, most=16):
    return state.Journal(spark, root, {"a": "k long, v string", "b": "k long, w long"}, KEYS, most)


def test_a_commit_covers_all_tables(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/log"
    store = journal(spark, root, most=3)
    a = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    b = lambda *rows: spark.createDataFrame(list(rows), "k long, w long")
    assert store.read("a").isEmpty() and store.commit({"a": a((1, "x"), (2, "y")), "b": b((1, 10))}) == 1
    store.commit({"a": a((2, None), (3, "z"))})
    assert sorted(map(tuple, store.read("a").collect())) == [(1, "x"), (2, None), (3, "z")]
    # a writer that breaks off between its tables and its manifest leaves nothing that is seen
    broken = journal(spark, root)
    monkeypatch.setattr(broken, "_publish", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        broken.commit({"a": a((1, "lost")), "b": b((1, 99))})
    assert sorted(map(tuple, store.read("a").collect())) == [(1, "x"), (2, None), (3, "z")] and store.read("b").first().w == 10
    # a second writer that began from the same commit is refused
    late = journal(spark, root)
    seen = late.manifest()
    store.commit({"b": b((1, 11))})
    monkeypatch.setattr(late, "manifest", lambda back=0: seen)
    with pytest.raises(RuntimeError, match="another writer made commit 3"):
        late.commit({"b": b((1, 12))})
    assert store.read("b").first().w == 11
    for k in range(5):
        store.commit({"a": a((k, str(k)))})
    assert sorted(map(tuple, store.read("a").collect())) == [(k, str(k)) for k in range(5)]
    assert len(store.manifest()[1]["a"]) <= 3 and len(list((tmp_path / "log" / "a").iterdir())) <= 8


class Server(BaseHTTPRequestHandler):
    files: dict[str, bytes] = {}
    broken: dict[str, int] = {}
    asked: list[str] = []

    def do_GET(self):
        body = self.files.get(self.path)
        Server.asked.append(self.path)
        if body is None:
            self.send_error(404)
            return
        if self.broken.get(self.path, 0) > 0:  # breaks off half way
            self.broken[self.path] -= 1
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body[: len(body) // 2])
            return
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    own = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    Server.files, Server.broken, Server.asked = {}, {}, []
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_address[1]}"
    own.shutdown()


def test_downloads_that_break_off_are_begun_again(spark, tmp_path, server):
    data = geotiff.encode(raster(holes=False), 0, 40, 1.0, 1.0)
    Server.files = {"/t0.tif": data, "/t1.tif": data}
    Server.broken = {"/t0.tif": 2}
    tiles = spark.createDataFrame([(f"t{k}", f"{server}/t{k}.tif", len(data)) for k in range(2)], "item_id string, href string, size_bytes long")
    fetch = cache.fetched_files(f"{tmp_path}/cache", "u", "p", parts=2, wait=0.01)
    assert {(r.tile, bytes(r.content) == data) for r in fetch(tiles).collect()} == {("t0", True), ("t1", True)}
    assert not list((tmp_path / "cache").iterdir())
    Server.broken = {"/t0.tif": 9}
    with pytest.raises(Exception, match="bytes instead of|IncompleteRead"):
        fetch(tiles).collect()
    assert not list((tmp_path / "cache").iterdir())
    Server.files.pop("/t1.tif")
    Server.broken, Server.asked = {}, []
    with pytest.raises(RuntimeError, match="t1.tif: access failed with status 404"):
        remote.tile_bytes(f"{server}/t1.tif", 5, str(tmp_path), "u", "p", len)
    assert Server.asked == ["/t1.tif"]


def test_attempts_side_by_side_have_whole_files(tmp_path, server):
    data = geotiff.encode(raster(holes=False), 0, 40, 1.0, 1.0)
    Server.files = {"/t.tif": data}
    for keep in (True, False):
        got = []
        run = lambda: [got.append(remote.tile_bytes(f"{server}/t.tif", len(data), f"{tmp_path}/c", "u", "p", geotiff.decode, keep, wait=0.01)) for _ in range(5)]  # noqa: B023, E731
        threads = [threading.Thread(target=run) for _ in range(6)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(got) == 30 and all(x == data for x in got)
        assert [p.name for p in (tmp_path / "c").iterdir()] == (["t.tif"] if keep else [])


def test_a_rate_is_kept(tmp_path, server):
    import time

    Server.files = {"/t": b"x" * 100_000}
    began = time.monotonic()
    remote.tile_bytes(f"{server}/t", 100_000, str(tmp_path), "u", "p", len, mbps=2.0)
    assert time.monotonic() - began >= 0.39


@pytest.mark.parametrize("rows", [1, 7, 8, 40, 100])
def test_bands_of_a_tile_equal_the_tile(spark, rows):
    v = np.round(raster(3))  # equal extremes in several bands
    head = {"x0": 0.0, "y0": 40.0, "res_x": 1.0, "res_y": 1.0, "nodata": -9999.0}
    [batch] = tables.pixel_batches("t", v, head)
    pixels = spark.createDataFrame(batch.to_pandas().replace({np.nan: None}), tables.TILE_PIXELS)
    shape = spark.createDataFrame([(ODD,)], f"g {schemas.GEOMETRY}").select(F.lit("A").alias("tatort"), F.lit("K").alias("kommun"), geometry.edges(F.col("g")).alias("edges"))
    bands = tables.packed_bands(pixels, rows)
    whole, banded = (kernel.zone_tiles(files.withColumnRenamed("tile", "item_id").crossJoin(shape)) for files in (tables.packed_pixels(pixels), bands))
    heights = [(r.part, len(geotiff.decode(r.content)[0])) for r in bands.collect()]
    assert sorted(k for k, _ in heights) == list(range(-(-40 // rows))) and max(h for _, h in heights) <= rows + 2
    a, b = (kernel.partials(f).first().asDict() for f in (whole, banded))
    assert abs(a.pop("slope_sum_squares") - b.pop("slope_sum_squares")) < 1e-6 and a == b
    shares = {"low": 0.05, "mid": 0.5, "high": 0.95}
    assert kernel.quantiles(banded, shares, "tatort").collect() == kernel.quantiles(whole, shares, "tatort").collect()
