"""GeoTIFF files of one band: strips or tiles, plain, deflated or LZW, with or without a predictor, classic or with 64-bit offsets."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Tags of the header that are read, and sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, COUNTS, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS, FORMAT, SCALE, TIE, MISSING = (
    256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339, 33550, 33922, 42113,
)
KINDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "Q", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
VALUES = {(32, 3): "f4", (64, 3): "f8", (16, 2): "i2", (32, 2): "i4", (8, 2): "i1", (16, 1): "u2", (32, 1): "u4", (8, 1): "u1"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946


def unpacked(data: bytes) -> bytes:
    """The bytes of an LZW strip: codes from 9 to 12 bits, most significant bit first, each width ending one code early."""
    clear, end = 256, 257
    fresh = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, held, bits, last = list(fresh), 9, 0, 0, b""
    out = []
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == end:
            return b"".join(out)
        if code == clear:
            table, width, last = list(fresh), 9, b""
            continue
        if code < len(table):
            now = table[code]
        elif code == len(table) and last:
            now = last + last[:1]
        else:
            raise ValueError(f"an LZW code {code} is beyond the table")
        out.append(now)
        if last:
            table.append(last + now[:1])
        last = now
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    raise ValueError("LZW data ends without its end code")


def unpredicted(part: np.ndarray, predictor: int, order: str, kind: str) -> np.ndarray:
    """Values of a block of bytes (rows, bytes of a row) whose predictor is undone: of differences of values (2), or of bytes by significance (3)."""
    if predictor == 1:
        return part.view(order + kind)
    if predictor == 2:
        return np.cumsum(part.view(order + kind), axis=1, dtype=np.dtype(kind)).astype(order + kind) if kind[0] in "iu" else _fault("predictor 2 is for integers")
    if predictor == 3 and kind[0] == "f":
        size = int(kind[1])
        sums = np.cumsum(part, axis=1, dtype=np.uint8)
        planes = sums.reshape(len(part), size, -1)  # the most significant byte of every value first
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(len(part), -1).view(">" + kind)
    return _fault(f"predictor {predictor} is not supported")


def _fault(text: str):
    raise ValueError(text)


def header(data: bytes) -> tuple[str, dict[int, tuple]]:
    """(byte order, values by tag) of the first directory."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2])) or _fault("not a TIFF file")
    version = struct.unpack_from(f"{order}H", data, 2)[0]
    if version not in (42, 43):
        _fault(f"not a TIFF file: version {version}")
    big = version == 43
    offset, number, entry, wide = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
    try:
        at = struct.unpack_from(order + offset, data, 8 if big else 4)[0]
        tags = {}
        for k in range(struct.unpack_from(order + number, data, at)[0]):
            here = at + struct.calcsize(order + number) + entry * k
            tag, kind, n = struct.unpack_from(f"{order}HH{offset}", data, here)
            if kind not in KINDS:
                continue
            form = f"{order}{n}{KINDS[kind]}"
            place = here + entry - wide
            if struct.calcsize(form) > wide:
                place = struct.unpack_from(order + offset, data, place)[0]
            tags[tag] = struct.unpack_from(form, data, place)
    except struct.error as e:
        raise ValueError(f"the header is cut short: {e}") from e
    return order, tags


def decode(data: bytes) -> tuple[np.ndarray, dict]:
    """(values, header) of a raster as doubles; x0, y0 is the upper left corner. What can't be read is a ValueError that names the fault."""
    order, tags = header(data)
    for tag, name in ((WIDTH, "width"), (HEIGHT, "height"), (BITS, "bits")):
        if tag not in tags:
            _fault(f"the header has no {name}")
    if tags.get(SAMPLES, (1,))[0] != 1 or len(tags[BITS]) != 1:
        _fault("the raster has more than one band")
    height, width = tags[HEIGHT][0], tags[WIDTH][0]
    form = tags[BITS][0], tags.get(FORMAT, (1,))[0]
    kind = VALUES.get(form) or _fault(f"values of {form[0]} bits and format {form[1]} are not supported")
    pack, predictor = tags.get(COMPRESSION, (PLAIN,))[0], tags.get(PREDICTOR, (1,))[0]
    if pack not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE):
        _fault(f"compression {pack} is not supported")
    tiled = TILES in tags
    places, counts = (TILES, TILE_COUNTS) if tiled else (STRIPS, COUNTS)
    if places not in tags or counts not in tags:
        _fault("the header has neither strips nor tiles")
    high, wide = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(tags.get(ROWS, (height,))[0], height), width)
    across = -(-width // wide)
    if len(tags[places]) < across * -(-height // high):
        _fault("the header lists too few blocks")
    values = np.empty((height, width), np.float64)
    size = int(kind[1])
    for k, (start, n) in enumerate(zip(tags[places], tags[counts], strict=True)):
        top, left = k // across * high, k % across * wide
        if top >= height:
            break
        rows = high if tiled else min(high, height - top)
        raw = data[start : start + n]
        if len(raw) != n:
            _fault(f"block {k} is cut short")
        try:
            body = raw if pack == PLAIN else unpacked(raw) if pack == LZW else zlib.decompress(raw)
        except zlib.error as e:
            raise ValueError(f"block {k} can't be inflated: {e}") from e
        if len(body) < rows * wide * size:
            _fault(f"block {k} has {len(body)} bytes instead of {rows * wide * size}")
        cells = np.frombuffer(body, np.uint8, rows * wide * size).reshape(rows, wide * size)
        block = unpredicted(cells, predictor, order, kind)
        part = values[top : top + rows, left : left + wide]
        part[:] = block[: part.shape[0], : part.shape[1]]
    tie, scale = tags.get(TIE, (0.0,) * 6), tags.get(SCALE, (1.0, 1.0, 0.0))
    missing = b"".join(tags[MISSING]).split(b"\0")[0].strip() if MISSING in tags else b""
    head = {"x0": tie[3] - tie[0] * scale[0], "y0": tie[4] + tie[1] * scale[1], "res_x": abs(scale[0]), "res_y": abs(scale[1]), "nodata": float(missing) if missing else None}
    return values, head


def encode(values: np.ndarray, x0: float, y0: float, res_x: float, res_y: float, nodata: float | None = None) -> bytes:
    """A file of one deflated strip of doubles."""
    body = zlib.compress(values.astype("<f8").tobytes(), 1)
    scale, tie = struct.pack("<3d", res_x, res_y, 0), struct.pack("<6d", 0, 0, 0, x0, y0, 0)
    missing = b"" if nodata is None else repr(float(nodata)).encode().ljust(7, b" ") + b"\0"
    extra = 8 + len(body)
    tags = [
        (WIDTH, 4, 1, values.shape[1]), (HEIGHT, 4, 1, values.shape[0]), (BITS, 3, 1, 64), (COMPRESSION, 3, 1, DEFLATE), (STRIPS, 4, 1, 8), (ROWS, 4, 1, values.shape[0]),
        (COUNTS, 4, 1, len(body)), (FORMAT, 3, 1, 3), (SCALE, 12, 3, extra), (TIE, 12, 6, extra + 24),
    ]
    if missing:
        tags.append((MISSING, 2, len(missing), extra + 72))
    directory = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", extra + 72 + len(missing)) + body + scale + tie + missing + directory
