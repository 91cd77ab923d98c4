"""Binary payloads kept as PNG images in binary columns.

``store`` pads the UTF-8 bytes of a text to a positive multiple of 64 and writes them as an 8-bit grey
image, 64 samples wide. ``load`` reads the stored bytes back through the PNG chunks: every length and
checksum is tested, the data stream is inflated and its rows are unfiltered with numpy. From the samples
it computes a hash of low-frequency cosine-transform terms. Images are handled one at a time, so memory
is bounded by one batch of rows plus the largest text.

Defined cases: a null text counts as empty and is stored as one row of zeros; repeated rows give equal
images; extra columns are ignored; an empty table gives an empty result. A damaged image raises
``ValueError`` naming the fault, unless ``load(..., strict=False)``, which gives nulls and the fault.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: The hash is taken over an image of this many rows and columns, of which the low frequencies are kept.
SIDE, LOW = 32, 8
#: Rows that one result batch holds.
STEP = 256


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(samples: np.ndarray) -> np.ndarray:
    """Rows with their filter bytes: of no filter, left difference and upper difference the one with the least sum of magnitudes."""
    left = samples.copy()
    left[:, 1:] -= samples[:, :-1]
    upper = samples.copy()
    upper[1:] -= samples[:-1]
    forms = (samples, left, upper)
    cost = [np.abs(x.view(np.int8).astype(np.int16)).sum() for x in forms]
    kind = int(np.argmin(cost))
    out = np.empty((samples.shape[0], samples.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = forms[kind]
    return out


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """A payload of a positive multiple of 64 bytes as a grey PNG image."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(_filtered(samples).tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The chunks of a PNG stream, each after a test of its length and checksum."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("cut chunk")
        (size,) = struct.unpack_from(">I", png, at)
        end = at + 12 + size
        if end > len(png):
            raise ValueError("cut chunk")
        kind, body = png[at + 4 : at + 8], png[at + 8 : end - 4]
        if zlib.crc32(png[at + 4 : end - 4]) != struct.unpack_from(">I", png, end - 4)[0]:
            raise ValueError(f"checksum of {kind!r}")
        yield kind, body
        if kind == b"IEND":
            return
        at = end
    raise ValueError("no end chunk")


def _unpredict(row: np.ndarray, above: np.ndarray, kind: int) -> np.ndarray:
    """One row under the average (3) or Paeth (4) filter, whose samples depend on each other."""
    out = [0] * len(row)
    left = corner = 0
    for k, (x, up) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
        if kind == 3:
            guess = (left + up) >> 1
        else:
            p = left + up - corner
            guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
        left, corner = (x + guess) & 255, up
        out[k] = left
    return np.array(out, np.uint8)


def unfilter(rows: np.ndarray) -> np.ndarray:
    """The samples of rows that begin with their filter byte; runs of rows with one filter are undone together."""
    kinds, data = rows[:, 0], rows[:, 1:]
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown filter")
    out = np.empty_like(data)
    starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
    for a, b in zip(starts, [*starts[1:], len(kinds)], strict=True):
        kind = int(kinds[a])
        above = out[a - 1] if a else np.zeros(data.shape[1], np.uint8)
        if kind == 0:
            out[a:b] = data[a:b]
        elif kind == 1:
            np.add.accumulate(data[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            np.add.accumulate(data[a:b], axis=0, dtype=np.uint8, out=out[a:b])
            out[a:b] += above
        else:
            for k in range(a, b):
                above = out[k] = _unpredict(data[k], above, kind)
    return out


def decode_png(png: bytes) -> np.ndarray:
    """The samples of an 8-bit grey image without interlacing."""
    head, body = None, []
    for kind, part in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
    if head is None or head[2:] != (8, 0, 0, 0, 0) or not head[0] or not head[1]:
        raise ValueError("not an 8-bit grey image")
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise ValueError(f"data stream: {e}") from e
    if len(raw) != head[1] * (head[0] + 1):
        raise ValueError("wrong amount of data")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(head[1], head[0] + 1))


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * SIDE))


COSINES = _cosines()


def _shrunk(samples: np.ndarray) -> np.ndarray:
    """Means over a grid of SIDE x SIDE cells; a short image repeats its rows."""
    high = samples.shape[0]
    edges = np.arange(SIDE + 1) * high // SIDE
    if high >= SIDE:
        sums = np.add.reduceat(samples.reshape(high, SIDE, -1).sum(axis=2, dtype=np.int64), edges[:-1], axis=0)
        return sums / (np.diff(edges)[:, None] * (samples.shape[1] // SIDE))
    return samples.reshape(high, SIDE, -1).mean(axis=2)[np.minimum(edges[:-1], high - 1)]


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: whether each low-frequency term is over the median of all but the constant one."""
    terms = np.round(COSINES @ _shrunk(samples) @ COSINES.T, 6).ravel()
    return np.packbits(terms > np.median(terms[1:])).tobytes()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, those padded to a positive multiple of 64)."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0")


STORED = "doc_id long, n_bytes long, media binary"
LOADED = "doc_id long, n_bytes long, media binary, payload binary, feature binary, fault string"


def _in_steps(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


def store(docs: DataFrame, level: int = 1) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a PNG image."""

    def run(batches):
        for batch in _in_steps(batches):
            made = [payload_of(x.as_py()) for x in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([n for n, _ in made], pa.int64()),
                    pa.array([encode_png(p, level) for _, p in made], pa.binary()),
                ],
                ["doc_id", "n_bytes", "media"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STORED)


def load(stored: DataFrame, strict: bool = True) -> DataFrame:
    """The stored images with what is read back: the payload, its feature and null or the fault found."""

    def read(png):
        try:
            samples = decode_png(png)
            return samples.tobytes(), cosine_hash(samples), None
        except ValueError as e:
            if strict:
                raise
            return None, None, str(e)

    def run(batches):
        for batch in _in_steps(batches):
            made = [read(x.as_py()) for x in batch["media"]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["n_bytes"],
                    batch["media"],
                    *(pa.array([x[k] for x in made], pa.binary()) for k in (0, 1)),
                    pa.array([x[2] for x in made], pa.string()),
                ],
                ["doc_id", "n_bytes", "media", "payload", "feature", "fault"],
            )

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, LOADED)


def digests(docs: DataFrame) -> DataFrame:
    """Digests of each document's stored image and of the payload read back from it."""
    return load(store(docs)).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -WIDTH, WIDTH)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("feature")).alias("feature"),
    )
