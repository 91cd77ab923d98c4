"""Fill-in-middle texts by secondary sort.

A document is cut into lines, its units, and two cut points, drawn from a hash of its id, part them into prefix, middle
and suffix. ``transformed`` emits the new text in pieces of whole units, or parts of one very long unit, keyed by
document and place, deals them out by document and sorts each partition by (document, place): a stream of pieces from
which texts, digests or files are written without a whole text in a row. ``restored`` reads nothing but the form and the
pieces of the output, finds the marks in them, and sorts the partition again, by the places before; no second exchange is
needed, as a document's pieces are in one partition already. One document is one stream, as its digest is; the size of a
task is that of its documents, its memory that of a few pieces.

Defined cases: a null or empty text has no unit, is plain and has no piece but one empty one; a null id is drawn as the text
``null``; rows of one id are separate documents with equal cut points; a text that holds a mark is plain, as its output
could not be told apart; a text without a line end is one unit, however long; extra columns are ignored; an empty table gives
an empty result. Rows are told apart by their place in the input's plan: give a table that was written, as everywhere, if its
rows come in another order when they are computed again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a piece, and of the pieces of one result batch.
PIECE, BATCH = 32_768, 1_048_576


@dataclass(frozen=True)
class Options:
    """The draw: its seed, the shares in percent of documents that are transformed and of those with the suffix first, and the marks."""

    seed: int = 7
    rate: int = 100
    suffix_first: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


#: Columns of a piece of the output. Those of the whole document stand in its every piece.
PIECES = "row long, doc_id long, n long, form string, prefix_chars long, middle_chars long, place long, piece string"
#: Columns of a piece of the text before; ``closing`` marks an empty last one, which has the digest of the output.
RESTORED = "row long, doc_id long, n long, form string, prefix_chars long, middle_chars long, section int, place long, piece string, closing boolean, output_sha256 string"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
#: Order of the sections in the text before.
SECTIONS = ("prefix", "middle", "suffix")


def draws(doc_id, seed: int) -> list[int]:
    """The first four groups of eight digits of the hash of a seed and an id."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def _line_starts(text: str, first: int, last: int) -> tuple[int, int]:
    """Where the units of two numbers begin; a number beyond the last unit is the end of the text."""
    at, found = 0, []
    for stop, begin in ((first, 0), (last, first)):
        for _ in range(stop - begin):
            end = text.find("\n", at)
            at = len(text) if end < 0 else end + 1
        found.append(at)
    return found[0], found[1]


def plan(doc_id, text: str, options: Options) -> tuple[int, str, int, int]:
    """(units, form, end of the prefix, end of the middle) of a document."""
    n = text.count("\n") + (text[-1:] not in ("", "\n"))
    h = draws(doc_id, options.seed)
    if not text or any(m in text for m in options.marks) or h[2] % 100 >= options.rate:
        return n, "plain", 0, 0
    ends = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return n, "spm" if h[3] % 100 < options.suffix_first else "psm", *_line_starts(text, *ends)


def _units(text: str, at: int, end: int) -> Iterator[str]:
    """Pieces of a section: as many whole units as fit, or a part of one that doesn't."""
    while at < end:
        stop = min(end, at + PIECE)
        cut = text.rfind("\n", at, stop) + 1 if stop < end else stop
        stop = cut or stop
        yield text[at:stop]
        at = stop


def output_of(text: str, form: str, first: int, last: int, options: Options) -> Iterator[str]:
    """The pieces of the output in order; a mark is a piece of its own."""
    if form == "plain":
        yield from _units(text, 0, len(text)) if text else ("",)
        return
    spans = {options.prefix: (0, first), options.middle: (first, last), options.suffix: (last, len(text))}
    for mark in (options.suffix, options.prefix, options.middle) if form == "spm" else (options.prefix, options.suffix, options.middle):
        yield mark
        yield from _units(text, *spans[mark])


def _batches(rows: Iterator[tuple], schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows, bounded by the characters of their column of number ``text``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text]) + 256
        if size > BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def _rows(batches, *columns: str) -> Iterator[tuple]:
    """Rows of batches, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield from zip(*(part[c].to_pylist() for c in columns), strict=True)


def transformed(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """The pieces of the output, one partition for each document and sorted by (row, place)."""

    def emit(batches):
        def rows():
            for row, doc_id, text in _rows(batches, "row", "doc_id", "text"):
                text = text or ""
                n, form, first, last = plan(doc_id, text, options)
                chars = (None, None) if form == "plain" else (first, last - first)
                for place, piece in enumerate(output_of(text, form, first, last, options)):
                    yield row, doc_id, n, form, *chars, place, piece

        yield from _batches(rows(), _schema(PIECES), 7)

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keyed.mapInArrow(emit, PIECES).repartition("row").sortWithinPartitions("row", "place")


def restored(pieces: DataFrame, options: Options = Options()) -> DataFrame:
    """The pieces of the texts before, made of the pieces of outputs in order, and sorted again by (row, section, place).

    A section is that of the last mark before a piece. A piece equals a mark only if it is one, as a text that holds one is plain.
    Each document ends with an empty piece that has the digest of its output.
    """
    section = {getattr(options, name): k for k, name in enumerate(SECTIONS)}

    def emit(batches):
        def rows():
            known, digest, now = None, None, 0
            for *document, place, piece in _rows(batches, *(c.split()[0] for c in PIECES.split(", "))):
                if known is None or document[0] != known[0]:
                    if known:
                        yield *known, len(SECTIONS), 0, "", True, digest.hexdigest()
                    known, digest, now = document, hashlib.sha256(), 0
                digest.update(piece.encode())
                if document[3] != "plain" and piece in section:
                    now = section[piece]
                else:
                    yield *document, now, place, piece, False, None
            if known:
                yield *known, len(SECTIONS), 0, "", True, digest.hexdigest()

        yield from _batches(rows(), _schema(RESTORED), 8)

    return pieces.mapInArrow(emit, RESTORED).sortWithinPartitions("row", "section", "place")


def digests(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """Of each document: its units, form, characters of prefix and middle, and the digests of its output and of the text that was made of it again."""

    def emit(batches):
        def rows():
            digest = hashlib.sha256()
            for _, *document, piece, closing, output in _rows(batches, "row", "doc_id", "n", "form", "prefix_chars", "middle_chars", "piece", "closing", "output_sha256"):
                digest.update(piece.encode())
                if closing:
                    yield *document, output, digest.hexdigest()
                    digest = hashlib.sha256()

        yield from _batches(rows(), _schema(DIGESTS), 6)

    return restored(transformed(docs, options), options).mapInArrow(emit, DIGESTS)


def texts(pieces: DataFrame) -> DataFrame:
    """(row, doc_id, form, text): pieces in order put together again, for those who want whole texts in rows."""

    def emit(batches):
        def rows():
            known, held = None, []
            for *document, piece in _rows(batches, "row", "doc_id", "form", "piece"):
                if known is not None and document[0] != known[0]:
                    yield *known, "".join(held)
                    held = []
                known = document
                held.append(piece)
            if known:
                yield *known, "".join(held)

        yield from _batches(rows(), _schema("row long, doc_id long, form string, text string"), 3)

    return pieces.mapInArrow(emit, "row long, doc_id long, form string, text string")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle(options: Options = Options()) -> str:
    """The digests in SQL."""
    hexes = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    marked = " OR ".join(f"contains(t, {_sql(m)})" for m in options.marks)
    p, s, m = map(_sql, options.marks)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{options.seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
    u AS (SELECT doc_id, t, regexp_extract_all(t, {_sql("[^" + chr(10) + "]*" + chr(10) + "|[^" + chr(10) + "]+")}) AS units, {hexes} FROM d),
    c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
        CASE WHEN t = '' OR {marked} OR h3 % 100 >= {options.rate} THEN 'plain' WHEN h4 % 100 < {options.suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM u),
    e AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN {s} || suf || {p} || pre || {m} || mid ELSE {p} || pre || {s} || suf || {m} || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM e"""


#: What a unit is, for tests.
UNIT = re.compile(r"[^\n]*\n|[^\n]+")
