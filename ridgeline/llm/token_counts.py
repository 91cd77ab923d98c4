"""Token counts of whole texts; huge ones by overlapping chunks that are spliced where both encodings agree.

A text of up to one chunk is encoded as it is. A longer one is cut into chunks that overlap, which become rows of their own
and are dealt out, so that many tasks share one text. Each chunk is encoded with offsets, and keeps, for the two stretches that it
shares with its neighbours, where words begin and how many tokens come before. Neighbours are spliced at a place where
a word begins in both encodings.

Why that is exact: the pattern that parts a text into words reads from left to right and never looks back, so that from a place
where a word begins all that follows depends on the text after it alone, added tokens too. A place in the left chunk that is so far from its end that
no word before it can read beyond (``guard`` characters) is one of the whole text, if the chunk's own beginning was spliced;
where the right chunk has a word's beginning there too, both go on alike. Merges never cross words.

Where a pair of chunks shares no such place (a word longer than the overlap), the overlap is widened to the whole chunk: runs of
chunks without a splice become one chunk, which is encoded again, until every pair is spliced. The rest stays as it was.

Defined cases: a null or empty text has no token and no byte; equal rows have equal counts and each its own row; a null id stays null; the string of a special token within a text is
that token, as is the library's default; extra columns are ignored; an empty table gives an empty result. A tokenizer of another kind than
byte-level without a normalizer encodes every text whole, as the proof doesn't hold for it.
"""

from __future__ import annotations

import json
import os

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Tokens above which a document is over the limit.
LIMIT = 1024
#: Characters between the beginnings of chunks, and those that neighbours share.
SPAN, OVERLAP = 32_768, 512
#: Texts and characters that are encoded at once.
TEXTS, CHARS = 256, 1_048_576

PLACES = "array<struct<at:bigint,before:bigint>>"
CHUNK = "row long, doc_id long, n_bytes long, start long, until long, part string"
#: ``head`` and ``tail``: words' beginnings in what is shared with the chunk before and the one after.
ENCODED = f"row long, doc_id long, n_bytes long, start long, until long, tokens long, head {PLACES}, tail {PLACES}"

_LOADED: dict[int, object] = {}


def _tokenizer(model: str):
    """The tokenizer of this worker, which has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        own = Tokenizer.from_str(model)
        own.no_truncation()
        own.no_padding()
        _LOADED[key] = own
    return _LOADED[key]


def guard(model: str) -> int | None:
    """Characters before a chunk's end in which words may still change; None if the proof doesn't hold for the tokenizer."""
    found = json.loads(model)
    first = found["pre_tokenizer"] or {}
    plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True)
    if found["normalizer"] or found["post_processor"] or not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in found["added_tokens"]):
        return None
    return max([len(t["content"]) for t in found["added_tokens"]], default=0) + 16


def _groups(texts: list[str]):
    """Slices of a list of texts, bounded in number and characters."""
    held, size = [], 0
    for text in texts:
        if held and (len(held) == TEXTS or size + len(text) > CHARS):
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def whole(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of texts (doc_id, n_bytes, text) that are encoded as they are."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = _tokenizer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                counts = [len(e) for group in _groups(part["text"].to_pylist()) for e in own.encode_batch_fast(group, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["n_bytes"], pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return rows.select("doc_id", "n_bytes", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def chunks(rows: DataFrame, span: int = SPAN, overlap: int = OVERLAP) -> DataFrame:
    """The chunks of texts (row, doc_id, n_bytes, text): each from ``start`` to ``overlap`` beyond ``until``, where the next begins; ``until`` is null in the last."""

    def run(batches):
        for batch in batches:
            for row, doc_id, n_bytes, text in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "n_bytes", "text")), strict=True):
                starts = list(range(0, max(len(text) - overlap, 1), span))
                for start in starts:
                    last = start == starts[-1]
                    part = text[start:] if last else text[start : start + span + overlap]
                    cells = (row, doc_id, n_bytes, start, None if last else start + span, part)
                    yield pa.RecordBatch.from_pylist([dict(zip(names, cells, strict=True))], schema=schema)

    names = [c.split()[0] for c in CHUNK.split(", ")]
    schema = pa.schema([(n, pa.string() if n == "part" else pa.int64()) for n in names])
    return rows.select("row", "doc_id", "n_bytes", "text").mapInArrow(run, CHUNK).repartition("row", "start")


def word_places(encoding, start: int, low: int, high: int) -> list[dict]:
    """Where words begin from ``low`` to ``high`` in a chunk that begins at ``start``, and how many tokens of it come before."""
    words, offsets, out = encoding.word_ids, encoding.offsets, []
    for k, (word, (at, _)) in enumerate(zip(words, offsets, strict=True)):
        if low <= start + at <= high and (k == 0 or words[k - 1] != word):
            out.append({"at": start + at, "before": k})
    return out


def encoded(parts: DataFrame, model: str, edge: int, overlap: int = OVERLAP) -> DataFrame:
    """Chunks with their tokens and the places at which they may be spliced; a place in the tail is ``edge`` characters from the chunk's end."""
    shared = parts.sparkSession.sparkContext.broadcast(model)
    place = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
    schema = pa.schema([(c.split()[0], place if "array" in c else pa.int64()) for c in ENCODED.split(", ")])

    def run(batches):
        own = _tokenizer(shared.value)
        for batch in batches:
            for row, doc_id, n_bytes, start, until, part in zip(*(batch[c].to_pylist() for c in (c.split()[0] for c in CHUNK.split(", "))), strict=True):
                found = own.encode(part, add_special_tokens=False)
                head = word_places(found, start, start, start + overlap) if start else []
                tail = word_places(found, start, until, start + len(part) - edge) if until is not None else []
                cells = (row, doc_id, n_bytes, start, until, len(found), head, tail)
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, cells, strict=True))], schema=schema)

    return parts.mapInArrow(run, ENCODED)


def splices(found: DataFrame) -> DataFrame:
    """(row, at, gain) for each pair of neighbours, whose right one begins at ``at``: tokens of the left one before the first shared place less those of the right one before it.

    A text's tokens are those of its last chunk and all gains. ``gain`` is null if the pair shares no place.
    """
    sides = F.array(
        F.struct(F.col("until").alias("at"), F.col("tail").alias("tail"), F.lit(None).cast(PLACES).alias("head")),
        F.struct(F.when(F.col("start") > 0, F.col("start")).alias("at"), F.lit(None).cast(PLACES).alias("tail"), F.col("head").alias("head")),
    )
    pairs = found.select("row", F.inline(sides)).where("at IS NOT NULL").groupBy("row", "at").agg(F.first("tail", True).alias("tail"), F.first("head", True).alias("head"))

    def both(t: Column) -> Column:
        return F.transform(F.filter("head", lambda h: h["at"] == t["at"]), lambda h: F.struct(t["at"].alias("at"), (t["before"] - h["before"]).alias("gain")))

    return pairs.select("row", "at", F.array_min(F.flatten(F.transform("tail", both)))["gain"].alias("gain"))


def merged(parts: DataFrame, broken: DataFrame) -> DataFrame:
    """The chunks of texts with a broken pair: each run of chunks without a splice between them is one, the others stay as they are."""
    marked = parts.join(broken.select("row").distinct(), "row", "left_semi").join(broken.select("row", F.col("at").alias("start"), F.lit(True).alias("_broken")), ["row", "start"], "left")
    run = F.sum(F.when(F.col("_broken"), 0).otherwise(1)).over(Window.partitionBy("row").orderBy("start"))
    listed = F.array_sort(F.collect_list(F.struct("start", "until", "part")))
    runs = marked.withColumn("_run", run).groupBy("row", "doc_id", "n_bytes", "_run").agg(listed.alias("_parts"))
    size = F.size("_parts")
    pieces = F.transform("_parts", lambda p, k: F.when(k == size - 1, p["part"]).otherwise(F.substring(p["part"], F.lit(1), (p["until"] - p["start"]).cast("int"))))
    return runs.select("row", "doc_id", "n_bytes", F.col("_parts")[0]["start"].alias("start"), F.col("_parts")[size - 1]["until"].alias("until"), F.array_join(pieces, "").alias("part"))


def spliced(rows: DataFrame, model: str, span: int = SPAN, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of long texts (row, doc_id, n_bytes, text) by their chunks."""
    edge = guard(model)
    parts = cut(chunks(rows, span, overlap))
    found = cut(encoded(parts, model, edge, overlap))
    while True:
        broken = cut(splices(found).where("gain IS NULL"))
        if broken.isEmpty():
            break
        parts_now = cut(merged(parts, broken))
        touched = broken.select("row").distinct()
        again = encoded(parts_now.repartition("row", "start"), model, edge, overlap)
        found = cut(found.join(touched, "row", "left_anti").unionByName(again))
        parts = cut(parts.join(touched, "row", "left_anti").unionByName(parts_now))
    gains = splices(found).groupBy("row").agg(F.sum("gain").alias("gain"))
    last = found.where("until IS NULL").join(gains, "row", "left")
    return last.select("doc_id", "n_bytes", (F.col("tokens") + F.coalesce("gain", F.lit(0))).alias("n_tokens"))


def counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, span: int = SPAN, overlap: int = OVERLAP) -> DataFrame:
    """Of each document: bytes of its text, tokens, and whether these are over the limit."""
    with open(vocabulary, encoding="utf-8") as f:
        model = f.read()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    if guard(model) is None:
        found = whole(rows, model)
    else:
        fits = F.length("text") <= span + overlap
        long = rows.where(~fits).withColumn("row", F.monotonically_increasing_id())
        found = whole(rows.where(fits), model).unionByName(spliced(long, model, span, overlap))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
