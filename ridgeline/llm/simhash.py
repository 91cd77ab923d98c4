"""SimHash fingerprints and their near-duplicate components.

Fingerprints are 64-bit majority votes over the hashes of word shingles. Two fingerprints link when they
differ in at most ``REACH`` bits; a component holds everything that links reach.

Exact copies meet first: one row for each distinct fingerprint. A pivot table then holds, for each of them,
its Hamming distances to reference fingerprints. By the triangle inequality, the distances of a linked pair
to any reference differ by ``REACH`` at most: a row is only held against those whose first distance is that near its own, a pair
whose largest coordinate difference is greater is discarded, and the others are verified bit by bit. Pivot distances of far-apart fingerprints are too alike to
be a join key, so pairs meet in buckets instead: of ``m`` blocks of bits, a linked pair has all but REACH equal,
and every choice of that many blocks is one bucket key. ``m`` grows with the number of fingerprints, which keeps
buckets small; any ``m`` finds every link. Buckets over ``BUCKET`` rows are dealt out as pairs of their parts.

A bucket gives a spanning forest of its links, never all of its pairs. Components then come from rounds of
taking the least neighbour and jumping to its own least neighbour; each round is a checkpoint.

Defined cases: a null or blank text has no shingle and the fingerprint zero, which links like any other; a text
of fewer words than a shingle is one shingle; repeated rows and ids are kept row by row; a component without any
non-null id has the id null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Most differing bits of a link.
REACH = 3
#: Rows of a bucket that one task compares; larger buckets are dealt out in parts of this size.
BUCKET = 4096
#: Shingles of the texts of a bucket that one task compares.
HEAVY = 4_000_000
#: Reference fingerprints, eight to each packed long.
PIVOTS = 16


def references(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: hashes of their numbers."""
    return [xxhash.xxh64_intdigest(str(k), 7) for k in range(n)]


def majority(hashes: np.ndarray) -> bytes:
    """Of rows of hashes, the bits that are set in over half the rows. Up to 255 rows are summed in bytes at a time."""
    width = hashes.shape[1] * 64
    ones = np.zeros(width, np.int64)
    for at in range(0, len(hashes), 255 * 16):
        part = hashes[at : at + 255 * 16].astype(">u8").view(np.uint8)
        bits = np.unpackbits(part, axis=1)
        whole = len(bits) // 255
        if whole:
            ones += bits[: whole * 255].reshape(whole, 255, width).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole * 255 :].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprint(text: str | None, words: int) -> int:
    """The fingerprint of a text over shingles of so many words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = [b" ".join(tokens)] if len(tokens) < words else map(b" ".join, zip(*(tokens[k:] for k in range(words))))
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
    return int.from_bytes(majority(hashes[:, None]), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                made = [signed(fingerprint(t.as_py(), words)) for t in batch["text"]]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(made, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def pivot_table(fps: DataFrame) -> DataFrame:
    """The fingerprints with their distances to the references, eight bytes to each of the columns p0, p1, ..."""
    far = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(r)))).cast("long") for r in references()]
    packed = []
    for k in range(0, PIVOTS, 8):
        value = F.lit(0).cast("long")
        for j, d in enumerate(far[k : k + 8]):
            value = value.bitwiseOR(F.shiftleft(d, 8 * j))
        packed.append(value.alias(f"p{k // 8}"))
    return fps.select("*", *packed)


def blocks_for(n: int) -> int:
    """Blocks of bits so that a bucket of evenly spread fingerprints has few rows."""
    return next((m for m in range(4, 9) if 2 ** (64 * (m - REACH) / m) >= n / 8), 9)


def _bucket_keys(fp: Column, m: int) -> Column:
    """One key for each choice of m - REACH of the m blocks: the choice's number hashed with their bits."""
    edges = [64 * k // m for k in range(m + 1)]
    masks = [((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in range(m)]
    choices = [signed(sum(masks[k] for k in c)) for c in combinations(range(m), m - REACH)]
    return F.explode(F.array(*(F.struct(F.lit(k).cast("short").alias("choice"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("bits")) for k, mask in enumerate(choices))))


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows (fp, pivot bytes) of two equally long tables link: the pivot test first, then the bits of what is left."""
    near = np.abs(a["p"].astype(np.int16) - b["p"].astype(np.int16)).max(axis=-1) <= REACH
    out = np.zeros(len(near), bool)
    at = np.flatnonzero(near)
    out[at] = np.bitwise_count(a["fp"][at] ^ b["fp"][at]) <= REACH
    return out


def _forest(rows: np.ndarray, close, left: int | None = None, reach: int | None = None) -> list[tuple[int, int]]:
    """Links that connect what links within a bucket connect, fewer than rows. With ``left``, only rows before and after that place are compared.

    Search from one row at a time: those it reaches leave the rest at once, so a dense group costs about one comparison for each of its rows.
    With ``reach``, rows are in order of their distance to the first pivot, and only those within reach of a row's own are looked at.
    """
    links = []
    pivot = rows["p"][:, 0].astype(np.int64)
    sort = (lambda x: x[np.argsort(pivot[x], kind="stable")]) if reach is not None else (lambda x: x)
    sides = [sort(np.arange(len(rows)))] if left is None else [sort(np.arange(left)), sort(np.arange(left, len(rows)))]
    while all(len(x) for x in sides):
        frontier, sides[0] = [(0, int(sides[0][0]))], sides[0][1:]
        while frontier:
            side, k = frontier.pop()
            other = side if left is None else 1 - side
            rest, low, high = sides[other], 0, len(sides[other])
            if reach is not None:
                low, high = np.searchsorted(pivot[rest], [pivot[k] - reach, pivot[k] + reach + 1])
            near = rest[low:high]
            if len(near):
                hit = close(rows[near], np.broadcast_to(rows[k : k + 1], len(near)))
                found = near[hit].tolist()
                links += [(k, j) for j in found]
                frontier += [(other, j) for j in found]
                sides[other] = np.concatenate([rest[:low], near[~hit], rest[high:]]) if found else rest
    return links


ROW = np.dtype([("fp", np.uint64), ("p", np.uint8, (PIVOTS,))])
BUCKETS = ("choice", "bits", "part_a", "part_b")


def _fp_rows(batch) -> np.ndarray:
    rows = np.empty(batch.num_rows, ROW)
    rows["fp"] = batch["fp"].to_numpy().view(np.uint64)
    packed = np.stack([batch[f"p{k}"].to_numpy() for k in range(PIVOTS // 8)], axis=1)
    rows["p"] = np.ascontiguousarray(packed).view(np.uint8)
    return rows


def _runs(batches, table, name: str):
    """(key, rows, part, node) of whole runs of equal bucket columns, by which the input is sorted; ``table`` makes comparable rows of a batch, ``name`` is the column of the nodes."""
    held = None
    for batch in batches:
        key = np.rec.fromarrays([batch[k].to_numpy(zero_copy_only=False) for k in BUCKETS], names=list(BUCKETS))
        now = key, table(batch), batch["part"].to_numpy(), np.array(batch[name].to_pylist(), object)
        if held is not None:
            now = tuple(np.concatenate([x, y]) for x, y in zip(held, now, strict=True))
        key = now[0]
        last = np.flatnonzero(key[1:] != key[:-1])
        at = int(last[-1]) + 1 if len(last) else 0  # the last run may go on in the next batch
        if at:
            yield tuple(x[:at] for x in now)
        held = tuple(x[at:] for x in now)
    if held is not None and len(held[0]):
        yield held


def _sides(key, part):
    """(places, how many of them come first) of each run of over one row; only rows of the two sides are compared if it is of two parts, else the second is None."""
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    for a, n in zip(new.tolist(), np.diff(np.r_[new, len(key)]).tolist(), strict=True):
        order, left = np.arange(a, a + n), None
        if key["part_a"][a] != key["part_b"][a]:
            first = part[a : a + n] == key["part_a"][a]
            order, left = order[np.argsort(~first, kind="stable")], int(first.sum())
        if n > 1:
            yield order, left


def _links_of(table, close, name: str, kind, reach: int | None = None):
    """Links within runs of equal bucket columns, by which the input is sorted. A run is bounded by twice BUCKET rows.

    ``table`` makes comparable rows of a batch, ``close`` compares them, ``name`` is the column of the linked nodes.
    """

    def found(key, rows, part, node) -> list[tuple]:
        out = []
        two = [order for order, left in _sides(key, part) if len(order) == 2 and left is None]
        if two:
            pairs = np.array(two)
            hit = pairs[close(rows[pairs[:, 0]], rows[pairs[:, 1]])]
            out += [(node[j], node[k]) for j, k in hit.tolist()]
        for order, left in _sides(key, part):
            if len(order) > 2 or left is not None:
                out += [(node[order[x]], node[order[y]]) for x, y in _forest(rows[order], close, left, reach)]
        return out

    def run(batches):
        for runs in _runs(batches, table, name):
            links = found(*runs)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], kind) for k in (0, 1)], ["a", "b"])

    return run


def _parts(rows: DataFrame, by: str, weight: str | None = None) -> DataFrame:
    """Rows of buckets (choice, bits) with more than one row, with their parts.

    A bucket of over BUCKET rows, or of over HEAVY in the sum of ``weight``, is cut in parts of about half of that by a hash of ``by``, and each pair of parts meets once.
    """
    heavy = F.lit(0) if weight is None else F.sum(weight) / HEAVY
    sizes = rows.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("rows_in"), heavy.alias("heavy")).where("rows_in > 1")
    full = F.least(F.greatest(F.col("rows_in") / BUCKET, F.col("heavy")), F.col("rows_in"))
    parts = F.when(full > 1, F.ceil(full * 2)).otherwise(1).cast("int").alias("parts")
    sized = rows.join(sizes.select("choice", "bits", parts), ["choice", "bits"])
    return (
        sized.withColumn("part", F.pmod(F.xxhash64(by), F.col("parts").cast("long")).cast("int"))
        .select(*rows.columns, "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select(*rows.columns, "part", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"))
    )


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with their parts, sorted by bucket and part."""
    return rows.repartition(*BUCKETS).sortWithinPartitions(*BUCKETS)


def links(fps: DataFrame, n: int) -> DataFrame:
    """(a, b): links between the given distinct fingerprints, enough of them to connect whatever all links connect."""
    rows = pivot_table(fps.select("fp")).select("*", _bucket_keys(F.col("fp"), blocks_for(n)).alias("key")).select("*", "key.*").drop("key")
    return _dealt(_parts(rows, "fp")).mapInArrow(_links_of(_fp_rows, _linked, "fp", pa.int64(), REACH), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of an edge reaches; signed order of the nodes.

    Each round joins every node to the least one among itself and its neighbours, with the edges contracted
    to their roots; the number of edges falls fast, and rounds end when none is left.
    """
    edges = cut(edges)
    found = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        # a node that isn't its own least is linked to a lower one; two jumps shorten the chains
        least = cut(least)
        for _ in range(2):
            up = least.select(F.col("node").alias("to"), F.col("to").alias("further"))
            least = least.join(up, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
        least = cut(least)
        if found is None:
            found = least.select("node", F.col("to").alias("root"))
        else:
            found = found.join(least.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        found = cut(found)
        a, b = (least.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to")) for x in ("a", "b"))
        edges = cut(
            edges.join(a, "a")
            .join(b, "b")
            .where(F.col("a_to") != F.col("b_to"))
            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
            .distinct()
        )
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def clusters(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row: the least id of its component."""
    prints = cut(fingerprints(docs, words))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, distinct.count()))
    joined = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    owner = joined.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(owner, "fp", "left").select("doc_id", "fp", "component_id")


#: Longs of a wide fingerprint, bands of least hashes and hashes in each: a pair of similarity 0.8 shares no band once in 3 * 10^7 times.
WIDE, BANDS, BAND = 16, 24, 3
#: Standard deviations of its estimate by which a pair may miss the similarity and still be compared, and the fewest shingles of both for an estimate.
SLACK, ESTIMATED = 6, 256
SKETCH = "doc_id long, row_key long, row_more long, content binary, n_shingles long, wide binary, bands array<long>"
WIDE_ROW = np.dtype([("fp", np.uint64, (WIDE,)), ("p", np.int16, (PIVOTS,)), ("n", np.int64), ("set", object), ("band", np.int16), ("bands", np.int64, (BANDS,))])


def _mixers(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(seed)).integers(1, 1 << 63, (n, 2), dtype=np.uint64) | np.uint64(1)


def _mixed(hashes: np.ndarray, mixers: np.ndarray) -> np.ndarray:
    """Independent hashes of hashes, a column for each mixer."""
    out = (hashes[:, None] ^ mixers[:, 0]) * mixers[:, 1]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _shingles(tokens: list[bytes], words: int) -> np.ndarray:
    """The hashes of the different shingles of a text."""
    shingles = {b" ".join(tokens)} if len(tokens) < words else set(map(b" ".join, zip(*(tokens[k:] for k in range(words)))))
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))


class _Set:
    """The shingles of a text as sorted hashes, made when first asked for."""

    def __init__(self, text: str | None, words: int):
        self.text, self.words, self.made = text, words, None

    def hashes(self) -> np.ndarray:
        if self.made is None:
            self.made = np.sort(_shingles((self.text or "").encode().lower().split(), self.words))
            self.text = None
        return self.made


def row_keys() -> tuple[Column, Column]:
    """128 bits of a row's id and text in two columns, by which rows are told apart."""
    return F.xxhash64("doc_id", "text").alias("row_key"), F.xxhash64(F.lit(1), "doc_id", "text").alias("row_more")


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """Of each row: a digest of its words, the number of its different shingles, their wide fingerprint and bands of least hashes."""
    wide_of, least_of = _mixers(WIDE, 11), _mixers(BANDS * BAND, 12)

    def one(text: str | None):
        tokens = (text or "").encode().lower().split()
        content = xxhash.xxh3_128_digest(b" ".join(tokens))
        hashes = _shingles(tokens, words)
        least = np.full(BANDS * BAND, np.uint64(2**64 - 1))
        for at in range(0, len(hashes), 4096):
            least = np.minimum(least, _mixed(hashes[at : at + 4096], least_of).min(axis=0))
        bands = [signed(xxhash.xxh64_intdigest(x.tobytes(), k)) for k, x in enumerate(least.reshape(BANDS, BAND))]
        return content, len(hashes), majority(_mixed(hashes, wide_of)), bands

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                made = [one(t.as_py()) for t in batch["text"]]
                kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["row_key"], batch["row_more"], *(pa.array([x[k] for x in made], kind) for k, kind in enumerate(kinds))],
                    ["doc_id", "row_key", "row_more", "content", "n_shingles", "wide", "bands"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(), "text")
    return rows.mapInArrow(run, SKETCH)


def _wide_rows(batch, words: int) -> np.ndarray:
    rows = np.empty(batch.num_rows, WIDE_ROW)
    rows["fp"] = np.frombuffer(b"".join(batch["wide"].to_pylist()), np.uint64).reshape(-1, WIDE)
    far = [[xxhash.xxh3_128_digest(str(k), 100 + j) for j in range(WIDE // 2)] for k in range(PIVOTS)]
    pivots = np.frombuffer(b"".join(b"".join(x) for x in far), np.uint64).reshape(PIVOTS, WIDE)
    for k in range(PIVOTS):
        rows["p"][:, k] = np.bitwise_count(rows["fp"] ^ pivots[k]).sum(axis=1)
    rows["n"] = batch["n_shingles"].to_numpy()
    rows["band"] = batch["choice"].to_numpy()
    rows["bands"] = batch["bands"].flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
    rows["set"] = [_Set(t, words) for t in batch["text"].to_pylist()] if "text" in batch.schema.names else None
    return rows


def _maybe_alike(similarity: float):
    """Whether two shingle sets may have a Jaccard similarity of at least this, and no band before this one has them both; and how many shingles they must share.

    The sets' sizes bound the similarity from above. Differing bits of wide fingerprints measure the angle between the sets: a pair that is
    SLACK deviations off is left out, pivot distances first, as they bound the differing bits from below.
    """
    bits = WIDE * 64
    number = np.arange(BANDS)

    def close(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = a["n"].astype(float), b["n"].astype(float)
        shared = similarity * (x + y) / (1 + similarity)
        angle = np.arccos(np.minimum(shared / np.sqrt(np.maximum(x * y, 1e-9)), 1)) / np.pi
        most = np.where(np.minimum(x, y) >= ESTIMATED, bits * angle + SLACK * np.sqrt(bits * np.maximum(angle * (1 - angle), 1 / bits)), bits)
        out = (np.minimum(x, y) >= shared - 1e-9) & (np.abs(a["p"] - b["p"]).max(axis=-1) <= most)
        at = np.flatnonzero(out)
        at = at[np.bitwise_count(a["fp"][at] ^ b["fp"][at]).sum(axis=-1) <= most[at]]
        at = at[~((a["bands"][at] == b["bands"][at]) & (number < a["band"][at, None])).any(axis=-1)]
        out[:] = False
        out[at] = True
        return out, shared

    return close


def _alike(similarity: float):
    """Whether the Jaccard similarity of two shingle sets is at least this: those that may be so alike are intersected, each pair in the first band that has both."""
    maybe = _maybe_alike(similarity)

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, shared = maybe(a, b)
        for k in np.flatnonzero(out).tolist():
            both = len(np.intersect1d(a["set"][k].hashes(), b["set"][k].hashes(), assume_unique=True))
            out[k] = both >= shared[k] - 1e-9
        return out

    return close


def _partnered(words: int, similarity: float):
    """The rows of buckets that may be alike to another of their bucket; texts aren't needed for that."""
    maybe = _maybe_alike(similarity)

    def marked(key, rows, part) -> np.ndarray:
        out = np.zeros(len(rows), bool)
        for order, left in _sides(key, part):
            for k in range(len(order) - 1 if left is None else left):
                rest = order[k + 1 :] if left is None else order[left:]
                if out[order[k]]:
                    rest = rest[~out[rest]]
                if len(rest):
                    hit = rest[maybe(np.broadcast_to(rows[order[k] : order[k] + 1], len(rest)), rows[rest])[0]]
                    out[hit] = True
                    out[order[k]] |= len(hit) > 0
        return out

    def run(batches):
        names = ["content", *BUCKETS, "part"]
        kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        for key, rows, part, node in _runs(batches, lambda batch: _wide_rows(batch, words), "content"):
            kept = np.flatnonzero(marked(key, rows, part))
            columns = [node[kept], *(key[c][kept] for c in BUCKETS), part[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


MET = "content binary, choice int, bits long, part_a int, part_b int, part int"


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of texts whose word shingles are alike, directly or by others: the one with the least id.

    At this similarity too many bits differ for blocks of equal bits, and for pivots to tell pairs apart, so texts meet in
    bands of least hashes of their shingles; pivots and wide fingerprints discard pairs, and the shingles themselves decide.
    All columns are kept. Texts of the same words are one content from the start. Equal rows fall together.
    """
    made = cut(sketches(docs, words))
    key = ["row_key", "row_more"]
    row = F.struct("doc_id", *key)
    contents = cut(made.groupBy("content").agg(F.min(row).alias("least"), *(F.first(c).alias(c) for c in ("n_shingles", "wide", "bands"))))
    met = _parts(contents.select("content", "n_shingles", F.posexplode("bands").alias("choice", "bits")), "content", "n_shingles").drop("n_shingles")
    measures = contents.select("content", "n_shingles", "wide", "bands")
    # a text goes only to the buckets that are the first to have it and one that may be alike
    wanted = cut(_dealt(met.join(measures, "content")).mapInArrow(_partnered(words, similarity), MET))
    own = contents.join(wanted.select("content").distinct(), "content", "left_semi").select("content", "n_shingles", "wide", "bands", *(F.col(f"least.{c}").alias(c) for c in key))
    own = own.join(docs.select(*row_keys(), "text"), key).groupBy("content").agg(*(F.first(c).alias(c) for c in ("n_shingles", "wide", "bands", "text")))
    found = _links_of(lambda batch: _wide_rows(batch, words), _alike(similarity), "content", pa.binary())
    edges = _dealt(wanted.join(own, "content")).mapInArrow(found, "a binary, b binary").distinct()
    roots = components(edges)
    least = (
        contents.select("content", "least")
        .join(roots, F.col("content") == F.col("node"), "left")
        .groupBy(F.coalesce("root", "content").alias("root"))
        .agg(F.min("least").alias("least"))
        .select(*(F.col(f"least.{c}").alias(c) for c in key))
    )
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("_row"), *row_keys())
    place = F.row_number().over(Window.partitionBy(*key).orderBy("row_key"))
    return rows.join(least.distinct(), key, "left_semi").withColumn("_place", place).where("_place = 1").select("_row.*")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Fingerprints and components of all documents."""
    return clusters(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
