"""Mixing sources to target weights by blocks of words.

The words of a source, text after text, are a stream that is cut in blocks of one length. Every output shard
draws how many of its slots each source fills, from a multinomial law under the condition that the totals of
all shards come to the sources' targets; it does so alone, by walking down a tree of seeded draws. The slots of a source
are numbered through all shards; a slot's number goes through a pseudorandom permutation of the source's blocks, a
new one for each pass over the source, and the blocks are joined by their number. All blocks have one length but for the
last of a source; the last slot of a source takes only as many words as its target still lacks.

Positions in a stream are sums over hashed chunks of rows plus sums within a chunk, so no source is ordered
in one task. All draws depend on the seed and the row contents alone: reruns agree.

Defined cases: a null or blank text has no word, and nothing of it is taken; the null source is a source of its own,
last in order; null and repeated ids and repeated rows are kept row by row; ``_``-named extra columns
are ignored; an empty table gives an empty mix. The driver and the tasks that draw hold one small row for each source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, cut, let, words

SEED = 20260
#: Words of a block.
BLOCK = 128
#: Slots of an output shard.
SHARD = 4096
#: Sources whose table is broadcast; more are joined by a shuffle.
FEW_SOURCES = 10_000
#: Items of an urn from which numpy draws without replacement.
URN = 10**9
#: Weights of the sources in order, repeating, and the words taken as a multiple of all words.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Rows of a chunk, about, and the most chunks that there are of a source.
CHUNK, MAX_CHUNKS = 256, 1 << 16


def water_fill(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is over goes to the others by weight."""
    targets = [0.0] * len(sizes)
    free = set(range(len(sizes)))
    left = total
    while free:
        weight = sum(weights[k] for k in sorted(free))
        over = [k for k in sorted(free) if left * weights[k] / weight > most * sizes[k]]
        if not over:
            for k in free:
                targets[k] = left * weights[k] / weight
            break
        for k in over:
            targets[k] = most * sizes[k]
        left -= sum(targets[k] for k in over)
        free -= set(over)
    return targets


@dataclass(frozen=True)
class Source:
    """One source of the mix: its words and rows, its target, the number of its blocks, the slots that it fills, and the words that its last slot takes."""

    number: int
    name: str | None
    size: int
    rows: int
    target: float
    blocks: int
    slots: int
    last: int


def _slots_of(number: int, size: int, words: int, block: int = BLOCK) -> tuple[int, int]:
    """(slots, words of the last one) that take so many words of a source: whole passes, then blocks in the order of one more pass."""
    blocks = -(-size // block)
    passes, rest = divmod(words, size) if size else (0, 0)
    if not rest:
        return passes * blocks, block
    short = size - (blocks - 1) * block
    first = -(-rest // block)
    place = place_of(blocks - 1, blocks, number, passes)
    full = rest - (first - 1) * block
    if place >= first or (place == first - 1 and full <= short):
        return passes * blocks + first, full
    others = -(-(rest - short) // block)  # the short block is among the first ones, so that one more may be needed
    return passes * blocks + 1 + others, rest - short - (others - 1) * block


def plan(totals, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[Source]:
    """The sources in order of code points, null last, from (name, words, rows)."""
    rows = sorted(totals, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
    targets = water_fill([r[1] for r in rows], [weights[k % len(weights)] for k in range(len(rows))], share * sum(r[1] for r in rows), most)
    found = []
    for k, ((name, size, count), target) in enumerate(zip(rows, targets, strict=True)):
        filled, last = _slots_of(k, size, min(round(target), int(most * size)))
        found.append(Source(k, name, size, count, target, -(-size // BLOCK), filled, last))
    return found


def _rng(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([SEED, *key])))


def _log_share(k: float, n: float, p: float) -> float:
    """Logarithm of the binomial probability of k out of n, by saddle points: no large terms cancel."""

    def stirling(x: float) -> float:
        return math.lgamma(x + 1) - ((x + 0.5) * math.log(x) - x + 0.5 * math.log(2 * math.pi)) if x < 16 else (1 / 12 - (1 / 360 - 1 / 1260 / x**2) / x**2) / x

    def deviance(x: float, mean: float) -> float:
        d = (x - mean) / mean
        # x log(x / mean) - x + mean, by its series near the mean
        return mean * (d * d / 2 - d**3 / 6 + d**4 / 12 - d**5 / 20) if abs(d) < 1e-3 else x * math.log(x / mean) - x + mean

    if k < 0 or k > n:
        return -math.inf
    if k == 0 or k == n:
        return n * math.log(1 - p if k == 0 else p)
    return stirling(n) - stirling(k) - stirling(n - k) - deviance(k, n * p) - deviance(n - k, n * (1 - p)) + 0.5 * math.log(n / (2 * math.pi * k * (n - k)))


def _drawn(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn without replacement are good.

    Beyond numpy's range, each item is drawn with the same chance of its own, under the condition that ``n`` are: the number of one
    kind is proposed, and kept by how likely the other kind makes up the rest. That is the same law.
    """
    if min(good, n) == 0:
        return 0
    if bad == 0 or n == good + bad:
        return min(n, good)
    if good + bad < URN:
        return int(rng.hypergeometric(good, bad, n))
    few, many = min(good, bad), max(good, bad)
    p = n / (good + bad)
    mode = min(max(math.floor((many + 1) * p), 0), many)
    best = _log_share(mode, many, p)
    while True:
        x = int(rng.binomial(few, p))
        if math.log(1 - rng.random()) <= _log_share(n - x, many, p) - best:
            return x if good <= bad else n - x


def shard_counts(shard: int, shards: int, slots: list[int], size: int = SHARD) -> tuple[list[int], list[int]]:
    """(slots that each source fills in a shard, those it fills in all shards before). Each node of the tree splits its counts by one seeded draw."""
    low, high, counts, before = 0, shards, list(slots), [0] * len(slots)
    while high - low > 1:
        middle = (low + high) // 2
        rng, need = _rng(1, low, high), min(sum(counts), (middle - low) * size)
        left, rest = [], sum(counts)
        for c in counts:
            rest -= c
            left.append(_drawn(rng, c, rest, need))
            need -= left[-1]
        if shard < middle:
            high, counts = middle, left
        else:
            low, before = middle, [b + x for b, x in zip(before, left, strict=True)]
            counts = [c - x for c, x in zip(counts, left, strict=True)]
    return counts, before


def _network(n: int, key: tuple[int, ...]):
    """(bits of a half, round function, keys) of four Feistel rounds on the least even number of bits that n places need."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = _rng(2, *key).integers(1, 1 << 62, 4, dtype=np.uint64) | np.uint64(1)

    def mixed(right: np.ndarray, k: np.uint64) -> np.ndarray:
        out = (right + np.uint64(0x9E3779B97F4A7C15)) * k
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return (out >> np.uint64(32)) & mask

    return np.uint64(half), mask, mixed, keys


def permuted(index: np.ndarray, n: int, *key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the given places: Feistel rounds, walked until in range."""
    half, mask, mixed, keys = _network(n, key)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ mixed(right, k)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def place_of(value: int, n: int, *key: int) -> int:
    """The place that ``permuted`` gives a value: the same rounds backwards."""
    half, mask, mixed, keys = _network(n, key)
    out = np.array([value], np.uint64)
    while True:
        left, right = out >> half, out & mask
        for k in keys[::-1]:
            left, right = right ^ mixed(left, k), left
        out = (left << half) | right
        if out[0] < n:
            return int(out[0])


def slots(spark, sources: list[Source]) -> DataFrame:
    """(shard, slot, number, block, words): which block of which source each slot of the mix takes, and how many of its words at most."""
    total = sum(s.slots for s in sources)
    shards = -(-total // SHARD)

    def run(batches):
        for batch in batches:
            for shard in batch["id"].to_pylist():
                counts, before = shard_counts(shard, shards, [s.slots for s in sources])
                number = np.repeat(np.arange(len(sources)), counts)
                block, words_of = np.empty(len(number), np.int64), np.full(len(number), BLOCK)
                at = 0
                for s, n, b in zip(sources, counts, before, strict=True):
                    places = np.arange(b, b + n)
                    for turn in np.unique(places // s.blocks) if n else ():
                        here = places // s.blocks == turn
                        block[at : at + n][here] = permuted(places[here] % s.blocks, s.blocks, s.number, int(turn))
                    words_of[at : at + n][places == s.slots - 1] = s.last
                    at += n
                order = _rng(3, shard).permutation(len(number))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(order), shard), pa.int64()),
                        pa.array(np.arange(len(order)), pa.int32()),
                        pa.array(number[order], pa.int32()),
                        pa.array(block[order], pa.int64()),
                        pa.array(words_of[order], pa.int32()),
                    ],
                    ["shard", "slot", "number", "block", "words"],
                )

    # the planner takes the slots for as few as the shards: whoever joins them asks for a merge join
    parts = max(1, min(shards, 4 * spark.sparkContext.defaultParallelism * (1 + shards // 10_000)))
    return spark.range(0, shards, 1, parts).mapInArrow(run, "shard long, slot int, number int, block long, words int")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sources_of(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[Source]:
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    return plan([(r["source"], r["size"], r["n"]) for r in totals], weights, share, most)


SOURCE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("number", T.IntegerType()),
        T.StructField("chunks", T.IntegerType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()),
    ]
)


def _with_source(sized: DataFrame, sources: list[Source]) -> DataFrame:
    """The rows with what is known of their source; a table of at most FEW_SOURCES rows is broadcast."""
    table = [(s.name, s.number, min(MAX_CHUNKS, -(-s.rows // CHUNK)), s.size, s.target) for s in sources]
    known = sized.sparkSession.createDataFrame(table, SOURCE).withColumnRenamed("source", "_name")
    known = F.broadcast(known) if len(sources) <= FEW_SOURCES else known.hint("merge")
    return sized.join(known, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")


def positions(sized: DataFrame, sources: list[Source]) -> DataFrame:
    """The rows with their source's number, words and target, and ``start``, where their words begin in its stream.

    The rows of a source are dealt to chunks by a hash of their contents and ordered in a chunk by that hash.
    Equal rows may change places, which changes nothing. The table of chunks has at most about
    MAX_CHUNKS rows for a source, whatever the input.
    """
    rows = _with_source(sized, sources).withColumn("chunk", F.pmod("row_hash", "chunks").cast("int"))
    sums = rows.groupBy("number", "chunk").agg(F.sum("size").alias("words_in"))
    before = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("number", "chunk", F.coalesce(F.sum("words_in").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("number", "chunk").orderBy("row_hash", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return inside.join(sums, ["number", "chunk"]).withColumn("start", F.col("base") + F.col("inside")).drop("chunk", "chunks", "base", "inside")


def segments(placed: DataFrame, *keep: str, text: Column | None = None) -> DataFrame:
    """One row for each part of a row's words in one block: ``block``, ``first_word`` in the row, ``n_words``, ``place`` in the block and, of ``text``, the ``passage``.

    Rows without words get one row without a block.
    """
    start, size, length = F.col("start"), F.col("size"), F.lit(BLOCK).cast("long")

    def part(block: Column, tokens: Column | None) -> Column:
        first = F.greatest(block * length - start, F.lit(0))
        count = F.least((block + 1) * length - start, size) - first
        more = [] if tokens is None else [F.array_join(F.slice(tokens, (first + 1).cast("int"), count.cast("int")), " ").alias("passage")]
        return F.struct(block.alias("block"), first.alias("first_word"), count.alias("n_words"), (start + first - block * length).alias("place"), *more)

    blocks = F.when(size > 0, F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}")))
    parts = F.transform(blocks, lambda b: part(b, None)) if text is None else let(words(text), lambda w: F.transform(blocks, lambda b: part(b, w)))
    return placed.select(*keep, F.explode_outer(parts).alias("_part")).select(*keep, "_part.*")


def _measured(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, words and a hash of the contents of each row, and the named columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", "source").alias("row_hash"), *keep)


def _within(words: Column) -> Column:
    """How many words of a part lie among the first so many words of its block."""
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("n_words"), words - F.col("place")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix: (shard, slot, source, block, first_word, n_words, doc_id, text), a row for each part of a text in a slot."""
    rows = _measured(docs, "text")
    sources = sources_of(cut(rows.select("source", "size")), weights, share, most)
    parts = segments(positions(rows, sources), "number", "source", "doc_id", text=F.col("text")).where(F.col("n_words") > 0)
    taken = slots(docs.sparkSession, sources)
    met = parts.join(taken.hint("merge"), ["number", "block"]).withColumn("_n", _within(F.col("words"))).where(F.col("_n") > 0)
    passage = F.when(F.col("_n") == F.col("n_words"), F.col("passage")).otherwise(F.array_join(F.slice(words(F.col("passage")), F.lit(1), F.col("_n").cast("int")), " "))
    return met.select("shard", "slot", "source", "block", "first_word", F.col("_n").alias("n_words"), "doc_id", passage.alias("text"))


def _times(spark, sources: list[Source]) -> DataFrame:
    """(number, block, times, part): how often each block is taken as a whole, and how many of its words once more."""
    whole = F.col("words") == BLOCK
    return (
        slots(spark, sources)
        .groupBy("number", "block")
        .agg(F.count_if(whole).cast("int").alias("times"), F.coalesce(F.max(F.when(~whole, F.col("words"))), F.lit(0)).alias("part"))
    )


def shares(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row: how many of its words the mix takes."""
    rows = cut(_measured(docs))
    sources = sources_of(rows, weights, share, most)
    fixed = ("number", "start", "doc_id", "size", "source_size", "target")
    parts = segments(positions(rows, sources), *fixed)
    taken = _times(docs.sparkSession, sources)
    # rows with words differ in their start; equal rows without words fall together, are counted and repeated
    return (
        parts.join(taken.hint("merge"), ["number", "block"], "left")
        .groupBy(*fixed)
        .agg(
            F.sum(F.coalesce(F.col("n_words") * F.col("times") + _within(F.col("part")), F.lit(0))).cast("long").alias("taken"),
            F.sum(F.when(F.col("size") == 0, 1).otherwise(0)).alias("copies"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("copies"), F.lit(1)))))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The documents as the mix takes them, with all of their columns.

    A row's text is made of the parts that slots take, in order, once for each pass; rows of which nothing is taken
    go. ``n_chars``, if there, is counted anew. The texts are shuffled once, to meet the lists of their parts.
    """
    names = docs.columns
    more = F.xxhash64(F.lit(1), "doc_id", "text", "source").alias("row_more")  # with row_hash, 128 bits of a row's contents
    rows = docs.select(F.struct(*names).alias("_row"), F.xxhash64("doc_id", "text", "source").alias("row_hash"), more)
    sized = cut(_measured(docs, more))
    sources = sources_of(sized, weights, share, most)
    parts = segments(positions(sized, sources), "number", "start", "row_hash", "row_more").where(F.col("n_words") > 0)
    times = _times(docs.sparkSession, sources)
    # equal rows have a list of parts each, and take them in order of their start
    plans = (
        parts.join(times.hint("merge"), ["number", "block"])
        .groupBy("row_hash", "row_more", "start")
        .agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words", "times", _within(F.col("part")).alias("more")))).alias("parts"))
        .withColumn("copy", F.row_number().over(Window.partitionBy("row_hash", "row_more").orderBy("start")))
    )
    numbered = rows.withColumn("copy", F.row_number().over(Window.partitionBy("row_hash", "row_more").orderBy("row_hash")))

    def passages(w: Column) -> Column:
        def turn(k: int) -> Column:
            sized = F.transform("parts", lambda p: F.struct(p["first_word"].alias("at"), F.when(p["times"] >= k, p["n_words"]).when(p["times"] == k - 1, p["more"]).otherwise(0).alias("n")))
            return F.transform(F.filter(sized, lambda p: p["n"] > 0), lambda p: F.array_join(F.slice(w, (p["at"] + 1).cast("int"), p["n"].cast("int")), " "))

        return F.array_join(F.concat(*(turn(k) for k in range(1, int(most) + 1))), " ")

    text = let(words(F.col("_row.text")), passages)
    made = numbered.join(plans.select("row_hash", "row_more", "copy", "parts").hint("merge"), ["row_hash", "row_more", "copy"]).select("_row", text.alias("_text"))
    fresh = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return made.select(*(fresh[c].alias(c) if c in fresh else F.col(f"_row.`{c}`").alias(c) for c in names))
