"""Class-based bigram scores of texts.

Word counts are sums over all training texts. Classes are learned in three steps. Exchange clustering moves units
between classes as long as that raises the likelihood of the class bigrams of the whole training text; its units are
the most frequent words, one each, and groups of all other words by a hash of their last bytes. Then each
frequent word that has no unit of its own goes to the class that its own neighbours make likeliest, one exchange move against the
classes that were found. Then the exchange goes on over all frequent words, those with units too: in each sweep half of them move at once,
as one job over the training text, and a sweep that doesn't raise the likelihood is given back. What is left are rare and unseen
words, which have the class of their group. A token's probability is that of
its class after the class before it, times that of the word in its class, smoothed by half a count with one place in each class for
unknown words.

The training texts are tokenized twice, for the counts and to write them as numbers of words; all sums over pairs are read from these numbers.

What comes to the driver is bounded: UNITS squared sums and at most KNOWN frequent words with their classes, which are
broadcast. The counts of all other words stay a table, and texts meet it in a join by word; as frequent words never take
part in it, it has no hot key.

Defined cases: a null or blank text is its end token; rows are scored one by one, repeated or not; extra columns
are ignored; an empty table gives an empty result; without training texts every word is unknown; of equally likely classes
the first is taken.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, remove, shared_folder

#: Units in all, those that are one word each, and classes. The last unit and the last class are the end's.
UNITS, OWN, CLASSES = 2304, 2048, 64
END = UNITS - 1
#: Bytes at the end of a word that choose its unit.
TAIL = 3
#: Frequent words that every worker holds with their counts, at most.
KNOWN = 200_000
#: Entries that a worker's counters and caches hold before they are emptied.
HELD = 300_000
#: Counts by which class transitions are drawn to the classes' own shares.
PULL = 50.0
#: Sweeps of the exchange over all units, at most; after these, sweeps over halves of the frequent words, at most.
SWEEPS, WIDE_SWEEPS = 8, 4
#: Tokens or pairs that a worker gathers before it sums them up.
GATHERED = 1 << 21
#: Pairs of tokens in a row of numbers.
ROW = 1 << 18


def tokens(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(different words, the number of each token's word, tokens of each text) of an array of texts."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full).as_py():  # blanks at the ends of a text make empty words
        owner = np.repeat(np.arange(len(texts)), lengths)[full.to_numpy(zero_copy_only=False)]
        flat, lengths = flat.filter(full), np.bincount(owner, minlength=len(texts))
    coded = flat.dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False), lengths


def slices(batch: pa.RecordBatch, rows: int = 2048):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _group(word: bytes) -> int:
    """The unit that a word shares with others of its last bytes."""
    return OWN + zlib.crc32(word[-TAIL:]) % (END - OWN)


class Numbers(dict):
    """Numbers of words as they are asked for: the place of a frequent word; after these, one for each group of other words."""

    def __init__(self, words: list[bytes]):
        super().__init__()
        self.known = {w: k for k, w in enumerate(words)}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        number = self.known.get(word)
        if number is None:
            number = len(self.known) + _group(word) - OWN
        self[word] = number
        return number


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n): how often each word is in the training texts; the ends are left out."""

    def run(batches):
        held: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch):
                words, number, _ = tokens(part["text"])
                for word, n in zip(words, np.bincount(number, minlength=len(words)).tolist(), strict=True):
                    held[word] += n
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        yield rows()

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> tuple[int, list[tuple[bytes, int]]]:
    """(least count, the words that have it), at most so many: the least count is read from a histogram, no order of all words is made."""
    step = F.floor(F.log2("n") * 16).cast("int")
    histogram = sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect(), key=lambda r: -r["step"])
    least, total = (1 << 62), 0
    for r in histogram:
        total += r["words"]
        if total > most:
            break
        least = r["least"]
    rows = counts.where(F.col("n") >= least).toArrow()
    return least, sorted(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def _streams(batches, end: int, number_of):
    """Arrays of the numbers of the tokens of many texts, the end before and after each text."""
    held: list[np.ndarray] = [np.array([end])]
    for batch in batches:
        for part in slices(batch):
            words, number, lengths = tokens(part["text"])
            numbers = np.fromiter(map(number_of, words), np.int64, len(words))[number]
            held.append(np.insert(numbers, np.cumsum(lengths), end))
            if sum(map(len, held)) > GATHERED:
                yield np.concatenate(held)
                held = [np.array([end])]
    yield np.concatenate(held)


def write_numbers(train: DataFrame, words: list[bytes], path: str) -> DataFrame:
    """The training texts as numbers of words, an end before and after each text, written to the path and read again.

    A row has compressed numbers of at most ROW pairs and begins with the last number of the row before it, so that each pair is in one row.
    """
    shared = train.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for u in _streams(batches, len(shared.value) + END - OWN, Numbers(shared.value).__getitem__):
            for at in range(0, len(u) - 1, ROW):
                part = u[at : at + ROW + 1].astype(np.int32)
                yield pa.RecordBatch.from_pydict({"n": [len(part)], "numbers": [pa.compress(part, codec="zstd", asbytes=True)]})

    train.select("text").mapInArrow(run, "n long, numbers binary").write.option("compression", "none").parquet(path)
    shared.destroy()
    return train.sparkSession.read.schema("n long, numbers binary").parquet(path)


def _paths(batches):
    """The arrays of numbers that ``write_numbers`` wrote."""
    for batch in batches:
        for n, packed in zip(batch["n"].to_pylist(), batch["numbers"], strict=True):
            yield np.frombuffer(pa.decompress(packed.as_buffer(), 4 * n, codec="zstd"), np.int32)


def _gathered(arrays):
    """The arrays joined to fewer ones."""
    held: list[np.ndarray] = []
    for x in arrays:
        held.append(x)
        if sum(map(len, held)) > GATHERED:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def bigrams(numbers: DataFrame, size: int, kind_of: np.ndarray) -> np.ndarray:
    """How often each kind of word follows each other in the training texts; ``kind_of`` gives the kind of each number, of which there are ``size``."""
    kinds = numbers.sparkSession.sparkContext.broadcast(kind_of.astype(np.int32))

    def run(batches):
        cells = np.zeros(size * size, np.int64)
        for codes in _gathered(u[:-1] * size + u[1:] for u in (kinds.value[x] for x in _paths(batches))):
            cells += np.bincount(codes, minlength=len(cells))
        full = np.flatnonzero(cells)
        for at in range(0, max(1, len(full)), 1 << 18):
            part = full[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(cells[part], pa.int64())], ["cell", "n"])

    rows = numbers.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


def transitions(table: np.ndarray) -> np.ndarray:
    """Logarithms of the probability of each class after each other, drawn to the classes' own shares."""
    class_tokens = table.sum(axis=0)
    share = (class_tokens + 0.5) / (class_tokens.sum() + 0.5 * CLASSES)
    return np.log10((table + PULL * share) / (table.sum(axis=1, keepdims=True) + PULL))


def own_classes(numbers: DataFrame, moving: np.ndarray, begin: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each frequent word: for those that are moving the one that their neighbours make likeliest, for others the one they have.

    ``begin`` is the class of each number so far. A worker counts the classes before and after its words; the counts of a word meet, at most two for each class, and give its class.
    """
    n_words = len(moving)
    shared, moves = numbers.sparkSession.sparkContext.broadcast((begin.astype(np.int32), np.r_[moving, np.zeros(len(begin) - n_words, bool)])), transitions(table)
    in_class = np.log10(np.maximum(table.sum(axis=0), 0.5))

    def codes(batches):
        for x in _paths(batches):
            c, at = shared.value[0][x], np.where(shared.value[1][x], x, -1)
            after, before = np.flatnonzero(at[:-1] >= 0), np.flatnonzero(at[1:] >= 0)
            yield np.concatenate([at[after] * 2 * CLASSES + c[after + 1], at[before + 1] * 2 * CLASSES + CLASSES + c[before]])

    def count(batches):
        for code in _gathered(codes(batches)):
            found, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found // (2 * CLASSES), pa.int32()), pa.array((found % (2 * CLASSES)).astype(np.int16), pa.int16()), pa.array(n, pa.int32())], ["place", "cell", "n"]
            )

    def choose(batches):
        for batch in batches:
            lists = batch["cells"]
            rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            counts = np.zeros((len(lists), 2 * CLASSES))
            np.add.at(counts, (rows, flat.field("cell").to_numpy()), flat.field("n").to_numpy())
            after, before = counts[:, :CLASSES], counts[:, CLASSES:]
            gain = after @ moves.T + before @ moves - before.sum(axis=1, keepdims=True) * in_class
            gain[:, -1] = -np.inf
            yield pa.RecordBatch.from_arrays([batch["place"], pa.array(gain.argmax(axis=1), pa.int32())], ["place", "class"])

    out = begin[:n_words].astype(np.int64)
    if moving.any():
        met = numbers.mapInArrow(count, "place int, cell short, n int").repartition("place").groupBy("place", "cell").agg(F.sum("n").alias("n"))
        chosen = met.groupBy("place").agg(F.collect_list(F.struct("cell", "n")).alias("cells")).mapInArrow(choose, "place int, class int").toArrow()
        out[chosen["place"].to_numpy()] = chosen["class"].to_numpy()
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(table: np.ndarray) -> float:
    """What the classes add to the logarithm of the likelihood of the training texts, from the counts of their bigrams."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def swept(numbers: DataFrame, class_of: np.ndarray, groups: np.ndarray, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each frequent word, bigrams of classes) after sweeps in which every second frequent word moves, in turn, to its likeliest class.

    Words that move at once may spoil each other's moves: a sweep that doesn't raise the likelihood is given back and ends the exchange.
    """
    table = bigrams(numbers, CLASSES, np.r_[class_of, groups])
    for k in range(sweeps):
        moved = own_classes(numbers, np.arange(len(class_of)) % 2 == k % 2, np.r_[class_of, groups], table)
        found = bigrams(numbers, CLASSES, np.r_[moved, groups])
        if likelihood(found) <= likelihood(table):
            break
        class_of, table = moved, found
    return class_of, table


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of units by exchange clustering on their bigram counts; the end's unit keeps the last class to itself.

    Units begin dealt out by frequency. One sweep takes each unit out of its class and puts it where the
    likelihood of the class bigrams is greatest; sweeps end when no unit moves.
    """
    n_units = len(pairs)
    after, before = pairs.sum(axis=1), pairs.sum(axis=0)
    order = np.argsort(-(after + before)[: n_units - 1], kind="stable")
    where = np.empty(n_units, np.int64)
    where[order] = np.arange(n_units - 1) % (classes - 1)
    where[-1] = classes - 1
    one_hot = np.zeros((n_units, classes))
    one_hot[np.arange(n_units), where] = 1
    table = one_hot.T @ pairs @ one_hot
    rows, cols = table.sum(axis=1), table.sum(axis=0)
    to_class, from_class = pairs @ one_hot, (one_hot.T @ pairs).T  # of each unit: counts to and from each class
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not after[u] and not before[u]:
                continue
            old, own = where[u], pairs[u, u]
            right, left = to_class[u].copy(), from_class[u].copy()
            right[old] -= own
            left[old] -= own
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= own
            rows[old] -= after[u]
            cols[old] -= before[u]
            base = _xlogx(table)
            gain_row = _xlogx(table + right) - base
            gain_col = _xlogx(table + left[:, None]) - base
            diagonal = np.diag(table)
            gain = gain_row.sum(axis=1) - np.diag(gain_row) + gain_col.sum(axis=0) - np.diag(gain_col)
            gain += _xlogx(diagonal + right + left + own) - np.diag(base)
            gain -= _xlogx(rows + after[u]) - _xlogx(rows) + _xlogx(cols + before[u]) - _xlogx(cols)
            gain[-1] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            table[new] += right
            table[:, new] += left
            table[new, new] += own
            rows[new] += after[u]
            cols[new] += before[u]
            if new != old:
                moved += 1
                where[u] = new
                to_class[:, old] -= pairs[:, u]
                to_class[:, new] += pairs[:, u]
                from_class[:, old] -= pairs[u]
                from_class[:, new] += pairs[u]
        if not moved:
            break
    return where


@dataclass
class Model:
    """What every worker needs for the scores: frequent words with counts and classes, classes of units and the sizes of classes."""

    words: list[bytes]
    counts: np.ndarray
    class_of: np.ndarray
    where: np.ndarray
    moves: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    n_tokens: int
    n_words: int
    ends: int

    @property
    def base_room(self) -> float:
        return self.n_tokens + 0.5 * (self.n_words + 1)

    @property
    def class_room(self) -> np.ndarray:
        return self.class_tokens + 0.5 * (self.class_words + 1)


class _Places(dict):
    """Of a word: its place among the frequent words, or for others minus one, less their class."""

    def __init__(self, words: list[bytes], where: np.ndarray):
        super().__init__()
        self.known = {w: k for k, w in enumerate(words)}
        self.where = where

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        place = self.known.get(word)
        if place is None:
            place = -1 - int(self.where[_group(word)])
        self[word] = place
        return place


class _Classes(dict):
    """Classes of words."""

    def __init__(self, words: list[bytes], class_of: np.ndarray, where: np.ndarray):
        super().__init__()
        self.known, self.where = dict(zip(words, class_of.tolist(), strict=True)), where

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        found = self.known.get(word)
        self[word] = found = int(self.where[_group(word)]) if found is None else found
        return found


def fit(train: DataFrame) -> tuple[Model, DataFrame]:
    """(model, counts of the words that it doesn't hold itself)."""
    counts = cut(word_counts(train))
    least, known = frequent(counts, KNOWN)
    words = [w for w, _ in known]
    first = min(OWN, len(words))
    groups = np.arange(OWN, UNITS)  # the last one is the end's
    unit_of = np.r_[np.arange(first), [_group(w) for w in words[first:]], groups].astype(np.int64)
    spark = train.sparkSession
    folder = f"{shared_folder(spark)}/words-{uuid.uuid4().hex}"
    try:
        numbers = write_numbers(train, words, folder)
        pairs = bigrams(numbers, UNITS, unit_of)
        where = exchange(pairs)
        one_hot = np.zeros((UNITS, CLASSES))
        one_hot[np.arange(UNITS), where] = 1
        class_of = own_classes(numbers, np.arange(len(words)) >= first, where[unit_of], one_hot.T @ pairs @ one_hot)
        class_of, table = swept(numbers, class_of, where[groups], WIDE_SWEEPS)
    finally:
        remove(spark, folder)
    shared = spark.sparkContext.broadcast((words, class_of, where))
    class_tokens = table.sum(axis=0)

    def sizes(batches):
        classes = _Classes(*shared.value)
        found = np.zeros(CLASSES, np.int64)
        for batch in batches:
            found += np.bincount([classes[w] for w in batch["word"].to_pylist()], minlength=CLASSES) if batch.num_rows else 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES), pa.int32()), pa.array(found, pa.int64())], ["class", "words"])

    class_words = np.zeros(CLASSES)
    for r in counts.select("word").mapInArrow(sizes, "class int, words long").groupBy("class").agg(F.sum("words").alias("words")).collect():
        class_words[r["class"]] = r["words"]
    ends = int(class_tokens[-1])
    class_words[-1] = 1 if ends else 0
    model = Model(
        words,
        np.array([n for _, n in known], np.float64),
        class_of,
        where,
        transitions(table),
        class_tokens,
        class_words,
        int(class_tokens.sum()),
        int(class_words.sum()),
        ends,
    )
    return model, counts.where(F.col("n") < least)


PARTS = "rid long, doc_id long, held_out boolean, key long, word binary, times int, class int, n_tokens long, n_known long, base double, score double"


def _parts(model):
    """Of each text one row with the sums over its transitions, frequent words and end, and one for each of its other words."""

    def run(batches):
        m = model.value
        places, class_of = _Places(m.words, m.where), m.class_of
        room = m.class_room
        base = np.log10((m.counts + 0.5) / m.base_room)
        emit = np.log10((m.counts + 0.5) / room[class_of]) if len(m.words) else base
        end_base = math.log10((m.ends + 0.5) / m.base_room)
        end_emit = math.log10((m.ends + 0.5) / room[-1])
        for whole in batches:
            for batch in slices(whole):
                words, number, lengths = tokens(batch["text"])
                n = batch.num_rows
                word_place = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
                word_class = np.where(word_place < 0, -1 - word_place, class_of[np.maximum(word_place, 0)] if len(class_of) else 0)
                owner, place = np.repeat(np.arange(n), lengths), word_place[number]
                path = np.r_[CLASSES - 1, np.insert(word_class[number], np.cumsum(lengths), CLASSES - 1)]
                steps = m.moves[path[:-1], path[1:]]
                known = place >= 0
                total = lambda x, of: np.bincount(of, x, minlength=n)
                score = total(steps, np.repeat(np.arange(n), lengths + 1)) + end_emit
                base_sum, n_known = np.full(n, end_base), np.full(n, int(m.ends > 0))
                if known.any():
                    score += total(emit[place[known]], owner[known])
                    base_sum += total(base[place[known]], owner[known])
                    n_known += np.bincount(owner[known], minlength=n)
                rare = np.flatnonzero(~known)
                pair, times = np.unique(owner[rare] * len(words) + number[rare], return_counts=True)
                doc, word = pair // max(1, len(words)), pair % max(1, len(words))
                row = np.r_[np.arange(n), doc]
                zeros = np.zeros(len(doc))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["rid"].take(pa.array(row)),
                        batch["doc_id"].take(pa.array(row)),
                        batch["held_out"].take(pa.array(row)),
                        pa.concat_arrays([batch["rid"], pa.nulls(len(doc), pa.int64())]),
                        pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(words, pa.binary()).take(pa.array(word))]),
                        pa.array(np.r_[np.zeros(n, np.int32), times.astype(np.int32)], pa.int32()),
                        pa.array(np.r_[np.zeros(n, np.int64), word_class[word]].astype(np.int32), pa.int32()),
                        pa.array(np.r_[lengths + 1, zeros].astype(np.int64), pa.int64()),
                        pa.array(np.r_[n_known, zeros].astype(np.int64), pa.int64()),
                        pa.array(np.r_[base_sum, zeros], pa.float64()),
                        pa.array(np.r_[score, zeros], pa.float64()),
                    ],
                    ["rid", "doc_id", "held_out", "key", "word", "times", "class", "n_tokens", "n_known", "base", "score"],
                )

    return run


def scores(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text, by a model of those outside the held-out fold."""
    held_out = fold(F.col("doc_id"), folds) == held
    model, rest = fit(docs.where(~held_out))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    parts = rows.mapInArrow(_parts(docs.sparkSession.sparkContext.broadcast(model)), PARTS)
    # rows without a word have keys of their own, so that they are spread and match nothing
    keyed = parts.withColumn("key", F.coalesce("key", F.xxhash64("word")))
    table = rest.select(F.xxhash64("word").alias("key"), "word", "n")
    room = F.get(F.array(*(F.lit(float(x)) for x in model.class_room)), F.col("class"))
    n = F.coalesce(F.col("n"), F.lit(0))
    rare = F.col("word").isNotNull()
    joined = keyed.join(table, ["key", "word"], "left").select(
        "rid",
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.when(rare & (n > 0), F.col("times")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.when(rare, F.col("times") * F.log10((n + 0.5) / model.base_room)).otherwise(0.0)).alias("base"),
        (F.col("score") + F.when(rare, F.col("times") * F.log10((n + 0.5) / room)).otherwise(0.0)).alias("score"),
    )
    return (
        joined.groupBy("rid", "doc_id", "held_out")
        .agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
    )
