"""Toxic passages as maximal scoring segments of token log-odds.

Training counts the words of labelled rows by label and compares them by the log-odds ratio with an
informative Dirichlet prior: the prior of a word is its share of all counted words. Beginnings of words are counted like words, so that
inflected forms that training never saw are known by their stem. A word whose ratio is significant scores
its log-odds, or else those of its longest significant beginning; all others score their joint
log-odds, which is a little below zero. A scan in linear time finds every maximal scoring segment of a text.

The greatest segment of a clean text follows an extreme-value law: in n words, a score of S or more comes up
by chance E = K n exp(-lambda S) times. ``lambda`` and ``K`` are fitted to the greatest segments of the clean training rows by
maximum likelihood, texts without any segment counted as such; a few rows that follow the law of log-odds, for which
lambda is 1, go with them, so that rows without chance segments have a law as well. Passages of ``E`` up to LEAST_E are significant. A text's
p-value is the chance of a clean text of its length to reach the sum of its significant passages, each less the score of E = 1; it becomes
a probability by the share of toxic rows and by how p-values of toxic training rows lie: by a density a p^(a-1), whose
``a`` is fitted to them. Words are learned on one half of the sample and the law on the other, both ways round, and the parameters averaged: rows
that a word was learned from would show it too well.

The labelled rows used are bounded: at most about ``SAMPLE`` of each label, those with the least hash of
their id, whatever the size of the corpus. Rows of the same words under the same label are learned from once, so copies don't weigh. Scores cover every row.

Defined cases: a null or empty text has no passage and gets the score of no passage; a document with
several labels counts as toxic if one of them is; labels of unknown documents and null labels are left out;
equal texts under both labels are learned from under both; words of equal ratio don't compete, as each is judged by itself;
segments of equal sums stay apart unless one must grow to join;
repeated rows get equal results; extra columns are ignored; without training rows of both labels
no word is significant and the score is the share of toxic training rows, 0 if there are none.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, let, words

#: Labelled rows of each label that are learned from, about.
SAMPLE = 4_000
#: Least z score and log-odds of a significant word or beginning, and least number of toxic training texts that hold it.
LEAST_Z, LEAST_ODDS, LEAST_TEXTS = 3.0, 2.0, 4
#: Weight of the prior, as a share of the counted words.
PRIOR = 0.1
#: Lengths of the beginnings of longer words, longest first. A beginning is written with a blank after it.
STEMS = (7, 6, 5, 4)
#: Scores of words that a worker keeps; beyond it, it starts afresh.
CACHED = 200_000
#: Greatest number of chance matches of a significant passage, and the clean texts that follow the law of log-odds by assumption.
LEAST_E, ASSUMED = 0.5, 5.0
#: Highest score of a word that isn't significant.
OTHER = -0.005
#: Strips what stands around a word.
EDGES = ".,;:!?()[]{}\"'*#$%&|<>-_`~"


def tokens(text: str | None) -> list[str]:
    return [w.strip(EDGES) for w in (text or "").lower().split()]


def stems(word: str) -> list[str]:
    return [word[:n] + " " for n in STEMS if len(word) > n]


class _Scores(dict):
    """Scores of words as they are asked for, None for words without one."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: str) -> float | None:
        if len(self) >= CACHED:
            self.clear()
        self[word] = score = next((self.odds[x] for x in (word, *stems(word)) if x in self.odds), None)
        return score


@dataclass(frozen=True)
class Law:
    """Extreme-value law of the greatest segment of clean texts, share of toxic rows and exponent of their p-values."""

    rate: float = 1.0
    k: float = 0.1
    share: float = 0.0
    power: float = 1.0

    def chances(self, score: float, n_words: int) -> float:
        """E: how many segments of at least this score chance gives in so many words."""
        return self.k * n_words * math.exp(-self.rate * score)

    def p_value(self, scores: list[float], n_words: int) -> float:
        """Chance of a clean text of so many words to reach the sum of these significant scores; 1 without any."""
        if not scores:
            return 1.0
        r = len(scores)
        t = sum(self.rate * x for x in scores) - r * math.log(self.k * n_words)
        return -math.expm1(-math.exp(min(0.0, (r - 1) * math.log(max(t, 1e-9)) - t - math.lgamma(r + 1) - math.lgamma(r)))) if r > 1 else -math.expm1(-math.exp(-t))

    def probability(self, p: float) -> float:
        """Probability that a text with this p-value is toxic."""
        if not 0 < self.share < 1:
            return self.share
        log_odds = math.log(self.share / (1 - self.share)) + math.log(self.power) + (self.power - 1) * math.log(max(p, 1e-300))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, log_odds))))


@dataclass
class Model:
    """Scores of the significant words, and the law of chance."""

    odds: dict[str, float]
    other: float = OTHER
    law: Law = Law()

    def __post_init__(self):
        self.scores = _Scores(self.odds)

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """(number of words, all maximal segments as first word, end and score)."""
        found = tokens(text)
        marks = [(k, x) for k, x in enumerate(map(self.scores.__getitem__, found)) if x is not None]
        return len(found), maximal_segments(_with_gaps(marks, self.other))

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """(number of words, the significant segments)."""
        n, found = self.segments(text)
        return n, [x for x in found if self.law.chances(x[2], n) <= LEAST_E]

    def probability(self, n_words: int, passages) -> float:
        return self.law.probability(self.law.p_value([x[2] for x in passages], n_words))


def _with_gaps(marks: list[tuple[int, float]], other: float):
    """Runs (first word, end, score) in order: single significant words, and the others between them as one run each."""
    at = None
    for k, score in marks:
        if at is not None and k > at:
            yield at, k, other * (k - at)
        yield k, k + 1, score
        at = k + 1


def maximal_segments(runs) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, in order, in time linear in the runs.

    A stack holds candidate segments with the sums before and after them. A new positive run looks for the
    nearest candidate that begins lower; if that one also ends lower, the two are joined with all between.
    """
    stack: list[list] = []  # first word, end, sum before, sum after, place of the nearest candidate that begins lower
    total = 0.0
    for first, end, score in runs:
        before, total = total, total + score
        if score <= 0:
            continue
        item = [first, end, before, total, -1]
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= item[2]:
                k = stack[k][4]
            item[4] = k
            if k < 0 or stack[k][3] >= item[3]:
                stack.append(item)
                break
            item = [stack[k][0], item[1], stack[k][2], item[3], -1]
            del stack[k:]
    return [(a, b, after - before) for a, b, before, after, _ in stack]


def _labelled(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> DataFrame:
    """(text, toxic) of a bounded sample of the training rows."""
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), folds) != held))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("_share", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20))
    )
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).where("toxic in (0, 1)").collect()}
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col("toxic") == value, F.lit(SAMPLE / n)).otherwise(share)
    kept = marks.where(F.col("_share") < share).select("doc_id", "toxic")
    # about 2 * SAMPLE rows of an id and a number at most, whatever the input
    rows = docs.select("doc_id", "text").join(F.broadcast(kept), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    # words of a text with many near copies would pass for words of many texts: of texts whose shingles have the same two least hashes, one stays
    shingle = lambda w, i: (w[i], w[i + 1], w[i + 2])
    least = let(
        words(F.lower("text")),
        lambda w: F.when(
            F.size(w) >= 3,
            let(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda at: F.array(*(F.array_min(F.transform(at, f)) for f in (lambda i: F.xxhash64(*shingle(w, i)), lambda i: F.xxhash64(F.lit(1), *shingle(w, i))))),
            ),
        ),
    )
    alike = F.coalesce(least, F.array(F.xxhash64("text")))
    kept = rows.groupBy(alike.alias("_alike"), "toxic").agg(F.min("text").alias("text"))
    return cut(kept.select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))), sizes


COUNTS = ("clean", "toxic", "clean_texts", "toxic_texts")


def _count(batches):
    held = {(half, kind): Counter() for half in range(2) for kind in COUNTS}
    for batch in batches:
        for text, toxic, half in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), batch["half"].to_pylist(), strict=True):
            found = [w for w in tokens(text) if w]
            forms = Counter(x for w in found for x in (w, *stems(w)))
            kind = COUNTS[toxic]
            held[half, kind].update(forms)
            held[half, kind][" "] += len(found)  # the row of a blank holds the numbers of words by label
            held[half, f"{kind}_texts"].update(forms.keys())
    for half in range(2):
        words_ = list(held[half, "clean"] | held[half, "toxic"])
        columns = [pa.array([held[half, kind][w] for w in words_], pa.int64()) for kind in COUNTS]
        yield pa.RecordBatch.from_arrays([pa.array(words_, pa.string()), pa.array([half] * len(words_), pa.int32()), *columns], ["word", "half", *COUNTS])


def _significant(counts: DataFrame, sample: DataFrame, share: float = 1.0) -> tuple[dict[str, float], float]:
    """(log-odds of the significant words of counts, score of all others). A share of the sample is judged by as much less.

    Log-odds are of words, but their spread is of texts: a word that one text repeats is not significant.
    """
    sums = counts.groupBy("word").agg(*(F.sum(c).cast("double").alias(c) for c in COUNTS))
    total = sums.where("word = ' '").first()
    if total is None or not total["clean"] or not total["toxic"]:
        return {}, OTHER
    weight = PRIOR * (total["clean"] + total["toxic"])
    prior = PRIOR * (F.col("clean") + F.col("toxic"))
    logit = lambda y, n: F.log((F.col(y) + prior) / (n + weight - F.col(y) - prior))
    ratio = logit("toxic", total["toxic"]) - logit("clean", total["clean"])
    prior_texts = PRIOR * (F.col("clean_texts") + F.col("toxic_texts"))
    spread = F.sqrt(1 / (F.col("toxic_texts") + prior_texts) + 1 / (F.col("clean_texts") + prior_texts))
    found = (
        sums.where((F.col("toxic_texts") >= LEAST_TEXTS * share) & (F.col("word") != " "))
        .select("word", ratio.alias("odds"), (ratio / spread).alias("z"))
        .where((F.col("z") >= LEAST_Z * math.sqrt(share)) & (F.col("odds") >= LEAST_ODDS))
    )
    odds = {r["word"]: r["odds"] for r in found.collect()}
    # the other words of toxic texts are rarer by the share of the significant ones
    return odds, min(OTHER, math.log(max(0.5, 1 - _share_of_marks(sample, odds))))


def gumbel(greatest: np.ndarray, n_words: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of the greatest segments of clean texts by maximum likelihood; 0 stands for no segment.

    The likelihood's slope in lambda falls, so bisection finds its zero; K follows from lambda.
    """
    some, n = greatest > 0, np.maximum(n_words, 1.0)
    count = some.sum()

    def k_of(rate: float) -> float:
        return (count + 0.5) / max(1e-300, (n * np.exp(-rate * greatest)).sum())

    def slope(rate: float) -> float:
        return (count + ASSUMED) / rate - greatest[some].sum() - ASSUMED + k_of(rate) * (n * greatest * np.exp(-rate * greatest)).sum()

    low, high = 0.05, 5.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    return low, k_of(low)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> Model:
    """A model of the labelled rows outside the held-out fold. Significant words of the sample and two numbers for each of its rows come to the driver."""
    sample, sizes = _labelled(docs, labels, folds, held)
    counts = sample.mapInArrow(_count, "word string, half int, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("word", "half").agg(*(F.sum(c).alias(c) for c in COUNTS))
    counts = cut(counts)
    known = sum(sizes.values())
    share = sizes.get(1, 0) / known if known else 0.0
    odds, other = _significant(counts, sample)
    if not odds:
        return Model(odds, other, Law(share=share))
    halves = [Model(*_significant(counts.where(F.col("half") == k), sample.where(F.col("half") == k), 0.5)) for k in range(2)]

    def crossed(value, kind):
        """``value`` of each row by the words of the other half."""

        def run(batches):
            for batch in batches:
                x = [value(halves[1 - half], text) for text, half in zip(batch["text"].to_pylist(), batch["half"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in x], pa.float64()) for k in range(2)], ["x", "y"])

        rows = sample.where(F.col("toxic") == kind).mapInArrow(run, "x double, y double").toArrow()
        return rows["x"].to_numpy(), rows["y"].to_numpy()

    def greatest(model: Model, text: str) -> tuple[float, float]:
        n, found = model.segments(text)
        return max((x[2] for x in found), default=0.0), float(n)

    rate, k = gumbel(*crossed(greatest, 0))
    law = Law(rate, k, share)

    def p_value(model: Model, text: str) -> tuple[float, float]:
        n, found = Model(model.odds, model.other, law).passages(text)
        return law.p_value([x[2] for x in found], n), float(n)

    p, _ = crossed(p_value, 1)
    power = min(1.0, max(1e-3, len(p) / max(1e-9, -np.log(np.maximum(p, 1e-300)).sum()))) if len(p) else 1.0
    return Model(odds, other, Law(rate, k, share, power))


def _share_of_marks(sample: DataFrame, odds: dict[str, float]) -> float:
    """Share of the words of toxic training texts that are significant."""
    model = Model(odds)

    def run(batches):
        for batch in batches:
            texts = [tokens(t.as_py()) for t in batch["text"]]
            marks = [sum(model.scores[w] is not None for w in x) for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in texts], pa.int64()), pa.array(marks, pa.int64())], ["n", "marks"])

    row = sample.where("toxic = 1").mapInArrow(run, "n long, marks long").agg(F.sum("n").alias("n"), F.sum("marks").alias("marks")).first()
    return row["marks"] / row["n"] if row["n"] else 0.0


SCORED = "doc_id long, n_words long, score double, passages array<struct<first_word:int,end_word:int,score:double,e_value:double>>"
PASSAGE = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, score, passages) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, names = shared.value, ("first_word", "end_word", "score", "e_value")
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                found = [model.passages(x.as_py()) for x in batch["text"]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"],
                        pa.array([n for n, _ in found], pa.int64()),
                        pa.array([model.probability(*x) for x in found], pa.float64()),
                        pa.array([[dict(zip(names, (*s, model.law.chances(s[2], n)), strict=True)) for s in p] for n, p in found], PASSAGE),
                    ],
                    ["doc_id", "n_words", "score", "passages"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def predicted(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, least: float = 0.3) -> DataFrame:
    """Scores of every document by a model of the labelled rows outside the held-out fold."""
    model = fit(docs, labels, folds, held)
    return score(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == held).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
