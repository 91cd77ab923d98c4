"""Language identification of spans in texts of one or more languages.

Training counts byte trigrams of words by language, over all labelled rows, in a table of fixed size.
To label a text, the script of each word narrows the candidate languages to those that were seen in that
script; each word gets a log-probability under every candidate, and the Viterbi path over the words, with
a penalty for each switch, gives the spans. A text's language is the one with the most letters in its spans.

There may be any number of languages: the model, which every worker holds, is a list of the trigrams that each language has, so that it
grows with the labels and their kinds of words, not with the rows. Scores are held for so many words at a time that words times languages
stay below a bound, texts of any length included; of a text's path, a bit for each word and language is kept.

Defined cases: a null text or one without a letter is ``und`` with score 0; words without a letter count
for no language; ties go to the language that sorts first; repeated rows get equal results; extra columns
are ignored; an empty table gives an empty result; without any labelled row every text is ``und``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Cells of a language's trigram table; trigrams are dealt to them by a multiplicative hash.
CELLS = 1 << 15
#: Log-probability that a switch of language costs.
SWITCH = 12.0
#: The most that one word may count against a language.
WORD_CLIP = 8.0
#: Words of a language that are counted before their trigrams are.
KEPT_WORDS = 200_000
#: Scores (words x languages) that are worked out together, and those that a worker keeps; beyond it, it starts afresh.
HELD, KEPT = 1 << 21, 1 << 24
#: First code points of scripts, with the script that begins there.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"),
    (0x10000, "other"), (0x20000, "han"),
)
NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
STARTS = [at for at, _ in SCRIPTS]
KIND_OF = [NAMES.index(name) for _, name in SCRIPTS]
LATIN = NAMES.index("latin")


def script_of(word: str) -> int:
    """The script of a word's first letter, -1 without any letter."""
    for c in word:
        if c.isalpha():
            return KIND_OF[bisect_right(STARTS, ord(c)) - 1]
    return -1


def _cells(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(cells of all trigrams of the words between blanks, where each word's begin). A word of n bytes has n of them."""
    raw = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size + 2) - size - 2
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    cell = (code * np.uint32(2654435761)) >> np.uint32(17)
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return cell[at], np.cumsum(size) - size


def _tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def _learn(batches):
    cells: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(CELLS + len(NAMES)))
    held: dict[str, Counter] = defaultdict(Counter)

    def settle(lang: str) -> None:
        words = list(held[lang])
        if words:
            times = np.fromiter(held[lang].values(), np.float64, len(words))
            cell, first = _cells(words)
            size = np.diff(np.r_[first, len(cell)])
            cells[lang][:CELLS] += np.bincount(cell, np.repeat(times, size), CELLS)
            kinds = np.array([script_of(w.decode("utf-8", "replace")) for w in words])
            cells[lang][CELLS:] += np.bincount(kinds + 1, times, len(NAMES) + 1)[1:]
        held[lang].clear()

    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            lang = lang.as_py()
            held[lang].update(_tokens(text.as_py()))
            if len(held[lang]) > KEPT_WORDS:
                settle(lang)
    for lang in held:
        settle(lang)
    for lang, table in cells.items():
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(table[at])], ["lang", "cell", "n"])


@dataclass
class Model:
    """What each trigram cell adds to a language's log-probability, by cell; what a cell without it gives; the scripts of each language."""

    langs: list[str]
    first: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    base: np.ndarray
    scripts: np.ndarray

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Log-probabilities of words, each less the best one's; languages that a word's script rules out get the lowest."""
        step = self.together
        return np.vstack([self._scores(words[at : at + step]) for at in range(0, len(words), step)])

    @property
    def together(self) -> int:
        """Words whose scores are worked out together."""
        return max(1, HELD // max(1, len(self.langs)))

    def _scores(self, words: list[bytes]) -> np.ndarray:
        kinds = np.array([script_of(w.decode("utf-8", "replace")) if not w.isascii() else LATIN if _letters(w) else -1 for w in words])
        cell, begin = _cells(words)
        size, languages = np.diff(np.r_[begin, len(cell)]), len(self.langs)
        out = size[:, None] * self.base
        owner = np.repeat(np.arange(len(words)), size)
        count = self.first[cell + 1] - self.first[cell]
        until = np.cumsum(count)
        a = 0
        while a < len(cell):
            b = max(a + 1, int(np.searchsorted(until, until[a] - count[a] + HELD, "right")))
            n, low, high = count[a:b], owner[a], owner[b - 1] + 1
            at = np.arange(n.sum()) + np.repeat(self.first[cell[a:b]] - (np.cumsum(n) - n), n)
            place = np.repeat(owner[a:b] - low, n) * languages + self.lang[at]
            out[low:high] += np.bincount(place, self.gain[at], (high - low) * languages).reshape(-1, languages)
            a = b
        known = np.where(kinds[:, None] >= 0, self.scripts[kinds], True)
        known |= ~known.any(axis=1, keepdims=True)
        out[~known] = -np.inf
        out -= out.max(axis=1, keepdims=True)
        out[kinds < 0] = 0
        return np.maximum(out, -WORD_CLIP).astype(np.float32)


def _letters(word: bytes) -> bool:
    return any(97 <= c <= 122 for c in word)


def fit(docs: DataFrame) -> Model:
    """A model of the rows with a language. A row comes to the driver for each language and trigram cell or script that it has."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    sums = known.mapInArrow(_learn, "lang string, cell int, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names = pa.compute.unique(sums["lang"]).to_pylist()
    langs = sorted(names)
    rank = np.empty(len(langs), np.int32)
    rank[np.argsort(np.array(names, object), kind="stable")] = np.arange(len(langs))
    lang = rank[pa.compute.index_in(sums["lang"], pa.array(names, pa.string())).to_numpy()] if langs else np.zeros(0, np.int32)
    cell, n = sums["cell"].to_numpy(), sums["n"].to_numpy()
    scripts = np.zeros((len(NAMES), len(langs)))
    kind = cell >= CELLS
    scripts[cell[kind] - CELLS, lang[kind]] = n[kind]
    cell, lang, n = cell[~kind], lang[~kind], n[~kind]
    order = np.lexsort((lang, cell))
    base = np.log(0.05 / (np.bincount(lang, n, len(langs)) + 0.05 * CELLS))
    first = np.r_[0, np.cumsum(np.bincount(cell, minlength=CELLS))]
    return Model(langs, first, lang[order], np.log(n[order] / 0.05 + 1), base, scripts > 0.005 * scripts.sum(axis=0))


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word when every switch costs ``switch``; ties go to the first language and to staying."""
    return best_path(lambda a, b: scores[a:b], *scores.shape, switch)


def _forward(value: list[float], rows: np.ndarray, switch: float) -> tuple[np.ndarray, list[float]]:
    """(the best paths' values by language before each word, those after the last). Before the first word of a text all are 0."""
    if len(value) > 32:  # numpy's calls cost less than the languages one by one
        values, now = np.empty(rows.shape), np.array(value)
        for kept, row in zip(values, rows.astype(np.float64), strict=True):
            kept[:] = now
            now = np.maximum(now, now.max() - switch) + row
        return values, now.tolist()
    values = []
    for row in rows.tolist():
        values.append(value)
        least = max(value) - switch
        value = [(v if v >= least else least) + x for v, x in zip(value, row, strict=True)]
    return np.array(values), value


def best_path(block, words: int, languages: int, switch: float = SWITCH) -> np.ndarray:
    """``viterbi`` over the scores that ``block`` gives for words a to b.

    The search is left out where no other path can beat the best single language: a path of m stretches pays m - 1 switches, so
    it gains nothing if all words together gain one switch at most by their best languages, or any stretch half of one at most.
    """
    step = max(1, HELD // languages)
    if words <= step:
        only = block(0, words)
        block = lambda a, b: only
    cuts = range(0, words, step)
    best = int(np.argmax(sum(block(a, a + step).sum(axis=0, dtype=np.float64) for a in cuts)))
    gained, rise, end, low = 0.0, 0.0, np.zeros(languages), np.zeros(languages)
    for a in cuts:
        gains = block(a, a + step)
        gains = gains - gains[:, best : best + 1]
        gained += gains.max(axis=1).sum(dtype=np.float64)
        run = end + np.cumsum(gains, axis=0, dtype=np.float64)
        lows = np.minimum(np.minimum.accumulate(run, axis=0), low)
        rise = max(rise, (run - lows).max())
        end, low = run[-1], lows[-1]
    if gained <= switch or rise <= switch / 2:
        return np.full(words, best)
    stays, tops = np.empty((words, (languages + 7) // 8), np.uint8), np.empty(words, np.int32)
    value = [0.0] * languages
    for a in cuts:
        values, value = _forward(value, block(a, a + step), switch)
        tops[a : a + len(values)] = values.argmax(axis=1)
        stays[a : a + len(values)] = np.packbits(values >= values.max(axis=1, keepdims=True) - switch, axis=1)
    tops = tops.tolist()
    path = np.empty(words, np.int64)
    at = int(np.argmax(value))
    for t in range(words - 1, 0, -1):
        path[t] = at
        if not stays[t, at >> 3] >> (7 - (at & 7)) & 1:
            at = tops[t]
    path[0] = at
    return path


class _Words(dict):
    """Numbers of words, given as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


LABELLED = "doc_id long, lang_pred string, score double, spans array<struct<first_word:int,n_words:int,lang:string>>"


def label(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans): score is the share of the text's letters in spans of its language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        languages = len(model.langs)
        numbers, scores, letters = _Words(), np.zeros((0, languages), np.float32), np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found, waiting = [], []
                for k, text in enumerate(part["text"]):
                    tokens = _tokens(text.as_py() or "")
                    if len(tokens) > model.together:
                        found.append(_of_long(model, tokens, switch))
                    else:
                        found.append(list(map(numbers.__getitem__, tokens)))
                        waiting.append(k)
                    if k + 1 < part.num_rows and (len(numbers) - len(scores)) * languages < HELD:
                        continue
                    if len(numbers) > len(scores):
                        new = list(numbers)[len(scores) :]
                        scores = np.vstack([scores, model.scores(new)]) if languages else np.zeros((len(numbers), 0), np.float32)
                        letters = np.r_[letters, _n_letters(new)]
                    for w in waiting:
                        ids = found[w]
                        found[w] = _spans(model, lambda a, b, own=ids: scores[own[a:b]], letters[ids], switch) if ids else ("und", 0.0, [])
                    waiting = []
                    if len(numbers) * max(1, languages) > KEPT:
                        numbers, scores, letters = _Words(), scores[:0], letters[:0]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], SPAN)],
                    ["doc_id", "lang_pred", "score", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, LABELLED)


SPAN = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))


def _n_letters(words: list[bytes]) -> list[int]:
    return [len(w) if w.isalpha() else sum(map(str.isalpha, w.decode("utf-8", "replace"))) for w in words]


def _of_long(model: Model, tokens: list[bytes], switch: float):
    """``_spans`` of a text of which not all scores can be held."""

    def block(a: int, b: int) -> np.ndarray:
        numbers = _Words()
        ids = list(map(numbers.__getitem__, tokens[a:b]))
        return model.scores(list(numbers))[ids]

    return _spans(model, block, np.array(_n_letters(tokens)), switch)


def _spans(model: Model, block, letters: np.ndarray, switch: float):
    if not letters.any() or not model.langs:
        return "und", 0.0, []
    path = best_path(block, len(letters), len(model.langs), switch)
    share = np.bincount(path, letters, len(model.langs))
    best = int(np.argmax(share))
    first = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
    size = np.diff(np.r_[first, len(path)])
    spans = [{"first_word": int(a), "n_words": int(n), "lang": model.langs[path[a]]} for a, n in zip(first, size, strict=True)]
    return model.langs[best], float(share[best] / share.sum()), spans


def predicted(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Predictions for every document by a model of the rows outside the held-out fold."""
    model = fit(docs.where(fold(F.col("doc_id"), folds) != held))
    return label(docs, model).select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")
