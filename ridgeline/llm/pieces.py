"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut where no piece can reach across, and the distinct parts of a batch are laid out as one byte
string, with a byte between them that no text has. All suffixes of it are sorted; every piece of the vocabulary
finds its occurrences by binary search as a range of that order; the occurrences are the edges of all parts' lattices.
Sorted by where they end, they are relaxed one end after the other, all parts at once; a part of over LONG bytes is
indexed and relaxed alone, a stretch at a time.

The vocabulary is of the byte-pair kind, whose encoding isn't the cheapest path but that of its merges. It is
a path through the lattice all the same: at each end exactly one edge is left whose piece and the piece before
encode to themselves when written together. Relaxing keeps that edge. Whether a pair of pieces does is worked out by
merging once and then looked up. Parts with runs of blanks, whose merges tie, are merged directly.

Characters that no piece has are written as their bytes. A text begins with one blank that isn't its own.

Defined cases: a null or empty text has no ids and decodes to an empty text; the blank mark U+2581 in a text
decodes to a blank, as ids don't tell the two apart; texts of any length are encoded whole; repeated rows give equal
ids; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default place of the vocabulary; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Byte between parts: UTF-8 has no such byte.
GAP = b"\xff"
#: Bytes by which suffixes are sorted; longer pieces are compared in full within their range.
KEY = 16
#: Bytes of new parts that are indexed together, about, and parts that a worker keeps.
INDEXED, KEPT = 1 << 19, 400_000
#: Looked-up pairs that a worker keeps.
PAIRS = 1 << 22
#: Bytes of a part that is relaxed alone, and bytes of such a part that are indexed together.
LONG, STRETCH = 2048, 1 << 16


#: Texts that tell models apart: normalizers change them, and cheapest paths part from merging.
PROBES = ("ﬁne ＡＢＣ　x² ①", "a  b   c", " lead", "trail ", "Internationalization of unbelievable misunderstandings", "e\u0301te\u0301", "的中文字符😀", "tab\tnew\nline\r", "1234567 3.14159")


class Vocabulary:
    """The pieces of a model file's bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_proto=model)
        size = own.get_piece_size()
        self.pieces = [own.id_to_piece(k) for k in range(size)]
        self.byte_ids = np.zeros(256, np.int64)
        normal = []
        for k in range(size):
            if own.is_byte(k):
                self.byte_ids[int(self.pieces[k][3:5], 16)] = k
            elif not (own.is_control(k) or own.is_unknown(k) or own.is_unused(k)):
                normal.append(k)
        self.id_of = {self.pieces[k]: k for k in normal}
        self.score = {self.pieces[k]: own.get_score(k) for k in normal}
        self.single = {p for p in self.id_of if len(p) == 1}
        self.written = [bytes([int(p[3:5], 16)]) if own.is_byte(k) else b"" if own.is_control(k) else p.encode() for k, p in enumerate(self.pieces)]
        chars = "".join(map(re.escape, sorted(self.single - {BLANK})))
        self.parts = re.compile(f"{BLANK}*[{chars}]+|{BLANK}+|.", re.DOTALL)
        raw = sorted((p.encode(), k) for p, k in self.id_of.items() if set(p) <= self.single)
        self.sorted_ids = np.array([k for _, k in raw])
        self.sorted_bytes = [b for b, _ in raw]
        self.size = np.array([len(b) for b in self.sorted_bytes])
        self.reach = int(self.size.max())
        self.low = np.array([b[:KEY] for b in self.sorted_bytes], f"S{KEY}")
        self.high = np.array([b[:KEY].ljust(KEY, GAP) for b in self.sorted_bytes], f"S{KEY}")

        if any(BLANK in p.lstrip(BLANK) for p in self.id_of):
            raise ValueError("a piece with a blank inside can't be matched word by word")
        for text in PROBES:
            if own.encode(text) != self.merged(BLANK + text.replace(" ", BLANK)):
                raise ValueError(f"the model doesn't encode {text!r} by merging its pieces: only byte-pair models with byte fallback, a leading blank and no normalizer are known here")

    def merged(self, text: str) -> list[int]:
        """Ids of a text by merging: the best adjacent pair first, of equal ones the leftmost."""
        symbols: list[str | None] = list(text)
        after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(symbols) and (pair := symbols[a] + symbols[b]) in self.score:
                heapq.heappush(heap, (-self.score[pair], a, pair))

        for k in range(len(text) - 1):
            offer(k)
        while heap:
            _, a, pair = heapq.heappop(heap)
            b = after[a] if symbols[a] is not None else len(symbols)
            if b >= len(symbols) or symbols[a] + symbols[b] != pair:
                continue
            symbols[a], symbols[b] = pair, None
            after[a] = after[b]
            if after[b] < len(symbols):
                before[after[b]] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        ids: list[int] = []
        for s in symbols:
            if s is not None:
                ids += [self.id_of[s]] if s in self.id_of else self.byte_ids[list(s.encode())].tolist()
        return ids


class _Pairs:
    """Whether two pieces written together encode to themselves: an open hash table of what was worked out."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.full = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool), 0
        self.single: dict[int, bool] = {}

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots that hold the keys, or the free ones where their search ends."""
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)
        todo = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) % PAIRS
            todo = todo[(self.keys[at[todo]] != keys[todo]) & (self.keys[at[todo]] != -1)]
        return at

    def _worked_out(self, before: int, piece: int) -> bool:
        name, merged = self.vocabulary.pieces, self.vocabulary.merged
        return merged(name[piece]) == [piece] if before < 0 else merged(name[before] + name[piece]) == [before, piece]

    def fit(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """For pairs of pieces; -1 stands before a part's first piece."""
        keys = (before.astype(np.int64) + 1) * (1 << 24) + piece
        at = self._find(keys)
        missing = np.unique(keys[self.keys[at] == -1])
        if len(missing):
            if self.full + len(missing) > PAIRS // 2:
                self.clear()
                missing = np.unique(keys)
            values = np.array([self._worked_out((key >> 24) - 1, key & 0xFFFFFF) for key in missing.tolist()])
            self.full += len(missing)
            while len(missing):  # of keys that end at one slot, one takes it and the others search on
                slots, first = np.unique(self._find(missing), return_index=True)
                self.keys[slots], self.values[slots] = missing[first], values[first]
                missing, values = np.delete(missing, first), np.delete(values, first)
            at = self._find(keys)
        return self.values[at]

    def fits(self, before: int, piece: int) -> bool:
        """``fit`` for one pair."""
        key = (before + 1) << 24 | piece
        good = self.single.get(key)
        if good is None:
            if len(self.single) > PAIRS // 2:
                self.single.clear()
            good = self.single[key] = self._worked_out(before, piece)
        return good


def suffix_order(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of the suffixes that begin there, the first KEY bytes of each): by half of the key, ties by the other."""
    padded = np.concatenate([raw, np.full(KEY, GAP[0], np.uint8)])
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, KEY)[starts])
    halves = windows.view(">u8").astype(np.uint64)
    order = np.argsort(halves[:, 0])
    first = halves[order, 0]
    same = first[1:] == first[:-1]
    tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    rows = order[tied]
    order[tied] = rows[np.lexsort((halves[rows, 1], halves[rows, 0]))]
    return starts[order], windows.view(f"S{KEY}").ravel()[order]


def edges(vocabulary: Vocabulary, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of every occurrence of every piece."""
    places, keys = suffix_order(raw, np.flatnonzero(((raw & 0xC0) != 0x80) & (raw != GAP[0])).astype(np.int32))
    low = np.searchsorted(keys, vocabulary.low, "left")
    high = np.searchsorted(keys, vocabulary.high, "right")
    count = high - low
    piece = np.repeat(np.arange(len(count), dtype=np.int32), count)
    at = np.arange(len(piece)) + np.repeat(low - (np.cumsum(count) - count), count)
    start = places[at]
    size = vocabulary.size[piece]
    long = np.flatnonzero(size > KEY)
    if len(long):
        text = raw.tobytes()
        same = [text.startswith(vocabulary.sorted_bytes[piece[k]], start[k]) for k in long.tolist()]
        keep = np.ones(len(piece), bool)
        keep[long] = same
        start, piece, size = start[keep], piece[keep], size[keep]
    return start, start + size, vocabulary.sorted_ids[piece]


def encode_long(vocabulary: Vocabulary, pairs: _Pairs, raw: bytes) -> np.ndarray | None:
    """Ids of one long part, None at a dead end. Each end is relaxed in turn, and only the edges of one stretch are held."""
    text = np.frombuffer(raw, np.uint8)
    last = [-2] * (len(raw) + 1)  # the piece that ends at a place; -2: none
    last[0] = -1
    fits = pairs.fits
    for a in range(0, len(raw), STRETCH):
        low = max(0, a - vocabulary.reach)
        start, end, piece = edges(vocabulary, text[low : a + STRETCH + vocabulary.reach])
        here = np.flatnonzero((end + low > a) & (end + low <= a + STRETCH))
        here = here[np.argsort(end[here], kind="stable")]
        for s, e, p in zip((start[here] + low).tolist(), (end[here] + low).tolist(), piece[here].tolist(), strict=True):
            if last[e] == -2 and last[s] != -2 and fits(last[s], p):
                last[e] = p
    if last[-1] == -2:
        return None
    ids, at = [], len(raw)
    while at:
        ids.append(last[at])
        at -= len(vocabulary.written[last[at]])
    return np.array(ids[::-1], np.int32)


def encode_parts(vocabulary: Vocabulary, pairs: _Pairs, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all parts one after the other, number of ids of each)."""
    direct = np.array([part[0] not in vocabulary.single or part[:2] == BLANK * 2 for part in parts])
    owners, found = [], []
    alone = np.zeros(len(parts), bool)
    for k in np.flatnonzero(~direct).tolist():
        if 4 * len(parts[k]) > LONG and len(raw := parts[k].encode()) > LONG:
            ids = encode_long(vocabulary, pairs, raw)
            if ids is None:
                direct[k] = True
            else:
                alone[k] = True
                owners.append(np.full(len(ids), k))
                found.append(ids)
    chosen = np.flatnonzero(~direct & ~alone)
    if len(chosen):
        texts = [parts[k].encode() for k in chosen.tolist()]
        raw = np.frombuffer(GAP.join(texts) + GAP, np.uint8)
        size = np.fromiter(map(len, texts), np.int32, len(texts))
        first = np.cumsum(size + 1, dtype=np.int32) - size - 1
        begin = np.repeat(first, size + 1)
        start, end, piece = edges(vocabulary, raw)
        depth = end - begin[start]
        order = np.argsort(depth.astype(np.uint16), kind="stable") if len(depth) and depth.max() < 1 << 16 else np.argsort(depth, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        cuts = np.r_[0, np.cumsum(np.bincount(depth))]
        last = np.full(len(raw) + 1, -2, np.int32)  # the piece that ends at a place; -2: none
        last[first] = -1
        came = np.zeros(len(raw) + 1, np.int32)
        for a, b in zip(cuts[1:-1].tolist(), cuts[2:].tolist(), strict=True):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            open_ = np.flatnonzero(last[s] != -2)
            s, e, p = s[open_], e[open_], p[open_]
            good = np.flatnonzero(pairs.fit(last[s], p))
            last[e[good]], came[e[good]] = p[good], s[good]
        stops = first + size
        direct[chosen[last[stops] == -2]] = True
        live = np.flatnonzero(last[stops] != -2)
        at = stops[live]
        back = []
        while len(live):
            back.append((chosen[live], last[at]))
            at = came[at]
            more = at > first[live]
            live, at = live[more], at[more]
        for owner, piece in back[::-1]:
            owners.append(owner)
            found.append(piece)
    for k in np.flatnonzero(direct).tolist():
        ids = vocabulary.merged(parts[k])
        owners.append(np.full(len(ids), k))
        found.append(np.array(ids, np.int32))
    if not owners:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    owner = np.concatenate(owners)
    return np.concatenate(found)[np.argsort(owner, kind="stable")].astype(np.int32), np.bincount(owner, minlength=len(parts))


class _Numbers(dict):
    """Numbers of parts as they come; ``new`` lists those without ids yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = number = len(self)
        self.new.append(part)
        return number


class Encoder:
    """Encodes texts by batches; parts that were seen are kept with their ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.pairs = vocabulary, _Pairs(vocabulary)
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.numbers) > KEPT:
            self.clear()
        number, find = self.numbers.__getitem__, self.vocabulary.parts.findall
        rows = [np.array(list(map(number, find(BLANK + text.replace(" ", BLANK)))) if text else [], np.int64) for text in texts]
        new, self.numbers.new = self.numbers.new, []
        at = 0
        while at < len(new):
            stop, size = at, 0
            while stop < len(new) and size < INDEXED:
                size += len(new[stop])
                stop += 1
            ids, count = encode_parts(self.vocabulary, self.pairs, new[at:stop])
            self.first = np.r_[self.first, len(self.ids) + np.cumsum(count) - count]
            self.count, self.ids = np.r_[self.count, count], np.r_[self.ids, ids]
            at = stop
        out = []
        for row in rows:
            count = self.count[row]
            place = np.repeat(self.first[row] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            out.append(self.ids[place])
        return out


def decode_ids(vocabulary: Vocabulary, ids) -> str:
    text = b"".join([vocabulary.written[k] for k in ids]).decode("utf-8", "replace").replace(BLANK, " ")
    return text[1:] if text[:1] == " " else text


def decode_lists(vocabulary: Vocabulary, lists: pa.ListArray) -> list[str | None]:
    """Texts of lists of ids; null for null."""
    written = pa.array(vocabulary.written, pa.binary()).take(lists.flatten())
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    joined = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), written), b"")
    texts = [x.decode("utf-8", "replace").replace(BLANK, " ") for x in joined.to_pylist()]
    return [None if null else t[1:] if t[:1] == " " else t for null, t in zip(lists.is_null().to_pylist(), texts, strict=True)]


_LOADED: dict[int, tuple[Vocabulary, Encoder]] = {}


def _loaded(model: bytes) -> tuple[Vocabulary, Encoder]:
    """The vocabulary and encoder of this worker."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        vocabulary = Vocabulary(model)
        _LOADED[key] = vocabulary, Encoder(vocabulary)
    return _LOADED[key]


def _steps(batches, rows: int):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The named columns and ``ids`` of each whole text. The model file is read by the driver alone."""
    with open(vocabulary, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(*keep, *({"text"} - set(keep)))
    kept = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        _, encoder = _loaded(model.value)
        for batch in _steps(batches, 1024):
            ids = encoder(batch["text"].to_pylist())
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))], [*keep, "ids"])

    return rows.mapInArrow(run, kept)


def decode(encoded: DataFrame, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The named columns and the ``text`` of ids."""
    with open(vocabulary, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())
    rows = encoded.select(*keep, *({"ids"} - set(keep)))
    kept = encoded.select(*keep).schema.add("text", T.StringType())

    def run(batches):
        own, _ = _loaded(model.value)
        for batch in _steps(batches, 1024):
            texts = decode_lists(own, batch["ids"])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return rows.mapInArrow(run, kept)


def round_trips(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Of each document: ids, their hash, and whether they decode to the text (with U+2581 as a blank)."""
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(BLANK), F.lit(" "))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(plain.cast("binary"), 256).alias("text_sha256"), "text")
    encoded = encode(rows, "doc_id", "text_sha256", vocabulary=vocabulary)
    sized = encoded.select("doc_id", "text_sha256", "ids", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"))
    return decode(sized, "doc_id", "text_sha256", "n_ids", "ids_hash", vocabulary=vocabulary).select(
        "doc_id", "n_ids", "ids_hash", F.length("text").cast("long").alias("n_chars"), (F.sha2(F.col("text").cast("binary"), 256) == F.col("text_sha256")).alias("round_trip")
    )
