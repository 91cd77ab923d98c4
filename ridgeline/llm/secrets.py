"""Secret scans through a trigram index.

Each rule's regular expression is parsed once on the driver into a Boolean query over the trigrams
that any match must hold. The index has a posting (trigram, key) for each of these trigrams and each text
that holds it; a query intersects the postings of its conjunctions by key, and texts that come out are
verified with the expression itself. A rule without a mandatory trigram scans every text. The tables are
made and searched with built-in column expressions only.

The key of a text is a hash of its id and contents. Two texts of one key would share their
candidates, which are verified in any case.

Defined cases: a null text counts as empty; repeated rows and ids are scanned row by row; extra columns are ignored;
an empty table gives an empty result. Places are code points, the end exclusive. Very long texts, and texts of very many
secrets, take time in proportion to their length, but for a logarithm of the number of secrets.
"""

from __future__ import annotations

import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import add
from re import _constants as op

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, the group that holds the secret, the least length of that, and whether it is of the base."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The rules in order; spans that start together follow it.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9+/_.=-]{20,}"),
)
#: What a private key is from its first line on: all up to its END line, or without one, the lines of base64 that follow.
PEM_REST = (
    r"(?:[^-]*+(?:-[^-]++)*+-----END (?:[A-Z]+ )?PRIVATE KEY-----"
    r"|(?:\s*(?:Proc-Type|DEK-Info):[^\r\n]*){0,2}(?:[\s\\]++[A-Za-z0-9+/]{16,}+={0,2}+)++(?:\r?\n[A-Za-z0-9+/]{1,15}={0,2}(?![^\r\n]))?|)"
)
#: The rules of what is replaced: as reported, but a private key is whole.
REPLACED = tuple(Rule(r.kind, r.pattern + PEM_REST) if r.kind == "pem" else r for r in RULES)
#: Most strings that a part of an expression is spelled out in.
SPELLED = 64


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


def _strings(node) -> list[str] | None:
    """All lower-case strings that a node of a parsed expression matches, or None if they are many or without bound."""
    kind, value = node
    if kind is op.LITERAL:
        return [chr(value).lower()]
    if kind is op.IN:
        chars = []
        for k, v in value:
            if k is op.LITERAL:
                chars.append(chr(v).lower())
            elif k is op.RANGE and v[1] - v[0] < 8:
                chars += [chr(c).lower() for c in range(v[0], v[1] + 1)]
            else:
                return None
        chars = sorted(set(chars))
        return chars if len(chars) <= 8 else None
    if kind is op.SUBPATTERN:
        return _sequence_strings(value[3])
    if kind is op.BRANCH:
        found = [_sequence_strings(x) for x in value[1]]
        return None if None in found else sorted({s for x in found for s in x})
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] <= 2:
        inner = _sequence_strings(value[2])
        return None if inner is None else _bounded("".join(x) for n in range(value[0], value[1] + 1) for x in product(inner, repeat=n))
    return None


def _bounded(strings) -> list[str] | None:
    found: set[str] = set()
    for s in strings:
        found.add(s)
        if len(found) > SPELLED:
            return None
    return sorted(found)


def _sequence_strings(nodes) -> list[str] | None:
    found = [""]
    for node in nodes:
        more = _strings(node)
        found = None if more is None else _bounded(a + b for a in found for b in more)
        if found is None:
            return None
    return found


def _spelled(strings: list[str]):
    """The query of a text that holds one of the strings; None if one is too short for a trigram."""
    if any(len(s) < 3 for s in strings):
        return None
    sets = {frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings}
    least = [x for x in sets if not any(y < x for y in sets)]  # what holds more trigrams than another alternative adds nothing
    each = [All(x) for x in sorted(tuple(sorted(x)) for x in least)]
    return each[0] if len(each) == 1 else Any(tuple(each))


def trigram_query(pattern: str):
    """The Boolean query over lower-case trigrams that every match of an expression fulfils, or None without a mandatory one."""

    def of_sequence(nodes):
        parts, held = [], [""]
        for node in nodes:
            more = _strings(node)
            joined = None if more is None else _bounded(a + b for a in held for b in more)
            if joined is not None:
                held = joined
                continue
            parts.append(_spelled(held))
            held = more if more is not None else [""]
            if more is None:
                parts.append(of_node(node))
        parts = [x for x in (*parts, _spelled(held)) if x is not None]
        return None if not parts else parts[0] if len(parts) == 1 else All(tuple(parts))

    def of_node(node):
        kind, value = node
        if kind is op.SUBPATTERN:
            return of_sequence(value[3])
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            return of_sequence(value[2])
        if kind is op.BRANCH:
            each = [of_sequence(x) for x in value[1]]
            return None if None in each else Any(tuple(each))
        return None

    return of_sequence(parser.parse(pattern))


def trigrams(query) -> set[str]:
    return {query} if isinstance(query, str) else {t for part in query.parts for t in trigrams(part)}


def _holds(query, words: list[Column], places: dict[str, int]) -> Column:
    """Whether a set of trigrams, as bits in words of 64, fulfils a query."""
    if isinstance(query, All) and all(isinstance(x, str) for x in query.parts):
        masks: dict[int, int] = {}
        for t in query.parts:
            masks[places[t] // 64] = masks.get(places[t] // 64, 0) | 1 << places[t] % 64
        each = [words[w].bitwiseAND(F.lit(_signed(m)).cast("long")) == F.lit(_signed(m)).cast("long") for w, m in sorted(masks.items())]
    else:
        each = [_holds(x, words, places) for x in query.parts]
    out = each[0]
    for x in each[1:]:
        out = out & x if isinstance(query, All) else out | x
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def key_of(doc_id: Column, text: Column) -> Column:
    """A text's key; texts that share one share their candidates, which are verified."""
    return F.xxhash64(doc_id, text)


def index(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """Postings (trigram, key) of the wanted trigrams, given by their places in the list."""
    low = F.lower(F.col("text"))
    found = let(low, lambda t: F.array_compact(F.array(*(F.when(F.contains(t, F.lit(x)), F.lit(k).cast("int")) for k, x in enumerate(wanted)))))
    return docs.select(F.explode(found).alias("trigram"), key_of(F.col("doc_id"), F.col("text")).alias("key"))


def candidates(postings: DataFrame, queries: dict[int, object], wanted: list[str]) -> DataFrame:
    """(key, rules): the texts that fulfil queries, with the numbers of their rules; postings are intersected by key, 64 trigrams to a word of bits."""
    places = {t: k for k, t in enumerate(wanted)}
    bit = F.expr("shiftleft(1L, trigram % 64)")
    held = [f"held{w}" for w in range(-(-len(wanted) // 64))]
    sets = postings.groupBy("key").agg(
        *(F.bit_or(F.when(F.floor(F.col("trigram") / 64) == w, bit).otherwise(F.lit(0).cast("long"))).alias(c) for w, c in enumerate(held)),
    )
    words = [F.col(c) for c in held]
    rules = F.array_compact(F.array(*(F.when(_holds(query, words, places), F.lit(k)) for k, query in queries.items())))
    return sets.select("key", rules.alias("rules")).where(F.size("rules") > 0)


#: Steps that reach over any array, each FACTOR times as far as the one before: a text of 2 GB has fewer than 2 ** 30 matches.
STEPS, FACTOR = 10, 8


def running(values: Column, joined) -> Column:
    """What ``joined`` makes of each value and all before it, in n log n steps; it gets groups of any size, with nulls for what is missing.

    After step k, each value stands for itself and up to FACTOR ** k - 1 before it.
    """

    def grown(x: Column, step: int) -> Column:
        return F.transform(x, lambda v, i: joined(v, *(F.get(x, i - k * step) for k in range(1, FACTOR))))

    def level(a: Column, step: int) -> Column:
        return let(a, lambda x: F.when(F.size(x) <= step, x).otherwise(grown(x, step)))

    return reduce(level, (FACTOR**k for k in range(STEPS)), values)


def total(*values: Column) -> Column:
    return reduce(add, (F.coalesce(x, F.lit(0)) for x in values))


SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
PIECE = "array<struct<rank:int,size:int,part:int,step:bigint>>"


def pieces_of(rule: Rule, rank: int, text: Column) -> Column:
    """The leftmost matches of a rule that don't overlap: their length, that of their secret, and ``step``, the length from the end of the one before.

    A last piece without a match reaches to the text's end, so that the steps of all pieces come to the text's length.
    """
    lengths = lambda group: F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)), lambda x: F.length(x))
    gaps = F.transform(F.split(text, rule.pattern), lambda x: F.length(x))

    def of(sizes: Column) -> Column:
        found = F.zip_with(sizes, lengths(rule.group) if rule.group else sizes, lambda a, b: F.struct(a.alias("size"), b.alias("part")))
        step = lambda gap, m: (gap + F.coalesce(m["size"], F.lit(0))).cast("long")
        return F.zip_with(gaps, found, lambda gap, m: F.struct(F.lit(rank).alias("rank"), m["size"].alias("size"), m["part"].alias("part"), step(gap, m).alias("step")))

    return let(lengths(0), of)


def spans_of(pieces: Column, sums: Column, length: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans from the pieces of one rule after another and the running sums of their steps, which go once through the text for each rule."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    least = F.array(*(F.lit(max(1, r.least)) for r in rules))
    kept = F.filter(F.arrays_zip(pieces.alias("p"), sums.alias("sum")), lambda x: x["p"]["part"] >= F.get(least, x["p"]["rank"]))

    def span(x: Column) -> Column:
        end = ((x["sum"] - 1) % length + 1).cast("int")
        return F.struct((end - x["p"]["size"]).alias("start"), x["p"]["rank"].alias("rank"), F.get(kinds, x["p"]["rank"]).alias("kind"), end.alias("end"))

    return F.array_sort(F.transform(kept, span))


#: The expression that finds a rule's spans. A match of characters that are all of one class, and so ends where its run ends, can be asked for by its least length at once.
FAST = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}


def scan(docs: DataFrame, *keep: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The named columns of each document with ``spans``: start, rank, kind and end of every secret, in order."""
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    wanted = sorted(set().union(*map(trigrams, queries.values())))
    rows = docs.select(*keep, *({"doc_id", "text"} - set(keep)))
    rows = rows.withColumn("_text", F.coalesce("text", F.lit("")))
    if queries:
        plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        found = candidates(index(plain, wanted), queries, wanted)
        rows = rows.withColumn("_key", key_of(F.col("doc_id"), F.col("_text"))).join(found.withColumnRenamed("key", "_key"), "_key", "left")
        asked_of = F.coalesce(F.col("rules"), F.array().cast("array<int>"))
    none = F.array().cast(PIECE)
    quick = tuple(Rule(r.kind, FAST[r.kind], 0, 0, r.base) if r.kind in FAST else r for r in rules)
    each = []
    for k, rule in enumerate(quick):
        asked = F.array_contains(asked_of, F.lit(k)) if k in queries else F.lit(True)
        each.append(F.when(asked & F.rlike("_text", F.lit(rule.pattern)), pieces_of(rule, k, F.col("_text"))).otherwise(none))
    found = rows.select(*keep, F.length("_text").alias("_length"), F.concat(*each).alias("_pieces"))
    sums = found.withColumn("_sums", running(F.transform("_pieces", lambda p: p["step"]), total))
    return sums.select(*keep, F.when(F.size("_pieces") == 0, F.array().cast(SPAN)).otherwise(spans_of(F.col("_pieces"), F.col("_sums"), F.col("_length"), quick)).alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans of each document."""
    base = [k for k, r in enumerate(rules) if r.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs, "doc_id", rules=rules).select(
        "doc_id",
        *(count(rules[k].kind) for k in base),
        F.sha2(_written(F.filter("spans", lambda s: s["rank"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )


APART = "array<struct<start:int,kind:string,end:int>>"


def merged(spans: Column) -> Column:
    """(start, kind, end) of spans in order, those that overlap made one under the first one's kind."""

    def of(tops: Column) -> Column:
        marked = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), i.alias("i")))
        heads = F.filter(marked, lambda s: (s["i"] == 0) | (s["start"] >= F.get(tops, s["i"] - 1)))
        end = lambda x, j: F.get(tops, F.coalesce(F.get(x, j + 1)["i"], F.size(tops)) - 1)
        return let(heads, lambda x: F.transform(x, lambda h, j: F.struct(h["start"].alias("start"), h["kind"].alias("kind"), end(x, j).alias("end"))))

    return let(running(F.transform(spans, lambda s: s["end"]), F.greatest), of)


def cut_up(pieces: Column) -> Column:
    """Pieces of a text (text, at, spans), those with more than one span cut at spans in up to FACTOR parts."""

    def parts(p: Column) -> Column:
        n = F.size(p["spans"])
        most = F.least(n, F.lit(FACTOR))
        place = lambda k: F.floor(k * n / most).cast("int")

        def part(k: Column) -> Column:
            low, high = place(k), place(k + 1)
            begin = F.when(k == 0, p["at"]).otherwise(F.get(p["spans"], low)["start"])
            end = F.coalesce(F.get(p["spans"], high)["start"], p["at"] + F.length(p["text"]))
            return F.struct(F.substring(p["text"], begin - p["at"] + 1, end - begin).alias("text"), begin.alias("at"), F.slice(p["spans"], low + 1, high - low).alias("spans"))

        return F.when(n <= 1, F.array(p)).otherwise(F.transform(F.sequence(F.lit(0), most - 1), part))

    return let(pieces, lambda x: F.when(F.forall(x, lambda p: F.size(p["spans"]) <= 1), x).otherwise(F.flatten(F.transform(x, parts))))


def marked(p: Column) -> Column:
    """A piece with one span at most, that replaced by its kind in brackets."""
    s = F.get(p["spans"], F.lit(0))
    rest = F.substring(p["text"], s["end"] - p["at"] + 1, F.length(p["text"]))
    return F.when(F.size(p["spans"]) == 0, p["text"]).otherwise(F.concat(F.substring(p["text"], F.lit(1), s["start"] - p["at"]), F.lit("["), s["kind"], F.lit("]"), rest))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = REPLACED) -> DataFrame:
    """The documents with every secret, private keys whole, replaced by its kind in brackets; overlapping secrets are replaced together, by the first kind.

    ``n_chars``, if there, is counted anew.
    """
    names = docs.columns
    rest = [c for c in names if c not in ("text", "n_chars")]
    rows = docs.select(F.struct(*rest).alias("_row"), "doc_id", "text")
    found = scan(rows, "_row", "text", rules=rules)
    whole = F.array(F.struct("text", F.lit(0).alias("at"), merged(F.col("spans")).alias("spans")))
    made = found.select("_row", F.when(F.size("spans") == 0, F.array(F.struct("text", F.lit(0).alias("at"), F.array().cast(APART).alias("spans")))).otherwise(whole).alias("_pieces"))
    for _ in range(STEPS):
        made = made.withColumn("_pieces", cut_up(F.col("_pieces")))
    pieces = F.transform("_pieces", marked)
    made = made.select("_row", F.when(F.size(pieces) == 1, F.get(pieces, F.lit(0))).otherwise(F.array_join(pieces, "")).alias("_text"))
    fresh = {"text": F.col("_text"), "n_chars": F.length(F.coalesce("_text", F.lit(""))).cast("long")}
    return made.select(*(fresh[c].alias(c) if c in fresh else F.col(f"_row.`{c}`").alias(c) for c in names))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The report's rows in SQL, by each rule's own expression over all texts."""

    def matches(k: int, rule: Rule) -> str:
        pattern = "'" + FAST.get(rule.kind, rule.pattern).replace("'", "''") + "'"
        group, least = (0, 1) if rule.kind in FAST else (rule.group, max(1, rule.least))
        return f"""SELECT r, {k} AS k, '{rule.kind}' AS kind, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS a,
            length(found[i]) AS n FROM (SELECT r, gaps, found, part, unnest(range(1, len(found) + 1)) AS i FROM (SELECT r, string_split_regex(t, {pattern}) AS gaps, regexp_extract_all(t, {pattern}, 0) AS found,
            regexp_extract_all(t, {pattern}, {group}) AS part FROM docs)) WHERE length(part[i]) >= {least}"""

    base = [k for k, rule in enumerate(rules) if rule.base]
    text = "kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT)"
    counts = ", ".join(f"count(kind) FILTER (k = {k}) AS n_{rules[k].kind}" for k in base)
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(matches(k, x) for k, x in enumerate(rules))})
        SELECT doc_id, {counts}, sha256(coalesce(string_agg({text}, ',' ORDER BY a, k) FILTER (k IN ({", ".join(map(str, base))})), '')) AS base_sha256, coalesce(string_agg({text}, ',' ORDER BY a, k), '') AS spans
        FROM docs LEFT JOIN s USING (r) GROUP BY r, doc_id"""
