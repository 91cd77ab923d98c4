"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for
each rule that fails; a policy is a version name with the mask of the rules that it enforces, so a new
policy or an ablation needs only bitwise arithmetic over the ledger and never the texts again.
Everything here is made of built-in column expressions.

Defined cases: a null or blank text has no words and fails ``few_words``; repeated rows and ids are
judged row by row; extra columns are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: Hashes that occur twice are looked up one by one up to this many, sorted with their places beyond it. Either way is exact.
FEW = 12


def _covered(places: Column) -> Column:
    """Words in the 3-word windows that start at the given ascending places."""
    news = let(places, lambda p: F.transform(p, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - p[i - 1]))))
    return F.aggregate(news, F.lit(0), lambda a, x: a + x)


def _sorted_places(windows: Column) -> Column:
    """Places of the windows that occur twice or more, by sorting windows with their places."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    kept = let(
        pairs,
        lambda s: F.filter(
            s,
            lambda x, k: (F.when(k == 0, F.lit(False)).otherwise(s[k - 1]["h"] == x["h"]))
            | (F.when(k == F.size(s) - 1, F.lit(False)).otherwise(s[k + 1]["h"] == x["h"])),
        ),
    )
    return F.sort_array(F.transform(kept, lambda x: x["i"]))


def repeated_words(tokens: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the same text.

    Windows are compared by a 64-bit hash of their three words.
    """

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

        def count(h: Column) -> Column:
            twice = let(F.sort_array(h), lambda s: F.filter(s, lambda x, i: F.when(i == 0, F.lit(False)).otherwise(x == s[i - 1])))
            return let(
                F.array_distinct(twice),
                lambda d: F.when(F.size(d) == 0, F.lit(0))
                .when(F.size(d) <= FEW, _covered(F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(d, h[i]))))
                .otherwise(_covered(_sorted_places(h))),
            )

        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, count))

    return let(tokens, of).cast("long")


def _count(text: Column, runs: str) -> Column:
    """Characters of a text in the runs that a pattern matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, runs, ""))).cast("long")


def _lines(text: Column) -> Column:
    """(lines with a word, those of them that equal an earlier line)."""
    full = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    return let(full, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


#: The measurements, in the ledger's order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")

#: (name, fails): bit k of the ledger is rule k. New rules go to the end, so that stored ledgers stay valid.
RULES = (
    ("few_words", lambda m: m["n_words"] < 50),
    ("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    ("symbols", lambda m: 100 * m["n_symbols"] > 30 * m["n_words"]),
    ("duplicate_lines", lambda m: (m["n_lines"] >= 6) & (100 * m["n_dup_lines"] > 50 * m["n_lines"])),
    ("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
    ("capitals", lambda m: (m["word_chars"] >= 50) & (100 * m["n_upper"] > 40 * m["word_chars"])),
    ("exclamations", lambda m: 100 * m["n_marks"] > 60 * m["n_words"]),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: Policies by version: the mask of enforced rules.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": BIT["few_words"] | BIT["repeated_words"] | BIT["symbols"] | BIT["duplicate_lines"],
    "v2": sum(BIT.values()),
}


def ledger(docs: DataFrame, *keep: str) -> DataFrame:
    """The named columns of each document, the measurements and ``failures``, the bits of its failed rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = words(F.col("text"))
    counts = let(
        tokens,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    measured = docs.select(
        *keep,
        counts.alias("_counts"),
        _lines(text).alias("_lines"),
        _count(text, r"[#*$%&|<>]+").alias("n_symbols"),
        _count(text, r"\p{Lu}+").alias("n_upper"),
        (F.length(text) - F.length(F.replace(text, F.lit("!")))).cast("long").alias("n_marks"),
    ).select(*keep, "_counts.*", "_lines.*", "n_symbols", "n_upper", "n_marks")
    m = {name: F.col(name) for name in MEASURES}
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(fails(m), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measured.select(*keep, *MEASURES, bits.alias("failures"))


def passes(policy: str, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def apply_policy(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The documents that the policy keeps, with all of their columns."""
    names = [c for c in docs.columns]
    return ledger(docs.select(F.struct(*names).alias("_row"), "text"), "_row").where(passes(policy)).select("_row.*")


def ablation(book: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects.

    The ledger is first grouped by its bits, of which there are at most 2 to the number of rules.
    """
    mask = F.lit(POLICIES[policy]).cast("long")
    groups = book.groupBy(F.col("failures").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in BIT if POLICIES[policy] & BIT[name]))
    return (
        groups.select("bits", "n", F.inline(rules))
        .groupBy("rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def measured(docs: DataFrame) -> DataFrame:
    """The ledger by document with the verdicts of the base and the current policy."""
    base = passes("base")
    book = ledger(docs, "doc_id")
    return book.select(
        "doc_id",
        *MEASURES,
        "failures",
        (~base).alias("base_failed"),
        passes("v1").alias("kept_v1"),
        (base & passes("v2")).alias("kept"),
    )


#: The same rows in SQL.
ORACLE = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
    SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs)
), twice AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY r
), m AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
        CAST(length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS BIGINT) AS n_upper, CAST(length(regexp_replace(t, '[^!]+', '', 'g')) AS BIGINT) AS n_marks
    FROM docs LEFT JOIN covered USING (r)
), b AS (
    SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 30 * n_words)::INT + 8 * (n_lines >= 6 AND 100 * n_dup_lines > 50 * n_lines)::INT
        + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT + 32 * (word_chars >= 50 AND 100 * n_upper > 40 * word_chars)::INT + 64 * (100 * n_marks > 60 * n_words)::INT AS BIGINT) AS failures FROM m
)
SELECT *, failures & 3 <> 0 AS base_failed, failures & 15 = 0 AS kept_v1, failures = 0 AS kept FROM b
"""

_BITS = ", ".join(f"('{name}', {BIT[name]})" for name in BIT if POLICIES["v2"] & BIT[name])
#: The ablation of the current policy in SQL.
ABLATION = f"""
SELECT rule, count(*) FILTER (failures & bit <> 0) AS n_failed, count(*) FILTER (failures & {POLICIES["v2"]} = bit) AS n_only
FROM ({ORACLE}) CROSS JOIN (VALUES {_BITS}) v(rule, bit) GROUP BY rule
"""
