"""Conversation repair against all edits, and against a search that keeps whole letters."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb


from ridgeline.llm import conversations as c

BLANK = "\x20\t\n\x0b\x0c\r"


def cheapest_of_all(rows):
    gaps = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    found = []

    def go(k, cost, audit, roles):
        for gap in gaps:
            at = cost + 5 * len(gap), audit + "I" * len(gap), roles + "".join(gap)
            if k == len(rows):
                if re.fullmatch("(s?(ua)+)?", at[2]):
                    found.append(at[:2])
                continue
            initial, keep, extra = rows[k]
            go(k + 1, at[0] + 2, at[1] + "D", at[2])
            if keep:
                go(k + 1, at[0] + extra, at[1] + "K", at[2] + initial)
                for role in "ua":
                    go(k + 1, at[0] + 1 + extra, at[1] + "R", at[2] + role)

    go(0, 0, "", "")
    return min(found)


def cheapest(rows):
    """States with whole letters: (cost, letters, repaired rows)."""

    def offered(ways, state, way):
        if state not in ways or way[:2] < ways[state][:2]:
            ways[state] = way

    def inserted(ways):
        for _ in range(3):
            for q, (cost, letters, out) in list(ways.items()):
                offered(ways, c.NEXT[q], (cost + 5, letters + "I", (*out, c.ROLES[c.NEXT[q]] + ":")))
        return ways

    ways = inserted({c.START: (0, "", ())})
    for role, text, keep, extra in rows:
        new = {}
        for q, (cost, letters, out) in ways.items():
            offered(new, q, (cost + 2, letters + "D", out))
            if keep:
                if (q, role[:1]) in c.BY_INITIAL:
                    offered(new, c.BY_INITIAL[q, role[:1]], (cost + extra, letters + "K", (*out, f"{role}:{text}")))
                offered(new, c.NEXT[q], (cost + 1 + extra, letters + "R", (*out, f"{c.ROLES[c.NEXT[q]]}:{text}")))
        ways = inserted(new)
    return min(ways[q] for q in c.ENDS if q in ways)


def searched(rows):
    search, out = c.Survivors(), []
    for row in rows:
        out += search.step(*row)
    cost, rest = search.close()
    return cost, "".join(out + rest)


def test_search_finds_the_cheapest_of_all_edits():
    r = random.Random(2)
    for _ in range(150):
        rows = [(r.choice("suat "), r.random() < 0.8, r.choice((0, 0, 5))) for _ in range(r.randrange(4))]
        assert searched(rows) == cheapest_of_all(rows)


def test_search_equals_whole_letters():
    r = random.Random(3)
    for k in range(800):
        rows = [(r.choice(("suat ", "ua", "u", "sua")[k % 4]), r.random() < 0.8, r.choice((0, 0, 5))) for _ in range(r.randrange(60))]
        assert searched(rows) == cheapest([(i, "", keep, extra) for i, keep, extra in rows])[:2]


def test_survivors_coalesce():
    search = c.Survivors()
    assert sum(len(search.step("ua"[k % 2], True, 0)) for k in range(5_000)) > 4_990
    for initial in "dt":  # what isn't resolved is still found
        search = c.Survivors()
        rows = [(initial, initial != "d", 0)] * 301 + [("a", True, 0), ("u", True, 5)] * 20
        assert searched(rows) == cheapest([(i, "", keep, extra) for i, keep, extra in rows])[:2]


def brute(rows):
    by = {}
    for conv_id, turn, role, text in rows:
        kept = by.setdefault(conv_id, [])
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept.extend([(turn is not None, turn or 0, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = []
    for conv_id, kept in by.items():
        kept.sort()
        count, seen, ready = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
        for _, _, role, text in kept:
            last = text.rstrip(BLANK)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                count[fault] += 1
            ready.append((role, text, fault not in ("blank", "duplicate"), 5 if fault == "truncated" else 0))
        turns = [t for has, t, *_ in kept if has]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        cost, audit, lines = cheapest(ready)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv_id, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, c.audits(c.damaged(df)).collect()), key=str)


def test_table(spark, data):
    df = spark.read.parquet(f"{data}/conversations.parquet")
    assert rows_of(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark):
    r = random.Random(4)
    texts = ["Yes.", "No!", "cut off", " \t\n", "", None, "Why?  \n", "long " * 20_000 + ".", "ü😀."]
    rows = [(conv, r.choice((None, *range(12))), r.choice(("user", "assistant", "system", "tool", "", None)), r.choice(texts)) for conv in (None, *range(40)) for _ in range(r.randrange(1, 25))]
    rows += rows[:20] + [(99, turn, "user", "Same.") for turn in range(400)]
    rows += [(100, turn, ("user", "assistant")[turn % 2], f"Turn {turn}.") for turn in range(3_000)]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "conv_id long, turn long, role string, text string, at string, part int").repartition(3)
    assert rows_of(df) == brute(rows)


def test_dropped_conversations_stay(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert rows_of(df) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert rows_of(df.where("false")) == []


def test_one_exchange(spark, data):
    df = spark.read.parquet(f"{data}/conversations.parquet")
    plan = c.audits(c.damaged(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_repaired_rows_have_the_structure(spark, data):
    df = spark.read.parquet(f"{data}/conversations.parquet")
    by = {}
    for r in c.repaired(c.damaged(df)).where("edit IN ('K', 'R', 'I')").orderBy("conv_id", "at").collect():
        by.setdefault(r.conv_id, []).append(r.role[:1])
    assert by
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in by.values())


def test_equals_sql(spark, data, duck):
    def equal(df, connection):
        found = connection.sql(c.oracle())
        assert sorted(map(str, map(tuple, c.audits(c.damaged(df)).select(*found.columns).collect()))) == sorted(map(str, found.fetchall()))

    equal(spark.read.parquet(f"{data}/conversations.parquet"), duck)
    r = random.Random(9)
    texts = ["Yes.", "No!", "cut off", " \t\n", "", None, "Why?  \n", "ü😀."]
    rows = [(conv, r.choice((None, *range(12))), r.choice(("user", "assistant", "system", "tool", "", None)), r.choice(texts)) for conv in (None, *range(60)) for _ in range(r.randrange(1, 20))]
    own = duckdb.connect()
    own.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    own.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows + rows[:20])
    equal(spark.createDataFrame(rows + rows[:20], "conv_id long, turn long, role string, text string"), own)
