"""Repair of the turn structure of conversations by a Viterbi search that emits edits as its survivors coalesce.

A conversation's rows are read in order as one stream. The search keeps the cheapest edits that lead to each state of the wanted
structure: nothing yet, after a system row, after a user row, after an assistant row. Their edits are a tree with one leaf for each
surviving state (``Survivors``): a node holds a run of edits and counts the branches that refer to it; a branch that no survivor needs goes, a node
with one branch is joined to it, and what all survivors share is emitted. So only unresolved edits are held, one character
for each row and branch, however long the conversation. Of equally cheap edits those whose letters sort first win. Branches of one node begin with different letters, as
a letter's effect follows from the state, so that the first letters behind the last shared node decide as the complete unresolved suffixes would.

Rows pass through the search and edits follow them; a second sort within the partition brings both together. One exchange, by conversation, serves all,
and no task holds more of a conversation than one batch of rows and its unresolved edits. A conversation is one stream because its digest is.

Defined cases: nulls in ``conv_id``, ``turn``, ``role`` and ``text`` count as one space, but a null turn sorts first and counts in no gap, and null conversations are one;
rows of equal turn go by role, then text; equal rows are a row and its duplicates; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS

KEEP, REROLE, DELETE, INSERT = "KRDI"
#: Costs of edits, and of a truncated row that stays.
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
#: States of the structure; it may end before the first row and after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: The state after a row of an initial, and the one after a row of the role that the structure wants next.
BY_INITIAL = {(START, "s"): SYSTEM, **{(q, "u"): USER for q in (START, SYSTEM, ASSISTANT)}, (USER, "a"): ASSISTANT}
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: (state, other, surplus): whatever ends a conversation from the state ends it from the other too, for this much more at most: a system row goes instead of staying.
COVERED = ((START, ASSISTANT, COST[DELETE]), (ASSISTANT, START, 0), (SYSTEM, ASSISTANT, 0), (SYSTEM, START, 0))


class Node:
    """A run of edits after those of ``parent``; ``refs`` counts its branches and whether a survivor ends here."""

    __slots__ = ("letters", "parent", "refs")

    def __init__(self, parent: Node | None):
        self.parent, self.letters, self.refs = parent, [], 0


def _path(node: Node) -> list[Node]:
    out = []
    while node:
        out.append(node)
        node = node.parent
    return out[::-1]


class Survivors:
    """The cheapest edits that lead to each state, as a tree. ``step`` takes a row, ``close`` ends a conversation, and both return the edits that are resolved."""

    def __init__(self):
        self.root = Node(None)
        self.best: dict[int, tuple[int, Node]] = {}
        self._take({START: (0, self.root, "")})
        self._take(self._inserted({q: (c, n, "") for q, (c, n) in self.best.items()}))

    def _before(self, a: tuple[int, Node, str], b: tuple[int, Node, str]) -> bool:
        """Whether one way is cheaper than another, or as cheap and its letters sort first."""
        if a[0] != b[0]:
            return a[0] < b[0]
        if a[1] is b[1]:
            return a[2] < b[2]
        left, right = _path(a[1]), _path(b[1])
        k = 0
        while k < len(left) and k < len(right) and left[k] is right[k]:
            k += 1
        return (left[k].letters[0] if k < len(left) else a[2]) < (right[k].letters[0] if k < len(right) else b[2])

    def _offer(self, ways: dict, state: int, way: tuple[int, Node, str]) -> None:
        if state not in ways or self._before(way, ways[state]):
            ways[state] = way

    def _inserted(self, ways: dict) -> dict:
        """The ways with rows inserted after them; two steps reach every state."""
        for _ in range(2):
            for state, (cost, node, letters) in list(ways.items()):
                self._offer(ways, NEXT[state], (cost + COST[INSERT], node, letters + INSERT))
        return ways

    def _take(self, ways: dict[int, tuple[int, Node, str]]) -> None:
        """The ways become the survivors: each letter is a branch, shared by the ways that have it; what no survivor needs goes.

        A way that is dearer than another with all that can come after it doesn't survive, so that deleting all rows, say, doesn't keep the tree from coalescing.
        """
        for state, other, surplus in COVERED:
            if state in ways and other in ways and ways[other][0] + surplus < ways[state][0]:
                del ways[state]
        old = [node for _, node in self.best.values()]
        made: dict[tuple[int, str], Node] = {}
        best = {}
        for state, (cost, node, letters) in ways.items():
            tip = node
            for k in range(len(letters)):
                key = id(node), letters[: k + 1]
                if key not in made:
                    made[key] = new = Node(tip)
                    new.letters.append(letters[k])
                    tip.refs += 1
                tip = made[key]
            tip.refs += 1
            best[state] = cost, tip
        for node in old:
            self._release(node)
        self.best = {state: (cost, self._joined(node)) for state, (cost, node) in best.items()}

    def _release(self, node: Node | None) -> None:
        while node:
            node.refs -= 1
            if node.refs or node is self.root:
                return
            node = node.parent

    def _joined(self, leaf: Node) -> Node:
        """The leaf, after its ancestors of a single branch were joined to their branch."""
        node = leaf
        while node.parent:
            above = node.parent
            if above.refs == 1:
                if len(above.letters) > len(node.letters):  # the shorter run moves
                    above.letters.extend(node.letters)
                    node.letters = above.letters
                else:
                    node.letters[:0] = above.letters
                node.parent = above.parent
                if above is self.root:
                    self.root = node
            else:
                node = above
        return leaf

    def step(self, initial: str, keep: bool, extra: int) -> list[str]:
        """Takes a row: ``keep`` is false for one that must go, ``extra`` is what it costs if it stays."""
        ways: dict[int, tuple[int, Node, str]] = {}
        for state, (cost, node) in self.best.items():
            self._offer(ways, state, (cost + COST[DELETE], node, DELETE))
            if keep:
                to = BY_INITIAL.get((state, initial))
                if to is not None:
                    self._offer(ways, to, (cost + COST[KEEP] + extra, node, KEEP))
                self._offer(ways, NEXT[state], (cost + COST[REROLE] + extra, node, REROLE))
        self._take(self._inserted(ways))
        return self._resolved()

    def _resolved(self) -> list[str]:
        """The letters that all survivors share."""
        out, self.root.letters = self.root.letters, []
        return out

    def close(self) -> tuple[int, list[str]]:
        """(cost, the letters that weren't resolved) of the cheapest end."""
        ways = {state: (cost, node, "") for state, (cost, node) in self.best.items() if state in ENDS}
        end = min(ways)
        for state in ways:
            if self._before(ways[state], ways[end]):
                end = state
        cost, node, _ = ways[end]
        return cost, [x for n in _path(node) for x in n.letters]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, dropped): rows after damage; a dropped row stays as a mark that its conversation was there."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    hurt = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 0, "").when(kind == 4, F.lit("user")).otherwise(blank("role")).alias("role"),
        F.when(kind == 0, "").otherwise(hurt).alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(copies).alias("copy"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """The rows with ``fault``, the first of blank, duplicate and truncated that they have, in the order of their conversations within partitions.

    Windows by conversation, role and text need no other exchange than the one by conversation.
    """
    text, last = F.col("text"), F.rtrim("text", F.lit(BLANKS))
    earlier = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    fault: Column = F.when(F.col("dropped"), None).when(last == "", "blank").when(F.col("_nth") > 1, "duplicate").when(~F.right(last, F.lit(1)).isin(".", "!", "?"), "truncated")
    dealt = rows.repartition("conv_id").withColumn("_nth", F.row_number().over(earlier))
    return dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", text, "copy", "_nth").select("conv_id", "turn", "role", "text", "dropped", fault.alias("fault"))


#: A row has ``part`` 0, its edit 1 and rows that are inserted after it 2 and up. A closing row, behind all, has the cost and the counts.
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
SEARCHED = "conv_id long, at long, part int, edit string, role string, text string, cost long, " + ", ".join(f"{c} long" for c in COUNTS)
#: A row after repair with its edit, and what the row was; deleted rows have no role and text, the closing row no edit.
REPAIRED = SEARCHED.replace("part int, ", "")
AUDITS = "conv_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, "cost")) + ", audit string, repaired_sha256 string"
CLOSING = 1 << 62
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in columns.split(", ")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class _Open:
    """A conversation while its rows go by."""

    def __init__(self, conv_id):
        self.conv_id, self.search, self.counts = conv_id, Survivors(), dict.fromkeys(COUNTS, 0)
        self.rows = self.edited = self.part = self.turns = 0
        self.initial = self.first = self.last = None

    def row(self, turn: int | None, initial: str, fault: str | None) -> Iterator[tuple]:
        self.rows += 1
        if fault:
            self.counts[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = initial
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        return self._edits(self.search.step(initial, fault not in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0))

    def _edits(self, letters: list[str]) -> Iterator[tuple]:
        for x in letters:
            self.edited, self.part = (self.edited, self.part + 1) if x == INSERT else (self.edited + 1, 1)
            yield self.conv_id, self.edited, self.part, x, *NOTHING

    def close(self) -> Iterator[tuple]:
        cost, letters = self.search.close()
        yield from self._edits(letters)
        if self.turns:
            self.counts["gaps"] = self.last - self.first + 1 - self.turns
        yield self.conv_id, CLOSING, 0, None, None, None, cost, *self.counts.values()


NOTHING = (None,) * (3 + len(COUNTS))


def searched(rows: DataFrame) -> DataFrame:
    """Rows of ``faults`` with their edits, put together by sorting each partition by (conv_id, at, part)."""

    def run(batches):
        schema = _schema(SEARCHED)
        now = None
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                piece = batch.slice(start, 1024)
                places, found = [], []
                for conv_id, turn, initial, dropped, fault in zip(*(piece[c].to_pylist() for c in ("conv_id", "turn", "initial", "dropped", "fault")), strict=True):
                    if now is None or now.conv_id != conv_id:
                        if now is not None:
                            found.extend(now.close())
                        now = _Open(conv_id)
                    if not dropped:
                        found.extend(now.row(turn, initial, fault))
                        places.append(now.rows)
                stay = piece.filter(pa.compute.invert(piece["dropped"]))
                n = stay.num_rows
                empty = {f.name: pa.nulls(n, f.type) for f in schema}
                columns = empty | {"conv_id": stay["conv_id"], "at": pa.array(places, pa.int64()), "part": pa.array([0] * n, pa.int32()), "role": stay["role"], "text": stay["text"]}
                yield pa.RecordBatch.from_arrays(list(columns.values()), schema=schema)
                if found:
                    yield _batch(found, schema)
        if now is not None:
            yield _batch(list(now.close()), schema)

    return rows.withColumn("initial", F.left("role", F.lit(1))).mapInArrow(run, SEARCHED).sortWithinPartitions("conv_id", "at", "part")


def repaired(conversations: DataFrame) -> DataFrame:
    """The conversations after repair, within partitions in order: every edit with the row that it makes, and a closing row with cost and counts for each conversation."""

    def run(batches):
        schema = _schema(REPAIRED)
        state, held = START, None
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                out = []
                for conv_id, at, part, edit, role, text, *rest in zip(*(c.to_pylist() for c in batch.slice(start, 512).columns), strict=True):
                    if at == CLOSING:
                        out.append((conv_id, at, None, None, None, *rest))
                        state, held = START, None
                    elif part == 0:
                        held = role, text
                    elif edit == DELETE:
                        out.append((conv_id, at, edit, None, None, *rest))
                    else:
                        state = BY_INITIAL[state, held[0][0]] if edit == KEEP else NEXT[state]
                        now = held[0] if edit == KEEP else ROLES[state]
                        out.append((conv_id, at, edit, now, "" if edit == INSERT else held[1], *rest))
                if out:
                    yield _batch(out, schema)

    return searched(faults(conversations)).mapInArrow(run, REPAIRED)


def audits(conversations: DataFrame) -> DataFrame:
    """Of each conversation (see ``damaged``): counts, cost, the letters of its edits and the digest of its repaired rows."""

    def run(batches):
        schema = _schema(AUDITS)
        letters, digest, first = [], hashlib.sha256(), True
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                out = []
                for conv_id, at, edit, role, text, cost, *counts in zip(*(c.to_pylist() for c in batch.slice(start, 512).columns), strict=True):
                    if at == CLOSING:
                        out.append((conv_id, *counts, cost, "".join(letters), digest.hexdigest()))
                        letters, digest, first = [], hashlib.sha256(), True
                        continue
                    letters.append(edit)
                    if edit != DELETE:
                        digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                        first = False
                if out:
                    yield _batch(out, schema)

    return repaired(conversations).mapInArrow(run, AUDITS)


def oracle() -> str:
    """The audits in SQL: ways with their whole letters and rows, the least of each state kept row by row."""
    way = "STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])"
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)

    def gone(s: str) -> str:
        return f"CASE WHEN {s} IS NOT NULL THEN CAST({{'c': {s}.c + {COST[DELETE]}, 'a': {s}.a || '{DELETE}', 'o': {s}.o}} AS {way}) END"

    def made(s: str, cost: str, letter: str, line: str, when: str = "true") -> str:
        return f"CASE WHEN {s} IS NOT NULL AND {when} THEN CAST({{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'o': list_append({s}.o, {line})}} AS {way}) END"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def inserted(s: str, role: str) -> str:
        return made(s, str(COST[INSERT]), INSERT, f"'{role}:'")

    def kept(s: str, initial: str) -> str:
        return made(s, f"{COST[KEEP]} + extra", KEEP, "role || ':' || text", f"ok AND initial = '{initial}'")

    def turned(s: str, role: str) -> str:
        return made(s, f"{COST[REROLE]} + extra", REROLE, f"'{role}:' || text", "ok")

    before_user = ("s0", "s1", "s3")
    step = f"""SELECT conv_id, pos, {gone('s0')} AS s0, {least(gone('s1'), kept('s0', 's'))} AS s1,
        {least(gone('s2'), *(f(s, x) for s in before_user for f, x in ((kept, 'u'), (turned, 'user'))))} AS s2, {least(gone('s3'), kept('s2', 'a'), turned('s2', 'assistant'))} AS s3
        FROM (SELECT f.*, s0, s1, s2, s3 FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.pos = dp.pos + 1)"""
    once = f"SELECT conv_id, pos, s0, s1, {least('s2', *(inserted(s, 'user') for s in before_user))} AS s2, {least('s3', inserted('s2', 'assistant'))} AS s3 FROM ({step})"
    twice = f"SELECT conv_id, pos, s0, s1, {least('s2', inserted('s3', 'user'))} AS s2, {least('s3', inserted('s2', 'assistant'))} AS s3 FROM ({once})"
    start = lambda cost, letters, *lines: f"CAST({{'c': {cost}, 'a': '{letters}', 'o': {list(lines)}}} AS {way})"
    bytes_of = "list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))"
    crc = f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_of}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"
    return f"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    h AS (SELECT *, {crc} % 20 AS kind FROM raw),
    d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE kind <> 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy, nth) AS pos, rtrim(text, {blanks}) AS whole, substr(role, 1, 1) AS initial
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d)),
    f AS (SELECT *, fault IS NULL OR fault = 'truncated' AS ok, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS extra, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS earlier
        FROM (SELECT *, CASE WHEN whole = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(whole, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM r)),
    dp AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, {start(0, '')} AS s0, CAST(NULL AS {way}) AS s1, {start(COST[INSERT], INSERT, 'user:')} AS s2, {start(2 * COST[INSERT], 2 * INSERT, 'user:', 'assistant:')} AS s3 FROM f
        UNION ALL {twice}),
    g AS (SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, {', '.join(f"count(*) FILTER (fault = '{x}') AS {x}" for x in ('blank', 'duplicate', 'truncated'))},
        count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
    e AS (SELECT g.*, {least('s0', 's3')} AS best FROM g JOIN dp ON dp.conv_id IS NOT DISTINCT FROM g.conv_id AND dp.pos = g.n)
    SELECT i.conv_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in COUNTS)}, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM i.conv_id"""
