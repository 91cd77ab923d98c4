"""Fill-in-middle texts against whole-text assembly and SQL."""

import hashlib

import pytest

from ridgeline.llm import infill
from ridgeline.llm.common import documents

ODD = [
    (1, "a\nb\nc\nd\n"),
    (1, "a\nb\nc\nd\n"),
    (1, "another\ntext\nof one id"),
    (2, None),
    (3, ""),
    (None, "no id\nat all"),
    (4, "\n\n\n"),
    (5, "holds <S> a mark\nso plain\n"),
    (6, "ends with <\nthen\n<P\n>"),
    (7, "x" * 200_000),
    (8, "".join(f"Zeile {k} ü😀\r\n" for k in range(20_000))),
    (9, ("y" * 40_000 + "\n") * 5),
    *((k, f"line {k}\n" * (k % 7) + "end") for k in range(10, 40)),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "clash", 1) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, row long").repartition(3)


def whole(doc_id, text, options):
    text = text or ""
    units = infill.UNIT.findall(text)
    h = [int(hashlib.sha256(f"{options.seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in options.marks) or h[2] % 100 >= options.rate:
        return len(units), "plain", None, None, text
    spm = h[3] % 100 < options.suffix_first
    p, s, m = options.marks
    return len(units), "spm" if spm else "psm", len(pre), len(mid), s + suf + p + pre + m + mid if spm else p + pre + s + suf + m + mid


@pytest.mark.parametrize("options", [infill.Options(), infill.Options(seed=3, rate=70, suffix_first=60, prefix="<fim_a>", suffix="<fim_b>", middle="<fim_c>")])
def test_digests_equal_whole_texts(odd, options):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((d, *(w := whole(d, t, options))[:4], sha(w[4]), sha(t or "")) for d, t in ODD), key=str)
    assert sorted(map(tuple, infill.digests(odd, options).collect()), key=str) == want
    forms = {w[2] for w in want}
    assert forms == {"plain", "spm", "psm"}


def test_pieces_are_bounded_and_put_together(odd):
    pieces = infill.transformed(odd)
    assert max(len(r.piece) for r in pieces.collect()) <= infill.PIECE
    got = sorted(((r.doc_id, r.form, r.text) for r in infill.texts(pieces).collect()), key=str)
    assert got == sorted(((d, (w := whole(d, t, infill.Options()))[1], w[4]) for d, t in ODD), key=str)


def test_one_exchange(odd):
    plan = infill.digests(odd.limit(1_000_000))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1


def test_equals_sql(spark, data, duck):
    found = duck.sql(infill.oracle())
    got = infill.digests(documents(spark, data)).select(*found.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, found.fetchall()))


def test_empty_table(odd):
    assert infill.digests(odd.where("false")).collect() == []
