"""Token counts by chunks against the library over whole texts."""

import random

import pytest
from tokenizers import Tokenizer

from ridgeline.llm import token_counts
from ridgeline.llm.common import documents


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_counts.VOCABULARY)


def odd_texts():
    r = random.Random(5)
    parts = [" ", "  ", "\n", "\t\n ", "'s", "'re", "don't", "ü", "😀", "word", "12345", "!?!", "<|endoftext|>", "<|endof", "text|>", " ", "a" * 90, " " * 70, "7" * 50, "'", "'l"]
    mixed = ["".join(r.choices(parts, k=r.randrange(1, 400))) for _ in range(120)]
    return [None, "", "a", " ", "<|endoftext|>" * 200, "x" * 5_000, " " * 3_000, "word " * 3_000, "one two " + "z" * 2_000 + " and on " * 300 + "9" * 1_500, *mixed]


@pytest.mark.parametrize(("span", "overlap"), [(64, 48), (200, 100), (1000, 128)])
def test_counts_equal_the_library(spark, library, span, overlap):
    texts = odd_texts()
    rows = [(k, t, 1, "clash") for k, t in enumerate(texts)] + [(None, texts[-1], 1, "clash")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, part string").repartition(3)
    want = sorted((str(k), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 50) for k, t, *_ in rows)
    got = token_counts.counts(docs, limit=50, span=span, overlap=overlap).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_chunks_without_a_shared_place_are_joined(spark, library):
    model = open(token_counts.VOCABULARY, encoding="utf-8").read()
    text = "and so on " * 30 + "q" * 1_000 + " and on"
    rows = spark.createDataFrame([(1, 1, len(text), text)], "row long, doc_id long, n_bytes long, text string")
    parts = token_counts.chunks(rows, 100, 60)
    found = token_counts.encoded(parts, model, token_counts.guard(model), 60)
    broken = token_counts.splices(found).where("gain IS NULL")
    assert 5 < broken.count() < found.count()
    assert [r.n_tokens for r in token_counts.spliced(rows, model, 100, 60).collect()] == [len(library.encode(text, add_special_tokens=False))]


def test_other_tokenizers_encode_whole_texts(spark):
    path = token_counts.public_tokenizers.path("word_bpe_49k.json")
    assert token_counts.guard(open(path, encoding="utf-8").read()) is None
    own = Tokenizer.from_file(path)
    text = "Some WORDS here, " * 50
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.counts(docs, path, span=64, overlap=48).collect()}
    assert got == {1: len(own.encode(text, add_special_tokens=False)), 2: len(own.encode("", add_special_tokens=False))}


def test_documents(spark, data, library):
    docs = documents(spark, data)
    want = {(r.doc_id, len(library.encode(r.text or "", add_special_tokens=False))) for r in docs.collect()}
    assert {(r.doc_id, r.n_tokens) for r in token_counts.counts(docs, span=2_000, overlap=256).collect()} == want
    assert token_counts.counts(docs.where("false")).collect() == []
