"""The pipeline's stages on small tables."""

import uuid

from pyspark.sql import functions as F

import corpus_pipeline
from ridgeline.llm import pieces
from ridgeline.llm.common import documents


def test_stages(spark, data, tmp_path):
    docs = documents(spark, data)
    names, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"file://{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{k}")
        sizes.append(docs.count())
        assert docs.columns == names or k == len(corpus_pipeline.STAGES) - 1
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    texts = {r.doc_id: r.text for r in before.collect()}
    decoded = {r.doc_id: r.text for r in pieces.decode(docs, "doc_id").collect()}
    assert decoded == texts


def test_run_is_the_stages(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "source", "n_ids", "ids"] and out.count() > 0


def test_stages_on_odd_tables(spark, tmp_path):
    text = "one two three four five six seven eight nine ten " * 3
    plain = " ".join(f"w{k} v{k % 7}" for k in range(80))
    rows = [(1, plain), (1, plain), (2, None), (3, ""), (None, plain + " more"), (4, " \t\n"), (5, text), (6, " ".join(f"x{k}" for k in range(60_000)) + " token=abcdefghijklmnop"), (7, "x")]
    made = spark.createDataFrame([(i, t, "en", None if i == 5 else "a", len(t or ""), "own", 1, 2.0, "f") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, content string, block long, size double, _key string")
    for df in (made, made.where("false"), made.withColumn("text", F.lit(None).cast("string"))):
        docs = df
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"file://{tmp_path}/{uuid.uuid4().hex}"
            stage(spark, docs, "").write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.columns == df.columns or k == 4
        if df is made:
            assert sorted({r.doc_id for r in docs.collect()}, key=str) == [6, None]
    whole = {r.doc_id: r.text for r in corpus_pipeline.secret_scans(spark, made, "").collect()}
    assert whole[2] is None and whole[3] == "" and whole[6].endswith(" [assign]")
    kept = corpus_pipeline.near_duplicates(spark, made, "").collect()
    assert len(kept) == len({r.text or "" for r in kept}) and [r.doc_id for r in kept if not (r.text or "").strip()] == [2]
