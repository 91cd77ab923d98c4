"""The corpus pipeline: quality rules, near-duplicates, secrets, source mix, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes a stage's result as Parquet in the
folder that the cluster names in spark.checkpoint.dir, where all executors see it, and reads it again for the next.
All but the last stage return the columns of ``documents``. An empty table goes through as one; columns beside those
of ``documents``, of whatever name, stay with their rows up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import mixing, pieces, quality, secrets, simhash
from ridgeline.llm.common import documents, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the current policy keeps.

    A null, empty or blank text has no word and goes; repeated rows are judged row by row; very long texts are judged whole; other columns stay as they are.
    """
    return quality.apply_policy(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id: five words, similarity 0.8 of their shingle sets.

    Fingerprints and pivot distances discard pairs here, as in the 64-bit operator, but don't find or decide them: at this similarity
    texts differ in too many bits. Null, empty and blank texts are one group; equal rows are one; of rows of one least id and different texts, which only a
    hash tells apart, one stays; a null id counts as the least; long texts are compared whole; other columns stay as they are.
    """
    return simhash.deduplicated(docs, words=5, similarity=0.8)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret replaced by its kind.

    Null and empty texts stay so; rows are scanned one by one, repeated or not; texts of many secrets take time in proportion; ``n_chars`` is counted anew.
    """
    return secrets.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as far as, and as often as, the mix takes their words.

    Texts without a word go, as nothing of them is taken; the null source is one of its own; equal rows take their parts in turn; ``n_chars`` is counted anew.
    """
    return mixing.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's text; a null or empty text has none, and repeated rows have equal ones."""
    return pieces.encode(docs, "doc_id", "source").select("doc_id", "source", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding", sentencepiece),
]

#: SQL can't express near-duplicate components, the seeded mix or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; a stage's table is removed as soon as the next one's is written."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
