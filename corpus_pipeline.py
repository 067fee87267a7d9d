"""A training corpus in five stages, each on what the one before it kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
`run` writes each stage's result as Parquet and reads it again as the next one's input.

1. quality: documents that the rule ensemble rejects go.
2. line_dedup: repeated passages of two lines or more go, all but their first occurrence.
3. near_duplicates: one document of each component stays, the one with the smallest doc_id.
4. mixing: a row for each pass that takes words of a document, with the words it takes.
5. sentencepiece: the pieces of every row, and whether decoding them gives the text back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import group_join, line_dedup, mixing, quality, unigram_scan
from stemma.llm.common import table, tuned, written
from stemma.llm.token_counts import model_path


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that rules fitted on their labels (no held-out ones) keep."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that stand elsewhere before; some may be left with empty texts."""
    return line_dedup.dedup_passages(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component."""
    return group_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, as documents; doc_id repeats for a document that two passes take."""
    return mixing.mixed_documents(docs)


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_pieces, ids (4 bytes each, lowest first), round_trip."""
    with open(model_path(), "rb") as f:
        model = f.read()
    tuned(spark)
    kept = ["doc_id", "lang", "source", "n_chars"]
    hashed = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    back = unigram_scan.encode(hashed, model, [*kept, "text_sha256"], decoded=True)
    return back.select(*kept, (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), "ids", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("quality", by_quality),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("sentencepiece", in_pieces),
]

#: Fitted rules, hashes of words and pseudorandom draws have no SQL twin; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
