"""Token counts by a map-side two-tier lookup.

A text's pre-tokens (a run of blanks with the letters behind it) are encoded apart from each other, because no
piece of the vocabulary has a blank behind another character; `check` refuses vocabularies that do.

Tier 1 is a broadcast table from frequent pre-tokens to their numbers of tokens: every task sums up its texts'
pre-tokens in a bounded summary, the summaries are added up, and the `TABLE_SIZE` most frequent are encoded once.
Tier 2 is a cache in each Python worker, bounded by `CACHE_SIZE`, in front of the library. Pre-tokens are never
shuffled, only the summaries are, and the table decides speed alone: counts are exact whatever it holds.

Null and empty texts have 0 tokens. Repeated rows each get their row. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter as Counts
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HELD, batches, strings, table, tuned

TABLE_SIZE = 1 << 16
SUMMARY_SIZE = 1 << 14
CACHE_SIZE = 400_000
#: Longer pre-tokens aren't cached.
LONGEST_CACHED = 64
LIMIT = 4096
BLANK = "▁"
PRE_TOKEN = re.compile(r" +[^ ]*")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def library(**model):
    import sentencepiece  # others import this module for its pre-tokens

    return sentencepiece.SentencePieceProcessor(**model)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first blank: the library adds that one itself."""
    if not text:
        return []
    if BLANK in text:
        text = text.replace(BLANK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [x[1:] for x in PRE_TOKEN.findall(" " + text)]


class Lengths(dict):
    """Pre-token -> number of tokens; misses go to the library and, while there is room, into the cache."""

    def __init__(self, model: bytes, frequent: dict[str, int], cache_size: int = CACHE_SIZE):
        super().__init__(frequent)
        self.frequent, self.most = frequent, len(frequent) + cache_size
        self.library = library(model_proto=model)
        self[""] = len(self.library.encode("  ")) - len(self.library.encode(" ")) or 1

    def __missing__(self, key: str) -> int:
        n = len(self.library.encode(key))
        if len(key) <= LONGEST_CACHED:
            if len(self) >= self.most:
                blank = self[""]
                self.clear()
                self.update(self.frequent)
                self[""] = blank
            self[key] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, pre_tokens(text)))


def check(model: bytes) -> None:
    """Raise where pre-tokens wouldn't be independent of each other."""
    sp = library(model_proto=model)
    if bad := [p for i in range(sp.get_piece_size()) if BLANK in (p := sp.id_to_piece(i)).lstrip(BLANK) and not sp.is_control(i)]:
        raise ValueError(f"pieces with a blank behind another character: {bad[:5]}")
    a, b = sp.encode(" a"), sp.encode("a")
    if a == b or sp.encode("a a") != b + b:
        raise ValueError("the model's normaliser drops or merges blanks")


def summaries(rows: Iterator[pa.RecordBatch], size: int = SUMMARY_SIZE) -> Iterator[pa.RecordBatch]:
    """One bounded summary of pre-token counts for each task."""
    found: Counts = Counts()
    for b in batches(rows):
        for text in strings(b.column(0)):
            found.update(x for x in pre_tokens(text) if len(x) <= LONGEST_CACHED)
            if len(found) > 16 * size:
                found = Counts(dict(found.most_common(4 * size)))
    top = found.most_common(size)
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["pre_token", "n"])


def frequent_lengths(docs: DataFrame, model: bytes, text: str = "text", size: int = TABLE_SIZE) -> dict[str, int]:
    """The tier-1 table; at most `size` entries, whatever the input."""
    parts = docs.select(F.col(text)).mapInArrow(summaries, "pre_token string, n bigint")
    top = parts.groupBy("pre_token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pre_token").limit(size)
    words = [r[0] for r in top.select("pre_token").collect() if r[0]]
    sp = library(model_proto=model)
    return {w: len(x) for w, x in zip(words, sp.encode(words, num_threads=1), strict=True)}


_workers: dict[str, Lengths] = {}
HELD.append(_workers)


def count_tokens(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text", table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of docs."""
    spark = tuned(docs.sparkSession)
    check(model)
    shared = spark.sparkContext.broadcast((model, frequent_lengths(docs, model, text, table_size)))
    key = uuid.uuid4().hex

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _workers:
            _workers.clear()
            _workers[key] = Lengths(*shared.value)
        known = _workers[key]
        for b in batches(rows):
            texts = strings(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array([known.count(x) for x in texts], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(model_path(), "rb") as f:
        model = f.read()
    counted = count_tokens(table(spark, sf_dir, "documents"), model)
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
