"""Line dedup by content-defined chunks.

A rolling hash over the hashes of `WINDOW` neighbouring lines decides where a document is cut: behind every line at
which it is a multiple of `DIVISOR`. Boundaries so depend on the lines beside them only, and lines that are put in or
taken out elsewhere don't shift them. Chunks of `LINES` lines or more that occur more than once in the corpus, also in
one document, are removed but for the first occurrence, by doc_id, text hash and place.

Chunks meet by a 128-bit digest; then all bytes of every repeated chunk are compared, by grouping digest and text, and
digests that stand for different texts are told apart by the texts. A hot chunk is summed up in each task first, and
occurrences are joined with one row for each digest, a join that Spark splits where it is skewed. Texts are shuffled
once, by document; chunks and digests otherwise.

A null text stays null; an empty one is one empty line. A document that loses all its lines has an empty text. Rows
that repeat doc_id and text are one document, whose chunks occur once; each of the rows gets its result. An empty table
gives an empty result.

Such cuts miss many repeats: a chunk of one line never goes, and a passage's first cut depends on the line before it.
`dedup_passages` therefore takes every two neighbouring lines as a chunk. Chunks overlap, so a passage of `LINES` lines
or more that stands elsewhere before goes as a whole, wherever it begins. A line goes only where an equal one stands at
an earlier place, so the first occurrence of every line stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, fresh, release, strings, table, text_hash, tuned, written

#: Lines under the rolling hash (the SQL twin has 2 built in), and one in how many lines ends a chunk.
WINDOW, DIVISOR = 2, 2
#: Lines of a chunk that may be removed, at least.
LINES = 2
BASE, MODULUS = 31, 65_521


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.md5(line.encode()).digest()[:4], "big") >> 4


def cuts(lines: list[str], divisor: int = DIVISOR, window: int = WINDOW) -> list[tuple[int, int]]:
    """(first line, lines) of each chunk."""
    out, begin, rolling = [], 0, 0
    hashes = [line_hash(x) for x in lines]
    out_factor = BASE**window
    for i, h in enumerate(hashes):
        rolling = rolling * BASE + h - (hashes[i - window] * out_factor if i >= window else 0)
        if rolling % MODULUS % divisor == 0 or i + 1 == len(hashes):
            out.append((begin, i + 1 - begin))
            begin = i + 1
    return out


def neighbours(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, lines) of all runs of `LINES` lines, which overlap."""
    return [(i, LINES) for i in range(len(lines) - LINES + 1)]


def chunks(docs: DataFrame, cut: Callable[[list[str]], list[tuple[int, int]]] = cuts) -> DataFrame:
    """doc_id, h (the text's hash), no, first, lines, digest: every chunk of several lines of every document."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            at, found = [], []
            for i, text in enumerate(strings(b.column(2))):
                if "\n" in text:
                    lines = text.split("\n")
                    for no, (first, n) in enumerate(cut(lines)):
                        if n >= LINES:
                            at.append(i)
                            found.append((no, first, n, hashlib.blake2b("\n".join(lines[first : first + n]).encode(), digest_size=16).digest()))
            at = pa.array(at, pa.int64())
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array([f[k] for f in found], t) for k, t in enumerate(kinds))], names=["doc_id", "h", "no", "first", "lines", "digest"])
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_hash(F.col("text")).alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h bigint, no int, first int, lines int, digest binary")


def _firsts(rows: DataFrame, *keys: str) -> DataFrame:
    place = F.struct("doc_id", "h", "no")
    return rows.groupBy(*keys).agg(F.min(place).alias("keep"), F.max(place).alias("last"))


def _with_parts(docs: DataFrame, again: DataFrame, gone: Column, lines: str, mine: str) -> DataFrame:
    """docs with lines instead of text and, as `__parts`, their repeated chunks; written.

    The list of documents with repeated chunks grows with the corpus, so this join is never a broadcast.
    """
    parts = again.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), F.struct("no", "first", "lines", "digest", gone.alias("gone")).alias("part")).groupBy("__d", "__h").agg(F.collect_list("part").alias("__parts"))
    cut_up = docs.withColumns({mine: text_hash(F.col("text")), lines: F.split("text", "\n")}).drop("text")
    return written(cut_up.join(parts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col(mine) == F.col("__h")) & F.col(lines).isNotNull(), "left").drop("__d", "__h"), "line-parts")


def marked(docs: DataFrame, lines: str, mine: str, found: DataFrame) -> DataFrame:
    """docs with lines instead of text and, as `__parts`, their repeated chunks with `gone` for those to remove."""
    found = written(found, "line-chunks")
    # Rows that repeat doc_id and text have equal places, so they don't make a chunk a repeated one.
    firsts = written(_firsts(found, "digest").where(~F.col("keep").eqNullSafe(F.col("last"))).select(F.col("digest").alias("g"), "keep"), "line-firsts")
    again = written(found.join(firsts, F.col("digest") == F.col("g")).drop("g").distinct(), "line-again")
    place = F.struct("doc_id", "h", "no")
    held = _with_parts(docs, again, ~place.eqNullSafe(F.col("keep")), lines, mine)
    # Compare bytes: every digest must stand for one text.
    shown = held.where(F.col("__parts").isNotNull()).select("doc_id", F.col(mine).alias("h"), lines, F.explode("__parts").alias("p"))
    shown = shown.select("doc_id", "h", "p.no", "p.digest", F.array_join(F.slice(lines, F.col("p.first") + 1, F.col("p.lines")), "\n").alias("chunk"))
    clashing = written(shown.select("digest", "chunk").distinct().groupBy("digest").count().where(F.col("count") > 1).select("digest"), "line-clashes")
    if clashing.isEmpty():
        return held
    # Digests of several texts: the first of each text stays.
    clash = shown.join(clashing, "digest", "left_semi").dropDuplicates(["doc_id", "h", "no"])
    stay = _firsts(clash, "digest", "chunk").select("keep.*").select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("no").alias("k"))
    kept = again.join(clashing.withColumn("clash", F.lit(True)), "digest", "left").join(stay.withColumn("stay", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & (F.col("no") == F.col("k")), "left")
    return _with_parts(docs, kept, F.when(F.col("clash"), F.col("stay").isNull()).otherwise(~place.eqNullSafe(F.col("keep"))), lines, mine)


def dedup_lines(docs: DataFrame, *added: str) -> DataFrame:
    """docs without repeated chunks; n_chars, where there, follows the text. added: names for lines, removed lines."""
    tuned(docs.sparkSession)
    return _without(docs, chunks(docs), *added)


def dedup_passages(docs: DataFrame) -> DataFrame:
    """docs without passages of `LINES` lines or more that stand elsewhere before, wherever these begin."""
    tuned(docs.sparkSession)
    return _without(docs, chunks(docs, neighbours))


def _without(docs: DataFrame, found: DataFrame, *added: str) -> DataFrame:
    mine, held = fresh(docs, "__text_hash", "__lines")
    out = marked(docs, held, mine, found).withColumn("__gone", F.filter("__parts", lambda p: p["gone"]))
    none = F.coalesce(F.size("__gone") <= 0, F.lit(True))
    places = F.flatten(F.transform("__gone", lambda g: F.sequence(g["first"], g["first"] + g["lines"] - 1)))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(held) - 1), places), lambda i: F.get(F.col(held), i))
    counts = [F.coalesce(F.array_size(held), F.lit(1)), F.coalesce(F.aggregate("__gone", F.lit(0), lambda a, g: a + g["lines"]), F.lit(0))]
    if added:
        out = out.withColumns(dict(zip(added, counts, strict=True)))
    out = out.withColumn("text", F.array_join(F.when(none, F.col(held)).otherwise(left), "\n"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(none, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *added)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, "n_lines", "n_removed")
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


#: The same rules over a table `documents`, from its lines: {source} has doc_id and text.
LINES_SQL = """
lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM {source}),
hashed AS (SELECT doc_id, i, line, ('0x' || substr(md5(line), 1, 7))::BIGINT AS lh FROM lines),
rolled AS (SELECT *, (coalesce(lag(lh) OVER w, 0) * 31 + lh) % 65521 % 2 = 0 AS cut FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM rolled),
chunked AS (SELECT doc_id, no, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM numbered GROUP BY doc_id, no),
judged AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY n >= 2, chunk ORDER BY doc_id, no) > 1 AS gone FROM chunked)"""

ORACLE = (
    "WITH "
    + LINES_SQL.format(source="documents")
    + """
SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed,
  length(coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (NOT gone), ''))::BIGINT AS kept_chars,
  sha256(coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""
)
