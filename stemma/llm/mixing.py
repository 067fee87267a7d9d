"""Mixing sources to target weights, in DataFrame expressions only.

A source's documents form one stream of words, cut into blocks of `BLOCK` words. The mix is a run of slots, a block
each, dealt into output shards. Every slot draws its source, so that a shard's source counts are multinomial with the
targets as probabilities; the k-th slot of a source holds the block that the source's pseudorandom permutation maps k
to, and a second permutation serves a source's second pass. Slots and blocks are joined by source and index.
Draws beyond a source's quota, its target in blocks, are dealt again to sources that drew too few, so that no block is
taken more than twice. A source's last block may be short, and its last slot takes a part of a block, so that every
source's words are its target, rounded.

Offsets come from prefix sums over hash buckets of a source's documents and over shards, about the square root of the
rows in number, so a source of any size is spread over tasks. Sources are numbered, filled up and given their slots by
sums over ranges, so there may be any number of them. The tables of sources and drawn intervals are joined; Spark
broadcasts them only below its size threshold.

A null source is a source of its own, behind the others; null texts have 0 words. Documents without words are never
taken. Rows that repeat are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import before, fresh, table, text_hash, written

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block; slots of a shard, at least.
BLOCK, SHARD = 32, 4096
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
SEED = 20_240_229
#: No number of blocks below 2^43 is divisible by three primes above 2^18, so one of these has none in common with it.
PRIMES = (262_147, 393_241, 524_287)
ROUNDS, FACTOR = 3, 0x3A5B1


def sized(docs: DataFrame, *columns: str) -> DataFrame:
    """A written table of the rows: their number `row`, doc_id, source, size, a hash of the text, and `columns`."""
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), text_hash(F.col("text")).alias("h"), *columns), "mixing")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, k (its place), source_size, target. Sources are numbered and filled up by sums over ranges of them."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = before(s, [F.col("source").asc_nulls_last()], [], "sources", k=F.lit(1))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int"))).withColumn("cap", F.lit(most) * F.col("source_size"))
    words, weight = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    # Sources fill up in the order of cap / weight; `level` is what a weight of 1 gets if all before are full.
    s = before(s.withColumn("turn", F.col("cap") / F.col("w")), ["turn", "k"], [], "levels", caps=F.col("cap"), ws=F.col("w"))
    s = s.withColumn("level", (F.lit(words) * share - F.col("caps")) / (F.lit(weight) - F.col("ws"))).withColumn("full", F.col("turn") <= F.col("level"))
    # Where all are full there is no level, and none needs it.
    level = (s.where(~F.col("full")).agg(F.min(F.struct("turn", "k", "level"))).first()[0] or {"level": 0.0})["level"]
    return s.select("source", "k", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.lit(float(level)) * F.col("w")).alias("target"))


def quotas(sources: DataFrame, block: int = BLOCK, most: int = MOST, seed: int = SEED) -> DataFrame:
    """sources with n_blocks, quota (slots) and what makes their words meet the target to the word.

    Whole passes take all blocks. In a last, partial pass the short block comes at `place`, for which it changes places
    with the block that the permutation has there, `instead`; the last slot takes the first `last` words of its block.
    [low, high) is a source's part of all slots.
    """
    s = sources.withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long")).withColumn("turns", F.greatest("n_blocks", F.lit(1)))
    s = s.withColumn("words", F.least(F.round("target").cast("long"), most * F.col("source_size")))
    s = s.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    s = s.withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size")).withColumn("short", F.col("n_blocks") * block - F.col("source_size"))
    s = s.select("*", *constants(F.col("turns"))).withColumn("place", F.pmod(F.xxhash64(F.lit(seed), F.lit("short"), "k"), F.col("turns")))
    s = permuted(s, "instead", "place", "turns", F.col("k"), F.col("passes"), seed=seed)
    held = lambda slots: slots * block - F.when(F.col("place") < slots, F.col("short")).otherwise(0)
    s = s.withColumn("slots", F.ceil(F.col("rest") / block).cast("long"))
    s = s.withColumn("slots", F.col("slots") + (held(F.col("slots")) < F.col("rest")).cast("long"))
    s = s.withColumn("last", F.when(F.col("slots") > 0, F.col("rest") - held(F.col("slots") - 1)).otherwise(block).cast("int")).withColumn("quota", F.col("passes") * F.col("n_blocks") + F.col("slots"))
    s = before(s.drop("turns", "words", "rest", "short", "slots"), ["k"], [], "quotas", low=F.col("quota"))
    return s.withColumn("high", F.col("low") + F.col("quota"))


def constants(n: Column) -> list[Column]:
    """What `permuted` needs for permutations of [0, n): a factor prime to n, the largest power of two up to n."""
    factor = F.coalesce(*(F.when(n % p != 0, F.lit(p)) for p in PRIMES)).cast("long")
    bits = F.length(F.bin(n)) - 1
    return [factor.alias("factor"), F.pow(F.lit(2.0), bits).cast("long").alias("power"), F.pow(F.lit(2.0), F.floor(bits / 2) + 1).cast("long").alias("half")]


def permuted(df: DataFrame, name: str, index: str, n: str, *keys: Column, seed: int = SEED) -> DataFrame:
    """df with a column: where a pseudorandom permutation of [0, n), chosen by keys, takes the index.

    Each round is an affine map modulo n, then a mix of the numbers below `power`, both bijections. df has the columns
    of `constants`. The rounds are a fold, so that no round's expression is copied into the next.
    """
    shifts = F.array(*(F.pmod(F.xxhash64(F.lit(seed), F.lit(r), *keys), F.col(n)) for r in range(ROUNDS)))

    def mixed(y: Column) -> Column:
        return F.when(y < F.col("power"), (y.bitwiseXOR(F.call_function("div", y, F.col("half"))) * FACTOR).bitwiseAND(F.col("power") - 1)).otherwise(y)

    step = lambda x, c: F.element_at(F.transform(F.array((x * F.col("factor") + c) % F.col(n)), mixed), 1)
    return df.withColumn(name, F.aggregate(shifts, F.col(index).cast("long"), step))


def draw(sources: DataFrame, n_slots: int, n_sources: int, seed: int = SEED, shard: int = SHARD) -> DataFrame:
    """shard, k, ordinal: a row for each slot, the ordinal-th of its source; n_blocks and constants of its source."""
    spark = sources.sparkSession
    shard = max(shard, math.isqrt(n_slots))
    width = max(1, -(-n_slots // max(1024, 4 * n_sources)))
    buckets = F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)))
    parts = sources.where(F.col("quota") > 0).select("k", "low", "high", buckets.alias("bucket"))
    drawn = spark.range(n_slots).select(F.floor(F.col("id") / shard).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n_slots)).alias("u"))
    drawn = drawn.join(parts, (F.floor(F.col("u") / width) == F.col("bucket")) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    counts = drawn.groupBy("shard", "k").agg(F.count(F.lit(1)).alias("n"))
    by_source = Window.partitionBy("k").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ends = written(counts.withColumn("end", F.sum("n").over(by_source)), "draws")
    own = ["n_blocks", "factor", "power", "half", "passes", "place", "instead", "last", "quota"]
    facts = sources.select("k", *own)
    # Few intervals stand for many slots: spread them by what they will be.
    ends = ends.join(facts, "k").withColumn("begin", F.col("end") - F.col("n")).repartition(max(1, min(20_000, n_slots // 100_000)), "shard", "k")
    kept = ends.where(F.col("begin") < F.col("quota")).select("shard", "k", *own, F.explode(F.sequence("begin", F.least("end", "quota") - 1)).alias("ordinal"))
    # The few draws beyond quotas, at the last shards, are numbered and meet the numbered slots that quotas still lack.
    numbers = lambda n: F.explode(F.sequence("at", F.col("at") + F.col(n) - 1)).alias("number")
    over = ends.select("shard", "k", F.least("n", F.col("end") - F.col("quota")).alias("extra")).where(F.col("extra") > 0)
    over = before(over, ["shard", "k"], [], "draws-over", at=F.col("extra")).select("shard", numbers("extra"))
    had = ends.groupBy("k").agg(F.sum("n").alias("had"))
    lack = facts.join(had, "k", "left").withColumn("had", F.coalesce("had", F.lit(0))).withColumn("missing", F.col("quota") - F.col("had")).where(F.col("missing") > 0)
    lack = before(lack, ["k"], [], "draws-missing", at=F.col("missing")).select("k", *own, "had", F.col("at").alias("first"), numbers("missing"))
    dealt = over.join(lack, "number").select("shard", "k", *own, (F.col("had") + F.col("number") - F.col("first")).alias("ordinal"))
    return kept.unionByName(dealt)


def pieces(sizes: DataFrame, sources: DataFrame, n_docs: int, block: int = BLOCK) -> DataFrame:
    """row, k, block, inside (word in the block), first (word in the document), words: how documents lie in blocks."""
    n = max(1, math.isqrt(n_docs))
    rows = sizes.where(F.col("size") > 0).join(sources.select(F.col("source").alias("s"), "k"), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.select("row", "doc_id", "h", "size", "k", F.pmod(F.xxhash64("doc_id", "h"), F.lit(n)).alias("bucket"))
    sums = rows.groupBy("k", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.sum("words").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).drop("words")
    here = Window.partitionBy("k", "bucket").orderBy("doc_id", "h", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(sums, ["k", "bucket"]).withColumn("at", F.col("before") + F.sum("size").over(here) - F.col("size"))
    exploded = placed.select("row", "k", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    first = F.greatest(F.col("at"), F.col("block") * block)
    return exploded.select("row", "k", "block", (first - F.col("block") * block).cast("int").alias("inside"), (first - F.col("at")).alias("first"), (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - first).alias("words"))


def mix(sizes: DataFrame, seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(sources, taken): taken has shard, pass, row, k, block, first, words for each piece of a document in the mix."""
    spark = sizes.sparkSession
    sources = written(quotas(targets(sizes), block, seed=seed), "sources")
    n_slots, n_sources = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count(F.lit(1))).first()
    if not n_slots:
        return sources, spark.createDataFrame([], "shard bigint, pass bigint, row bigint, k bigint, block bigint, first bigint, words bigint")
    slots = draw(sources, n_slots, n_sources, seed).withColumn("pass", F.floor(F.col("ordinal") / F.col("n_blocks"))).withColumn("turn", F.col("ordinal") % F.col("n_blocks"))
    slots = permuted(slots, "to", "turn", "n_blocks", F.col("k"), F.col("pass"), seed=seed)
    short = F.col("n_blocks") - 1
    changed = F.when(F.col("turn") == F.col("place"), short).when(F.col("to") == short, F.col("instead")).otherwise(F.col("to"))
    slots = slots.withColumn("block", F.when(F.col("pass") == F.col("passes"), changed).otherwise(F.col("to")))
    slots = slots.select("shard", "pass", "k", "block", F.when(F.col("ordinal") == F.col("quota") - 1, F.col("last")).otherwise(block).alias("most"))
    found = slots.join(pieces(sizes, sources, sizes.count(), block), ["k", "block"]).withColumn("words", F.least(F.col("words"), F.col("most") - F.col("inside")))
    return sources, found.where(F.col("words") > 0).select("shard", "pass", "row", "k", "block", "first", "words")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents with the columns of docs: a row for each pass that takes words of a document.

    A document that a pass takes whole keeps its text; otherwise the taken words follow each other, a blank between.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "source")]
    mine = fresh(docs, "row", "size", "h")
    plain = docs.select(*(F.col(f"`{c}`") for c in docs.columns))
    held = written(plain.withColumn(mine[0], F.monotonically_increasing_id()).withColumn(mine[1], F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")), "mixing")
    sizes = held.select(F.col(mine[0]).alias("row"), "doc_id", "source", F.col(mine[1]).alias("size"), text_hash(F.col("text")).alias("h"))
    _, taken = mix(sizes)
    by_doc = taken.groupBy("row", "pass").agg(F.sum("words").alias("__words"), F.sort_array(F.collect_list(F.struct("first", "words"))).alias("__pieces")).withColumnRenamed("row", "__row")
    out = held.join(by_doc, F.col(mine[0]) == F.col("__row"))
    # The words are an element that the inner expression refers to: they are found once for a row, not for each piece.
    taken_of = lambda w: F.array_join(F.flatten(F.transform("__pieces", lambda p: F.slice(w, (p["first"] + 1).cast("int"), p["words"].cast("int")))), " ")
    cut = F.element_at(F.transform(F.array(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))), taken_of), 1)
    out = out.withColumn("text", F.when(F.col("__words") == F.col(mine[1]), F.col("text")).otherwise(cut))
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sized(table(spark, sf_dir, "documents"))
    sources, taken = mix(sizes)
    words = taken.groupBy("row").agg(F.sum("words").alias("taken")).withColumnRenamed("row", "r")
    known = sources.select(F.col("source").alias("s"), "source_size", "target")
    out = sizes.join(words, F.col("row") == F.col("r"), "left").join(known, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
