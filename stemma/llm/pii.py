"""Personal data: patterns, then information-theoretic sanitisation of what stands around them.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. From the whole corpus the operator then
estimates how strongly a term reveals a protected entity that stands in the same document, near or far: with n
documents, PMI(t; e) = ln(n * n_te / (n_t * n_e)) is compared with the entity's information IC(e) = ln(n / n_e). A term
with PMI >= `GENERALISE` * IC(e) gets a span of kind `term` wherever it stands in each document that holds e, also where
e stands in one text only; from `REMOVE` * IC(e) on it is removed instead of being generalised to its class, such as
[NAME 5-8]. Counts run over all documents, by text and its copies: pairs and terms are summed up in each task before
they are shuffled, so a frequent entity or word costs each task one row. The texts that have entities, the only ones
that change, are marked and cleaned in one pass; `sanitise` puts them in place of the documents' texts.

Texts that are null count as empty and have no spans. Rows that repeat doc_id and text get equal results; rows with
one doc_id but different texts are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, fresh, strings, table, text_hash, tuned, written

KINDS = ["email", "ip", "card", "phone", "term"]
GENERALISE, REMOVE = 0.75, 0.99
#: Pre-aggregated terms that a task holds at once.
HELD_TERMS = 300_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where a run of digits begins, and no shorter run can match: hence the look-behind and `++`.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\w+")
_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern finds them, without going back over long runs: each @ is the centre of one match at most."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            out.append((begin, last))
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(begin, kind's number, end), in order; code points, end exclusive."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())] if "." in text else []
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """All terms outside of the spans, which are in order, with their places."""
    out, at = [], 0
    for begin, _, end in [*spans, (len(text), 0, len(text))]:
        out += [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text, at, begin)]
        at = max(at, end)
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_SPAN = pa.struct([("begin", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_TOLD = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("removed", pa.bool_())])
SPANS = "array<struct<begin:bigint,kind:int,end:bigint>>"
TOLD = "array<struct<begin:bigint,end:bigint,removed:boolean>>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base, entities, text: the base spans, their values, and the text where there are any."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            base, entities, held = [], [], []
            for text in strings(b.column(2)):
                spans = base_spans(text)
                base.append([{"begin": a, "kind": k, "end": e} for a, k, e in spans])
                entities.append(sorted({f"{KINDS[k]}:{text[a:e].lower()}" for a, k, e in spans}))
                held.append(text if spans else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, pa.list_(_SPAN)), pa.array(entities, pa.list_(pa.string())), pa.array(held, pa.string())], names=["doc_id", "text_hash", "base", "entities", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash bigint, base {SPANS}, entities array<string>, text string")


def term_counts(docs: DataFrame) -> DataFrame:
    """term, n_t: documents that have the term, summed up in each task first."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches(rows):
            for text in strings(b.column(0)):
                found.update({w.lower() for w in _WORD.findall(text)})
            if len(found) > HELD_TERMS:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])
                found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n_t"))


def _terms_by_text(texts: DataFrame) -> DataFrame:
    """text_hash, n, term: each text's terms."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            for h, n, base, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                terms = list({t for t, _, _ in terms_of(text, [(s["begin"], s["kind"], s["end"]) for s in base])})
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(terms), pa.int64()), pa.array([n] * len(terms), pa.int64()), pa.array(terms, pa.string())], names=["text_hash", "n", "term"])

    return texts.select("text_hash", "n", "base", "text").mapInArrow(run, "text_hash bigint, n bigint, term string")


def disclosing(texts: DataFrame, terms: DataFrame, n_docs: int, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """text_hash, term, removed: the terms of each text that disclose one of its entities.

    texts: text_hash, n (documents with the text), base, entities, text. Entities that stand in the same texts have equal
    counts with every term, so they are counted as one: a text of many entities costs no product of these and its terms.
    A term of more than n_docs ** (1 - generalise) * n_e ** generalise documents can't reach the threshold, for n_te <= n_e.
    """
    holds = texts.select("text_hash", "n", F.explode("entities").alias("entity"))
    same = F.struct(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("texts"), *(F.bit_xor(F.xxhash64("text_hash", F.lit(k))).alias(f"x{k}") for k in (1, 2)))
    alike = holds.groupBy("entity").agg(same.alias("alike")).where(F.log(F.lit(float(n_docs)) / F.col("alike.n_e")) > 0)
    alike = holds.join(alike, "entity").select("text_hash", "alike").distinct()
    known = _terms_by_text(texts).join(terms, "term", "left").withColumn("n_t", F.coalesce("n_t", F.lit(0)))
    most = F.pow(F.lit(float(n_docs)), F.lit(1 - generalise)) * F.pow(F.col("alike.n_e").cast("double"), F.lit(generalise))
    pairs = written(known.join(alike, "text_hash").where(F.col("n_t") <= most * 1.000001), "pii-pairs")
    # A piece of a word that an entity cuts is no whole word anywhere: it has the documents it was seen in.
    told = pairs.groupBy("alike", "term").agg(F.sum("n").alias("n_te"), F.max("n_t").alias("n_t")).withColumn("n_t", F.greatest("n_t", "n_te"))
    pmi = F.log(F.lit(float(n_docs)) * F.col("n_te") / (F.col("n_t") * F.col("alike.n_e")))
    told = told.withColumn("share", pmi / F.log(F.lit(float(n_docs)) / F.col("alike.n_e"))).where(F.col("share") >= generalise).select("alike", "term", (F.col("share") >= remove).alias("removed"))
    return pairs.join(told, ["alike", "term"]).groupBy("text_hash", "term").agg(F.max("removed").alias("removed"))


def term_class(term: str) -> str:
    """What a generalised term is still known by: its shape, and its length in steps that double."""
    shape = "NUMBER" if term.isdigit() else "CODE" if any(map(str.isdigit, term)) else "NAME" if term[:1].isupper() else "WORD"
    high = max(2, 1 << (len(term) - 1).bit_length())
    return f"[{shape} {high // 2 + 1 if high > 2 else 1}-{high}]"


def cleaned(text: str, base: list[tuple[int, int, int]], told: list[tuple[int, int, bool]]) -> str:
    """text without what its spans cover: base spans become [EMAIL] and so on, terms their class, removed ones go."""
    marks = [(a, b, f"[{KINDS[k].upper()}]") for a, k, b in base]
    marks += [(a, b, "" if removed else term_class(text[a:b])) for a, b, removed in told]
    out, at = [], 0
    for a, b, mark in sorted(marks):
        if b > at:
            out += [text[at : max(a, at)], mark]
            at = b
    return "".join([*out, text[at:]])


def _marked(texts: DataFrame) -> DataFrame:
    """h, told, clean: all places of the terms in `terms` (none, if null), and the text without them and base spans."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            told, clean = [], []
            for base, text, terms in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                removed = {t["term"]: t["removed"] for t in terms or []}
                spans = [(s["begin"], s["kind"], s["end"]) for s in base]
                found = [(i, j, removed[t]) for t, i, j in terms_of(text, spans) if t in removed]
                told.append([{"begin": i, "end": j, "removed": r} for i, j, r in found])
                clean.append(cleaned(text, spans, found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(told, pa.list_(_TOLD)), pa.array(clean, pa.string())], names=["h", "told", "clean"])

    return texts.select("text_hash", "base", "text", "terms").mapInArrow(run, f"h bigint, told {TOLD}, clean string")


def protect(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base, told, clean: base spans, spans of disclosing terms and what is done to them.

    clean is the protected text; null where nothing changes.
    """
    tuned(docs.sparkSession)
    found = written(find(docs), "pii")
    n_docs = found.count()
    held = found.where(F.size("entities") > 0)
    copies = held.select("doc_id", "text_hash").distinct().groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"))
    texts = written(held.groupBy("text_hash").agg(*(F.first(c).alias(c) for c in ("base", "entities", "text"))).join(copies, "text_hash"), "pii-texts")
    told = disclosing(texts, term_counts(docs), max(n_docs, 1)).groupBy("text_hash").agg(F.collect_list(F.struct("term", "removed")).alias("terms"))
    places = _marked(texts.join(told, "text_hash", "left"))
    none, same = F.array().cast(TOLD), F.lit(None).cast("string")
    out = held.select("doc_id", "text_hash", "base").join(places, F.col("text_hash") == F.col("h")).select("doc_id", "text_hash", "base", "told", "clean")
    return out.unionByName(found.where(F.size("entities") == 0).select("doc_id", "text_hash", "base", none.alias("told"), same.alias("clean")))


def sanitise(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with protected texts, from the spans of `protect`; texts that don't change are taken as they are."""
    mine = fresh(docs, "__h", "__clean")
    changed = spans.where(F.col("clean").isNotNull()).select(F.col("text_hash").alias(mine[0]), F.col("clean").alias(mine[1])).dropDuplicates([mine[0]])
    joined = docs.join(changed, text_hash(F.col("text")) == F.col(mine[0]), "left")
    return joined.withColumn("text", F.when(F.col("text").isNotNull(), F.coalesce(mine[1], "text"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spans = protect(docs)
    named = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["begin"].cast("string"), s["end"].cast("string"))
    base = F.concat_ws(",", F.transform("base", named))
    term = F.transform("told", lambda s: F.struct(s["begin"].alias("begin"), F.lit(KINDS.index("term")).alias("kind"), s["end"].alias("end")))
    both = F.concat_ws(",", F.transform(F.sort_array(F.concat("base", term)), named))
    counted = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")  # noqa: E731  # a second argument of the inner one would be the index
    counts = [counted(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return spans.select(
        "doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), both.alias("spans"), F.size("base").cast("long").alias("n_pii"), F.size("told").cast("long").alias("n_term"),
        F.size(F.filter("told", lambda s: s["removed"])).cast("long").alias("n_removed"), F.sha2("clean", 256).alias("clean_sha256"),
    )
