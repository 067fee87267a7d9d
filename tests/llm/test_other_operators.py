"""Neighbours, quality, mixing, media, chat, and the pipeline: against brute force, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stemma.llm import ann, chat, common, components, entry, matroska, mixing, quality, token_counts, unigram_scan

from .conftest import BASE, TEXTS, texts_of
from .test_text_operators import WORD, plain_components

# --- neighbours


def plain_neighbours(rows, is_query, k=5):
    held = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q in sorted(held):
        if is_query(q):
            scores = [(-float((held[q] * x).sum() / (np.sqrt((held[q] ** 2).sum()) * np.sqrt((x**2).sum()))), i) for i, x in held.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in scores)[:k]]
    return out


def test_neighbours(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(6, 8))
    rows = [(k, (centres[k % 6] + 0.3 * r.normal(size=8)).tolist()) for k in range(1200)]
    rows += [(2000 + k, [1.0] * 8) for k in range(300)]  # many equal ones
    rows += [(3000, None), (3001, [0.0] * 8), (3002, [float("nan")] * 8), (3003, [1.0] * 3), (None, [1.0] * 8), (3004, [1.0, None] + [0.0] * 6), (3005, [float("inf")] * 8), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("list", F.lit(1))
    got = defaultdict(list)
    for x in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    want = plain_neighbours(rows, lambda q: q % 20 == 0)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert [i for i, _ in got[2000]] == [2001, 2002, 2003, 2004, 2005] and [i for i, _ in got[2100]] == [2000, 2001, 2002, 2003, 2004]
    held = dict(rows[:1500])
    for q, found in got.items():
        for i, s in found:
            a, b = np.array(held[q]), np.array(held[i])
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def found_by_query(df):
    got = defaultdict(list)
    for x in df.orderBy("query_id", "rank").collect():
        got[x.query_id].append(x.vec_id)
    return got


def test_shifts_inside_cells_lose_little(spark):
    """Lists of about 4 rows, as a far larger table would have them for its size."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 8))
    rows = [(k, (centres[k % 20] + 0.4 * r.normal(size=8)).tolist()) for k in range(3000)]
    assert len(ann.fit(ann._unit(np.array([v for _, v in rows])), len(rows), list_rows=4).shifts) > 8
    got = found_by_query(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, list_rows=4))
    want = plain_neighbours(rows, lambda q: q % 20 == 0)
    assert set(got) == set(want) and sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_vectors_of_every_length_are_searched(spark):
    r = np.random.default_rng(4)
    rows = [(k, r.normal(size=2 + k % 3).tolist()) for k in range(90)]
    got = found_by_query(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0))
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows}
    for q in range(0, 90, 10):
        want = sorted((i for i in unit if i % 3 == q % 3 and i != q), key=lambda i: (-unit[i] @ unit[q], i))[:5]
        assert len(got[q]) == 5 and len(set(got[q]) & set(want)) >= 4


def test_recall_on_the_drivers_vectors(spark, data):
    folder = data.replace("sf0.001", "sf0.1")
    got = found_by_query(entry.queries()["op4_ivfpq_neighbours"](spark, folder))
    held = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = held["vec_id"].to_numpy(), ann._unit(np.stack(held["embedding"].to_numpy()).astype(float))
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        scores = x @ x[q]
        scores[q] = -2
        hits += len(set(ids[np.lexsort((ids, -np.round(scores, 12)))[:5]]) & set(got[ids[q]]))
    assert hits >= 0.9 * 5 * (ids % 50 == 0).sum()


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert Counter(r.query_id for r in ann.search(few, F.col("vec_id") % 50 == 0).collect()) == {0: 2, 50: 2}
    assert ann.search(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- quality


def test_quality(docs, none, spark, data):
    d, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rules = quality.fit(d, labels)
    scored = quality.score(docs, rules)
    assert scored.count() == docs.count() and all(0 <= r.score <= 1 for r in scored.collect())
    numbers = np.array([quality.measure(t or "") for t in TEXTS])
    by_id = {r.doc_id: r.score for r in scored.collect()}
    assert np.allclose([by_id[k] for k in range(len(TEXTS))], rules.predict(numbers))
    kept = quality.keep(docs, rules)
    assert kept.columns == docs.columns and kept.count() == scored.where("predicted = 1").count()
    assert quality.keep(none, rules).count() == 0 and quality.score(none, rules).count() == 0
    alone = quality.fit(d, labels.limit(0))
    assert quality.score(docs, alone).select("score").distinct().first().score == 0.5


def auc(y, score):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(y))
    ranks[order] = np.arange(1, len(y) + 1)
    for v in np.unique(score):  # ties share their ranks
        ranks[score == v] = ranks[score == v].mean()
    n = y.sum()
    return (ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out_rows_are_told_apart(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in entry.queries()["op5_quality_rules"](spark, folder).collect() if r.held_out and labels.get(r.doc_id) in (0, 1)]
    y, score = np.array([labels[r.doc_id] for r in rows]), np.array([r.score for r in rows])
    assert len(rows) > 20 and auc(y, score) > 0.98 and ((score >= quality.THRESHOLD) == y).mean() > 0.97


def test_repeated_documents_reach_the_driver_once(spark, data):
    d, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    one = labels.where(~quality.held_out(F.col("doc_id"))).first().doc_id
    again = d.unionByName(d.where(F.col("doc_id") == one).withColumn("doc_id", F.explode(F.array_repeat("doc_id", 50))))
    assert quality.fit(again, labels) == quality.fit(d, labels)


def test_rules_hold_out():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.2) & (x[:, 3] <= 0.5) | (x[:, 5] > 1.2)).astype(float)
    rules = quality.fit_rules(x[:2000], y[:2000])
    assert ((rules.predict(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95 and len(rules.rules) < 120


# --- mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, out, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        rest, weight = total - sum(2 * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        out = {s: 2 * sizes[s] if s in full else rest * w[s] / weight for s in names}
        if not (over := {s for s in names if s not in full and out[s] > 2 * sizes[s]}):
            return out
        full |= over


def test_mixing(spark, docs, none):
    r = random.Random(2)
    rows = [(k, " ".join(["w"] * r.randint(0, 400)), r.choice(["a", "b", "c", "ä", None, "hot", "hot", "hot"])) for k in range(800)] + [(900, None, "a"), (None, "x y", "b"), (3, "x y z", "b"), (3, "x y z", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = mixing.sized(d)
    sources, taken = mixing.mix(sizes)
    per = defaultdict(int)
    for _, t, s in rows:
        per[s] += len((t or "").split())
    want = plain_targets(per)
    got = {x.source: x for x in sources.collect()}
    assert all(abs(got[s].target - v) < 1e-6 * max(1, v) and got[s].source_size == per[s] for s, v in want.items())
    words = {x.row: x.words for x in taken.groupBy("row").agg(F.sum("words").alias("words")).collect()}
    by_source = defaultdict(int)
    for x in sizes.collect():
        assert words.get(x.row, 0) <= 2 * x["size"]
        by_source[x.source] += words.get(x.row, 0)
    assert all(abs(by_source[s] - v) <= 0.5 + 1e-9 * v for s, v in want.items())
    again = {x.row: x.words for x in mixing.mix(sizes)[1].groupBy("row").agg(F.sum("words").alias("words")).collect()}
    assert again == words
    slots = taken.select("shard", "pass", "k", "block").distinct()
    assert slots.count() == slots.select("pass", "k", "block").distinct().count()
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and set(r.doc_id for r in out.collect()) <= {r.doc_id for r in docs.collect()}
    held = {(t or "") for t in TEXTS} | {BASE + " more"}
    assert all(any(set(r.text.split()) <= set(t.split()) for t in held) for r in out.collect())
    assert mixing.mixed_documents(none).count() == 0 and mixing.mix(mixing.sized(none))[1].count() == 0


@pytest.mark.parametrize("sizes", [{"a": [10]}, {"a": [10], "b": [12]}, {"a": [33]}, {"a": [1], "b": [1], "c": [1], None: [1]}, {"a": [32, 32], "b": [31], "c": [65, 0]}, {"a": [7, 9, 3], "b": [640], "c": [1000, 24], "d": [0]}])
def test_small_sources_meet_their_targets(spark, sizes):
    rows = [(k, " ".join(["w"] * n), s) for k, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    held = mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    sources, taken = mixing.mix(held)
    want, by_source = plain_targets({s: sum(ns) for s, ns in sizes.items()}), defaultdict(int)
    assert {x.source: x.target for x in sources.collect()} == pytest.approx(want)
    places = {x.row: (x.source, x["size"]) for x in held.collect()}
    seen = Counter()
    for x in taken.collect():
        source, size = places[x.row]
        assert 0 <= x.first and x.first + x.words <= size
        seen.update((x.row, w) for w in range(x.first, x.first + x.words))
        by_source[source] += x.words
    assert max(seen.values()) <= 2 and all(abs(by_source[s] - t) <= 0.5 for s, t in want.items())
    if sizes == {"a": [10]}:
        assert by_source == {"a": 15}


def test_permutations(spark):
    for n in (1, 2, 3, 32, 33, 1000, 262_147):
        x = mixing.permuted(spark.range(n).withColumn("n", F.lit(n).cast("long")).select("*", *mixing.constants(F.col("n"))), "p", "id", "n", F.lit(3))
        assert x.agg(F.count_distinct("p"), F.min("p"), F.max("p")).first() == (n, 0, n - 1)


def test_mixing_runs_no_python(spark, docs):
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


# --- media


def test_media_round_trips(docs, none):
    held = {k: t or "" for k, t in enumerate(TEXTS)}
    out = matroska.read_media(matroska.write_media(docs))
    for r in out.collect():
        if r.doc_id is not None:
            n, p = matroska.padded(held[r.doc_id])
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.error) == (n, len(p), hashlib.sha256(p).hexdigest(), None)
    assert out.count() == docs.count() and matroska.read_media(matroska.write_media(none)).count() == 0
    packets = matroska.packet_table(matroska.write_media(docs))
    assert packets.where("doc_id = 10").count() > 8


def test_media_features(spark):
    """All columns of a file's row, from the text alone; equal texts have equal ones."""
    texts = ["", "a", "é" * 40, "x" * 64, "word " * 900, None, "a", "line\n" * 7000]
    out = matroska.read_media(matroska.write_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    rows = {r.doc_id: r for r in out.collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r, frames = rows[k], -(-len(p) // 512)
        clusters = -(-frames // 64)
        levels, crossings = len(set(p)), sum((a >= 128) != (b >= 128) for a, b in zip(p, p[1:], strict=False))
        want = f"packets={frames};clusters={clusters};cues={clusters};last_ns={(frames - 1) * 64_000_000};sum={sum(p)};energy={sum(x * x for x in p)};peak={max(p)};crossings={crossings};levels={levels}"
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.feature) == (len(raw), len(p), zlib.crc32(p[-64:]), want)
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.media_sha256 == hashlib.sha256(matroska.mux(p)).hexdigest() and r.media_bytes == len(matroska.mux(p))


def test_content_encodings_are_undone():
    e, n = matroska.element, matroska.number
    for algorithm, settings, stored in ((3, b"HEAD", b"tail"), (0, b"", zlib.compress(b"HEADtail")), (1, b"", b"x")):
        compression = e(matroska.CONTENT_COMPRESSION, n(matroska.COMP_ALGO, algorithm) + (e(matroska.COMP_SETTINGS, settings) if settings else b""))
        track = e(matroska.TRACK_ENTRY, n(matroska.TRACK_NUMBER, 1) + e(matroska.CONTENT_ENCODINGS, e(matroska.CONTENT_ENCODING, compression)))
        cluster = e(matroska.CLUSTER, n(matroska.TIMESTAMP, 0) + e(matroska.SIMPLE_BLOCK, matroska.vint(1) + b"\x00\x00\x80" + stored))
        f = e(matroska.EBML, e(matroska.DOC_TYPE, b"matroska")) + e(matroska.SEGMENT, e(matroska.TRACKS, track) + cluster)
        m = matroska.demux(f)
        if algorithm == 1:
            assert m.error and not m.packets
        else:
            assert m.error is None and [m.payload(f, p) for p in m.packets] == [b"HEADtail"] and f[m.packets[0][4] :][: m.packets[0][5]] == stored


def test_batches_are_halved():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 100] * 37 + ["y" * 5000, ""])], names=["t"])
    parts = list(common.batches(iter([b, b.slice(0, 0)]), 1000))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([b])) and all(p.nbytes <= 1000 or p.num_rows == 1 for p in parts)


def test_lacing_cues_and_damage():
    r = random.Random(1)
    for n in (64, 512, 576, 4096, 4160, 32768, 32832, 640_000):
        b = r.randbytes(n)
        f = matroska.mux(b)
        m = matroska.demux(f)
        assert m.error is None and b"".join(f[p[4] : p[4] + p[5]] for p in m.packets) == b
        assert [p[1] for p in m.packets] == [k * 64_000_000 for k in range(len(m.packets))]
        assert len(m.cues) == m.clusters and all(f[c[2] : c[2] + 4] == bytes.fromhex("1f43b675") for c in m.cues)
        assert all(matroska.demux(f[: r.randrange(len(f))]).error for _ in range(10))
    assert matroska.demux(None).error == "empty" and matroska.demux(b"").error == "empty" and matroska.demux(b"junk").error


def test_block_groups_and_unknown_sizes():
    e, n = matroska.element, matroska.number
    frames = [b"a" * 300, b"b" * 10, b"c" * 700]
    body = matroska.vint(2) + b"\x00\x05\x06" + matroska.laced(frames, matroska.EBML_LACING)
    group = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, body) + n(matroska.REFERENCE_BLOCK, 1))
    xiph = e(matroska.SIMPLE_BLOCK, matroska.vint(2) + b"\x00\x09\x02" + matroska.laced(frames, matroska.XIPH))
    clusters = b"".join(matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + n(matroska.TIMESTAMP, 100) + group + xiph for _ in range(2))
    segment = matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + clusters + e(matroska.CUES, b"")
    f = e(matroska.EBML, e(matroska.DOC_TYPE, b"matroska")) + segment
    m = matroska.demux(f)
    assert m.error is None and m.clusters == 2 and [f[p[4] : p[4] + p[5]] for p in m.packets] == frames * 4
    assert [(p[0], p[1], p[2]) for p in m.packets[:1]] == [(2, 105_000_000, False)]


# --- chat


def test_chat(spark):
    r = random.Random(4)
    bits = ["a", "\\", "</s>", "[INST]", "<|im_end|>", "\n", "é", "<", "<<SYS>>", "\\\\"]
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system", None, "a\\b", "a\nb", "\\n</s>\n"]), r.choice([None, "".join(r.choices(bits, k=r.randint(0, 8)))])) for c in [0, 1, 2, None] for t in range(r.randint(1, 700 if c == 1 else 9))]
    rows += [rows[0], (5, None, "assistant", "x"), (5, 0, "assistant", "y"), (6, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit(1)).withColumn("begin", F.lit("x"))
    formatted = chat.format_turns(df)
    got = {x.conv_id: x for x in chat.digests(formatted).collect()}
    held = defaultdict(list)
    for c, t, a, b in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")):
        held[c].append((a or "", b or ""))
    assert set(got) == set(held)
    for c, turns in held.items():
        x, said = got[c], "".join(b for a, b in turns if a == "assistant")
        assert x.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (x.n_turns, x.loss_chars, x.loss_sha256) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
        whole = "".join(y.formatted for y in formatted.where(F.col("conv_id").eqNullSafe(F.lit(c))).orderBy("place").collect())
        assert x.formatted_chars == len(whole) and chat.parse(whole) == turns
        examples = chat.expand(formatted.where(F.col("conv_id").eqNullSafe(F.lit(c)))).orderBy("target_place").collect()
        want = [k for k, (a, _) in enumerate(turns) if a == "assistant"]
        assert [e.target_place for e in examples] == want
        whole_examples = {e.target_place: e for e in chat.examples(formatted.where(F.col("conv_id").eqNullSafe(F.lit(c)))).collect()}
        assert sorted(whole_examples) == want and x.n_examples == len(want) and x.expanded_chars == sum(len(e.text) for e in whole_examples.values())
        for e in examples[:5]:
            assert whole_examples[e.target_place].text == whole[: e.example_end]
            text, ((low, high),) = chat.render(turns, e.target_place)
            assert whole[: e.example_end] == text and (e.loss_begin, e.loss_end) == (low, high) and chat.unescape(text[low:high]) == turns[e.target_place][1]
    # The query reads losses from examples that hold their contexts; ranges of `expand` give the same.
    rows = chat._written_out(formatted).where("low is not null").collect()
    assert Counter((x.conv_id, x.text, x.low, x.high) for x in rows) == Counter((x.conv_id, x.text, x.loss_begin, x.loss_end) for x in chat.examples(formatted).collect())
    assert Counter(map(tuple, chat.digests(formatted, chat.expand(formatted)).collect())) == Counter(map(tuple, got.values()))
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_escapes():
    for s in ("", "\\", "</s>", "<\\/s>", "[INST] ok [/INST]", "<<SYS>><s></s><|im_end|>\\<|im_start|>", "\\\\<"):
        assert chat.unescape(chat.escape(s)) == s and not chat._CONTROL.search(chat.escape(s))


# --- components, pipeline


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[300] == 100


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "sentencepiece"]
    before = texts_of(docs)
    kept = texts_of(corpus_pipeline.by_quality(spark, docs, data))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    good = [d for d, _ in before if labels.get(d) == 1]
    assert set(kept) <= set(before) and len({d for d, _ in kept} & set(good)) >= 0.97 * len(good)
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_pieces", "ids", "round_trip"]
    rows = out.collect()
    assert rows and all(r.round_trip and len(r.ids) == 4 * r.n_pieces for r in rows) and {r.doc_id for r in rows} <= {d for d, _ in kept}


def plain_passages(pairs):
    """Texts without every two neighbouring lines that stand before, in the order of doc_id."""
    seen, out = set(), {}
    for doc, text in sorted(pairs):
        rows, gone = text.split("\n"), set()
        for k, two in enumerate(zip(rows, rows[1:], strict=False)):
            gone |= {k, k + 1} if two in seen else set()
            seen.add(two)
        out[doc] = "\n".join(x for k, x in enumerate(rows) if k not in gone)
    return out


def test_pipeline_stage_by_stage(spark, data):
    """Each stage's rows from those of the stage before, by plain Python."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = {r.doc_id: r for r in docs.collect()}
    rules = quality.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    ids = sorted(held)
    scores = dict(zip(ids, rules.predict(np.array([quality.measure(held[d].text or "") for d in ids])), strict=True))
    good = {d: held[d].text or "" for d in ids if scores[d] >= quality.THRESHOLD}
    stages = dict(corpus_pipeline.STAGES)
    one = common.written(stages["quality"](spark, docs, data), "test")
    assert dict(texts_of(one)) == good
    two = common.written(stages["line_dedup"](spark, one, data), "test")
    passages = plain_passages(good.items())
    assert dict(texts_of(two)) == passages
    three = common.written(stages["near_duplicates"](spark, two, data), "test")
    found = plain_components(list(passages.items()))
    assert {d for d, _ in texts_of(three)} == {d for d, _, c in found if d == c}
    four = common.written(stages["mixing"](spark, three, data), "test")
    left, size = {r.doc_id: r for r in three.collect()}, lambda t: len(mixing_words(t))
    per, taken, each = Counter(), Counter(), Counter()
    for r in left.values():
        per[r.source] += size(r.text)
    for r in four.collect():
        taken[r.source] += size(r.text)
        each[r.doc_id] += size(r.text)
        assert set(mixing_words(r.text)) <= set(mixing_words(left[r.doc_id].text)) and r.n_chars == len(r.text)
    assert all(abs(taken[s] - t) <= 0.5 + 1e-9 * t for s, t in plain_targets(per).items()) and all(n <= 2 * size(left[d].text) for d, n in each.items())
    five = stages["sentencepiece"](spark, four, data)
    with open(token_counts.model_path(), "rb") as f:
        v = unigram_scan.Vocabulary(f.read())
    assert Counter((r.doc_id, bytes(r.ids)) for r in five.collect()) == Counter((r.doc_id, unigram_scan.encode_whole(v, r.text)) for r in four.collect())


def mixing_words(text):
    return WORD.findall(text or "")


def test_pipeline_on_empty_tables(spark, data, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in entry.queries()] == [f"op{k}" for k in range(1, 11)] and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    want = con.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, data).toPandas()[list(want.columns)]
    assert sorted(map(tuple, want.itertuples(index=False))) == sorted(map(tuple, got.itertuples(index=False)))
