"""Line dedup, encoding, token counts, personal data, grouped join: against brute force, and on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from stemma.llm import group_join, line_dedup, pii, token_counts, unigram_scan

from .conftest import BASE, LONG, NEAR, TEXTS, texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="session")
def model():
    with open(token_counts.model_path(), "rb") as f:
        return f.read()


# --- line dedup


def plain_dedup(pairs):
    """Kept text of each (doc_id, text), by the rules of the module, in plain Python."""
    seen, out = set(), {}
    for doc, text in sorted(set(pairs), key=lambda p: (p[0] is not None, p[0] or 0)):
        if text is None:
            out[doc, text] = None
            continue
        rows, kept = text.split("\n"), []
        for first, n in line_dedup.cuts(rows):
            chunk = rows[first : first + n]
            if n >= 2 and tuple(chunk) in seen:
                continue
            if n >= 2:
                seen.add(tuple(chunk))
            kept += chunk
        out[doc, text] = "\n".join(kept)
    return out


def test_line_dedup(docs, none):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and line_dedup.dedup_lines(none).count() == 0
    want = plain_dedup(texts_of(docs))
    assert Counter(texts_of(out)) == Counter((d, want[d, t]) for d, t in texts_of(docs))
    assert len(want[6, BASE]) < len(BASE)  # a null doc_id comes first, and its text begins like these
    assert all(r.n_chars == len(r.text or "") for r in out.where("doc_id = 6").collect())


def test_cuts_resist_shifts():
    rows = BASE.split("\n")
    ends = lambda r: {tuple(r[a : a + n]) for a, n in line_dedup.cuts(r)}
    assert len(ends(rows) & ends(["new line", *rows])) >= len(ends(rows)) - 2
    assert sum(n for _, n in line_dedup.cuts(rows)) == len(rows) and line_dedup.cuts([""]) == [(0, 1)]


def test_colliding_digests_are_told_apart(spark, docs, monkeypatch):
    found = line_dedup.chunks

    def bad(d):
        from pyspark.sql import functions as F

        return found(d).withColumn("digest", F.lit(b"same"))

    monkeypatch.setattr(line_dedup, "chunks", bad)
    want = plain_dedup(texts_of(docs))
    assert Counter(texts_of(line_dedup.dedup_lines(docs))) == Counter((d, want[d, t]) for d, t in texts_of(docs))


def test_pipeline_removes_repeated_passages_wherever_they_begin(spark, docs, none):
    import corpus_pipeline

    def plain(pairs):
        seen, out = set(), {}
        for doc, text in sorted(set(pairs), key=lambda p: (p[0] is not None, p[0] or 0)):
            if text is None:
                out[doc, text] = None
                continue
            rows, gone = text.split("\n"), set()
            for k, two in enumerate(zip(rows, rows[1:], strict=False)):
                gone |= {k, k + 1} if two in seen else set()
                seen.add(two)
            out[doc, text] = "\n".join(x for k, x in enumerate(rows) if k not in gone)
        return out

    rows = [(k, "\n".join([f"before {k}", *(f"passage {k // 10} line {i}" for i in range(2 + k // 10)), f"behind {k}"])) for k in range(30)]
    few = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = dict(texts_of(corpus_pipeline.without_repeated_lines(spark, few, "")))
    assert all(out[k] == (t if k % 10 == 0 else f"before {k}\nbehind {k}") for k, t in rows)
    want = plain(texts_of(docs))
    out = corpus_pipeline.without_repeated_lines(spark, docs, "")
    assert Counter(texts_of(out)) == Counter((d, want[d, t]) for d, t in texts_of(docs))
    assert out.columns == docs.columns and corpus_pipeline.without_repeated_lines(spark, none, "").count() == 0


# --- pieces and tokens


def test_token_counts(docs, none, model):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = token_counts.count_tokens(docs, model, table_size=50)
    held = dict(enumerate(TEXTS))
    for r in got.collect():
        if r.doc_id is not None:
            text = held[r.doc_id] or ""
            assert (r.n_tokens, r.n_bytes) == (len(sp.encode(text)), len(text.encode()))
    assert got.count() == docs.count() and token_counts.count_tokens(none, model).count() == 0


def test_small_caches_change_nothing(model):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    known = token_counts.Lengths(model, {}, cache_size=3)
    for t in [*filter(None, TEXTS), "  a", "a  ", "▁", "\n \t", "日本 x"]:
        assert known.count(t) == len(sp.encode(t))


def test_scan_equals_one_pass(docs, none, model):
    v = unigram_scan.vocabulary(model)
    want = {t or "": unigram_scan.encode_whole(v, t or "") for t in TEXTS}
    whole = {(r.doc_id, bytes(r.ids)) for r in unigram_scan.encode(docs, model, ["doc_id"]).collect()}
    parts = unigram_scan.encode(docs, model, ["doc_id", "row", "h"], chunk=37)
    assert {(r.doc_id, bytes(r.ids)) for r in parts.collect()} == whole
    assert all((k, want[t or ""]) in whole for k, t in enumerate(TEXTS))
    assert parts.count() == docs.count() and unigram_scan.encode(none, model, ["doc_id"]).count() == 0
    back = {r.doc_id: r.text for r in unigram_scan.decode(parts, model, ["doc_id"]).collect()}
    assert all(back[k] == (t or "").replace("▁", " ") for k, t in enumerate(TEXTS))


def test_words_together_as_one_by_one(model):
    import random

    v, r = unigram_scan.vocabulary(model), random.Random(3)
    words = {w for t in TEXTS if t for w in token_counts.pre_tokens(t)} | {"".join(r.choice("the\n\tan  .,09~!\x00<>éüß\x80\xa0") for _ in range(r.randint(1, 48))) for _ in range(4000)}
    of_length = defaultdict(list)
    for w in words:
        if w and v.plain.issuperset(w) and len(w) <= 48:
            of_length[len(w)].append(w)
    for some in of_length.values():
        assert v.segment_all(some) == [v.segment("▁" + w.replace(" ", "▁")) for w in some]
    for w in sorted(words)[:500]:
        s = "▁" + w.replace(" ", "▁")
        assert v.segment(s) == np.array(v.trace(s, v.forward(s, [0.0], len(s))[1], len(s)), np.int32).tobytes()
    texts = [t or "" for t in TEXTS]
    assert v.encode_texts(texts) == [unigram_scan.encode_whole(v, t) for t in texts]


def test_matrices_combine(model):
    v = unigram_scan.vocabulary(model)
    for text in ("the others  there", "x" * 40, LONG[:500]):
        s = unigram_scan.prepared(text)
        best, _ = v.forward(s, [0.0], len(s))
        for size in (1, 4, 17, 64):
            ms = [unigram_scan.Chunk(v, *c).matrix() for c in unigram_scan.cut(s, v.reach, size)]
            left = ms[0]
            for m in ms[1:]:
                left = unigram_scan.combine(left, m)
            right = ms[-1]
            for m in ms[-2::-1]:
                right = unigram_scan.combine(m, right)
            assert left[0, 0] == right[0, 0] == best[-1]


def test_segmentation_is_the_librarys_best(model):
    """The same file flagged as a unigram model: the library's first n-best path has the same pieces."""

    def varint(b, i):
        out = shift = 0
        while True:
            out |= (b[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if b[i - 1] < 128:
                return out, i

    i, flagged = 0, b""
    while i < len(model):
        begin = i
        key, i = varint(model, i)
        n, i = varint(model, i)
        body = model[i : i + n]
        if key >> 3 == 2:
            body = body.replace(b"\x18\x02", b"\x18\x01", 1)
        flagged, i = flagged + model[begin:i] + body, i + n
    sp = sentencepiece.SentencePieceProcessor(model_proto=flagged)
    v = unigram_scan.vocabulary(model)
    for w in sorted({w for t in TEXTS if t for w in t.split()})[:300]:
        if len(w) < 60:
            mine = [v.pieces[k][0] for k in np.frombuffer(unigram_scan.encode_whole(v, w), np.int32)]
            assert mine == sp.nbest_encode(w, nbest_size=2, out_type=str)[0]


# --- personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    def fine(k, s):
        d = re.sub("[^0-9]", "", s)
        if k == 1:
            return all(int(x) <= 255 for x in s.split("."))
        if k == 2:
            return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
        return k != 3 or 10 <= len(d) <= 15

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if fine(k, m[0]))


def test_base_spans():
    import random

    r = random.Random(7)
    for _ in range(4000):
        t = "".join(r.choice(["a", "@", ".", "-", "1", "22", " ", "+", "(", "4111111111111111", "é", "%", "\n", "300", "٣"]) for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_disclosure(spark):
    rows = [(k, f"the secretword zorro wrote to who{k % 2}@x.example.com in town") for k in range(6)] + [(k, f"the common text number{k} in town") for k in range(10, 60)]
    rows = [(k, t.replace("zorro", "zorro" if k % 2 == 0 else "tango") + f" tail{k}") for k, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = pii.protect(docs)
    told = {r.doc_id: [dict(rows)[r.doc_id][s.begin : s.end] for s in r.told] for r in spans.collect()}
    assert "zorro" in told[0] and "tango" in told[1] and not any("in" in t or "town" in t for t in told.values())
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, spans).collect()}
    assert "[EMAIL]" in clean[0] and "zorro" not in clean[0] and clean[20] == dict(rows)[20]


def test_disclosure_of_an_entity_of_one_text(spark):
    """Once or in copies: what stands beside it and hardly anywhere else reveals it."""
    rows = [(0, "the quixote wrote to lone@x.example.com in town"), *((k, "the sancho wrote to copied@x.example.com in town") for k in (1, 2, 3))]
    rows += [(k, f"the common text number{k} wrote to in town") for k in range(10, 60)]
    told = {r.doc_id: [dict(rows)[r.doc_id][s.begin : s.end] for s in r.told] for r in pii.protect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert told[0] == ["quixote"] and all(told[k] == ["sancho"] for k in (1, 2, 3)) and not any(told[k] for k in range(10, 60))


def test_disclosing_terms_go_wherever_they_stand(spark):
    """Far from the entity only, near and again far, and behind a very long word; against brute force."""
    common = " ".join(f"common{k}" for k in range(30))
    rows = [(0, f"Dulcinea {common} {common} sancho wrote to lone@x.example.com {common} {'y' * 9000} sancho {common} dulcinea日lone@x.example.com")]
    rows += [(k, f"{common} wrote to" if k % 2 else f"{common} wrote to panza{k % 5}@x.example.com windmill{k % 10} and {common} windmill{k % 10}") for k in range(1, 60)]
    rows += [(100, rows[2][1]), (101, rows[0][1])]
    docs, n = spark.createDataFrame(rows, "doc_id long, text string"), len(rows)
    spans = pii.protect(docs)
    sets = {d: ({t[a:b].lower() for a, _, b in plain_spans(t)}, {t[i:j].lower() for _, i, j in pii.terms_of(t, plain_spans(t))}) for d, t in rows}
    n_e = Counter(e for es, _ in sets.values() for e in es)
    n_t = Counter(t for _, ts in sets.values() for t in ts)
    n_te = Counter((e, t) for es, ts in sets.values() for e in es for t in ts)
    told = {(e, t) for (e, t), k in n_te.items() if np.log(n * k / (n_t[t] * n_e[e])) >= pii.GENERALISE * np.log(n / n_e[e]) - 1e-12}
    want = {d: [(i, j) for w, i, j in pii.terms_of(t, plain_spans(t)) if any((e, w) in told for e in sets[d][0])] for d, t in rows}
    assert {r.doc_id: [(s.begin, s.end) for s in r.told] for r in spans.collect()} == want
    clean = {r.doc_id: r.text.lower() for r in pii.sanitise(docs, spans).collect()}
    assert not any(w in clean[d] for w in ("dulcinea", "sancho", "yyy", "日") for d in (0, 101)) and "common0" in clean[0]
    assert all(f"windmill{k % 10}" not in clean[k] for k in range(2, 60, 2)) and clean[100] == clean[2] and clean[1] == rows[1][1]


def test_cleaned_texts():
    """Overlapping and touching spans, and terms by their class."""
    text = "Zorro wrote 12345 to a1b2 by mail x@y.example now"
    base = [(text.index("x@"), 0, text.index(" now"))]
    at = lambda w, gone: (text.index(w), text.index(w) + len(w), gone)
    assert pii.cleaned(text, base, [at("Zorro", False), at("12345", False), at("a1b2", False), at("now", True)]) == "[NAME 5-8] wrote [NUMBER 5-8] to [CODE 3-4] by mail [EMAIL] "
    assert pii.cleaned("aaaa", [(0, 1, 3)], [(2, 4, False)]) == "[IP][WORD 1-2]" and pii.cleaned("", [], []) == ""
    assert [pii.term_class("x" * n) for n in (1, 2, 3, 4, 5, 8, 9)] == ["[WORD 1-2]", "[WORD 1-2]", "[WORD 3-4]", "[WORD 3-4]", "[WORD 5-8]", "[WORD 5-8]", "[WORD 9-16]"]


def test_personal_data_of_odd_rows(docs, none):
    spans = pii.protect(docs)
    got = {r.doc_id: [(s.begin, s.kind, s.end) for s in r.base] for r in spans.collect()}
    assert all(got[k] == plain_spans(t or "") for k, t in enumerate(TEXTS)) and spans.count() == docs.count()
    assert pii.sanitise(docs, spans).columns == docs.columns and pii.sanitise(docs, spans).count() == docs.count()
    assert pii.protect(none).count() == 0


def test_counts_and_digests_of_the_personal_data_query(spark, tmp_path):
    """Each kind counts its own spans, wherever they stand among the others."""
    texts = [None, "", "a@b.c", "1.2.3.4 and 300.1.1.1", "4111 1111 1111 1111", "+1 (222) 333-4444", "x@y.example +1 (222) 333-4444 or a@b.c, 4111111111111111 at 10.0.0.1 and 10.0.0.2, z@y.example", "+12223334444 1.2.3.4 a@b.c"]
    rows = [*enumerate(texts), (6, texts[6]), (None, texts[7])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.op3_pii(spark, str(tmp_path)).collect()]
    spans = [(d, plain_spans(t or "")) for d, t in rows]
    want = [(d, *(sum(k == x for _, x, _ in s) for k in range(4)), hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in s).encode()).hexdigest()) for d, s in spans]
    assert Counter(got) == Counter(want)


# --- grouped join


def shingle_set(text):
    w = WORD.findall((text or "").translate(ASCII))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def plain_components(pairs):
    sets = [shingle_set(t) for _, t in pairs]
    label = list(range(len(pairs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    near = {(a, b) for held in inverted.values() for a in held for b in held if a < b}
    for a, b in near:
        k = len(sets[a] & sets[b])
        if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            label[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), (least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(pairs, sets, strict=True)))


def test_grouped_join(docs, none):
    assert Counter(tuple(r) for r in group_join.join(docs).collect()) == plain_components(texts_of(docs))
    assert group_join.join(none).count() == 0
    kept = group_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 1, 2, 5, None} and NEAR not in {r.text for r in kept.collect()}


def test_grouped_join_of_a_family(spark):
    """Near copies of near copies: links between members that hubs don't reach, sizes at the edge of similarity."""
    import random

    r = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):
        w = list(base if not rows or r.random() < 0.5 else r.choice(rows)[1].split())
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = [f"v{r.randrange(30)}"] * r.randint(0, 2)
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(x) for x in group_join.join(docs).collect()) == plain_components(rows)


def test_equal_signatures_of_different_sets_are_told_apart(spark, docs):
    """Of four bits, so that nearly all sets clash, and of none."""
    want = plain_components(texts_of(docs))
    for bits in (0, 4):
        signed, clashing = group_join.signatures(docs, bits=bits)
        assert len(clashing) and signed.where("n > 0").select("node").distinct().count() == len({frozenset(s) for _, t in texts_of(docs) if (s := shingle_set(t))})
        assert Counter(tuple(r) for r in group_join.join(docs, bits=bits).collect()) == want


def test_no_bit_of_a_shingle_is_lost():
    """A hash is its bucket's begin and its place there, of 7 bytes where there are 256 buckets."""
    r = np.random.default_rng(5)
    h = np.concatenate([r.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
    for n_buckets in (8, 29, 255, 256, 1709, 30_000):
        width = np.uint64((1 << 64) // n_buckets + 1)
        begin = h // width * width
        assert (group_join._from_places(*group_join._places(h - begin, n_buckets)) + begin == h).all() and int((h // width).max()) < n_buckets


def test_word_hashes_of_pieces(monkeypatch):
    texts = pa.array([t for t in TEXTS] + ["a" * 50 + " b", "\t\n"])
    whole = group_join.word_hashes(texts)
    monkeypatch.setattr(group_join, "PIECE", 13)
    small = group_join.word_hashes(texts)
    assert (whole[0] == small[0]).all() and (whole[1] == small[1]).all()
    assert whole[1].tolist() == [len(WORD.findall(t or "")) for t in texts.to_pylist()]
    assert (group_join.word_hashes(texts.slice(5, 3))[0] == whole[0][whole[1][:5].sum() : whole[1][:8].sum()]).all()
