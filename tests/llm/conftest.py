import random

import pytest


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(["th", "er", "on", "an", "re", "é"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def lines(seed, n):
    return "\n".join(" ".join(words((seed, k).__hash__(), 12)) for k in range(n))


BASE = lines(1, 12)
NEAR = BASE.replace("th", "TH", 1)
LONG = lines(2, 700) + "   " + "x" * 3000 + "\n" + lines(3, 300)
TEXTS = [None, "", " ", "one", "a b c", BASE, BASE, NEAR, " ".join(words(4, 300)), lines(5, 2) + "\n" + BASE, LONG, "mail a.b@c.example.com at +1 (222) 333-4444 from 10.0.0.255", "x ▁ y  z </s>"]
SOURCES = ["b", "a", None, "b", "c"]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, repeated rows, and columns whose names clash with those used inside."""
    rows = [(k, t, "en", SOURCES[k % 5], len(t or ""), k, "x", 1.5) for k, t in enumerate(TEXTS)]
    rows += [rows[5], rows[0], (None, BASE + " more", None, "a", 3, 0, "", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, h string, statistics double").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
