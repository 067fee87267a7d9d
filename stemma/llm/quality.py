"""Quality classifier: a sparse ensemble of rules over text statistics.

`statistics` measures whole texts. `fit` grows small boosted trees on a bounded sample of labelled rows, takes every
path of every tree as a conjunctive rule, and fits lasso logistic weights to the rules. `Rules.score` compiles the
rules that kept a weight into one Spark column expression, so scoring runs in generated code behind the statistics.

The sample is the `TRAIN_ROWS` labelled training rows with the smallest hashes of doc_id (all of them, if fewer);
everything else covers all rows. Labels, lang, source and doc_id are no inputs of a score. Null texts count as empty;
an empty text has statistics of 0 and a score. A row's label is the smallest quality that is 0 or 1 among its rows of
`labels`. With labels of one kind only, or none, every score is their share of ones, or 0.5. Repeated rows get equal
results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, fresh, release, strings, table, tuned

#: Labelled rows that the classifier is fitted on, at most.
TRAIN_ROWS = 20_000
FOLDS, THRESHOLD = 5, 0.3
TREES, DEPTH, RATE, BINS, LEAST = 40, 3, 0.3, 32, 10
#: Lasso penalties tried, from the strongest to the weakest; the part of the sample that chooses among them.
PENALTIES, CHOOSING = [0.02, 0.01, 0.005, 0.002, 0.001, 0.0005], 0.25

STATISTICS = ["chars", "words", "word_chars", "longest_word", "upper", "digits", "marks", "blanks", "other", "exclamations", "capitals", "ends_marked", "distinct_words", "top_word", "lines", "line_chars", "repeated_lines", "repeated_line_chars", "repeated_pairs", "sentences"]

_UPPER = np.arange(65, 91)
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"])


def measure(text: str) -> tuple[float, ...]:
    """The statistics of one text, in the order of STATISTICS."""
    if not text:
        return (0.0,) * len(STATISTICS)
    raw = text.encode()
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, nb = len(text), len(raw)
    words = text.split()
    nw = len(words)
    if nw:
        tally = Counter(words)
        letters = sum(map(len, words))
        pairs = len(set(zip(words, words[1:], strict=False))) / max(1, nw - 1)
        marked = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:")
        capitals = sum(1 for w in words if w.isupper() and len(w) > 1)
        word_stats = (letters / nw, max(map(len, tally)), capitals / nw, marked / nw, len(tally) / nw, max(tally.values()) / nw, 1 - pairs)
    else:
        word_stats = (0.0,) * 7
    lines = [x for x in text.split("\n") if x]
    lines_seen = Counter(lines)
    nl = max(1, len(lines))
    again = sum(v - 1 for v in lines_seen.values()) / nl
    again_chars = sum((v - 1) * len(k) for k, v in lines_seen.items()) / n
    return (
        float(n), float(nw), word_stats[0], float(word_stats[1]), float(seen[_UPPER].sum()) / nb, float(seen[48:58].sum()) / nb, float(seen[_MARKS].sum()) / nb, float(seen[32] + seen[9:14].sum()) / nb, float(seen[128:].sum()) / nb, float(seen[33]) / nb,
        word_stats[2], word_stats[3], word_stats[4], word_stats[5], float(len(lines)), n / nl, again, again_chars, word_stats[6], float(seen[46]) / max(1, nw),
    )


def statistics(docs: DataFrame, carried: list[str], name: str = "statistics") -> DataFrame:
    """The carried columns of docs, and a struct of all statistics."""
    struct = pa.struct([(s, pa.float64()) for s in STATISTICS])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            x = np.array([measure(t) for t in strings(b.column(0))], np.float64)
            made = pa.StructArray.from_arrays([pa.array(x[:, k]) for k in range(len(STATISTICS))], fields=list(struct))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], made], names=[*carried, name])
        release()

    (text,) = fresh(docs, "measured_text")
    chosen = docs.select(F.col("text").alias(text), *(F.col(f"`{c}`") for c in carried))
    schema = T.StructType([*chosen.schema.fields[1:], T.StructField(name, T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]))])
    return chosen.mapInArrow(run, schema)


Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class Rules:
    """bias + sum of weights of the rules that hold; a rule is (statistic, above, threshold) conditions."""

    bias: float
    rules: list[Rule]
    weights: list[float]

    def score(self, statistics: str = "statistics") -> Column:
        total = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for k, above, t in rule:
                c = F.col(statistics)[STATISTICS[k]]
                holds = holds & ((c > F.lit(float(t))) if above else (c <= F.lit(float(t))))
            total = total + F.when(holds, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.bias + _holds(x, self.rules) @ np.array(self.weights)) if self.rules else np.full(len(x), _sigmoid(np.array(self.bias)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _holds(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for k, above, t in rule:
            out[:, j] *= (x[:, k] > t) if above else (x[:, k] <= t)
    return out


def _tree(binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """All paths of a tree fitted to the gradient, and its step for each row."""
    paths: list[Rule] = []
    step = np.zeros(len(gradient))

    def grow(rows: np.ndarray, path: Rule) -> None:
        g, h = gradient[rows], hessian[rows]
        best = (1e-6, -1, -1)
        if len(path) < DEPTH and len(rows) >= 2 * LEAST:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for k, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, k]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, minlength=len(e) + 1))[:-1] for w in (g, h, None))
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = 0
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (float(gain[at]), k, at)
        if best[1] < 0:
            step[rows] = g.sum() / (h.sum() + 1)
            return
        _, k, at = best
        low = binned[rows, k] <= at
        for above, part in ((False, rows[low]), (True, rows[~low])):
            longer = (*path, (k, above, float(edges[k][at])))
            paths.append(longer)
            grow(part, longer)

    grow(np.arange(len(gradient)), ())
    return paths, step


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, start: tuple[float, np.ndarray], rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for the logistic loss; the bias isn't penalised."""
    bias, w = start
    zb, zw, t = bias, w.copy(), 1.0
    rate = 4 / (1 + np.linalg.norm(r, 2) ** 2 / len(r))
    for _ in range(rounds):
        error = _sigmoid(zb + r @ zw) - y
        nb, nw = zb - rate * error.mean(), zw - rate * (r.T @ error) / len(r)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zb, zw = nb + (t - 1) / nt * (nb - bias), nw + (t - 1) / nt * (nw - w)
        bias, w, t = nb, nw, nt
    return float(bias), w


def _loss(y: np.ndarray, p: np.ndarray) -> float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit_rules(x: np.ndarray, y: np.ndarray) -> Rules:
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 4 * LEAST or share in (0.0, 1.0):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Rules(float(np.log(p / (1 - p))), [], [])
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    edges = [e[e < x[:, k].max()] for k, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    margin, found = np.full(len(y), np.log(share / (1 - share))), {}
    for _ in range(TREES):
        p = _sigmoid(margin)
        paths, step = _tree(binned, edges, y - p, p * (1 - p))
        found |= dict.fromkeys(paths)
        margin += RATE * step
    rules = list(found)
    r = _holds(x, rules)
    if not rules:
        return Rules(float(margin[0]), [], [])
    choosing = np.arange(len(y)) % round(1 / CHOOSING) == 0
    start, best = (float(np.log(share / (1 - share))), np.zeros(len(rules))), (np.inf, PENALTIES[0])
    at = start
    for penalty in PENALTIES:
        at = _lasso(r[~choosing], y[~choosing], penalty, at)
        best = min(best, (_loss(y[choosing], _sigmoid(at[0] + r[choosing] @ at[1])), penalty))
    for penalty in (p for p in PENALTIES if p >= best[1]):
        start = _lasso(r, y, penalty, start)
    kept = np.flatnonzero(np.abs(start[1]) > 1e-6)
    return Rules(start[0], [rules[k] for k in kept], [float(start[1][k]) for k in kept])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Rules:
    """Rules fitted on at most `most` labelled rows that aren't held out."""
    tuned(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("id"), "quality")
    # The sample has at most `most` rows of two numbers: it may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("id", "quality", "text")
    # However often a doc_id repeats, the driver gets one row for it: that of the least statistics.
    got = statistics(rows, ["id", "quality"]).groupBy("id", "quality").agg(F.min("statistics").alias("statistics")).select("id", "quality", "statistics.*")
    table_ = got.toPandas().sort_values("id")
    order = np.random.default_rng(0).permutation(len(table_))
    rules = fit_rules(table_[STATISTICS].to_numpy(np.float64)[order], table_["quality"].to_numpy(np.float64)[order])
    release()  # the driver's memory, too, is needed later
    return rules


def score(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, score, predicted for every row."""
    scored = statistics(docs, ["doc_id"]).select("doc_id", rules.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep(docs: DataFrame, rules: Rules) -> DataFrame:
    """The rows of docs that the rules don't reject, with all their columns."""
    (name,) = fresh(docs, "statistics")
    return statistics(docs, docs.columns, name).where(rules.score(name) >= THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, rules).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
