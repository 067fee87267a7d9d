"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct shingles of `WORDS` lower-cased words, as 64-bit hashes. Equal sets are one node. Two
nodes link when their sets' Jaccard similarity is `PERCENT` % or more; a document's component is the smallest doc_id
among the documents of the nodes that it reaches.

1. Each shingle's frequency among nodes is counted exactly: packed hashes are dealt out by hash, sorted, and only those
   of two nodes or more go back to their nodes. A node with less than 80 % of such shingles has no link and is done.
2. Ordered by frequency, rare ones first, linked sets of sizes n and m have a shingle in common in their first
   n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1. Nodes with equal prefixes and sizes make one group, and groups are
   looked up by the shingles of their prefixes.
3. In `ROUNDS` rounds, every group of a shingle's list is paired with `HUBS` of the list's groups, chosen anew each
   time, its nodes are verified against the hubs' first nodes, and components are merged. That finds the components of
   large groups of near copies with few pairs for each node.
4. Every pair of groups of one list that may still join different components is then expanded into its nodes' pairs and
   verified, each at the first shingle that both prefixes have. Only pairs are left out whose sizes, shingles of their
   own and common shingles in their prefixes leave too few common ones, which no verification could pass.

Documents without words are linked with nothing: n_shingles 0 and their own doc_id as component. Null texts count as
empty. Rows that repeat doc_id are documents of their own; a null doc_id never names a component unless all are null.
An empty table gives an empty result.

Shingles are equal where their 64-bit hashes are: no bit is lost on the way to the comparison. Sets are equal where 128
bits are: nodes go by 64 of them, and where two sets have these in common but not the other 64, by a mix of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, dropped, fresh, release, table, tuned, written
from .components import components

WORDS, PERCENT = 5, 80
#: Lists of a group that rounds look at: the first LOOKED_UP of its prefix, four times as many in each later round.
ROUNDS, HUBS, LOOKED_UP = 3, 8, 4
#: Shingles of a bucket of the frequency count, and that a task holds before it deals them out.
BUCKET, FLUSH = 1_500_000, 1_000_000
#: Bytes of text that are hashed at once.
PIECE = 500_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = [_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3), _U(0x589965CC75374CC3)]
_powers: list[np.ndarray] = []


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with well mixed bits (splitmix64's last step)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        _powers[:] = [np.concatenate([np.ones(1, _U), np.cumprod(np.full(size, b, _U))]) for b in (_U(_BASE), _U(_INVERSE))]
    return _powers


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the place where it begins; starts: where documents begin, each the end of a word."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = starts[starts < len(data)]
    first[edges] = inside[edges]
    begin = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    inner = edges[edges > 0] - 1
    last[inner] = inside[inner]
    end = np.flatnonzero(last) + 1
    power, inverse = _power(len(data) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((_LOWER[data].astype(_U) + _U(1)) * power[: len(data)])])
    return _scramble((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(_U) * _MIX[0]), begin


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch of texts, and the number of words of each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    hashes, places, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + PIECE)
        while stop < len(data) and not _SPACE[data[stop]]:  # a piece ends at a blank, or with a document
            k = np.searchsorted(offsets, stop)
            if offsets[k] == stop:
                break
            ahead = data[stop : min(stop + 4096, int(offsets[k]))]
            blank = np.flatnonzero(_SPACE[ahead])
            stop += int(blank[0]) if len(blank) else len(ahead)
        own = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)] - at
        h, p = _words(data[at:stop], own)
        hashes.append(h)
        places.append(p + at)
        at = stop
    h = np.concatenate(hashes) if hashes else np.empty(0, _U)
    p = np.concatenate(places) if places else np.empty(0, np.int64)
    return h, np.diff(np.searchsorted(p, offsets))


def shingles(texts: pa.Array, words: int = WORDS, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text one after another, their numbers, and the sets' two signatures.

    bits: how many the first signature has; fewer than 64 make different sets meet, for tests.
    """
    h, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    out, sizes = [], np.zeros(len(counts), np.int64)
    if len(h) >= words:
        n = len(h) - words + 1
        whole = np.zeros(n, _U)
        for k in range(words):
            whole += h[k : k + n] * _MIX[k]
        whole = _scramble(whole)
    for i, (end, c) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
        if not c:
            continue
        if c >= words:
            s = np.unique(whole[end - c : end - words + 1])
        else:
            s = _scramble(np.array([sum(int(x) * int(_MIX[k]) for k, x in enumerate(h[end - c : end])) + c & (1 << 64) - 1], _U))
        sizes[i] = len(s)
        out.append(s)
    flat = np.concatenate(out) if out else np.empty(0, _U)
    signs = [np.zeros(len(counts), _U), np.zeros(len(counts), _U)]
    full = sizes > 0
    if full.any():
        starts = np.cumsum(sizes[full]) - sizes[full]
        for k, sign in enumerate(signs):
            sign[full] = _scramble(np.add.reduceat(_scramble(flat ^ _MIX[k + 1]), starts) + sizes[full].astype(_U) * _MIX[4])
    return flat, sizes, (signs[0] & _U((1 << bits) - 1)).view(np.int64), signs[1].view(np.int64)


def node_ids(signs: np.ndarray, others: np.ndarray, clashing: np.ndarray) -> np.ndarray:
    """A node's id: its first signature; where that is clashing, mixed with the other one. clashing is sorted."""
    if not len(clashing) or not len(signs):
        return signs
    at = np.minimum(np.searchsorted(clashing, signs), len(clashing) - 1)
    return np.where(clashing[at] == signs, _scramble(signs.view(_U) ^ _scramble(others.view(_U))).view(np.int64), signs)


def signatures(docs: DataFrame, words: int = WORDS, bits: int = 64) -> tuple[DataFrame, np.ndarray]:
    """A written table with doc_id, n, node for every row, and the clashing first signatures, sorted.

    Of n different sets some n * n / 2 ** 65 pairs clash, a few at 10 ** 10: that is the length of the driver's list.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            _, sizes, signs, others = shingles(b.column(1), words, bits)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(signs), pa.array(others)], names=["doc_id", "n", "node", "other"])
        _powers.clear()
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, node bigint, other bigint"), "signatures")
    several = signed.where(F.col("n") > 0).groupBy("node").agg(F.min("other").alias("low"), F.max("other").alias("high")).where(F.col("low") != F.col("high"))
    clashing = np.sort(np.array([r[0] for r in several.select("node").collect()], np.int64))
    if not len(clashing):
        return signed.drop("other"), clashing

    def told_apart(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            ids = node_ids(b.column(2).to_numpy(), b.column(3).to_numpy(), clashing)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids)], names=["doc_id", "n", "node"])

    return written(signed.mapInArrow(told_apart, f"doc_id {kind}, n bigint, node bigint"), "signatures"), clashing


def _packed(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def _unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(blob, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _dealt(parts: np.ndarray, n_parts: int, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(parts, kind="stable")
    bounds = np.searchsorted(parts[order], np.arange(n_parts + 1))
    for p in range(n_parts):
        if bounds[p] < bounds[p + 1]:
            yield p, [c[order[bounds[p] : bounds[p + 1]]] for c in columns]


def _places(h: np.ndarray, n_buckets: int) -> list[np.ndarray]:
    """Hashes' places in their bucket as columns of 4, 2, 1 and 1 bytes; with 256 buckets the last one isn't needed."""
    top = (h >> _U(56)).astype(np.uint8) if n_buckets < 256 else np.empty(0, np.uint8)
    return [(h & _U(0xFFFFFFFF)).astype(np.uint32), (h >> _U(32) & _U(0xFFFF)).astype(np.uint16), (h >> _U(48) & _U(0xFF)).astype(np.uint8), top]


def _from_places(low: np.ndarray, mid: np.ndarray, high: np.ndarray, top: np.ndarray) -> np.ndarray:
    h = low.astype(_U) | (mid.astype(_U) << _U(32)) | (high.astype(_U) << _U(48))
    return h | (top.astype(_U) << _U(56)) if len(top) else h


def shared_shingles(docs: DataFrame, signed: DataFrame, n_shingles: int, words: int = WORDS, percent: int = PERCENT, bucket: int = BUCKET, clashing: np.ndarray | None = None, bits: int = 64) -> DataFrame:
    """node, n, tokens: the nodes that may have links, with all shingles that other nodes have too, rare ones first.

    Hashes are dealt out by ranges of them, a task for each, then by ranges of nodes: a task's share doesn't grow.
    signed: node, n of all documents.
    """
    n_buckets = max(16, -(-n_shingles // bucket))
    width = _U((1 << 64) // n_buckets + 1)
    clashing = np.empty(0, np.int64) if clashing is None else clashing
    kinds = [np.uint32, np.uint16, np.uint8, np.uint8, np.int64, np.uint16, np.uint32]

    def sent(rows: list[tuple[int, bytes]], kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["key", "kind", "blob"])

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A blob for each bucket: the hashes' places in it, nodes, and hashes of each node."""
        held: list[tuple] = []
        n = 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate([h[0] for h in held])
            sizes, signs = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            at = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            out = []
            for p, (h, i) in _dealt((flat // width).astype(np.int32), n_buckets, flat, at):
                present, counts = np.unique(i, return_counts=True)
                few = counts.max() < 1 << 16
                numbers = [counts.astype(np.uint16), np.empty(0, np.uint32)] if few else [np.empty(0, np.uint16), counts.astype(np.uint32)]
                out.append((p, _packed(*_places(h - _U(p) * width, n_buckets), signs[present], *numbers)))
            return sent(out, 0)

        for b in batches(rows):
            flat, sizes, signs, others = shingles(b.column(0), words, bits)
            held.append((flat, sizes, node_ids(signs, others, clashing)))
            n += len(flat)
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()
        held.clear()
        _powers.clear()
        release()

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one bucket: the hashes that several nodes have, dealt out by node."""
        hashes, nodes = [], []
        for b in batches(rows):
            for p, blob in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                *places, signs, few, many = _unpacked(blob.as_buffer(), *kinds)
                hashes.append(_from_places(*places) + _U(p) * width)
                nodes.append(np.repeat(signs, few if len(few) else many))
            del b, blob, places, signs, few, many
        if not hashes:
            return
        h, node = np.concatenate(hashes), np.concatenate(nodes)
        del hashes, nodes
        order = np.argsort(h)
        h = h[order]
        again = np.zeros(len(h), bool)
        same = h[1:] == h[:-1]
        again[1:] |= same
        again[:-1] |= same
        h, node = h[again], node[order[again]]
        order = np.lexsort((node, h))
        h, node = h[order], node[order]
        new = np.ones(len(h), bool)  # copies of a node count once
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node = h[new], node[new]
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
        df = np.repeat(np.diff(np.append(starts, len(h))), np.diff(np.append(starts, len(h))))
        some = df > 1
        h, node, df = h[some], node[some], df[some]
        yield sent([(p, _packed(*columns)) for p, columns in _dealt((node.view(_U) // width).astype(np.int32), n_buckets, h.view(np.int64), node, df.astype(np.int32))], 0)
        del h, node, order, again, same, new, df, some
        release()

    def deal_sizes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            node, size = b.column(0).to_numpy(), b.column(1).to_numpy()
            yield sent([(p, _packed(*columns)) for p, columns in _dealt((node.view(_U) // width).astype(np.int32), n_buckets, node, size)], 1)

    def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one part of the nodes: those that have enough shared hashes, with them."""
        held: dict[int, list[list[np.ndarray]]] = {0: [], 1: []}
        for b in batches(rows):
            for kind, blob in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                held[kind].append(_unpacked(blob.as_buffer(), *([np.int64, np.int64] if kind else [np.int64, np.int64, np.int32])))
        if not held[0]:
            return
        known, sizes = (np.concatenate([x[k] for x in held[1]]) for k in range(2))
        order = np.argsort(known)
        known, sizes = known[order], sizes[order]
        h, node, df = (np.concatenate([x[k] for x in held[0]]) for k in range(3))
        held.clear()
        order = np.lexsort((h, df, node))
        h, node = h[order], node[order]
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(node)), bool), node[1:] != node[:-1]]))
        counts = np.diff(np.append(starts, len(node)))
        n = sizes[np.searchsorted(known, node[starts])]
        fine = np.flatnonzero(100 * counts >= percent * n)
        for a in range(0, len(fine), 1024):
            some = fine[a : a + 1024]
            lists = [h[starts[i] : starts[i] + counts[i]] for i in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(node[starts[some]]), pa.array(n[some]), pa.array(lists, pa.list_(pa.int64()))], names=["node", "n", "tokens"])
        del h, node, df, order, known, sizes
        release()

    blob = "key int, kind int, blob binary"
    counted = docs.select("text").mapInArrow(deal, blob).repartitionById(n_buckets, F.col("key")).mapInArrow(count, blob)
    sizes = signed.where(F.col("n") > 0).groupBy("node").agg(F.first("n").alias("n")).mapInArrow(deal_sizes, blob)
    return counted.unionByName(sizes).repartitionById(n_buckets, F.col("key")).mapInArrow(gather, "node bigint, n bigint, tokens array<bigint>")


def _fits(n: str, m: str, left_n: Column, left_m: Column, percent: int) -> Column:
    """Whether sets of n and m shingles can be similar enough if only left_n and left_m of them can be common."""
    n, m, common = F.col(n), F.col(m), F.least(left_n, left_m)
    return ((100 * F.least(n, m)) >= percent * F.greatest(n, m)) & ((100 + percent) * common >= percent * (n + m))


def verified(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: the different components of pairs (a, b) of nodes whose sets are similar enough.

    All shingles that both sets have are among their nodes' tokens.
    """
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"), F.col("component").alias(f"c{x}"))
    both = F.size(F.array_intersect("ta", "tb"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(F.col("ca") != F.col("cb"))
    return met.where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def links(nodes: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS, hubs: int = HUBS) -> DataFrame:
    """node, component for the nodes with links; nodes: node, n, tokens."""
    rare = F.col("n") - F.size("tokens")  # shingles of this node alone come first in its prefix
    prefix = F.slice("tokens", F.lit(1), F.greatest(F.lit(0), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - rare).cast("int")))
    held = written(nodes.withColumn("prefix", prefix).withColumn("key", F.xxhash64("n", "prefix")), "nodes")
    # Groups: nodes with equal prefixes and sizes.
    leaders = held.groupBy("key", "n", "prefix").agg(F.min("node").alias("leader"), F.min(F.col("n") - F.size("tokens")).alias("alone"))
    members = written(held.select("node", "key", "n").join(leaders.select(F.col("key").alias("k"), F.col("n").alias("m"), "leader"), (F.col("key") == F.col("k")) & (F.col("n") == F.col("m"))).select("leader", "node"), "members")
    lists = written(leaders.select("leader", "n", "alone", F.posexplode("prefix").alias("place", "token")), "lists")
    labels = members.select("node", F.col("node").alias("component"))
    def of_groups() -> DataFrame:
        """leader, component, null where a group's nodes are in several."""
        got = members.join(labels, "node").groupBy("leader").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        return got.select("leader", F.when(F.col("low") == F.col("high"), F.col("low")).alias("component"))

    def open_lists(rows: DataFrame) -> DataFrame:
        """The rows of lists that hold several components, with the component."""
        known = rows.join(of_groups(), "leader")
        several = known.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("all"), F.count("component").alias("plain"))
        several = several.where((F.col("low") != F.col("high")) | (F.col("plain") < F.col("all"))).select("token")
        return known.join(several, "token")

    def merged(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """labels, after the pairs that hold have joined their components."""
        joined = written(verified(pairs.distinct(), held.join(labels, "node"), percent).distinct(), "links")
        if joined.isEmpty():
            dropped(joined)
            return labels
        found = components(joined)
        moved = found.withColumnRenamed("component", "to").withColumnRenamed("node", "c")
        out = written(labels.join(moved, F.col("component") == F.col("c"), "left").select("node", F.coalesce("to", "component").alias("component")), "components")
        dropped(joined, found)
        return out

    # Inside a group: every node against the group's first.
    labels = merged(members.where(F.col("leader") != F.col("node")).select(F.col("leader").alias("a"), F.col("node").alias("b")), labels)
    for r in range(rounds):
        some = open_lists(lists.where(F.col("place") < LOOKED_UP * 4**r).select("token", "leader", "n", "alone"))
        some = written(some, "open")
        if some.isEmpty():
            dropped(some)
            continue
        # First those that have most in common with others, then any.
        turn = [F.col("alone")] if r == 0 else []
        chosen = some.withColumn("turn", F.row_number().over(Window.partitionBy("token").orderBy(*turn, F.xxhash64("leader", F.lit(r)), "leader"))).where(F.col("turn") <= hubs)
        chosen = chosen.select("token", F.col("leader").alias("hub"), F.col("n").alias("m"), F.col("alone").alias("alone2"), F.col("component").alias("d"))
        apart = F.coalesce(F.col("component") != F.col("d"), F.lit(True))
        near = some.join(chosen, "token").where((F.col("leader") != F.col("hub")) & _fits("n", "m", F.col("n") - F.col("alone"), F.col("m") - F.col("alone2"), percent) & apart).select("leader", "hub").distinct()
        pairs = near.join(members, "leader").select(F.col("node").alias("a"), F.col("hub").alias("b"))
        labels = merged(pairs, labels)
        dropped(some)
    # All that is left, group by group.
    rest = written(open_lists(lists.select("token", "leader", "n", "alone", "place")), "open")
    if not rest.isEmpty():
        with_prefix = rest.join(leaders.select("leader", "prefix"), "leader")
        # Before its first common shingle a set has none of the other's: what is left must suffice.
        side = lambda g, i: with_prefix.select("token", F.col("leader").alias(g), F.col("n").alias(f"n{i}"), (F.col("n") - F.col("alone") - F.col("place")).alias(f"left{i}"), F.col("component").alias(f"c{i}"), F.col("prefix").alias(f"p{i}"))
        left, right = side("g", 1), side("h", 2)
        apart = F.coalesce(F.col("c1") != F.col("c2"), F.lit(True))
        both = F.array_intersect("p1", "p2")
        # Common shingles are in both prefixes or behind the one that ends first.
        behind = lambda c: F.ceil(F.col(c) * percent / 100) - 1
        enough = (100 + percent) * (F.size(both) + F.greatest(behind("n1"), behind("n2"))) >= percent * (F.col("n1") + F.col("n2"))
        first = (both[0] == left["token"]) & enough
        near = left.join(right, (left["token"] == right["token"]) & (F.col("g") < F.col("h")) & _fits("n1", "n2", F.col("left1"), F.col("left2"), percent) & apart & first).select("g", "h")
        one, two = members.select(F.col("leader").alias("g"), F.col("node").alias("a")), members.select(F.col("leader").alias("h"), F.col("node").alias("b"))
        labels = merged(near.join(one, "g").join(two, "h").select("a", "b"), labels)
    dropped(rest, lists)
    # Groups whose nodes are still apart: their nodes against each other.
    mixed = of_groups().where(F.col("component").isNull()).select("leader")
    if not mixed.isEmpty():
        own = members.join(mixed, "leader").join(labels, "node")
        a, b = own.select("leader", F.col("node").alias("a"), F.col("component").alias("x")), own.select("leader", F.col("node").alias("b"), F.col("component").alias("y"))
        labels = merged(a.join(b, "leader").where((F.col("a") < F.col("b")) & (F.col("x") != F.col("y"))).select("a", "b"), labels)
    return labels


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    tuned(docs.sparkSession)
    signed, clashing = signatures(docs, words, bits)
    n_shingles = signed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    nodes = shared_shingles(docs, signed, n_shingles, words, percent, clashing=clashing, bits=bits)
    found = links(nodes, percent)
    # Of every node, the smallest doc_id; of every component, the smallest of its nodes'.
    names = signed.where(F.col("n") > 0).groupBy("node").agg(F.min("doc_id").alias("own"))
    known = written(names.join(found.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("node", "own", F.coalesce("component", "node").alias("component")), "names")
    wide = known.groupBy("component").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("nodes")).where(F.col("nodes") > 1)
    named = known.join(wide.select(F.col("component").alias("c"), "least"), F.col("component") == F.col("c"), "left").select(F.col("node").alias("x"), F.coalesce("least", "own").alias("component_id"))
    out = signed.join(named, (F.col("node") == F.col("x")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose doc_id is their component's smallest, with all columns; null doc_ids stay."""
    found = join(docs, words, percent)
    (mine,) = fresh(docs, "__kept")
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(mine)).distinct()
    return docs.join(kept, F.col("doc_id") == F.col(mine), "left").where(F.col("doc_id").isNull() | F.col(mine).isNotNull()).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same from the words themselves, by counting the common shingles of all pairs that have some.
ORACLE = f"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWERED}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
cut AS (SELECT doc_id, unnest(CASE WHEN len(w) >= {WORDS} THEN list_distinct([array_to_string(w[i:i + {WORDS - 1}], ' ') FOR i IN range(1, len(w) - {WORDS - 2})]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM cut GROUP BY ALL),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM cut x JOIN cut y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= {PERCENT} * (s.n + t.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id"""
