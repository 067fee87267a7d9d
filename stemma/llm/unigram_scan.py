"""SentencePiece encoding and decoding by a max-plus parallel scan.

The best segmentation of a text maximises the sum of its pieces' scores, a shortest-path problem over (max, +). A text
is cut into chunks of `CHUNK` characters. A boundary's state is how far the piece that crosses it reaches into the next
chunk, so a chunk is a matrix of best scores from states to states. Matrices combine associatively: `FAN` neighbours
at a time, level by level, until a text has `FAN` of them at most, so a text of any length is many small tasks and a
logarithm of levels. Walking down again gives the best score of every state at every boundary. A second such scan, of
the maps from a chunk's last state to its first, gives the state that the best path takes there, and then every chunk
is backtraced independently of the others. Texts of one chunk need no scan.

Inside a chunk the lattice falls apart wherever a blank follows another character, for no piece has a blank there; the
segmentations of these words are kept in a bounded cache of the worker. Words that aren't there yet are segmented
together, by the same recursion over all words of one length at once.

Scores are whole numbers or rounded to `GRAIN`, so that sums are exact and don't depend on where chunks end. Among
equally good segmentations the one whose last differing piece is longest wins. The result is the exact optimum, which
the library's n-best search puts first for a model of type unigram with the same pieces and scores. A vocabulary of
type BPE is read as such a model: its scores, the negative ranks of merges, are summed; the library itself would merge
greedily instead.

Unknown characters become byte pieces where the vocabulary has them, else the unknown piece. Decoding turns pieces
into text, drops the blank put before the text and gives the text back exactly, but for the blank symbol itself, which
comes back as a blank, and unknown characters without byte pieces. Null and empty texts have no pieces. Repeated rows
each get their result; rows with one doc_id and different texts are texts of their own. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HELD, batches, release, strings, table, tuned, written
from .token_counts import model_path, pre_tokens

BLANK = "▁"
CHUNK = 1 << 15
#: Neighbouring chunks, or blocks of them, that are combined at once.
FAN = 8
GRAIN = 1 / (1 << 20)
CACHE_SIZE = 200_000
LONGEST_CACHED = 48
#: Words that are segmented at once, at most; fewer are segmented one by one. Characters whose words meet for that.
LEARNED, FEW, LEARNED_CHARS = 8192, 8, 1_000_000
#: The blank in the tables for characters of one byte, of which it takes one's place.
BLANK_CODE = 127
#: Characters that the tables have a column for; words with others are segmented one by one.
COLUMNS = 127
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
#: What the library takes off the worst score for an unknown character.
UNKNOWN_PENALTY = 10.0
NONE = float("-inf")
_BREAK = re.compile(f"[^{BLANK}]{BLANK}")


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (b[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if b[i - 1] < 128:
                return out, i

    i = 0
    while i < len(b):
        key, i = varint(i)
        if key & 7 == 0:
            v, i = varint(i)
        else:
            n, i = varint(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            v, i = b[i : i + n], i + n
        yield key >> 3, v


class Words(dict):
    """Word without its first blank -> ids; two generations, of which the older goes when the newer one is full."""

    def __init__(self, segment, size: int):
        super().__init__()
        self.segment, self.size, self.older = segment, size // 2, {}

    def forget(self) -> None:
        self.older = {}
        self.clear()

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.segment(BLANK + (key.replace(" ", BLANK) if " " in key else key))
        if len(key) <= LONGEST_CACHED:
            self.put(key, got)
        return got

    def put(self, key: str, got: bytes) -> None:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = got


class Vocabulary:
    """Pieces of a model file, for segmenting and for decoding."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        prefix, squeezed = True, False
        for key, v in _fields(model):
            if key == 1:
                f = dict(_fields(v))
                self.pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif key == 3:
                f = dict(_fields(v))
                prefix, squeezed = bool(f.get(3, 1)), bool(f.get(4, 1)) or bool(f.get(2, b""))
        if squeezed or not prefix:
            raise ValueError("only models that keep texts as they are, with a blank put before them, are supported")
        normal = [(p, s) for p, s, t in self.pieces if t == NORMAL]
        if any(t == USER_DEFINED for *_, t in self.pieces) or any(BLANK in p.lstrip(BLANK) for p, _ in normal):
            raise ValueError("pieces of the user's own, or with a blank behind another character, aren't supported")
        self.reach = max(len(p) for p, _ in normal)
        self.ids = {p: k for k, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        self.scores = {p: round(s / GRAIN) * GRAIN for p, s in normal}
        #: The pieces as a tree: character -> (what may follow, the score where a piece ends here, its id).
        self.tree: dict = {}
        for p, score in self.scores.items():
            node = self.tree
            for c in p[:-1]:
                node = node.setdefault(c, ({}, NONE, -1))[0]
            node[p[-1]] = (node[p[-1]][0] if p[-1] in node else {}, score, self.ids[p])
        self.unknown_score = round((min(s for _, s in normal) - UNKNOWN_PENALTY) / GRAIN) * GRAIN
        self.unknown = next(k for k, (*_, t) in enumerate(self.pieces) if t == UNKNOWN)
        self.bytes = {int(p[1:-1], 16): k for k, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.raw = [bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(BLANK, " ").encode() for p, _, t in self.pieces]
        # What a piece adds to a path's score; of an unknown character's bytes, the first one has it all.
        self.worth = np.array([self.unknown_score if t == UNKNOWN or t == BYTE and not 0x80 <= int(p[1:-1], 16) < 0xC0 else 0.0 if t == BYTE else self.scores.get(p, 0.0) for p, _, t in self.pieces])
        self.words = Words(self.segment, CACHE_SIZE)
        self._dense()

    def found(self, piece: str) -> list[int]:
        """Ids of one character that no piece is."""
        return [self.bytes[c] for c in piece.encode()] if len(self.bytes) == 256 else [self.unknown]

    def forward(self, s: str, first: list[float], last: int) -> tuple[list[float], list[int]]:
        """Best scores up to each place of s and where the last piece begins; first: scores of the first places.

        Pieces begin before place `last` only.
        """
        n, tree, reach, unknown = len(s), self.tree, self.reach, self.unknown_score
        best = first + [NONE] * (n + 1 - len(first))
        back = [-1] * (n + 1)
        for i in range(min(last, n)):
            b = best[i]
            if b == NONE:
                continue
            node, j = tree, i
            for c in s[i : i + reach]:
                x = node.get(c)
                if x is None:
                    break
                j += 1
                node, score, _ = x
                score += b
                if score > best[j]:
                    best[j], back[j] = score, i
            x = tree.get(s[i])
            if (x is None or x[1] == NONE) and (score := b + unknown) > best[i + 1]:
                best[i + 1], back[i + 1] = score, i
        return best, back

    def trace(self, s: str, back: list[int], end: int) -> list[int]:
        """The ids of the path to `end`."""
        out, get = [], self.ids.get
        while (a := back[end]) >= 0:
            k = get(s[a:end])
            if k is None:
                out += self.found(s[a:end])[::-1]
            else:
                out.append(k)
            end = a
        out.reverse()
        return out

    def segment(self, w: str) -> bytes:
        """The ids of a word that begins and ends at breaks of the lattice: `forward` and `trace` in one."""
        n, tree, reach = len(w), self.tree, self.reach
        best, back, ids = [0.0] + [NONE] * n, [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            b, node, j = best[i], tree, i
            if b == NONE:
                continue
            for c in w[i : i + reach]:
                x = node.get(c)
                if x is None:
                    break
                j += 1
                node, score, k = x
                score += b
                if score > best[j]:
                    best[j], back[j], ids[j] = score, i, k
            x = tree.get(w[i])
            if (x is None or x[2] < 0) and (score := b + self.unknown_score) > best[i + 1]:
                best[i + 1], back[i + 1], ids[i + 1] = score, i, -1
        out = []
        while n:
            i, k = back[n], ids[n]
            if k < 0:
                out += self.found(w[i])[::-1]
            else:
                out.append(k)
            n = i
        out.reverse()
        return array("i", out).tobytes()

    def _dense(self) -> None:
        """The tree below characters of one byte and the blank as tables by state; state 0 is none, 1 the root."""
        at = {BLANK: BLANK_CODE} | {chr(c): c for c in range(256) if c != BLANK_CODE}
        scores, ids, rows, moves, todo = [NONE, NONE], [-1, -1], [0, 1], [], [(1, self.tree)]
        for row, node in todo:
            for c, (below, score, k) in node.items():
                if c in at:
                    moves.append((row, at[c], len(ids)))
                    scores.append(score)
                    ids.append(k)
                    # States that nothing follows share the row of state 0.
                    rows.append(len(todo) + 1 if below else 0)
                    if below:
                        todo.append((len(todo) + 1, below))
        self.state_rows, self.state_scores, self.state_ids = np.array(rows, np.int32), np.array(scores), np.array(ids, np.int32)
        moves = np.array(moves)
        # The characters that most pieces have; those that none has share column 0, which leads nowhere.
        self.columns, seen = np.zeros(256, np.uint8), np.bincount(moves[:, 1], minlength=256)
        seen[BLANK_CODE] = len(moves)
        used = np.argsort(-seen, kind="stable")[: min(COLUMNS, np.count_nonzero(seen))]
        self.columns[used] = np.arange(1, len(used) + 1)
        self.next_states = np.zeros((len(todo) + 1, len(used) + 1), np.int32)
        moves = moves[self.columns[moves[:, 1]] > 0]
        self.next_states[moves[:, 0], self.columns[moves[:, 1]]] = moves[:, 2]
        #: Characters that these tables have: their pieces, or one byte.
        self.plain = {chr(c) for c in range(256) if c != BLANK_CODE and (self.columns[c] or not seen[c]) and (c < 128 or chr(c) in self.ids)}
        self.char_ids = np.array([self.bytes.get(c, self.unknown) if len(self.bytes) == 256 else self.unknown for c in range(256)], np.int32)

    def segment_all(self, words: list[str]) -> list[bytes]:
        """`segment` of words of characters in `plain`, all of one length."""
        n, w = len(words[0]) + 1, len(words)
        chars = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(w, n - 1)
        chars = np.concatenate([np.full((1, w), BLANK_CODE, np.uint8), np.where(chars == 32, BLANK_CODE, chars).T])
        moves = self.columns[chars]
        best, back, ids = np.full((n + 1, w), NONE), np.zeros((n + 1, w), np.int32), np.full((n + 1, w), -1, np.int32)
        best[0] = 0.0
        for i in range(n):
            some, state = None, np.ones(w, np.int32)
            for j in range(i + 1, min(n, i + self.reach) + 1):
                c = moves[j - 1] if some is None else moves[j - 1][some]
                state = self.next_states[self.state_rows[state], c]
                if j == i + 1:
                    alone = np.flatnonzero(self.state_ids[state] < 0)
                    score = best[i][alone] + self.unknown_score
                    better = score > best[j][alone]
                    alone = alone[better]
                    best[j, alone], back[j, alone], ids[j, alone] = score[better], i, -1
                on = np.flatnonzero(state)
                if not len(on):
                    break
                some, state = on if some is None else some[on], state[on]
                score = best[i][some] + self.state_scores[state]
                better = score > best[j][some]
                found = some[better]
                best[j, found], back[j, found], ids[j, found] = score[better], i, self.state_ids[state[better]]
        # Back from the end, ids to the right.
        out, first, pos, some = np.zeros((w, n), np.int32), np.full(w, n), np.full(w, n), np.arange(w)
        while len(some):
            at = pos[some]
            k, begin = ids[at, some], back[at, some]
            first[some] -= 1
            out[some, first[some]] = np.where(k < 0, self.char_ids[chars[begin, some]], k)
            pos[some] = begin
            some = some[begin > 0]
        raw = out.tobytes()
        return [raw[4 * (i * n + a) : 4 * n * (i + 1)] for i, a in enumerate(first.tolist())]

    def learn(self, words: set[str]) -> None:
        """Put words, each without its first blank, into the cache, where it has none of them."""
        of_length: dict[int, list[str]] = {}
        for x in words:
            if x not in self.words and x not in self.words.older and len(x) <= LONGEST_CACHED and self.plain.issuperset(x):
                of_length.setdefault(len(x), []).append(x)
        for n, some in of_length.items():
            for a in range(0, len(some), LEARNED):
                part = some[a : a + LEARNED]
                if len(part) < FEW or not n:
                    continue  # these go one by one
                for x, ids in zip(part, self.segment_all(part), strict=True):
                    self.words.put(x, ids)

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts."""
        out, a = [], 0
        while a < len(texts):
            size, b = 0, a
            while b < len(texts) and (b == a or size < LEARNED_CHARS):
                size, b = size + len(texts[b]), b + 1
            found = [pre_tokens(t) for t in texts[a:b]]
            self.learn(set().union(*found))
            out += [self.merged(b"".join(map(self.words.__getitem__, x))) for x in found]
            a = b
        return out

    def merged(self, ids: bytes) -> bytes:
        """ids, with neighbouring unknown characters as one unknown piece."""
        if len(self.bytes) == 256:
            return ids
        x = np.frombuffer(ids, np.int32)
        return x[np.concatenate([np.ones(min(1, len(x)), bool), (x[1:] != self.unknown) | (x[:-1] != self.unknown)])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        text = b"".join([raw[k] for k in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def prepared(text: str) -> str:
    return BLANK + text.replace(" ", BLANK) if text else ""


class Chunk:
    """Characters [a, b) of a prepared text, with what pieces that begin there can reach behind b.

    `before` is the character in front of a ("" at the text's begin).
    """

    def __init__(self, v: Vocabulary, s: str, size: int, before: str):
        self.v, self.s, self.size = v, s, size
        opens = s[:1] == BLANK and before != BLANK or not before
        # Between the first and the last break, words stand for themselves.
        first = 0 if opens else m.start() + 1 if (m := _BREAK.search(s, 0, size)) else -1
        last = size
        while (last := s.rfind(BLANK, 0, last)) > 0 and s[last - 1] == BLANK:
            pass
        self.low, self.high = first, max(first, last)

    @cached_property
    def middle(self) -> bytes:
        """The ids of the words between the breaks, whatever the states are."""
        words = pre_tokens(self.s[self.low + 1 : self.high]) or [""] if self.high > self.low else []
        self.v.learn(set(words))
        return b"".join(map(self.v.words.__getitem__, words))

    def _head(self, first: list[float]) -> tuple[list[float], list[int]]:
        """Up to the first break; up to b where there is none."""
        if self.low < 0:
            return self.v.forward(self.s, first[: len(self.s) + 1], self.size)
        return self.v.forward(self.s[: self.low], first[: self.low + 1], self.low) if self.low else (first[:1], [-1])

    def _tail(self) -> tuple[list[float], list[int]]:
        """From the last break."""
        return self.v.forward(self.s[self.high :], [0.0], self.size - self.high)

    def states(self) -> int:
        return self.v.reach

    def matrix(self) -> np.ndarray:
        """Best score from each state at a to each state at b."""
        k = self.states()
        out = np.full((k, k), NONE)
        if self.low >= 0:
            behind = np.array(self._tail()[0][self.size - self.high :][:k]) + self.v.worth[np.frombuffer(self.middle, np.int32)].sum()
        for i in range(min(k, len(self.s) + 1)):
            first = [NONE] * k
            first[i] = 0.0
            if i > self.size:
                out[i, i - self.size] = 0.0
            elif self.low < 0:
                scores = self._head(first)[0][self.size :][:k]
                out[i, : len(scores)] = scores
            elif i <= self.low:
                out[i, : len(behind)] = self._head(first)[0][self.low] + behind
        return out

    def through(self, first: list[float]) -> list[int]:
        """Given the best scores of states at a: the state at a of the best path to each state at b; -1 if none."""
        k = self.states()
        best, back = self._head(first)

        def begin(at: int) -> int:
            if at >= len(best) or best[at] == NONE:
                return -1
            while back[at] >= 0:
                at = back[at]
            return at

        return [begin(self.size + o) for o in range(k)] if self.low < 0 else [begin(self.low)] * k

    def ids(self, first: list[float], out: int) -> bytes:
        """The ids of the best path that reaches state `out` at b."""
        v, s, back = self.v, self.s, self._head(first)[1]
        if self.low < 0:
            return array("i", v.trace(s, back, self.size + out)).tobytes()
        head = v.trace(s[: self.low], back, self.low) if self.low else []
        tail = v.trace(s[self.high :], self._tail()[1], self.size - self.high + out)
        return array("i", head).tobytes() + self.middle + array("i", tail).tobytes()


def cut(s: str, reach: int, size: int = CHUNK) -> list[tuple[str, int, str]]:
    """(characters with those that pieces may reach behind, size, character before) of each chunk."""
    return [(s[a : a + size + reach - 1], min(size, len(s) - a), s[a - 1 : a] if a else "") for a in range(0, len(s), size)]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def product(matrices: list[bytes]) -> bytes:
    """The max-plus product of neighbours, in order, pair by pair."""
    k = math.isqrt(len(matrices[0]) // 8)
    held = [np.frombuffer(m).reshape(k, k) for m in matrices]
    while len(held) > 1:
        held = [combine(*held[i : i + 2]) if i + 1 < len(held) else held[i] for i in range(0, len(held), 2)]
    return held[0].tobytes()


def walk(at: bytes, matrices: list[bytes]) -> list[bytes]:
    """Best scores of the states at the begin of each of a few neighbours, from those at the first one's."""
    best, out = np.frombuffer(at), []
    for m in matrices:
        out.append(best.tobytes())
        best = (best[:, None] + np.frombuffer(m).reshape(len(best), -1)).max(axis=0)
    return out


def map_product(maps: list[bytes]) -> bytes:
    """The map from the last one's states to the first one's; -1 stands for no state."""
    to = np.frombuffer(maps[-1], np.int32)
    for m in maps[-2::-1]:
        to = np.where(to < 0, to, np.frombuffer(m, np.int32)[to])
    return to.astype(np.int32).tobytes()


def walk_back(at: bytes, maps: list[bytes]) -> list[bytes]:
    """The state at the end of each of a few neighbours, from that at the last one's."""
    out, state = [b""] * len(maps), int(np.frombuffer(at, np.int32)[0])
    for k in range(len(maps) - 1, -1, -1):
        out[k] = np.array([state], np.int32).tobytes()
        state = int(np.frombuffer(maps[k], np.int32)[state])
    return out


def sweep(items: DataFrame, most: int, combined: Callable[[list[bytes]], bytes], walked: Callable[[bytes, list[bytes]], list[bytes]], start: bytes, fan: int = FAN) -> DataFrame:
    """__row, no, at: the state at every item; items: a written table of __row, no, m, at most `most` for each __row.

    combined is associative. walked gives the states at a few neighbours from that of their block; `start` is a row's.
    """

    def up(key: Any, frame: Any) -> Any:
        return type(frame)({"__row": [key[0]], "no": [key[1]], "m": [combined(list(frame.sort_values("no")["m"]))]})

    def down(key: Any, frame: Any) -> Any:
        frame = frame.sort_values("no")
        return frame[["__row", "no"]].assign(at=walked(frame["at"].iloc[0], list(frame["m"])))

    block = F.floor(F.col("no") / fan).alias("block")
    levels = [items]
    while most > fan:
        most = -(-most // fan)
        levels.append(written(levels[-1].select("__row", "no", "m", block).groupBy("__row", "block").applyInPandas(up, "__row bigint, no bigint, m binary"), "scan"))
    at = levels[-1].select("__row", F.lit(0).cast("long").alias("block"), "no", "m", F.lit(start).alias("at"))
    for below in [*levels[-2::-1], None]:
        at = at.groupBy("__row", "block").applyInPandas(down, "__row bigint, no bigint, at binary")
        if below is not None:
            at = below.select("__row", block, "no", "m").join(at.select("__row", F.col("no").alias("block"), "at"), ["__row", "block"])
    return at


_held: dict[str, Vocabulary] = {}
HELD.append(_held)


def vocabulary(model: bytes) -> Vocabulary:
    key = hashlib.md5(model).hexdigest()
    if key not in _held:
        _held.clear()
        _held[key] = Vocabulary(model)
    return _held[key]


def encode_whole(v: Vocabulary, text: str) -> bytes:
    return b"".join(map(v.words.__getitem__, pre_tokens(text)))


def encode(docs: DataFrame, model: bytes, carried: list[str], chunk: int = CHUNK, decoded: bool = False) -> DataFrame:
    """The carried columns and `ids`, the pieces of each row's text as 4-byte whole numbers, lowest byte first.

    decoded adds `decoded`, the text that the ids stand for, where one worker does both.
    """
    spark = tuned(docs.sparkSession)
    reach = vocabulary(model).reach
    release()  # the driver needs no more of it
    shared = spark.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    given = docs.select(*(F.col(f"`{c}`") for c in carried), F.coalesce("text", F.lit("")).alias("__text"))
    keys = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in carried)
    n = len(carried)
    out_names, out_types = [*carried, "ids", *["decoded"] * decoded], f"{keys}, ids binary" + ", decoded string" * decoded

    def small(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for b in batches(rows):
            ids = v.encode_texts(strings(b.column(n)))
            back = [pa.array([v.decode(np.frombuffer(x, np.int32)) for x in ids], pa.string())] * decoded
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(ids, pa.binary()), *back], names=out_names)
        v.words.forget()
        release(_held)

    # A text of one chunk is encoded where it is; one character more stands for the blank put before it.
    whole = given.where(F.length("__text") < chunk).mapInArrow(small, out_types)
    giant = given.where(F.length("__text") >= chunk)

    def pieces(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(b.num_rows):
                text = b.column(n + 1)[i].as_py()
                for a in range(0, (parts := cut(prepared(text), reach, chunk)) and len(parts), 64):
                    some = parts[a : a + 64]
                    held = [pa.array([b.column(k)[i].as_py()] * len(some), b.column(k).type) for k in range(n + 1)]
                    yield pa.RecordBatch.from_arrays([*held, pa.array(range(a, a + len(some)), pa.int64()), pa.array([s for s, *_ in some], pa.string()), pa.array([z for _, z, _ in some], pa.int32()), pa.array([c for *_, c in some], pa.string())], names=[*carried, "__row", "no", "s", "size", "before"])

    of_row = giant.select(*(F.col(f"`{c}`") for c in carried), F.monotonically_increasing_id().alias("__row"), "__text")
    chunks = written(of_row.mapInArrow(pieces, f"{keys}, __row bigint, no bigint, s string, size int, before string").repartition("__row", "no"), "chunks")
    bare = chunks.select("__row", "no", "s", "size", "before")

    def matrices(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for b in batches(rows):
            held = [Chunk(v, s, z, c) for s, z, c in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            got = [c.matrix().tobytes() for c in held]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary()), pa.array([c.middle for c in held], pa.binary())], names=["__row", "no", "m", "middle"])
        v.words.forget()
        release(_held)

    # A chunk's matrix is a small part of the chunk, so a text's matrices are far smaller than the text.
    most = chunks.agg(F.max("no") + 1).first()[0]
    if most is None:
        return whole
    begin = np.full(reach, NONE)
    begin[0] = 0.0
    held = written(bare.mapInArrow(matrices, "__row bigint, no bigint, m binary, middle binary"), "matrices")
    first = written(sweep(held, most, product, walk, begin.tobytes()).withColumnRenamed("at", "m"), "first")
    joined = bare.join(first, ["__row", "no"]).select("__row", "no", "s", "size", "before", "m")

    def maps(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for b in batches(rows):
            got = [Chunk(v, s, z, c).through(np.frombuffer(m).tolist()) for s, z, c, m in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.array(x, np.int32).tobytes() for x in got], pa.binary())], names=["__row", "no", "m"])

    back = written(joined.mapInArrow(maps, "__row bigint, no bigint, m binary"), "maps")
    ends = sweep(back, most, map_product, walk_back, np.zeros(1, np.int32).tobytes()).withColumnRenamed("at", "state")

    def traced(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for b in batches(rows):
            got = []
            for s, z, c, m, o, middle in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5, 6, 7)), strict=True):
                chunk = Chunk(v, s, z, c)
                chunk.middle = middle
                got.append(chunk.ids(np.frombuffer(m).tolist(), int(np.frombuffer(o, np.int32)[0])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())], names=["__row", "no", "part"])

    parts = joined.join(ends, ["__row", "no"]).join(held.select("__row", "no", "middle"), ["__row", "no"]).mapInArrow(traced, "__row bigint, no bigint, part binary")

    def put(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for b in batches(rows):
            got = [v.merged(b"".join(p["part"] for p in x)) for x in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(got, pa.binary())], names=[*carried, "ids"])

    whole_parts = parts.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("no", "part"))).alias("__parts")).withColumnRenamed("__row", "__r")
    long = chunks.where(F.col("no") == 0).select(*(F.col(f"`{c}`") for c in carried), "__row").join(whole_parts, F.col("__row") == F.col("__r"))
    long = long.select(*(F.col(f"`{c}`") for c in carried), "__parts").mapInArrow(put, f"{keys}, ids binary")
    if decoded:
        long = decode(long.withColumn("pieces", F.col("ids")), model, [*carried, "pieces"]).select(*(F.col(f"`{c}`") for c in carried), F.col("pieces").alias("ids"), F.col("text").alias("decoded"))
    return whole.unionByName(long)


def decode(encoded: DataFrame, model: bytes, carried: list[str]) -> DataFrame:
    """The carried columns of encoded and `text`, decoded from `ids`."""
    shared = tuned(encoded.sparkSession).sparkContext.broadcast(model)
    n = len(carried)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for b in batches(rows):
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array([v.decode(np.frombuffer(x, np.int32)) for x in b.column(n).to_pylist()], pa.string())], names=[*carried, "text"])

    kinds = {f.name: f.dataType for f in encoded.schema.fields}
    keys = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in carried)
    return encoded.select(*(F.col(f"`{c}`") for c in carried), "ids").mapInArrow(run, f"{keys}, text string")


def op2_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(model_path(), "rb") as f:
        model = f.read()
    docs = table(spark, sf_dir, "documents").withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    back = encode(docs, model, ["doc_id", "n_bytes", "text_sha256"], decoded=True).withColumn("decoded_sha256", F.sha2("decoded", 256))
    return back.select("doc_id", "n_bytes", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256", (F.col("decoded_sha256") == F.col("text_sha256")).alias("round_trip"))
