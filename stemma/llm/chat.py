"""Chat formatting by prefix-target expansion.

`format_turns` renders each turn between the template's marks, with the control strings inside its role and text
escaped reversibly, and gives its character range in the formatted conversation: a distributed prefix sum, first inside
ranges of the ordered turns, then over these, so that no conversation has to fit one task.

`expand` turns every assistant turn into an example of its own. Its context is the conversation's formatted prefix,
kept as the range [0, context_end) instead of a copy, because copies grow with the square of a conversation's
length; its loss span covers only its reply's text. `examples` writes all examples out as whole texts, contexts
included, for callers that want the copies; `render` does so for one in plain Python.

`digests` reads conversations back: the turns from the formatted ones, all about losses from the examples, which it
writes out with their contexts on the way, or from those of `expand`.

Turns are ordered by turn (nulls first), then role, then text; rows that repeat are turns of their own. A null
conv_id is a conversation like any other; a null role or text is an empty one. A conversation without an assistant
turn has turns but no example. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARROW_ROWS, BATCH_BYTES, before, batches, table

# The strings that chat templates give a meaning to.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
#: Before and behind a turn's text; %s is the role.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
ASSISTANT = "assistant"
OWN_CONVERSATION = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\([\\n]?)")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)" + MIDDLE + r"(.*?)" + re.escape(CLOSE), re.S)


def escape(text: str) -> str:
    """A backslash becomes two; in a control string one goes behind the first character."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    """Roles go into a line of their own: a line break becomes a backslash and an n, which no other escape makes."""
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def _escaped(c):
    """The same in Spark's own expressions."""
    out = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        out = F.replace(out, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}"))
    return out


def _role(c):
    return F.replace(_escaped(c), F.lit("\n"), F.lit("\\n"))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place, role, formatted, begin, loss_begin, loss_end, end; character ranges in the conversation.

    The loss range is null but for an assistant's turn.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Equal turns are told apart by their numbers, so that a range never has to hold all of them.
    t = t.withColumn("formatted", F.concat(F.lit(OPEN), _role("role"), F.lit(MIDDLE), _escaped("text"), F.lit(CLOSE))).withColumn("row", F.monotonically_increasing_id())
    t = before(t, ["turn", "role", "text", "row"], ["conv_id"], "turns", begin=F.char_length("formatted").cast("long"), place=F.lit(1).cast("long"))
    begin, chars, trained = F.col("begin"), F.char_length("formatted"), F.col("role") == ASSISTANT
    head, tail = F.char_length(F.concat(F.lit(OPEN), _role("role"), F.lit(MIDDLE))), len(CLOSE)
    return t.select(
        "conv_id", "place", "role", "formatted", "begin",
        F.when(trained, begin + head).alias("loss_begin"), F.when(trained, begin + chars - tail).alias("loss_end"), (begin + chars).alias("end"),
    )


def expand(formatted: DataFrame) -> DataFrame:
    """An example for every assistant turn: its context is the range [0, context_end) of the conversation."""
    return formatted.where(F.col("loss_begin").isNotNull()).select("conv_id", F.col("place").alias("target_place"), F.col("begin").alias("context_end"), "loss_begin", "loss_end", F.col("end").alias("example_end"), F.col("formatted").alias("target"))


def examples(formatted: DataFrame) -> DataFrame:
    """conv_id, target_place, text, loss_begin, loss_end: every example with its whole context.

    A conversation goes through one task, which holds its formatted text; what it gives grows with its square.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prefix = None, []
        for b in batches(rows):
            convs = b.column(0)
            for i, (conv, place, text, low, high) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if now != (conv,):
                    now, prefix = (conv,), []
                prefix.append(text)
                if low is not None:
                    prefix = ["".join(prefix)]
                    yield pa.RecordBatch.from_arrays([convs.slice(i, 1), pa.array([place], pa.int64()), pa.array(prefix, pa.string()), pa.array([low], pa.int64()), pa.array([high], pa.int64())], names=["conv_id", "target_place", "text", "loss_begin", "loss_end"])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.select("conv_id", "place", "formatted", "loss_begin", "loss_end").mapInArrow(run, f"conv_id {kind}, target_place bigint, text string, loss_begin bigint, loss_end bigint")


def render(turns: list[tuple[str, str]], target: int) -> tuple[str, list[tuple[int, int]]]:
    """The text of one example and its loss spans: turns up to the target-th, of which only that one is trained."""
    parts = [f"{OPEN}{escape_role(r)}{MIDDLE}{escape(x)}{CLOSE}" for r, x in turns[: target + 1]]
    end = sum(map(len, parts))
    return "".join(parts), [(end - len(CLOSE) - len(escape(turns[target][1])), end - len(CLOSE))]


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns read back from formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _written_out(formatted: DataFrame) -> DataFrame:
    """conv_id, text, begin, low, high: every formatted turn, and behind an assistant's its example with the whole context.

    Examples have their loss span, turns none. A conversation goes through one task, in order; its examples aren't
    shuffled, so they take no disk. The task holds the conversation's text and `BATCH_BYTES` characters of rows, or a row.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prefix, out, chars = None, [], [], 0

        def packed() -> pa.RecordBatch:
            kinds = (conv_type, pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["conv_id", "text", "begin", "low", "high"])

        for b in batches(rows):
            conv_type = b.column(0).type
            for conv, text, begin, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != (conv,):
                    now, prefix = (conv,), []
                prefix.append(text)
                out.append((conv, text, begin, None, None))
                if low is not None:
                    prefix = ["".join(prefix)]
                    out.append((conv, prefix[0], 0, low, high))
                    chars += len(prefix[0])
                chars += len(text)
                if chars >= BATCH_BYTES or len(out) >= ARROW_ROWS:
                    yield packed()
                    out, chars = [], 0
        if out:
            yield packed()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.select("conv_id", "formatted", "begin", "loss_begin", "loss_end").mapInArrow(run, f"conv_id {kind}, text string, begin bigint, low bigint, high bigint")


DIGEST = "n_turns bigint, turns_sha256 string, n_examples bigint, loss_chars bigint, loss_sha256 string, formatted_chars bigint, expanded_chars bigint"


def digests(formatted: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """A row for each conversation, read back from its formatted turns and from its examples.

    Without `expanded`, examples are written out with their whole contexts and read from there. Those of `expand`, if
    given, have ranges instead. The hashes run over a conversation's turns in order, so one task reads it, row by row:
    of a conversation, only the state of its hashes is held here, never its turns.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def done() -> None:
            if state:
                n, turns, examples, chars, loss, end, total = state
                out.append((now[0], n, turns.hexdigest(), examples, chars, loss.hexdigest(), end, total))

        for b in batches(rows):
            for conv, text, begin, low, high in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if now != (conv,):
                    done()
                    now, state = (conv,), [0, hashlib.sha256(), 0, 0, hashlib.sha256(), 0, 0]
                if low is None:  # a turn
                    ((role, said),) = parse(text)
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                    state[5] = begin + len(text)
                else:  # an example: its target, and the loss span in the whole of it
                    trained = unescape(text[low - begin : high - begin])
                    state[2] += 1
                    state[3] += len(trained)
                    state[4].update(trained.encode())
                    state[6] += begin + len(text)
            if len(out) >= 1000:
                yield packed(out)
                out.clear()
        done()
        yield packed(out)

    names = ["conv_id", *(x.split()[0] for x in DIGEST.split(", "))]
    conv_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)

    schema = f"conv_id {kind}, {DIGEST}"
    if expanded is None:
        return _written_out(formatted).mapInArrow(run, schema)
    none = F.lit(None).cast("long")
    turns = formatted.select("conv_id", "place", F.col("formatted").alias("text"), "begin", none.alias("low"), none.alias("high"))
    targets = expanded.select("conv_id", F.col("target_place").alias("place"), F.col("target").alias("text"), F.col("context_end").alias("begin"), F.col("loss_begin").alias("low"), F.col("loss_end").alias("high"))
    ordered = turns.unionByName(targets).repartition("conv_id").sortWithinPartitions("conv_id", "place", "low")
    return ordered.select("conv_id", "text", "begin", "low", "high").mapInArrow(run, schema)


def op8_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame(OWN_CONVERSATION, turns.schema)
    formatted = format_turns(turns.unionByName(own))
    return digests(formatted)


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_ROLE_SQL, _TEXT_SQL, _MARKS = _escaped_sql("role"), _escaped_sql("text"), len(OPEN + MIDDLE + CLOSE)
#: The same from plain strings: what the formatted turns and the examples must give back.
ORACLE = f"""
WITH own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (SELECT *, length(replace({_ROLE_SQL}, chr(10), '\\n')) + length({_TEXT_SQL}) + {_MARKS} AS chars FROM own),
placed AS (
  SELECT *, sum(chars) OVER w AS upto, row_number() OVER w AS place FROM sized
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  (count(*) FILTER (role = '{ASSISTANT}'))::BIGINT AS n_examples, coalesce(sum(length(text)) FILTER (role = '{ASSISTANT}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = '{ASSISTANT}'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, coalesce(sum(upto) FILTER (role = '{ASSISTANT}'), 0)::BIGINT AS expanded_chars
FROM placed GROUP BY conv_id"""
