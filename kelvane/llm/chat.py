"""Chat formatting with a grammar round trip.

A turn is its opening mark, its text and its closing mark. Inside a text, a control string gets one backslash more
before it than it had; the parser takes one away. Each text is first written as it is; the rendered turn is parsed
again, and a text that does not come back identical is escaped and tried again. A conversation is returned only
once the parser recovers exactly its turns.

Edge cases: null roles and texts are empty; turns are ordered by number (null last), then role, then text, so ties
and repeated rows have a fixed order and all stay; a null conv_id is a conversation of its own; an empty table
gives only the query's own conversation; other columns are never read. A conversation is one row of text, so it
must fit in memory; conversations are never held together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table

MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", " </s>"), "system": ("<<SYS>>", " <</SYS>>")}
_CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE:|\[/ROLE\]"
_MARKED = re.compile(rf"(?<!\\)(\\*)({_CONTROL})")  # from the first backslash of a run only: no run is scanned twice
_NAME = re.compile(r"((?:[^\\\]]|\\.)*)\]", re.S)


class NotOfTheGrammar(ValueError):
    """The text is not a rendered conversation."""


def escape(text: str) -> str:
    return _MARKED.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _MARKED.sub(lambda m: m[1][:-1] + m[2], text)


def marks(role: str) -> tuple[str, str]:
    return MARKS.get(role) or ("[ROLE:" + re.sub(r"([\\\]])", r"\\\1", role) + "]", " [/ROLE]")


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the escaped text in ``rendered``."""
    turns, at = [], 0
    while at < len(rendered):
        for role, (open_, close) in MARKS.items():
            if rendered.startswith(open_, at):
                at += len(open_)
                break
        else:
            if not rendered.startswith("[ROLE:", at) or not (m := _NAME.match(rendered, at + 6)):
                raise NotOfTheGrammar(f"no turn begins at {at}")
            role, close, at = re.sub(r"\\(.)", r"\1", m[1], flags=re.S), " [/ROLE]", m.end()
        end = next((m for m in _MARKED.finditer(rendered, at) if not m[1]), None)
        if end is None or not rendered.startswith(close, end.start() - 1) or end.start() - 1 < at:
            raise NotOfTheGrammar(f"the turn that begins at {at} is not closed")
        turns.append((role, unescape(rendered[at : end.start() - 1]), at, end.start() - 1))
        at = end.end()
    return turns


def render_turn(role: str, text: str) -> str:
    """The turn as text that parses back to it."""
    open_, close = marks(role)
    for body in (text, escape(text)):
        rendered = open_ + body + close
        try:
            if [t[:2] for t in parse(rendered)] == [(role, text)]:
                return rendered
        except NotOfTheGrammar:
            pass
    raise NotOfTheGrammar(f"no form of this text comes back: {text[:80]!r}")


def render(turns: list[tuple[str, str]]) -> str:
    rendered = "".join(render_turn(role, text) for role, text in turns)
    if [t[:2] for t in parse(rendered)] != turns:
        raise NotOfTheGrammar("the conversation does not come back")
    return rendered


def _ordered(turns: list[dict]) -> list[tuple[str, str]]:
    rows = [(t["turn"] is None, t["turn"] or 0, t["role"] or "", t["text"] or "") for t in turns]
    return [r[2:] for r in sorted(rows)]


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (start and end code points of each assistant text) of each conversation."""
    rows = turns.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                texts = [render(_ordered(t)) for t in batch.column(1).to_pylist()]
                spans = [[{"start": a, "end": b} for role, _, a, b in parse(t) if role == "assistant"] for t in texts]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], names=["conv_id", "formatted", "loss_spans"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind}, formatted string, loss_spans array<struct<start: long, end: long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: counts and hashes of turns and of texts under the loss mask."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns, loss = parse(text), "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{role}\n{body}\n" for role, body, _, _ in turns)
                out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


HARD = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(turns.unionByName(extra)))


ORACLE = rf"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{HARD}'), (-7, 1, 'assistant', '{HARD}')
), sized AS (
  SELECT *, length(regexp_replace(text, '(\\*(?:{_CONTROL}))', '\\\1', 'g'))
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 8 WHEN 'system' THEN 16
      ELSE 15 + length(regexp_replace(role, '([\\\]])', '\\\1', 'g')) END AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
