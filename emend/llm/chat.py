r"""Chat formatting in budgeted windows.

A conversation becomes one or more windows. Running sums of the turns' tokens choose spans of whole turns that fit the budget; every
window begins with the leading system turns and repeats a limited history. What is repeated is marked and never under the loss mask, so each
assistant text is a target once. A turn of its own that exceeds the budget stays whole in a window that is marked as over.

The template writes `<turn role="...">`, a line break, the text, `</turn>`, a line break. Inside texts a backslash goes before each
backslash, `<turn` and `</turn`, inside roles before each backslash and quote; taking away one backslash before any sign undoes both.
Turns are streamed in order, so a conversation of any length needs no more memory than a window. Tokens are words: a text without blanks is one
token however long it is, so the budget bounds a window's words, not its bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, small_batches

#: Tokens of a window and of its repeated history; tokens that the template adds to a turn's words.
BUDGET, HISTORY, TURN_TOKENS = 1024, 256, 4

_CONTROL = re.compile(r"\\|</?turn")
_ROLE_CONTROL = re.compile(r'[\\"]')
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r'<turn role="((?:[^"\\]|\\.)*+)"( again)?>\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n', re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Turn:
    role: str
    text: str
    tokens: int


@dataclass
class Window:
    """Formatted text, the spans of it (code points) that are targets, and what it holds."""

    parts: list[str] = field(default_factory=list)
    chars: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    new: int = 0
    tokens: int = 0

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def add(self, turn: Turn, again: bool) -> None:
        head = f'<turn role="{_ROLE_CONTROL.sub(r"\\\g<0>", turn.role)}"{" again" if again else ""}>\n'
        body = escape(turn.text)
        at = self.chars + len(head)
        if turn.role == "assistant" and not again and body:
            self.loss.append((at, at + len(body)))
        self.parts.append(f"{head}{body}</turn>\n")
        self.chars += len(self.parts[-1])
        self.tokens += turn.tokens
        self.new += not again


def windows(turns: Iterable[Turn], budget: int = BUDGET, history: int = HISTORY) -> Iterator[Window]:
    """The windows of one conversation, its turns given in order."""
    system: list[Turn] = []
    told = False  # whether a window has shown the system turns
    recent: deque[Turn] = deque()  # what a next window may repeat
    recent_tokens = system_tokens = 0
    now: Window | None = None

    def begin(turn: Turn | None) -> Window:
        nonlocal told
        out = Window()
        for t in system:
            out.add(t, told)
        told = True
        if turn is not None:
            kept, held = [], 0
            for t in reversed(recent):
                if held + t.tokens > history or system_tokens + held + t.tokens + turn.tokens > budget:
                    break
                kept.append(t)
                held += t.tokens
            for t in reversed(kept):
                out.add(t, True)
        return out

    for turn in turns:
        if now is None and not recent and turn.role == "system":
            system.append(turn)
            system_tokens += turn.tokens
            continue
        if now is None:
            now = begin(turn)
        elif now.tokens + turn.tokens > budget:
            yield now
            now = begin(turn)
        now.add(turn, False)
        recent.append(turn)
        recent_tokens += turn.tokens
        while recent and recent_tokens > history:
            recent_tokens -= recent.popleft().tokens
    if now is None and system:
        now = begin(None)
    if now is not None:
        yield now


def read_turns(text: str, loss: list[tuple[int, int]]) -> Iterator[tuple[str, str, bool, str | None]]:
    """(role, text, repeated, text under the loss mask or None) for each turn of a formatted window."""
    at, marked = 0, {a: b for a, b in loss}
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        target = unescape(text[m.start(3) : marked[m.start(3)]]) if m.start(3) in marked else None
        yield unescape(m[1]), unescape(m[3]), m[2] is not None, target
        at = m.end()


def _rows(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _groups(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Rows in the order of their first value, as (value, its rows); null is a value. Each group must be read to its end."""
    from itertools import groupby

    return groupby(rows, key=lambda r: r[0])


_LOSS = "array<struct<start:bigint,end:bigint>>"


def _format(batches, schema: pa.Schema, budget: int, history: int) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[] for _ in schema]
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    for conv, rows in _groups(_rows(batches, ["conv_id", "role", "text", "tokens"])):
        for k, w in enumerate(windows((Turn(*r[1:]) for r in rows), budget, history)):
            for c, v in zip(out, (conv, k, w.text, [{"start": a, "end": b} for a, b in w.loss], w.new, w.tokens, w.tokens > budget), strict=True):
                c.append(v)
            held += w.chars
            if held > 4_000_000:
                yield batch()
                out, held = [[] for _ in schema], 0
    if out[0]:
        yield batch()


def format_chat(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """turns (conv_id, turn, role, text, ...) -> conv_id, window, text, loss, new_turns, tokens, over.

    Null text or role: empty. Null turn: before all others; equal turns: by role, then text. Rows with a null conv_id are one conversation
    without an id. Repeated rows are repeated turns. An empty table gives an empty result. Other columns don't matter.
    """
    small_batches(turns.sparkSession)
    empty = F.lit("")
    rows = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = rows.withColumn("tokens", n_words(F.col("text")) + TURN_TOKENS)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    conv_type = turns.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("conv_id", to_arrow_type(conv_type)), ("window", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pair)), ("new_turns", pa.int64()), ("tokens", pa.int64()), ("over", pa.bool_())])
    return rows.select("conv_id", "role", "text", "tokens").mapInArrow(lambda it: _format(it, schema, budget, history), f"conv_id {conv_type.simpleString()}, window bigint, text string, loss {_LOSS}, new_turns bigint, tokens bigint, over boolean")


def _digests(batches) -> Iterator[pa.RecordBatch]:
    schema = None
    for conv, rows in _groups(_rows(batches, ["conv_id", "text", "loss"])):
        turns, loss, n, chars, formatted = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for _, text, spans in rows:
            formatted += len(text)
            for role, said, again, target in read_turns(text, [(s["start"], s["end"]) for s in spans]):
                if not again:
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if target is not None:
                    chars += len(target)
                    loss.update(target.encode("utf-8", "surrogatepass"))
        one = [conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted]
        yield pa.RecordBatch.from_arrays([pa.array([v]) if v is not None else pa.nulls(1, pa.int64()) for v in one], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame, dealt: bool = False) -> DataFrame:
    """Formatted windows -> for each conversation what they say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    dealt: the windows come straight from format_chat(), a conversation's together and in order, and needn't be dealt again.
    """
    rows = formatted.select("conv_id", "window", "text", "loss")
    if not dealt:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    conv = formatted.schema["conv_id"].dataType.simpleString()
    return rows.select("conv_id", "text", "loss").mapInArrow(_digests, f"conv_id {conv}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: The conversation that the contract adds.
EXTRA = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    from .common import table

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_chat(turns.unionByName(extra)), dealt=True)


OP1_SQL = rf"""
WITH RECURSIVE rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
turns AS (
  SELECT *, row_number() OVER w - 1 AS i, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {TURN_TOKENS} AS tokens,
         23 + len(regexp_replace(role, '[\\"]', '\\\0', 'g')) + len(regexp_replace(text, '\\|</?turn', '\\\0', 'g')) AS chars
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sums AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         coalesce(sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i), 0) = 0 AS head FROM turns),
heads AS (
  SELECT conv_id, count(*) FILTER (WHERE head) AS n_system, coalesce(sum(tokens) FILTER (WHERE head), 0) AS system_tokens,
         coalesce(sum(chars) FILTER (WHERE head), 0) AS system_chars, count(*) AS n FROM sums GROUP BY conv_id),
history AS (
  SELECT a.conv_id, a.i, coalesce(min(b.i), a.i) AS h
  FROM sums a JOIN heads USING (conv_id)
  LEFT JOIN sums b ON a.conv_id = b.conv_id AND b.i < a.i AND NOT b.head AND a.before - b.before <= {HISTORY}
       AND system_tokens + a.before - b.before + a.tokens <= {BUDGET}
  WHERE NOT a.head GROUP BY a.conv_id, a.i),
steps AS (
  SELECT a.conv_id, a.i, a.h, greatest(a.i + 1, coalesce(max(c.i) + 1, 0)) AS j
  FROM history a JOIN heads USING (conv_id) JOIN sums s ON s.conv_id = a.conv_id AND s.i = a.h
  LEFT JOIN sums c ON c.conv_id = a.conv_id AND c.i >= a.i AND system_tokens + c.before + c.tokens - s.before <= {BUDGET}
  GROUP BY a.conv_id, a.i, a.h),
chain AS (
  SELECT conv_id, n_system AS i FROM heads
  UNION ALL SELECT c.conv_id, s.j FROM chain c JOIN steps s ON c.conv_id = s.conv_id AND c.i = s.i),
sizes AS (
  SELECT c.conv_id, c.i, sum(t.chars + CASE WHEN t.i < c.i THEN 6 ELSE 0 END) AS chars
  FROM chain c JOIN steps s ON c.conv_id = s.conv_id AND c.i = s.i
  JOIN turns t ON t.conv_id = c.conv_id AND t.i >= s.h AND t.i < s.j GROUP BY c.conv_id, c.i),
totals AS (
  SELECT h.conv_id, coalesce(sum(z.chars), 0) + greatest(count(z.i), 1) * h.system_chars + greatest(count(z.i) - 1, 0) * 6 * h.n_system AS formatted_chars
  FROM heads h LEFT JOIN sizes z ON h.conv_id = z.conv_id GROUP BY h.conv_id, h.system_chars, h.n_system)
SELECT t.conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       any_value(o.formatted_chars)::BIGINT AS formatted_chars
FROM turns t JOIN totals o ON t.conv_id = o.conv_id GROUP BY t.conv_id
"""
