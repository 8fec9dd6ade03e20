"""Chat formatting by incremental black-box rendering.

A template is any object with ``render(turns) -> str``. A conversation is rendered for each prefix of its turns; where the
output for k turns extends the output for k - 1, the added text is the span of turn k. Where it doesn't, the template
rewrites history: the conversation is flagged and the span starts at the first character that changed. Inside a span, the
text of a turn is located by rendering the same prefix with a one-character sentinel as its last text. Nothing else is
assumed about the template; ``escape``, ``unescape`` and ``parse`` are used only to read results back.

Rows of a conversation meet by a shuffle on its id and are streamed in order, so no group is collected by Spark; a Python
worker holds one conversation at a time. Rendering every prefix costs time in proportion to the square of a single
conversation's length, which any black-box template implies.

Defined cases: rows go by turn, null turns first, ties by role, then text, repeated rows kept; null roles and texts are
empty; a row with a null conv_id is a conversation of its own; very long texts are rendered whole; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.storage import in_small_batches

Turn = tuple[str, str]
OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "<|end|>\n"
SCHEMA = (
    "conv_id bigint, n_turns bigint, formatted string, turn_spans array<struct<start:bigint,end:bigint>>, "
    "loss_spans array<struct<start:bigint,end:bigint>>, rewrites_history boolean"
)
#: Characters of formatted text gathered before a batch goes back to Spark.
CHARS_PER_BATCH = 8_000_000


class MarkedTemplate:
    """Marks each turn's start, text and end; escapes backslashes and ``<|`` inside roles and texts."""

    def escape(self, text: str) -> str:
        return text.replace("\\", "\\\\").replace("<|", "<\\|")

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def render(self, turns: list[Turn]) -> str:
        return "".join(f"{OPEN}{self.escape(role)}{BODY}{self.escape(text)}{CLOSE}" for role, text in turns)

    def parse(self, formatted: str) -> list[Turn]:
        """The turns of a rendered conversation."""
        found = re.findall(f"{re.escape(OPEN)}(.*?){re.escape(BODY)}(.*?){re.escape(CLOSE)}", formatted, flags=re.S)
        return [(self.unescape(role), self.unescape(text)) for role, text in found]


@dataclass
class Rendered:
    """A formatted conversation: spans of each turn and of each text under the loss mask, in code points."""

    formatted: str
    turn_spans: list[tuple[int, int]]
    loss_spans: list[tuple[int, int]]
    rewrites_history: bool


def _shared_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _text_span(template, turns: list[Turn], before: str, after: str, start: int) -> tuple[int, int]:
    """Where the last turn's text, as rendered, is in after; an empty span at its place if it is not rendered."""
    role, text = turns[-1]
    sentinel = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in before and c not in role and c not in after)
    marked = template.render([*turns[:-1], (role, sentinel)])
    at = marked.rfind(sentinel)
    if at < start:
        return start, start
    return at, max(at, len(after) - (len(marked) - at - 1))


def render_incrementally(template, turns: list[Turn], loss_roles: tuple[str, ...] = ("assistant",)) -> Rendered:
    """Render turn prefixes in succession and locate each turn by comparing consecutive outputs."""
    before, spans, loss, rewrites = template.render([]), [], [], False
    for k in range(1, len(turns) + 1):
        after = template.render(turns[:k])
        start = len(before)
        if not after.startswith(before):
            rewrites, start = True, _shared_prefix(before, after)
        spans.append((start, len(after)))
        if turns[k - 1][0] in loss_roles:
            loss.append(_text_span(template, turns[:k], before, after, start))
        before = after
    if rewrites:  # earlier spans refer to outputs that no longer exist
        spans = [(min(a, len(before)), min(b, len(before))) for a, b in spans]
        loss = [(min(a, len(before)), min(b, len(before))) for a, b in loss]
    return Rendered(before, spans, loss, rewrites)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """(conv_id, turns) of rows sorted by conversation; each row with a null conv_id is a conversation of its own."""
    current, turns, started = None, [], False
    for batch in batches:
        ids, roles, texts = (batch.column(k).to_pylist() for k in range(3))
        for conv, role, text in zip(ids, roles, texts, strict=True):
            if started and (conv != current or conv is None):
                yield current, turns
                turns = []
            current, started = conv, True
            turns.append((role or "", text or ""))
    if started:
        yield current, turns


def format_chats(conversations: DataFrame, template=None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: formatted text, turn spans, loss spans, and whether the template rewrites history."""
    template = template or MarkedTemplate()

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.string(), span, span, pa.bool_()]
        names = ["conv_id", "n_turns", "formatted", "turn_spans", "loss_spans", "rewrites_history"]
        rows, waiting = [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for conv, turns in _conversations(batches):
            r = render_incrementally(template, turns, loss_roles)
            dicts = [[{"start": a, "end": b} for a, b in spans] for spans in (r.turn_spans, r.loss_spans)]
            rows.append((conv, len(turns), r.formatted, *dicts, r.rewrites_history))
            waiting += len(r.formatted)
            if waiting >= CHARS_PER_BATCH or len(rows) >= 5000:
                yield packed()
                rows, waiting = [], 0
        if rows:
            yield packed()

    rows = in_small_batches(conversations).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"), F.col("turn").cast("bigint").alias("turn"),
    )
    apart = F.when(F.col("conv_id").isNull(), F.xxhash64("role", "text", "turn"))  # rows without a conversation are spread
    return rows.repartition("conv_id", apart).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(render, SCHEMA)


def chat_digests(formatted: DataFrame, template=None) -> DataFrame:
    """Digest columns read back from the output of format_chats alone."""
    template = template or MarkedTemplate()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                turns = template.parse(row["formatted"])
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = "".join(template.unescape(row["formatted"][s["start"] : s["end"]]) for s in row["loss_spans"])
                digest = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (said, loss)]
                out.append((row["conv_id"], len(turns), digest[0], len(loss), digest[1], len(row["formatted"])))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


#: The conversation that the query adds: both texts hold control strings of common templates.
PLANTED_ID, PLANTED_TEXT = -7, "\\### Assistant: </turn> ok"

ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS n FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
