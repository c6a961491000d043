"""Chat formatting with a grammar round trip.

A conversation is `<s>` and its turns: user turns `[INST]...[/INST]`, assistant turns
`[OUT]...</s>`, system turns `[SYS]...[/SYS]`, others `[ROLE:name]...[/ROLE]`. A text is put
in as it is, its rendered turn is parsed again, and where the parsed turn is not the source the
text is escaped one level further until it is: a backslash is put after the first character of
every control string, bare or escaped before, and the parser takes one away. No
control string begins within another, so what holds for a turn holds for turns put together.

Turns are rendered row by row; only the digests, which by nature follow the order of turns, read a
conversation's turns in sequence, one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN = "<s>"
#: Opening and closing marks by role.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER_OPEN, OTHER_CLOSE = "[ROLE:", "[/ROLE]"
LOSS_ROLE = "assistant"

#: A control string, or one with backslashes after its first character.
_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|OUT\]|/?SYS\]|ROLE:|/ROLE\])")
_OPENING = re.compile(r"\[(?:INST\]|OUT\]|SYS\]|ROLE:(?P<role>[^\]]*)\])")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    """Takes one backslash out of every escaped control string."""
    return _CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def _role_out(role: str) -> str:
    return role.replace("%", "%25").replace("]", "%5D")


def _role_in(role: str) -> str:
    return role.replace("%5D", "]").replace("%25", "%")


def _may_open(text: str) -> bool:
    """Whether an opening mark may begin with this text."""
    return any(o.startswith(text) for o in (*(o for o, _ in MARKS.values()), OTHER_OPEN)) or (text.startswith(OTHER_OPEN) and "]" not in text)


class Parser:
    """Deterministic parser that is fed the output piece by piece and yields (role, text, rendered text) for each turn that ends."""

    def __init__(self) -> None:
        self.rest, self.begun = "", False

    def feed(self, piece: str) -> Iterator[tuple[str, str, str]]:
        self.rest += piece
        at = 0
        if not self.begun:
            if BEGIN.startswith(self.rest) and self.rest != BEGIN:
                return
            if not self.rest.startswith(BEGIN):
                raise ValueError(f"no {BEGIN} at the beginning")
            self.begun, at = True, len(BEGIN)
        while at < len(self.rest):
            m = _OPENING.match(self.rest, at)
            if not m:
                if _may_open(self.rest[at:]):
                    break
                raise ValueError(f"no turn begins at {self.rest[at : at + 20]!r}")
            role = next((r for r, (o, _) in MARKS.items() if o == m[0]), None)
            close = MARKS[role][1] if role else OTHER_CLOSE
            end = self.rest.find(close, m.end())
            if end < 0:
                break
            text = self.rest[m.end() : end]
            yield role or _role_in(m["role"]), unescape(text), text
            at = end + len(close)
        self.rest = self.rest[at:]


def render_turn(role: str, text: str) -> tuple[str, int]:
    """The turn's part of the output, and the level of escaping at which it reads back as the source."""
    opening, close = MARKS.get(role) or (f"{OTHER_OPEN}{_role_out(role)}]", OTHER_CLOSE)
    inner = text
    for level in range(2):
        out = f"{opening}{inner}{close}"
        try:
            parser = Parser()
            if [x[:2] for x in parser.feed(BEGIN + out)] == [(role, text)] and not parser.rest:
                return out, level
        except ValueError:
            pass
        inner = escape(text)
    raise AssertionError(f"not reversible: {text[:40]!r}")


_SEGMENTS = "conv_id long, turn long, role string, source string, segment string, level int, loss_from long, loss_to long"


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, texts = ([x or "" for x in batch.column(k).to_pylist()] for k in (2, 3))
        done = [render_turn(r, t) for r, t in zip(roles, texts, strict=True)]
        opens = [len((MARKS.get(r) or (f"{OTHER_OPEN}{_role_out(r)}]", ""))[0]) for r in roles]
        closes = [len((MARKS.get(r) or ("", OTHER_CLOSE))[1]) for r in roles]
        loss = [r == LOSS_ROLE for r in roles]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int32()), pa.array([o if yes else None for o, yes in zip(opens, loss, strict=True)], pa.int64()), pa.array([len(x[0]) - c if yes else None for x, c, yes in zip(done, closes, loss, strict=True)], pa.int64())],
            ["conv_id", "turn", "role", "source", "segment", "level", "loss_from", "loss_to"],
        )


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """Rendered turns of `conversations` (conv_id, turn, role, text): conv_id, turn, role, source, segment, level of escaping, and the loss mask's span in the segment.

    A conversation's output is `<s>` and its segments in order of (turn, role, source), nulls first. Null texts and roles
    are empty; empty texts make turns too. Turns of one number are put in that order; repeated rows make
    repeated turns. Rows of a null conv_id make one conversation. Other columns are ignored; an empty table gives an empty result.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_render, _SEGMENTS)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([n], pa.int64()), pa.array([turns.hexdigest()]), pa.array([loss_chars], pa.int64()), pa.array([loss.hexdigest()]), pa.array([chars], pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    conv: int | None = None
    begun = False
    encoded = lambda s: s.encode("utf-8", "surrogatepass")
    for batch in batches:
        for c, segment in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not begun or c != conv:
                if begun:
                    yield row()
                conv, begun, n, loss_chars, chars = c, True, 0, 0, len(BEGIN)
                turns, loss, parser = hashlib.sha256(), hashlib.sha256(), Parser()
                list(parser.feed(BEGIN))
            piece = segment.as_py()
            chars += len(piece)
            for role, text, _ in parser.feed(piece):
                n += 1
                turns.update(encoded(f"{role}\n{text}\n"))
                if role == LOSS_ROLE:
                    loss_chars += len(text)
                    loss.update(encoded(text))
            if parser.rest:
                raise ValueError(f"conversation {conv}: a turn does not end with its segment")
    if begun:
        yield row()


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation of formatted_turns(): the turns read back from the output, their hash, the text under the loss mask and its hash, and the output's length."""
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "source")
    return dealt.select("conv_id", "segment").mapInArrow(_digest, _DIGESTS)


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id and the whole formatted text of each conversation of formatted_turns(), for conversations that fit in a row."""
    order = F.array_sort(F.collect_list(F.struct("turn", "role", "source", "segment")))
    return turns.groupBy("conv_id").agg(order.alias("_t")).select("conv_id", F.concat(F.lit(BEGIN), F.array_join(F.col("_t.segment"), "")).alias("formatted"))


#: The same digests in DuckDB SQL over `conversations`, with the conversation of control strings.
DIGESTS_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|OUT\]|/?SYS\]|ROLE:|/ROLE\])', '\1\\\2\3', 'g')) +
    CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 WHEN 'system' THEN 11
    ELSE 14 + length(replace(replace(role, '%', '%25'), ']', '%5D')) END AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
