"""Chat formatting by incremental black-box rendering.

A template is any callable that takes the turns so far, a list of {"role", "text"}, and returns a
string. Nothing is known of its inside: the prefixes of a conversation (none, one turn, two ...) are
rendered one after another, and each output is compared with the one before.

An ending that stays behind whatever is added (a closing tag, a prompt for the next answer) is learned
first: it is the longest ending that all the outputs share, the one for no turns included. Without it,
what an output adds to the one before is the new turn's span. If the old output isn't the beginning of
the new one, the template rewrites history; the earliest turn whose span is touched is named.

The comparison can't always tell where the trailer begins: if it and the turns begin alike, a cut some
characters later fits all outputs as well. The longest trailer is taken, which keeps a turn's own
opening with the turn, and `ambiguous` says that another cut would fit. Where the template can't
render no turns at all, the shortest trailer that keeps history is taken instead, since the longest would
take the turns' common ending.

Defined cases
* null role or text: rendered as ''. Null turn: comes last. Null conv_id: belongs to no conversation, left out.
* repeated rows: each is a turn; the order is by turn, role, text.
* a template that raises for a prefix, or returns no string: that turn has no span, and `error` says why; the next
  turn that renders is compared with the last output, so its span holds both turns, marked ambiguous.
* empty text: a turn like others. Very long texts: whole; two outputs are held at a time. Empty table: no rows.
* extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read_table

Turn = dict[str, str]
Template = Callable[[list[Turn]], str]
SCHEMA = "template string, conv_id long, place int, turn long, role string, span_start int, span_end int, rewrites boolean, rewritten_from int, piece string, ambiguous boolean, error string"


def chatml(turns: list[Turn]) -> str:
    return "".join(f"<|im_start|>{t['role']}\n{t['text']}<|im_end|>\n" for t in turns)


def enclosed(turns: list[Turn]) -> str:
    """An ending that stays behind whatever is added."""
    return "<s>" + "".join(f"[{t['role']}] {t['text']}\n" for t in turns) + "</s>"


def latest_answer(turns: list[Turn]) -> str:
    """Keeps the text of an assistant's turn only while it is the last: rewrites history."""
    last = len(turns) - 1
    return "".join(f"<{t['role']}>{t['text'] if i == last or t['role'] != 'assistant' else '...'}\n" for i, t in enumerate(turns))


def prompted(turns: list[Turn]) -> str:
    """Asks for the next answer at the end: a trailer that begins as the turns do."""
    return chatml(turns) + "<|im_start|>assistant\n"


TEMPLATES: dict[str, Template] = {"chatml": chatml, "enclosed": enclosed, "latest_answer": latest_answer, "prompted": prompted}


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _ending(a: str, b: str) -> int:
    """Length of the common ending."""
    return _common(a[::-1], b[::-1])


def _rendered(template: Template, turns: list[Turn]) -> tuple[str | None, str | None]:
    """(output, error)."""
    try:
        out = template(turns)
    except Exception as e:  # the template is foreign code
        return None, f"{type(e).__name__}: {e}"
    return (out, None) if isinstance(out, str) else (None, f"returned {type(out).__name__}")


def _trailer(turns: list[Turn], template: Template) -> tuple[int, bool]:
    """(length of the trailer, would another one fit?)."""
    none, _ = _rendered(template, [])
    if none == "" or (none is None and len(turns) < 2):
        return 0, False
    last, ending, least = none, none, 0
    for i in range(len(turns)):
        now, _ = _rendered(template, turns[: i + 1])
        if now is None:
            continue
        if last is not None:
            ending = now if ending is None else ending
            ending = ending[len(ending) - _ending(ending, now) :]
            kept = _common(last, now)
            if len(last) - kept <= len(ending):  # else it rewrites history, which says nothing of a trailer
                least = max(least, len(last) - kept)
        else:
            ending = now
        last = now
    most = len(ending or "")
    least = min(least, most)
    return (most if none is not None else least), least < most


class Span(NamedTuple):
    """A turn's place in the rendering of the turns up to it; rewrites: adding it changed what stood there, from the turn at place rewritten_from on."""

    start: int | None
    end: int | None
    rewrites: bool | None
    rewritten_from: int | None
    piece: str | None
    ambiguous: bool
    error: str | None


def locate(turns: list[Turn], template: Template) -> list[Span]:
    """The span of each turn."""
    trailer, ambiguous = _trailer(turns, template)
    out: list[Span] = []
    before, _ = _rendered(template, [])
    before, ends = "" if before is None else before[: len(before) - trailer], []  # where each turn ends in what came before; a rewritten one ends where the change begins
    skipped = False
    for i in range(len(turns)):
        now, error = _rendered(template, turns[: i + 1])
        if now is None:
            out.append(Span(None, None, None, None, None, ambiguous, error))
            skipped = True
            continue
        now = now[: len(now) - trailer]
        same = _common(before, now)
        rewrites, touched = same < len(before), None
        if rewrites:
            touched = next((k for k, e in enumerate(ends) if e > same), i)
            ends = [min(e, same) for e in ends]
        ends += [len(now)] * (i + 1 - len(ends))
        out.append(Span(same, len(now), rewrites, touched, now[same:], ambiguous or skipped, None))
        before, skipped = now, False
    return out


def _renderer(templates: dict[str, Template]):
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, told in zip(b.column(0).to_pylist(), b.column(1)):
                told = told.as_py()
                turns = [{"role": t["role"], "text": t["text"]} for t in told]
                for name, template in templates.items():
                    rows += [(name, conv, i, told[i]["turn"], told[i]["role"], *s) for i, s in enumerate(locate(turns, template))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=names)

    return render


def format_chats(conversations: DataFrame, templates: dict[str, Template] | None = None) -> DataFrame:
    """One row per conversation, template and turn; the pieces of a template that keeps history, joined by place, are the whole text (but for a trailer)."""
    told = F.struct(F.col("turn").isNull().alias("late"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(told)).alias("told"))
    return whole.select(F.col("conv_id").cast("long"), "told").mapInArrow(lean(_renderer(templates or TEMPLATES)), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every turn of every conversation in each template."""
    return format_chats(read_table(spark, sf_dir, "conversations"))


#: An old answer is rewritten from its first character that isn't the dots' - here texts don't begin with dots.
SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS a,
         '[' || role || '] ' || text || chr(10) AS b,
         '<' || role || '>' || text || chr(10) AS d,
         length('<' || role || '>' || CASE WHEN role = 'assistant' THEN '...' ELSE text END || chr(10)) AS kept,
         lag(role) OVER w AS before_role, lag(text) OVER w AS before_text
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
s AS (
  SELECT *, coalesce(sum(length(a)) OVER w, 0) AS a0, coalesce(sum(length(b)) OVER w, 0) AS b0, coalesce(sum(kept) OVER w, 0) AS d0
  FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, coalesce(before_role = 'assistant' AND before_text <> '', false) AS again FROM s),
u AS (
  SELECT 'chatml' AS template, conv_id, place, turn, role, a0 AS x, a0 + length(a) AS y, false AS rewrites, CAST(NULL AS BIGINT) AS f, a AS piece FROM t
  UNION ALL
  SELECT 'enclosed', conv_id, place, turn, role, 3 + b0, 3 + b0 + length(b), false, NULL, b FROM t
  UNION ALL
  SELECT 'prompted', conv_id, place, turn, role, a0, a0 + length(a), false, NULL, a FROM t
  UNION ALL
  SELECT 'latest_answer', conv_id, place, turn, role, CASE WHEN again THEN d0 - 4 ELSE d0 END, d0 + length(d), again,
         CASE WHEN again THEN place - 1 END, CASE WHEN again THEN '...' || chr(10) ELSE '' END || d FROM t)
SELECT template, conv_id, CAST(place AS INTEGER) AS place, turn, role, CAST(x AS INTEGER) AS span_start, CAST(y AS INTEGER) AS span_end, rewrites,
       CAST(f AS INTEGER) AS rewritten_from, piece, template = 'prompted' AS ambiguous, CAST(NULL AS VARCHAR) AS error FROM u"""
