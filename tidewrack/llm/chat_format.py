"""Chat formatting: conversations rendered by a compiled template, with the spans to learn from, and read back.

The rows of a conversation are brought together and sorted by Spark, and stream
through the template one by one; formatted text leaves in parts, cut between
messages, once it is long enough. So a conversation of very many rows is never
held as a whole: only the sort, which spills, and one part. Nearly every
conversation is one part. A conversation is written by one task, as it is one
text in one order.

Texts can say anything, the template's control strings too: its guard breaks
these reversibly. Reading back finds turns by control strings alone.

Defined results: a null text is empty, a null role an empty one; rows without
order come first; rows of equal order are sorted by role, then text. A null
conversation id is a conversation. Roles that the template doesn't name are
written out. No rows give no conversations. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import id_field
from .template import Guard, Template

PART_CHARS = 1 << 20
#: What stands before and behind the text of a turn, by role.
TURNS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>")}
#: Before the name of another role, between it and its text, and behind that.
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
CONTROLS = [x.strip() for x in (*(y for pair in TURNS.values() for y in pair), *OTHER)]
TEMPLATE = """
{%- for m in messages -%}
{%- if m.role == 'assistant' -%} {{ a0 }}{% generation %}{{ m.text | guard }}{% endgeneration %}{{ a1 }}
{%- elif m.role == 'user' -%} {{ u0 }}{{ m.text | guard }}{{ u1 }}
{%- elif m.role == 'system' -%} {{ s0 }}{{ m.text | guard }}{{ s1 }}
{%- else -%} {{ o0 }}{{ m.role | guard }}{{ o1 }}{{ m.text | guard }}{{ o2 }}
{%- endif -%}
{%- endfor -%}
"""
CONSTANTS = {k[0] + str(i): x for k, pair in TURNS.items() for i, x in enumerate(pair)} | {f"o{i}": x for i, x in enumerate(OTHER)}


def template() -> Template:
    """The one that read() reads."""
    return Template(TEMPLATE, CONSTANTS, CONTROLS)


def read(text: str, guard: Guard) -> Iterator[tuple[str, str, int, int]]:
    """role, text, start and end of the guarded text, for each turn of a part."""
    opening = {before.strip(): (role, before, behind) for role, (before, behind) in TURNS.items()}
    marks = [(m.start(), m.end(), m[0]) for m in guard.pattern.finditer(text)]
    i = at = 0
    while i < len(marks):
        start, end, mark = marks[i]
        if start != at:
            raise ValueError(f"there is text between turns at {at}")
        if mark == OTHER[0]:
            named = [m for _, _, m in marks[i : i + 3]] == list(OTHER)
            role, begin, behind = guard.unescape(text[end : marks[i + 1][0]]) if named else "", marks[min(i + 1, len(marks) - 1)][1], OTHER[2]
            i += 1
        elif mark in opening:
            role, before, behind = opening[mark]
            begin, named = start + len(before), True
        else:
            named = False
        close = marks[i + 1] if i + 1 < len(marks) else (0, 0, "")
        if not named or close[2] != behind.strip():
            raise ValueError(f"a turn at {start} isn't closed")
        stop = close[1] - len(behind)
        yield role, guard.unescape(text[begin:stop]), begin, stop
        at, i = close[1], i + 2
    if at != len(text):
        raise ValueError(f"there is text behind the last turn at {at}")


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str], step: int = 256) -> Iterator[tuple]:
    """The rows of sorted batches, few of them as Python values at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def _batched(rows: Iterable[tuple], to: pa.Schema, weight: int, most: int = 1 << 21, count: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as batches with about most characters in the column numbered weight."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or "")
        if size >= most or len(held) >= count:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), to, strict=True)], schema=to)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), to, strict=True)], schema=to)


def format_parts(
    rows: DataFrame, source: str = TEMPLATE, constants: dict | None = None, controls: list[str] | None = None,
    id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text", part_chars: int = PART_CHARS,
) -> DataFrame:
    """conv_id, part (from 0), last, n_turns, text and spans (start, end in the part's code points): the formatted conversations, the parts of each together and in order.

    A template that doesn't compile raises TemplateError here, not in a task.
    """
    given = (source, CONSTANTS if constants is None else constants, CONTROLS if controls is None else controls)
    Template(*given)
    long = T.LongType()
    schema = T.StructType([id_field(rows, id_col, "conv_id"), T.StructField("part", long), T.StructField("last", T.BooleanType()), T.StructField("n_turns", long), T.StructField("text", T.StringType()), T.StructField("spans", _SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        compiled = Template(*given)

        def parts() -> Iterator[tuple]:
            for conv, turns in groupby(_rows(batches, ["conv_id", "role", "text"]), key=lambda r: r[0]):
                messages = ({"role": role, "text": text} for _, role, text in turns)
                for k, p in enumerate(compiled.stream(messages, part_chars)):
                    yield conv, k, p.last, p.turns, p.text, [{"start": a, "end": b} for a, b in p.spans]

        yield from _batched(parts(), to_arrow_schema(schema), 4)

    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = rows.select(F.col(id_col).alias("conv_id"), F.col(order_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    return d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(run, schema)


def read_back(parts: DataFrame) -> DataFrame:
    """conv_id, turn (from 0), role, text, learnt: the turns that the parts of format_parts() say; learnt is the text under the spans, else null."""
    schema = T.StructType([parts.schema["conv_id"], T.StructField("turn", T.LongType()), *(T.StructField(x, T.StringType()) for x in ("role", "text", "learnt"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        guard = Guard(CONTROLS)

        def turns() -> Iterator[tuple]:
            for conv, mine in groupby(_rows(batches, ["conv_id", "text", "spans"], 8), key=lambda r: r[0]):
                n = 0
                for _, text, spans in mine:
                    learnt = {s["start"]: guard.unescape(text[s["start"] : s["end"]]) for s in spans}
                    for role, said, start, _ in read(text, guard):
                        yield conv, n, role, said, learnt.get(start)
                        n += 1

        yield from _batched(turns(), to_arrow_schema(schema), 3)

    return parts.mapInArrow(run, schema)


def digests(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of the parts of format_parts(), read back from their texts and spans alone."""
    names = {"n_turns": T.LongType(), "turns_sha256": T.StringType(), "loss_chars": T.LongType(), "loss_sha256": T.StringType(), "formatted_chars": T.LongType()}
    schema = T.StructType([parts.schema["conv_id"], *(T.StructField(k, x) for k, x in names.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        guard = Guard(CONTROLS)

        def sums() -> Iterator[tuple]:
            for conv, mine in groupby(_rows(batches, ["conv_id", "text", "spans"], 8), key=lambda r: r[0]):
                n = chars = learnt = 0
                of_turns, of_loss = hashlib.sha256(), hashlib.sha256()
                for _, text, spans in mine:
                    chars += len(text)
                    for role, said, _, _ in read(text, guard):
                        n += 1
                        of_turns.update(f"{role}\n{said}\n".encode())
                    for s in spans:
                        said = guard.unescape(text[s["start"] : s["end"]])
                        learnt += len(said)
                        of_loss.update(said.encode())
                yield conv, n, of_turns.hexdigest(), learnt, of_loss.hexdigest(), chars

        yield from _batched(sums(), to_arrow_schema(schema), 2)

    return parts.mapInArrow(run, schema)
