"""Chat formatting: conversations become training text with a loss mask, by a compiled template.

Turns are dealt by conversation and sorted; each task streams its rows through the template's closures (see ``templates``), so neither a conversation
nor a group is ever held whole. A conversation's text comes in parts, which end between turns once they have ``part_chars`` characters; most have one.
A part has the spans of its text that are learned, as code points.

The default template marks every turn and lets the model learn the assistant's texts. Control strings inside roles and texts are broken up by a
backslash after their first character, and backslashes are doubled, so that a formatted text reads back to exactly the turns that went in.

Null roles and texts are empty. Turns with equal numbers are ordered by role, then text; null turns come first. Repeated rows are repeated turns. Rows with
a null conversation id make one conversation of that id. A conversation of one row is formatted like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.templates import TURN, compile_template

# Control strings of the default template and of other common ones; fixed values.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = "{% for m in messages %}<|{{ m.role | escape }}|>{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</s>\n{% endfor %}"
PART_CHARS = 1 << 20

_SPECIAL = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_TURN = re.compile(r"<\|((?:[^|]|\|(?!>))*)\|>(.*?)</s>\n", re.S)


def escape(text: str) -> str:
    """The text without control strings, from which :func:`unescape` makes it again."""
    return _SPECIAL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\\\|\\", lambda m: "\\" if len(m[0]) == 2 else "", text)


FILTERS = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a text made by the default template; fails on any other."""
    at = 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        at = m.end()
        yield unescape(m[1]), unescape(m[2])
    if at != len(formatted):
        raise ValueError(f"not a formatted conversation from character {at}")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in ("id", "role", "text")), strict=True)


_PARTS = pa.schema([("part", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])


def _render(template: str, part_chars: int):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        pieces_of = compile_template(template, FILTERS)
        for key, rows in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            texts, spans, size, part = [], [], 0, 0
            for text, learned in pieces_of({"messages": ({"role": r[1] or "", "text": r[2] or ""} for r in rows)}):
                if learned is None:
                    if size >= part_chars:
                        yield key, part, "".join(texts), spans
                        texts, spans, size, part = [], [], 0, part + 1
                    continue
                if learned:
                    spans.append([size, size + len(text)])
                texts.append(text)
                size += len(text)
            if size or not part:
                yield key, part, "".join(texts), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kind = first.schema.field("id").type
        made = parts(itertools.chain([first], batches))
        while chunk := list(_upto(made, part_chars)):
            key, part, text, spans = zip(*chunk, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, kind), pa.array(part, pa.int64()), pa.array(text, pa.string()), pa.array(spans, _PARTS.field("spans").type)], names=["id", *_PARTS.names])

    return run


def _upto(rows: Iterator[tuple], chars: int) -> Iterator[tuple]:
    total = 0
    for row in rows:
        yield row
        total += len(row[2])
        if total >= chars:
            return


def format_conversations(turns: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """``part`` after part of each conversation: its id, ``formatted`` and ``spans``, in order within a partition."""
    named = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    dealt = named.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    return dealt.mapInArrow(_render(template, part_chars), f"id {kind}, part bigint, formatted string, spans array<array<bigint>>").withColumnRenamed("id", id_col)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = None

    def rows() -> Iterator[tuple]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("id").type
            yield from zip(*(batch.column(n).to_pylist() for n in ("id", "formatted", "spans")), strict=True)

    def digests() -> Iterator[tuple]:
        for key, parts in itertools.groupby(rows(), key=lambda r: r[0]):
            turns, learned, n, loss, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, formatted, spans in parts:
                for role, text in read_back(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for start, end in spans:
                    text = unescape(formatted[start:end])
                    learned.update(text.encode())
                    loss += len(text)
                chars += len(formatted)
            yield key, n, turns.hexdigest(), loss, learned.hexdigest(), chars

    found = digests()
    while chunk := list(itertools.islice(found, 5000)):
        key, n, turns, loss, learned, chars = zip(*chunk, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(key, kind), pa.array(n, pa.int64()), pa.array(turns), pa.array(loss, pa.int64()), pa.array(learned), pa.array(chars, pa.int64())], names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What reads back from the output of :func:`format_conversations` with the default template, one row per conversation."""
    named = formatted.withColumnRenamed(id_col, "id")
    kind = named.schema["id"].dataType.simpleString()
    return named.mapInArrow(_digest, f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").withColumnRenamed("id", id_col)
