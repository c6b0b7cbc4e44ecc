"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text. For each turn the conversation
is rendered with and without it; what the longer output adds is the turn's
span. Rendering the turn once more with an empty text shows where inside the
span the text stands. A template whose output for a prefix is not the
beginning of the next output rewrites history: such conversations are marked
and get no mask.

Texts are escaped before rendering so that no control string is left in them,
and can be restored. A turn is rendered after all turns before it, so a
conversation's cost grows with the square of its turns: nothing less tells what
a black box does with a long prefix.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import common

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
START, STOP = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(STOP) + "\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def chatml(turns: list[Turn]) -> str:
    """Turns between control strings, one after the other."""
    return "".join(f"{START}{role}\n{text}{STOP}\n" for role, text in turns)


def escape(text: str) -> str:
    """Without control strings or, in a role, line ends: a backslash marks what was changed."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def parse(formatted: str) -> list[Turn]:
    """The turns of a chatml output, unescaped."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


class Rewritten(ValueError):
    """The template's output for a prefix is not the beginning of the next output."""


def text_place(span: str, bare: str, text: str) -> int:
    """Where the text stands in its turn's span, given the span of an empty text."""
    n = len(text)
    if len(span) != len(bare) + n:
        raise Rewritten("a text changes more than its own place")
    for at in range(len(bare) + 1):
        if span.startswith(text, at) and span.startswith(bare[:at]) and span[at + n :] == bare[at:]:
            return at
    raise Rewritten("a text is not in its span as it is")


def render(turns: list[Turn], template: Template = chatml) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The output for escaped turns and per turn (start, end, text start, text end), in code points."""
    out, at, places = [], 0, []
    before = template([])
    out.append(before)
    at = len(before)
    for k, (role, text) in enumerate(turns):
        context = turns[:k]
        now = template([*context, (role, text)])
        if not now.startswith(before):
            raise Rewritten(f"turn {k} changes what was before it")
        bare = template([*context, (role, "")])
        if not bare.startswith(before):
            raise Rewritten(f"turn {k} changes what was before it")
        span = now[len(before) :]
        place = at + text_place(span, bare[len(before) :], text)
        places.append((at, at + len(span), place, place + len(text)))
        out.append(span)
        at += len(span)
        before = now
    return "".join(out), places


_FORMATTED = "conv long, formatted string, turns array<struct<role:string,start:int,end:int,text_start:int,text_end:int,loss:boolean>>, rewritten boolean"
_TURN_TYPE = pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("loss", pa.bool_())])
_SCHEMA = pa.schema([("conv", pa.int64()), ("formatted", pa.string()), ("turns", pa.list_(_TURN_TYPE)), ("rewritten", pa.bool_())])


def _format(template: Template, learned: frozenset[str]):
    def one(conv, turns: list[Turn]) -> dict:
        safe = [(escape_role(r), escape(t)) for r, t in turns]
        try:
            formatted, places = render(safe, template)
        except Rewritten:
            return {"conv": conv, "formatted": template(safe), "turns": [], "rewritten": True}
        marks = [{"role": r, "start": a, "end": b, "text_start": c, "text_end": d, "loss": r in learned} for (r, _), (a, b, c, d) in zip(turns, places, strict=True)]
        return {"conv": conv, "formatted": formatted, "turns": marks, "rewritten": False}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, out, have, begun = None, [], [], 0, False
        for batch in batches:
            for key, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if begun and key != conv:
                    out.append(one(conv, turns))
                    have += len(out[-1]["formatted"])
                    turns = []
                    if have > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
                        out, have = [], 0
                conv, begun = key, True
                turns.append((role or "", text or ""))
        if begun:
            out.append(one(conv, turns))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return run


def format_conversations(conversations: DataFrame, template: Template = chatml, learned: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, formatted, turns, rewritten) of every conversation.

    ``turns`` has each turn's role, span and text span in code points, and
    whether its text is under the loss mask (roles in ``learned``).

    Rows go by turn; ties by role, then text; null turns first. Null roles and
    texts are empty. Rows with a null conversation id form one conversation.
    Repeated rows are turns of their own. Other columns, of any name, are ignored; an empty
    table gives an empty result. Rows are dealt by conversation and sorted, so
    a task holds one conversation at a time: the output is one text each.
    """
    spark = conversations.sparkSession
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.col(turn_col).alias("turn"))
    dealt = rows.repartition(common.partitions(spark), "conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    return dealt.mapInArrow(_format(template, frozenset(learned)), _FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the outputs hold: turns by parsing, learned texts by the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            out = []
            for conv, text, turns in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = parse(text)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in found).encode())
                loss = "".join(unescape(text[t["text_start"] : t["text_end"]]) for t in turns if t["loss"])
                out.append((conv, len(found), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if out:
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    schema = "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv", "formatted", "turns").mapInArrow(run, schema)
