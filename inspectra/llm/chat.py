"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) messages to a string; it
is never looked into.  Successive prefixes of a conversation are rendered and
consecutive outputs compared: what a prefix adds is the span of its last turn.
Where the text sits inside a span is found by rendering the same prefix with
two one-letter probes in its place: what both outputs share before and after is
the turn's frame.  A template that changes earlier output when a turn is added
rewrites history; its conversations are flagged and get no spans.

Conversations are dealt over the executors and sorted by turn; a task streams
through them and holds one window of turns at a time.  A window starts with the
last turn of the one before it, so a conversation of any length costs memory
and time in proportion to its size.  That holds only for a template that
declares itself ``local``: what a turn adds depends on that turn and the one
before it, once there is one.  Of any other template all prefixes of a
conversation are rendered whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = tuple[str, str]
Template = Callable[[list[Message]], str]

WINDOW = 64
_START, _END = "<|im_start|>", "<|im_end|>"


def escape(s: str) -> str:
    """Control strings inside a text can't be taken for marks: every ``<|`` is broken by a backslash, backslashes are doubled."""
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def chat_markup(messages: list[Message]) -> str:
    """The default template; roles are escaped as well, their line feeds as ``\\`` and ``n``."""
    return "".join(f"{_START}{_role(r)}\n{escape(t)}{_END}\n" for r, t in messages)


chat_markup.local = True


def _role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def parse_markup(s: str) -> list[Message]:
    """The messages of a string that ``chat_markup`` made."""
    out, at = [], 0
    while at < len(s):
        if not s.startswith(_START, at):
            raise ValueError("no turn starts here")
        line, end = s.index("\n", at), s.index(_END, at)
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s[at + len(_START):line], flags=re.S)
        out.append((role, unescape(s[line + 1:end])))
        at = end + len(_END) + 1
    return out


def turn_spans(messages: list[Message], template: Template, start: int = 0):
    """(rendered, spans) of ``messages[start:]``; spans are None if the template rewrites history.

    A span is (start, end, text start, text end) in code points of the output
    that the messages from ``start`` on add.
    """
    before = template(messages[:start]) if start else ""
    base, spans = len(before), []
    for k in range(start, len(messages)):
        role = messages[k][0]
        now = template(messages[:k + 1])
        if not now.startswith(before):
            return None, None
        probes = [template([*messages[:k], (role, p)]) for p in ("0", "1")]
        if len(probes[0]) != len(probes[1]) or not all(p.startswith(before) for p in probes):
            return None, None
        one, two = (p[len(before):] for p in probes)
        differ = [i for i, (x, y) in enumerate(zip(one, two)) if x != y]
        added = now[len(before):]
        head, tail = (differ[0], len(one) - differ[-1] - 1) if differ else (len(added), 0)
        if head + tail > len(added) or added[:head] != one[:head] or (tail and added[-tail:] != one[-tail:]):
            head, tail = len(added), 0  # the text shapes its own frame: nothing can be attributed to it
        at = len(before) - base
        spans.append((at, at + len(added), at + head, at + len(added) - tail))
        before = now
    return before[base:], spans


OUT = ("conv_id {0}, part long, first_turn long, formatted string, rewrites_history boolean, "
       "turns array<struct<role:string,start:long,end:long,text_start:long,text_end:long,loss:boolean>>")


def format_conversations(rows: DataFrame, template: Template = chat_markup, window: int | None = None,
                         loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formatted conversations, one row per window: conv_id, part, first_turn, formatted, rewrites_history, turns.

    A conversation is one window, unless the template has a true attribute
    ``local`` (then a window has WINDOW turns) or ``window`` is given.

    ``rows`` has conv_id, turn, role, text; other columns are ignored.  Turns go
    by turn (nulls first), ties by role and text; repeated rows are repeated
    turns; null roles and texts are empty; rows without conv_id are one
    conversation.  The parts of a conversation, in order, joined, are its
    formatted text; ``turns`` counts code points from the start of its part, and
    ``loss`` marks turns whose text (text_start to text_end) is trained on.
    """
    window = window or (WINDOW if getattr(template, "local", False) else None)
    src = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kind = src.schema["conv_id"].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("role", pa.string()), *((k, pa.int64()) for k in ("start", "end", "text_start", "text_end")),
                                     ("loss", pa.bool_())]))
    fields = [("part", pa.int64()), ("first_turn", pa.int64()), ("formatted", pa.string()), ("rewrites_history", pa.bool_()),
              ("turns", spans_type)]

    def render(conv, part, first, messages, carried):
        text, spans = turn_spans(messages, template, carried)
        turns = None if spans is None else [
            dict(zip(("start", "end", "text_start", "text_end"), s), role=m[0], loss=m[0] in loss_roles)
            for m, s in zip(messages[carried:], spans)]
        return {"conv_id": conv, "part": part, "first_turn": first, "formatted": template(messages) if spans is None else text,
                "rewrites_history": spans is None, "turns": turns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, carried, part, first, any_row = None, [], 0, 0, 0, False
        out, size = [], 0
        for batch in batches:
            schema = pa.schema([batch.schema.field("conv_id"), *(pa.field(*f) for f in fields)])
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if any_row and c != conv:
                    out.append(render(conv, part, first, held, carried))
                    held, carried, part, first = [], 0, 0, 0
                elif window and len(held) - carried == window:
                    out.append(render(conv, part, first, held, carried))
                    held, carried, part, first = held[-1:], 1, part + 1, first + window
                conv, any_row = c, True
                held.append((role, text))
                size += len(text)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if any_row:
            out.append(render(conv, part, first, held, carried))
            yield pa.RecordBatch.from_pylist(out, schema)

    dealt = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, OUT.format(kind))


def digests(formatted: DataFrame, parse: Callable[[str], list[Message]] = parse_markup,
            clean: Callable[[str], str] = unescape) -> DataFrame:
    """What can be read back from formatted conversations, one row each.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of every
    turn, parsed from the formatted text), loss_chars and loss_sha256 (all text
    under the loss mask, unescaped), formatted_chars, rewrites_history.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def closed():
            conv, n, turns, chars, loss, total, rewrites = state
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in (
                (conv, id_type), (n, pa.int64()), (turns.hexdigest(), pa.string()), (chars, pa.int64()), (loss.hexdigest(), pa.string()),
                (total, pa.int64()), (rewrites, pa.bool_()))], names=names)

        for batch in batches:
            id_type, done = batch.schema.field("conv_id").type, []
            for row in batch.select(["conv_id", "formatted", "rewrites_history", "turns"]).to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state:
                        done.append(closed())
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                for role, text in parse(row["formatted"]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for t in row["turns"] or ():
                    if t["loss"]:
                        text = clean(row["formatted"][t["text_start"]:t["text_end"]])
                        state[3] += len(text)
                        state[4].update(text.encode())
                state[5] += len(row["formatted"])
                state[6] |= row["rewrites_history"]
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if state:
            yield closed()

    # format_conversations leaves a conversation's parts in one task, in order
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long, rewrites_history boolean")
