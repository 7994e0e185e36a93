"""Chat formatting by incremental black-box rendering.

A template is any callable from a list of (role, text) turns to one string. Nothing about it is assumed: every
prefix of a conversation is rendered, consecutive outputs are compared to locate each turn's span, and a template
whose output for n+1 turns does not begin with its output for n turns is reported as one that rewrites history.
Where a text lies inside its span is found by rendering the same prefix with a sentinel in the text's place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import pick

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

#: Control strings of the instruction template; a backslash before one makes it ordinary text.
CONTROL = re.compile(r"\\|</?s>|\[/?(?:INST|SYS|ROLE)\]")
ESCAPED = re.compile(r"\\(\\|</?s>|\[/?(?:INST|SYS|ROLE)\])")
SENTINEL = "\ue000\ue001\ue000"


def escape(text: str) -> str:
    """text with a backslash before each control string and each backslash."""
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    """What escape() was given."""
    return ESCAPED.sub(lambda m: m[1], text)


def instruct(turns: Turns) -> str:
    """`[INST] .. [/INST]` for users, ` .. </s>` for assistants, `[SYS]` and `[ROLE]` for the rest; texts are escaped."""
    out = ["<s>"]
    for role, text in turns:
        body = escape(text)
        if role == "user":
            out.append(f"[INST] {body} [/INST]")
        elif role == "assistant":
            out.append(f" {body} </s>")
        elif role == "system":
            out.append(f"[SYS] {body} [/SYS]")
        else:
            out.append(f"[ROLE] {escape(role)} [/ROLE] {body} </s>")
    return "".join(out)


def system_last(turns: Turns) -> str:
    """A template that moves the system text before the last user turn, and so rewrites history; for tests and audits."""
    system = "".join(escape(t) for r, t in turns if r == "system")
    rest = [(r, t) for r, t in turns if r != "system"]
    last = max((i for i, (r, _) in enumerate(rest) if r == "user"), default=-1)
    if last >= 0 and system:
        rest[last] = ("user", f"{system}\n\n{rest[last][1]}")
    return instruct(rest)


#: Turns of the instruction template, as its parser sees them.
_BODY = r"((?:[^\\<\[]|\\(?:\\|</?s>|\[/?(?:INST|SYS|ROLE)\])|<(?!/?s>)|\[(?!/?(?:INST|SYS|ROLE)\]))*)"
_TURN = re.compile(rf"\[INST\] {_BODY} \[/INST\]|\[SYS\] {_BODY} \[/SYS\]|\[ROLE\] {_BODY} \[/ROLE\] {_BODY} </s>| {_BODY} </s>", re.S)


def parse_instruct(formatted: str) -> Turns:
    """The turns that instruct() was given, read back from its output alone; ValueError if it isn't such output."""
    if not formatted.startswith("<s>"):
        raise ValueError("no start mark")
    out, at = [], 3
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        user, system, role, other, assistant = m.groups()
        if user is not None:
            out.append(("user", unescape(user)))
        elif system is not None:
            out.append(("system", unescape(system)))
        elif role is not None:
            out.append((unescape(role), unescape(other)))
        else:
            out.append(("assistant", unescape(assistant)))
        at = m.end()
    return out


def locate(turns: Turns, template: Template) -> tuple[str, list[tuple[int, int, int, int]], int]:
    """(output, spans, first turn at which history was rewritten or -1).

    A span is (start, end, text start, text end) in the last output. A turn whose span a later render changed, or
    that the template left out or transformed beyond recognition, has an empty text span.
    """
    out, spans, rewritten = template([]), [], -1
    sign = _sentinel(turns)
    for i in range(len(turns)):
        before, out = out, template(turns[: i + 1])
        if out.startswith(before):
            start = len(before)
        else:
            rewritten = i if rewritten < 0 else rewritten
            start = _common(before, out)
            # Spans from the first changed character on no longer hold.
            spans = [s if s[1] <= start else (min(s[0], start), min(s[1], start), 0, 0) for s in spans]
        marked = template([*turns[:i], (turns[i][0], sign)])
        head, found, tail = marked.partition(sign)
        first, last = len(head), len(out) - len(tail)
        whole = found and sign not in tail and first <= last and out.startswith(head) and out.endswith(tail) and first >= start
        spans.append((start, len(out), first, last) if whole else (start, len(out), 0, 0))
    return out, spans, rewritten


def _sentinel(turns: Turns) -> str:
    """A sign that no text or role of the conversation holds, for one repeated run of U+E000 is longer than any in them."""
    longest = max((len(run) for pair in turns for x in pair for run in re.findall(f"{SENTINEL[0]}+", x)), default=0)
    return SENTINEL[1] + SENTINEL[0] * (longest + 1) + SENTINEL[1]


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix, by bisection over slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, pd.DataFrame]]:
    """Whole conversations out of sorted batches; at most one unfinished conversation is held."""
    held: list[pd.DataFrame] = []
    key: object = None
    for batch in batches:
        if batch.empty:
            continue
        ids = batch["conv_id"]
        changed = (ids != ids.shift()) & ~(ids.isna() & ids.shift().isna())
        changed.iloc[0] = True
        starts = [*changed.to_numpy().nonzero()[0], len(batch)]
        for a, b in zip(starts, starts[1:], strict=False):
            part = batch.iloc[a:b]
            this = None if pd.isna(part["conv_id"].iloc[0]) else int(part["conv_id"].iloc[0])
            if held and this != key:
                yield key, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            key = this
            held.append(part)
    if held:
        yield key, pd.concat(held) if len(held) > 1 else held[0]


SCHEMA = """conv_id long, formatted string, n_turns long, rewrites_at int,
spans array<struct<role:string,start:int,end:int,text_start:int,text_end:int>>"""


def format_conversations(
    turns: DataFrame, template: Template = instruct, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: its formatted text, each turn's span, and where the template rewrote history.

    The loss mask is the text spans of the assistant's turns. rewrites_at is the first turn (from 0) whose render
    changed earlier output, or -1; the spans it changed have an empty text span, so no loss falls on moved text.

    Rows are ordered by turn, then role, then text, nulls first, so ties and repeated rows have one result; repeated
    rows are turns of their own. Null text or role: empty. Null conv_id: one conversation of its own. Empty tables
    give no rows; further columns are ignored. A conversation is handled by one task, batch by batch.
    """
    rows = pick(turns, conv_id=conv, turn=turn, role=role, text=text).withColumn("conv_id", F.col("conv_id").cast("long"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list = []
        size = 0
        for key, part in _conversations(batches):
            said = [("" if r is None else r, "" if t is None else t) for r, t in zip(part["role"], part["text"], strict=True)]
            formatted, spans, rewritten = locate(said, template)
            out.append((key, formatted, len(said), rewritten, [(r, *s) for (r, _), s in zip(said, spans, strict=True)]))
            size += len(formatted) + 64 * len(spans)
            if size > 4_000_000:
                yield _frame(out)
                out, size = [], 0
        if out:
            yield _frame(out)

    return dealt.mapInPandas(render, SCHEMA)


def _frame(rows: list) -> pd.DataFrame:
    names = ("role", "start", "end", "text_start", "text_end")
    frame = pd.DataFrame(rows, columns=["conv_id", "formatted", "n_turns", "rewrites_at", "spans"])
    frame["spans"] = [[dict(zip(names, s, strict=True)) for s in x] for x in frame["spans"]]
    frame["conv_id"] = frame["conv_id"].astype("Int64")
    return frame


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from formatted text and its loss mask (see the contract of the query)."""
    import hashlib

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, spans, at in zip(batch["conv_id"], batch["formatted"], batch["spans"], batch["rewrites_at"], strict=True):
                turns = parse_instruct(text)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                masked = "".join(unescape(text[s["text_start"] : s["text_end"]]) for s in spans if s["role"] == "assistant")
                sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                rows.append((key, len(turns), sha(said), len(masked), sha(masked), len(text), at >= 0))
            frame = pd.DataFrame(
                rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]
            )
            frame["conv_id"] = frame["conv_id"].astype("Int64")
            yield frame

    return formatted.select("conv_id", "formatted", "spans", "rewrites_at").mapInPandas(
        read,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean",
    )
