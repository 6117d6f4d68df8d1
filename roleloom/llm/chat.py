"""Chat formatting: a role automaton and a declarative template, in SQL functions only.

A template gives for each role the marks before and after a turn and whether
the turn's text counts for the loss.  Marks that occur inside texts are escaped
with a backslash after their first character (backslashes are doubled), so that
the formatted string can be read back without loss.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``turns``: marks by role.  Other roles are written as ``other`` with the escaped role between its marks.

    ``moves``: the automaton, ``state -> {role: next state}``; ``start`` and ``ends`` are states.
    """

    turns: dict[str, Turn]
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    moves: dict[str, dict[str, str]] = field(default_factory=dict)
    start: str = "start"
    ends: tuple[str, ...] = ()

    @property
    def marks(self) -> list[str]:
        return sorted({m for t in self.turns.values() for m in (t.before, t.after)} | set(self.other), key=lambda m: (-len(m), m))


#: Control strings and turn order of the default format.
DEFAULT = Template(
    turns={
        "system": Turn("<<SYS>>", "<</SYS>>"),
        "user": Turn("[INST]", "[/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True),
    },
    moves={
        "start": {"system": "ready", "user": "asked"},
        "ready": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    ends=("answered",),
)


def _quoted(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}<>/])", r"\\\1", text)


def mark_pattern(template: Template) -> str:
    """A pattern of two groups: a mark's first character and the rest; understood by Java, RE2 and Python."""
    by_first: dict[str, list[str]] = {}
    for m in template.marks:
        by_first.setdefault(m[0], []).append(_quoted(m[1:]))
    return "|".join(f"({_quoted(c)})({'|'.join(rest)})" for c, rest in sorted(by_first.items()))


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    groups = len({m[0] for m in template.marks})
    to = "".join(f"${2 * i + 1}" for i in range(groups)) + "\\\\" + "".join(f"${2 * i + 2}" for i in range(groups))
    return F.regexp_replace(out, mark_pattern(template), to)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(template: Template, role: Column, part, other: Column) -> Column:
    out = None
    for name, turn in template.turns.items():
        cond, value = role == name, part(turn)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(other) if out is not None else other


def _automaton(template: Template, roles: Column) -> Column:
    """The state after all roles; ``error`` once a role has no move."""

    def move(state: Column, role: Column) -> Column:
        out = F.lit("error")
        for s, to in template.moves.items():
            for r, t in to.items():
                out = F.when((state == s) & (role == r), F.lit(t)).otherwise(out)
        return out

    return F.aggregate(roles, F.lit(template.start), move)


def format_conversations(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """``conv_id, n_turns, segments, formatted, valid`` for ``rows(conv_id, turn, role, text)``.

    ``segments`` is an array of ``(text, loss)`` whose texts concatenated are
    ``formatted``: marks and other roles' texts with loss false, assistant texts
    with loss true.  Turns are ordered by (turn, role, text), nulls first; a
    null text or role is empty; a null conv_id is a conversation of its own;
    repeated rows are turns of their own.  ``valid``: the automaton accepts the
    order of roles; rejected conversations are formatted all the same.  A
    conversation is one output row, so it must fit a task; nothing else is
    gathered.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    opened = lambda t: _by_role(
        template, t["role"], lambda x: F.lit(x.before), F.concat(F.lit(template.other[0]), escape(t["role"], template), F.lit(template.other[1]))
    )
    closed = lambda t: _by_role(template, t["role"], lambda x: F.lit(x.after), F.lit(template.other[2]))
    loss = lambda t: _by_role(template, t["role"], lambda x: F.lit(x.loss), F.lit(False))
    segment = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(segment(opened(t), F.lit(False)), segment(escape(t["text"], template), loss(t)), segment(closed(t), F.lit(False))),
        )
    )
    state = _automaton(template, F.transform("turns", lambda t: t["role"]))
    return convs.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        segments.alias("segments"),
        state.isin(*template.ends).alias("valid"),
    ).withColumn("formatted", F.concat_ws("", F.transform("segments", lambda s: s["text"])))


def read_back(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns ``array<struct<role, text, loss>>`` of a formatted string."""
    known = [(r, t) for r, t in template.turns.items()]
    closers = "|".join(_quoted(m) for m in sorted({t.after for _, t in known} | {template.other[2]}, key=lambda m: (-len(m), m)))
    whole = F.regexp_extract_all(formatted, F.lit(f"(?s).*?(?:{closers})"), F.lit(0))
    o0, o1, o2 = template.other

    def turn(piece: Column) -> Column:
        role = text = loss = None
        for r, t in known:
            here = F.startswith(piece, F.lit(t.before))
            inner = F.substring(piece, F.lit(len(t.before) + 1), F.length(piece) - len(t.before) - len(t.after))
            role = F.when(here, F.lit(r)) if role is None else role.when(here, F.lit(r))
            text = F.when(here, inner) if text is None else text.when(here, inner)
            loss = F.when(here, F.lit(t.loss)) if loss is None else loss.when(here, F.lit(t.loss))
        split = F.instr(piece, o1)
        role = role.otherwise(unescape(F.substring(piece, F.lit(len(o0) + 1), split - 1 - len(o0))))
        text = text.otherwise(F.substring(piece, split + len(o1), F.length(piece) - split - len(o1) + 1 - len(o2)))
        return F.struct(role.alias("role"), unescape(text).alias("text"), loss.otherwise(F.lit(False)).alias("loss"))

    return F.transform(whole, turn)


def conversation_digests(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Digest columns of op10, derived from the formatted string of every conversation."""
    made = format_conversations(rows, template)
    back = made.withColumn("back", read_back(F.col("formatted"), template))
    told = F.concat_ws("", F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    lost = F.concat_ws("", F.transform(F.filter("back", lambda t: t["loss"]), lambda t: t["text"]))
    return back.select(
        "conv_id",
        F.size("back").cast("bigint").alias("n_turns"),
        F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"),
        F.length(lost).cast("bigint").alias("loss_chars"),
        F.sha2(F.encode(lost, "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )
