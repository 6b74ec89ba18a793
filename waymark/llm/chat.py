"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame operations alone.

Turns become segments ``(text, loss)``: an opening mark with the role, the text, a closing mark. Control strings inside
a role or text are broken by an escape character behind their first character, and the escape character is doubled, so
that the marks of the template are the only ones in the output and every text can be read back.

Conversations are handled in parts of ``PART`` turn numbers, so that a long one is not gathered in one go; the machine
runs within each part and over the border roles of the parts, which is the same as running over all turns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 64
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks, who may speak after whom, whose text bears loss, and other control strings to break."""

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>"
    loss: tuple[str, ...] = ("assistant",)
    first: tuple[str, ...] = ("system", "user")
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last: tuple[str, ...] = ("assistant",)
    guarded: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.opening, self.closing, *self.guarded)

    def __post_init__(self) -> None:
        if any(len(c) < 2 or ESCAPE in c for c in self.controls):
            raise ValueError("control strings have two characters or more and no backslash")


def _literal(text: str) -> str:
    """A regular expression, for Java, of exactly this text."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def escape(text: Column, template: Template) -> Column:
    by_first: dict[str, list[str]] = {}
    for c in template.controls:
        by_first.setdefault(c[0], []).append(_literal(c[1:]))
    pattern = "|".join(f"{_literal(c)}(?={'|'.join(rest)})" for c, rest in by_first.items())
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), pattern, "$0" + ESCAPE * 2)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _allowed(before: Column, after: Column, template: Template) -> Column:
    pairs = [F.lit(f"{a}\n{b}") for a, many in template.follows.items() for b in many]
    return F.array_contains(F.array(*pairs), F.concat(before, F.lit("\n"), after)) if pairs else F.lit(False)


def format_parts(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a part of a conversation: conv_id, part, segments, first_role, last_role, ordered.

    ``rows``: conv_id, turn, role, text; other columns are not read. ``segments``: array of (text, loss), three for a
    turn. ``ordered``: whether each turn in the part may follow the one before it. Turns are ordered by number (null
    first), ties by role and text; repeated rows are turns of their own. Null roles and texts are empty, roles and texts
    may be of any length, and an empty table gives an empty table.
    """
    turns = rows.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / PART).cast("long"), F.lit(-(2**62))).alias("part"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    parts = turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    marked = F.transform(
        "turns",
        lambda t: F.array(
            F.struct(F.concat(F.lit(template.opening), F.replace(escape(t["role"], template), F.lit("\n"), F.lit(ESCAPE + "\n")), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), t["role"].isin(*template.loss).alias("loss")),
            F.struct(F.lit(template.closing + "\n").alias("text"), F.lit(False).alias("loss")),
        ),
    )
    roles = F.col("turns.role")
    steps = F.zip_with(F.slice(roles, 1, F.size(roles) - 1), F.slice(roles, 2, F.size(roles)), lambda a, b: _allowed(a, b, template))
    return parts.select(
        "conv_id", "part", F.flatten(marked).alias("segments"), F.element_at(roles, 1).alias("first_role"), F.element_at(roles, -1).alias("last_role"),
        F.forall(steps, lambda x: x).alias("ordered"),
    )


def read_back(parts: DataFrame, template: Template = Template()) -> DataFrame:
    """``parts`` with what the formatted text alone says: formatted, turns (role, text), loss_text."""
    opening, closing = _literal(template.opening), _literal(template.closing)
    # possessive, so that the matcher keeps no way back for each character of a role
    pattern = F.lit(rf"(?s){opening}((?:[^\\\n]++|\\.)*+)\n(.*?){closing}\n")
    formatted = F.array_join(F.col("segments.text"), "")
    turns = F.arrays_zip(F.transform(F.regexp_extract_all("formatted", pattern, 1), unescape).alias("role"), F.transform(F.regexp_extract_all("formatted", pattern, 2), unescape).alias("text"))
    under = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return parts.withColumn("formatted", formatted).withColumn("turns", turns).withColumn("loss_text", F.array_join(under, ""))


def digest(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid.

    All but ``valid`` are read back from the formatted text. ``valid``: the machine accepts the order of the roles. The
    digests are of whole conversations, so the texts of one conversation meet in one row, as long strings made by part.
    A null conv_id is a conversation of its own; an empty table gives an empty table.
    """
    spoken = read_back(format_parts(rows, template), template).select(
        "conv_id",
        F.struct(
            "part", "first_role", "last_role", "ordered", F.size("turns").alias("n"),
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
            F.col("loss_text").alias("loss"), F.length("formatted").cast("long").alias("chars"),
        ).alias("p"),
    )
    whole = spoken.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    loss = F.array_join(F.col("p.loss"), "")
    between = F.zip_with(
        F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda a, b: _allowed(a["last_role"], b["first_role"], template)
    )
    return whole.select(
        "conv_id",
        F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_turns"),
        F.sha2(F.array_join(F.col("p.said"), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["chars"]).alias("formatted_chars"),
        (
            F.forall("p", lambda x: x["ordered"]) & F.forall(between, lambda x: x)
            & F.element_at("p", 1)["first_role"].isin(*template.first) & F.element_at("p", -1)["last_role"].isin(*template.last)
        ).alias("valid"),
    )


def oracle(template: Template = Template()) -> str:
    """DuckDB SQL of ``digest`` over the table ``conversations`` and the conversation -7."""

    def escaped(x: str) -> str:
        x = f"replace({x}, '\\', '\\\\')"
        for c in template.controls:
            x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
        return x

    pairs = ", ".join(f"'{a}' || chr(10) || '{b}'" for a, many in template.follows.items() for b in many)
    listed = lambda names: ", ".join(f"'{x}'" for x in names)
    marks = len(template.opening) + len(template.closing) + 2
    return f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), numbered as (
  select *, lag(role) over w as before, lead(role) over w as after from rows window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role in ({listed(template.loss)}) then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role in ({listed(template.loss)})), '')) as loss_sha256,
  cast(sum({marks} + length(replace({escaped('role')}, chr(10), '\\' || chr(10))) + length({escaped('text')})) as bigint) as formatted_chars,
  bool_and(case when before is null then role in ({listed(template.first)}) else before || chr(10) || role in ({pairs}) end
    and (after is not null or role in ({listed(template.last)}))) as valid
from numbered group by conv_id
"""
