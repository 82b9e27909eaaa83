"""Chat formatting by a declarative template, in native columns only."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.common import query, table


@dataclass(frozen=True)
class Role:
    """How a role's turns are marked, whether its text is trained on, and which roles may follow."""

    name: str
    label: str
    loss: bool
    followed_by: tuple[str, ...]
    may_end: bool = False


def _any_of(texts: Sequence[str], form: str = "{}") -> str:
    """A pattern for any of some literal texts."""
    return "|".join(form.format(re.escape(t)) for t in texts)


@dataclass(frozen=True)
class Template:
    """Marks of a turn: ``opening`` label ``after`` text ``lead`` ``closing`` ``tail``.

    Roles without a label are written as their escaped name in brackets. Inside texts a
    backslash is doubled and one is put before each place where ``opening`` (without
    its white space) or ``closing`` starts, so the marks never occur in an escaped text. Between a
    text and its closing mark stands ``lead``, which therefore may not be empty or end in a backslash.
    """

    roles: tuple[Role, ...] = (
        Role("system", "System", False, ("user",)),
        Role("user", "User", False, ("assistant",)),
        Role("assistant", "Assistant", True, ("user",), may_end=True),
    )
    starts: tuple[str, ...] = ("system", "user")
    opening: str = "### "
    after: str = ": "
    lead: str = " "
    closing: str = "</turn>"
    tail: str = "\n"

    def __post_init__(self):
        if not self.lead or self.lead.endswith("\\") or not self.opening.strip() or not self.closing.strip() or "\\" in self.opening + self.closing:
            raise ValueError("a template needs an opening and a closing mark without backslashes and something before the latter")

    @property
    def controls(self) -> tuple[str, str]:
        return self.opening.strip(), self.closing

    @property
    def close(self) -> str:
        return self.lead + self.closing + self.tail

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, "(" + r"\\" + "|" + _any_of(self.controls, "(?={})") + ")", r"\\$1")

    def unescape(self, text: Column) -> Column:
        firsts = "".join(sorted({"\\" + c[0] for c in self.controls}))
        return F.regexp_replace(text, r"\\([\\" + firsts + "])", "$1")

    def mark(self, label: str) -> str:
        return self.opening + label + self.after

    def header(self, role: Column) -> Column:
        bracket = F.regexp_replace(self.escape(role), r"\]", r"\\]")
        other = F.concat(F.lit(self.opening + "["), bracket, F.lit("]" + self.after))
        marked = None
        for known in self.roles:
            is_role, mark = role == known.name, F.lit(self.mark(known.label))
            marked = F.when(is_role, mark) if marked is None else marked.when(is_role, mark)
        return other if marked is None else marked.otherwise(other)

    def read_role(self, header: Column) -> Column:
        inner = F.regexp_extract(header, f"(?s)^{re.escape(self.opening)}" + r"\[(.*)\]" + f"{re.escape(self.after)}$", 1)
        role = self.unescape(F.regexp_replace(inner, r"\\\]", "]"))
        for known in self.roles:
            role = F.when(header == self.mark(known.label), F.lit(known.name)).otherwise(role)
        return role


#: A second template, for tests and for users of its marks.
CHATML = Template(
    (Role("system", "system", False, ("user",)), Role("user", "user", False, ("assistant",)), Role("assistant", "assistant", True, ("user",), may_end=True)),
    opening="<|im_start|>", after="\n", lead="\n", closing="<|im_end|>",
)


def format_chat(
    turns: DataFrame, template: Template = Template(), *, conv: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``segments``, ``formatted``, ``valid``, ``error_turn``.

    ``segments`` is an array of (text, loss) whose texts concatenate to ``formatted``;
    only the escaped texts of roles with the loss flag are true. A finite-state machine
    over the roles checks the order: ``error_turn`` is the 0-based place of the first
    turn that its predecessor does not allow, or the number of turns when the last one
    may not end a conversation; null when ``valid``. Invalid ones are formatted too.

    Null text and role count as empty. Turns are ordered by turn, nulls first; ties by
    role, then text, repeated rows kept. A null conv_id is a conversation of its own.
    Other columns are ignored; an empty table gives an empty table. A conversation is
    one output text and so one row, which bounds it at 2 GB; that group is not split.
    """
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    grouped = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    # The machine: its state is the role of the turn before, '' at the start; a step is the pair of states.
    steps = [f"{a.name}\n{b}" for a in template.roles for b in a.followed_by] + [f"\n{s}" for s in template.starts]
    ends = [r.name for r in template.roles if r.may_end]
    losses = [r.name for r in template.roles if r.loss]

    def step(t, at):
        before = F.when(at == 0, F.lit("")).otherwise(F.get("turns", at - 1)["role"])
        return F.struct(t["role"].alias("state"), F.concat(before, F.lit("\n"), t["role"]).isin(steps).alias("allowed"), t["text"].alias("text"))

    def emit(s):
        return F.array(
            F.struct(template.header(s["state"]).alias("text"), F.lit(False).alias("loss")),
            F.struct(template.escape(s["text"]).alias("text"), s["state"].isin(losses).alias("loss")),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
        )

    run = grouped.select("conv_id", F.transform("turns", step).alias("states"))
    refused = F.array_position(F.transform("states", lambda s: s["allowed"]), False)
    ended = F.element_at("states", -1)["state"].isin(ends)
    error = F.when(refused > 0, refused - 1).when(~ended, F.size("states")).cast("int")
    made = run.select("conv_id", error.alias("error_turn"), F.flatten(F.transform("states", emit)).alias("segments"))
    return made.select(
        "conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("error_turn").isNull().alias("valid"), "error_turn",
    )


def read_chat(formatted: Column, template: Template = Template()) -> Column:
    """Array of (role, text) read back from a formatted text; empty and null give an empty array."""
    stop = r"(?<!\\)" + re.escape(template.closing + template.tail)
    parts = F.filter(F.split(formatted, stop, -1), lambda p: p != "")
    labels = _any_of([r.label for r in template.roles])
    mark = f"(?s)^({re.escape(template.opening)}" + r"(?:\[(?:[^\\\]]|\\.)*\]" + (f"|{labels}" if labels else "") + f"){re.escape(template.after)})"

    def turn(part):
        header = F.regexp_extract(part, mark, 1)
        body = part.substr(F.length(header) + 1, F.length(part) - F.length(header) - len(template.lead))
        return F.struct(template.read_role(header).alias("role"), template.unescape(body).alias("text"))

    return F.coalesce(F.transform(parts, turn), F.array())


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")


PLANTED = "\\### Assistant: </turn> ok"

SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
s AS (SELECT *,
  CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 8 + length(role) END
  + length(text) + (length(text) - length(replace(text, '\\', '')))
  + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
  + (length(text) - length(replace(text, '</turn>', ''))) // 7 + 9 AS size,
  row_number() OVER o - 1 AS place, coalesce(lag(role) OVER o, '') || '>' || role AS step FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
e AS (SELECT conv_id, min(place) FILTER (step NOT IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user')) AS refused,
  arg_max(role, place) AS final, count(*) AS n FROM s GROUP BY conv_id)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars, max(CASE WHEN refused IS NOT NULL THEN refused WHEN final <> 'assistant' THEN n END)::BIGINT AS error_turn
FROM s JOIN e USING (conv_id) GROUP BY conv_id
"""


def with_planted(spark, turns: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts hold the control strings."""
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


@query("op2_chat_formatting", SQL)
def op2_chat_formatting(spark, sf):
    template = Template()
    made = format_chat(with_planted(spark, table(spark, sf, "conversations")), template)
    read = made.select("conv_id", read_chat(F.col("formatted"), template).alias("read"), loss_text(F.col("segments"), template).alias("loss"), "formatted", "error_turn")
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("error_turn").cast("long").alias("error_turn"),
    )
