"""Chat formatting: a declarative template, a finite-state machine over roles, and loss flags per segment.

Everything is DataFrame expressions: turns are gathered per conversation (one conversation is the unit of
output, so it has to fit in a row), walked by ``aggregate`` for the turn order and by ``transform`` for the
segments.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import columns_of, table

MARK = "\\"


@dataclass(frozen=True)
class Template:
    """``open`` + role + ``middle`` + text + ``close`` for each turn.

    ``control`` lists every string that must not stand unescaped in a text.  An occurrence, with any number
    of marks after its first character, gets one more mark there; reading takes one away.  That is
    reversible as long as no control string holds the mark, or the first character of any of them further on."""

    open: str = "<|turn:"
    middle: str = "|>"
    close: str = "<|end|>"
    control: tuple[str, ...] = ("<|turn:", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)
    #: state -> roles that may follow; the role is the next state
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def __post_init__(self):
        if not {self.open, self.close} <= set(self.control):
            raise ValueError("the turn marks must be among the control strings")
        if any(MARK in c or self.firsts & set(c[1:]) or len(c) < 2 for c in self.control):
            raise ValueError("a control string may hold neither the mark nor a first character further on")

    @property
    def firsts(self) -> set[str]:
        return {c[0] for c in self.control}

    def pattern(self, between: str) -> str:
        """What stands between the first character of a control string and its marks and rest."""
        rest = lambda a: "|".join(re.escape(c[1:]) for c in self.control if c[0] == a)
        return "|".join(rf"(?<={re.escape(a)}){between}(?=\\*(?:{rest(a)}))" for a in sorted(self.firsts))

    def role_codes(self) -> list[tuple[str, str]]:
        return [(c, f"%{ord(c):02X}") for c in ["%", *sorted(self.firsts | {self.middle[0]})]]


def escaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, t.pattern(""), r"\\")


def unescaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, t.pattern(r"\\"), "")


def written_role(role: Column, t: Template) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), t.role_codes(), role)


def read_role(role: Column, t: Template) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), t.role_codes()[::-1], role)


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Rows (conv_id, turn, role, text) to one row per conversation.

    - ``segments``: array of (text, loss): the opening mark, the escaped text, the closing mark of each turn;
      loss is true for the texts of ``loss_roles`` alone.  ``formatted`` is all of them, one after the other.
    - ``valid``: whether the roles follow ``order`` and end in an accepting state; ``first_bad`` the place
      (from 0) of the first turn that doesn't follow, null if none.  Invalid conversations are formatted too.

    Turns go by turn, role, text (nulls first), so repeated and tied rows have a defined place and all stay.
    A null text or role counts as empty; rows with a null conv_id make one conversation.  No rows: no
    conversations.  Other columns are left out."""
    t = template
    d = columns_of(turns, conv_id="conv_id", turn="turn", role="role", text="text")
    d = d.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    d = d.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    allowed = F.create_map(*[v for state, nexts in t.order.items() for v in (F.lit(state), F.array(*map(F.lit, nexts)))])
    walk = F.aggregate(
        "xs",
        F.struct(F.lit(t.start).alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("at")),
        lambda s, x: F.struct(
            x.role.alias("state"),
            F.coalesce(s.bad, F.when(~F.coalesce(F.array_contains(F.try_element_at(allowed, s.state), x.role), F.lit(False)), s["at"])).alias("bad"),
            (s["at"] + 1).alias("at"),
        ),
    )
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "xs",
            lambda x: F.array(
                piece(F.concat(F.lit(t.open), written_role(x.role, t), F.lit(t.middle)), F.lit(False)),
                piece(escaped(x.text, t), x.role.isin(*t.loss_roles)),
                piece(F.lit(t.close), F.lit(False)),
            ),
        )
    )
    d = d.select("conv_id", walk.alias("w"), segments.alias("segments"))
    return d.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"),
        (F.col("w.bad").isNull() & F.col("w.state").isin(*t.accepting)).alias("valid"),
        F.col("w.bad").alias("first_bad"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """Array of (role, text) that a formatted conversation holds: the way back."""
    t = template
    parts = F.filter(F.split(formatted, re.escape(t.close)), lambda s: s != "")
    bare = lambda s: F.substring(s, len(t.open) + 1, 2**31 - 1)
    role = lambda s: F.substring_index(bare(s), t.middle, 1)
    return F.transform(parts, lambda s: F.struct(read_role(role(s), t).alias("role"), unescaped(bare(s).substr(F.length(role(s)) + len(t.middle) + 1, F.lit(2**31 - 1)), t).alias("text")))


def op7_chat_formatting(spark, sf_dir):
    """All conversations plus number -7, whose two texts are made of control strings."""
    t = Template()
    made = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(made), t)
    out = out.withColumn("back", read_turns(F.col("formatted"), t)).withColumn("learnt", unescaped_loss(F.col("segments"), t))
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("first_bad").cast("long").alias("first_bad"),
    )


def unescaped_loss(segments: Column, t: Template) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescaped(s.text, t)), "")


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, row_number() OVER p - 1 AS pos, coalesce(lag(role) OVER p, 'start') AS state,
    length(text) + len(regexp_extract_all(text, '(<\\*(\|turn:|\|end\|>|s>|/s>))|(\[\\*(INST\]|/INST\]))')) AS len,
    length(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '[', '%5B'), '|', '%7C')) + 16 AS around
  FROM t WINDOW p AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
b AS (
  SELECT *, NOT coalesce((state = 'start' AND role IN ('system', 'user')) OR (state IN ('system', 'assistant') AND role = 'user')
    OR (state = 'user' AND role = 'assistant'), false) AS bad
  FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(len + around)::BIGINT AS formatted_chars, NOT bool_or(bad) AND arg_max(role, pos) = 'assistant' AS valid,
  (min(pos) FILTER (WHERE bad))::BIGINT AS first_bad
FROM b GROUP BY conv_id
"""
