"""Chat formatting: a finite-state machine over roles and a declarative template, in SQL expressions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of a turn, which roles are learnt from, and which role may follow which.

    No escaped text holds ``###`` or ``</turn>``, so the marks can be found again. Roles without a label are written as
    ``=role``.
    """

    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    learnt: tuple = ("assistant",)
    #: state -> roles that may come next; the state after a turn is its role
    follows: dict = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple = ("assistant",)

    head, after_label, tail = "### ", ": ", "</turn>\n"


DEFAULT = ChatTemplate()


def escape(text: Column) -> Column:
    """Reversible: a backslash before each backslash and inside each control string."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("###"), F.lit("\\#\\#\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _label(role: Column, t: ChatTemplate) -> Column:
    out = F.concat(F.lit("="), F.replace(escape(role), F.lit(":"), F.lit("\\:")))
    for name, label in t.labels.items():
        out = F.when(role == name, F.lit(label)).otherwise(out)
    return out


def _role(label: Column, t: ChatTemplate) -> Column:
    out = unescape(F.substring(label, 2, 2**30))
    for name, text in t.labels.items():
        out = F.when(label == text, F.lit(name)).otherwise(out)
    return out


def format_chats(turns: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """conv_id, n_turns, valid, n_valid_turns, segments (array of text, loss), formatted (the segments joined).

    Turns come in the order of (turn, role, text), nulls first; null roles and texts count as empty strings; repeated rows
    are turns of their own. valid: the machine accepts the roles and stops after a learnt turn; n_valid_turns: turns before
    the first one it refuses. Refused conversations are formatted too, so a caller decides. Other columns are not carried.
    """
    none = F.lit("")
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    steps = F.create_map(*[F.lit(x) for state, roles in template.follows.items() for r in roles for x in (f"{state}>{r}", r)])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, t: Column) -> Column:
        to = F.coalesce(F.element_at(steps, F.concat(s["state"], F.lit(">"), t["role"])), F.lit("refused"))
        return F.struct(to.alias("state"), (s["n"] + (to != "refused").cast("long")).alias("n"))

    def segments(t: Column) -> Column:
        mark = F.concat(F.lit(template.head), _label(t["role"], template), F.lit(template.after_label))
        learnt = t["role"].isin(*template.learnt)
        one = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(one(mark, F.lit(False)), one(escape(t["text"]), learnt), one(F.lit(template.tail), F.lit(False)))

    ran = F.aggregate("turns", start, step)
    out = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), ran.alias("ran"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.select("conv_id", "n_turns", F.col("ran.state").isin(*template.final).alias("valid"), F.col("ran.n").alias("n_valid_turns"), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(chats: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """Adds turns (array of role, text), parsed from formatted, and loss_text, the unescaped text of the segments under loss."""
    parts = F.split(F.col("formatted"), F.lit(template.tail), -1)
    bodies = F.slice(parts, 1, F.size(parts) - 1)  # the last part is what follows the last tail: nothing

    def parse(body: Column) -> Column:
        inner = F.substring(body, len(template.head) + 1, 2**30)
        at = F.regexp_instr(inner, F.lit(r"(?<!\\):"))  # a colon in a role is escaped
        label = F.substring(inner, F.lit(1), at - 1)
        return F.struct(_role(label, template).alias("role"), unescape(F.substring(inner, at + len(template.after_label), F.lit(2**30))).alias("text"))

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return chats.withColumn("turns", F.transform(bodies, parse)).withColumn("loss_text", loss)


def op7_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations and the planted one whose texts hold control strings."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")], "conv_id long, turn long, role string, text string")
    back = read_back(format_chats(rows.unionByName(planted)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "n_valid_turns")


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>') AS esc,
    CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '=' || role END AS label,
    lag(role) OVER w AS prev, row_number() OVER w AS k
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (
  SELECT *, CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev = 'system' THEN role = 'user'
    WHEN prev = 'user' THEN role = 'assistant' WHEN prev = 'assistant' THEN role = 'user' ELSE false END AS ok FROM e),
g AS (SELECT *, min(CASE WHEN NOT ok THEN k END) OVER (PARTITION BY conv_id) AS bad FROM f)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(label) + 2 + length(esc) + 8) AS BIGINT) AS formatted_chars,
  bool_and(ok) AND arg_max(role, k) = 'assistant' AS valid,
  coalesce(min(bad) - 1, count(*)) AS n_valid_turns
FROM g GROUP BY conv_id
"""
