"""Chat formatting: a finite-state machine checks the order of turns, a template writes them.

The template says, for each role, what marks the start of a turn and whether its text counts for the loss;
every turn ends with the same mark. Control strings inside texts are escaped so that none is left: the
escape character is doubled and one is set after the first character of each control string. Both steps
can be undone, so a formatted conversation can be read back exactly.

Defined results: null text and null role are empty; a role outside the template is written by name; rows of
equal turn go by role, then text; null turns come first; conversations whose order the machine rejects are
formatted as well, with ``valid`` false; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versewell.llm.common import table

#: role -> (mark of the turn, whether its text counts for the loss)
TEMPLATE = {"system": ("[SYS] ", False), "user": ("[INST] ", False), "assistant": ("[/INST] ", True)}
START, END, OTHER = "<s>", "</s>", ("[ROLE]", "[/ROLE] ")
CONTROL = (START, END, "[SYS]", "[/SYS]", "[INST]", "[/INST]", *(x.strip() for x in OTHER))
ESCAPE = "\\"
#: transitions that the machine allows; it ends well in any state but the first
TURNS = ("start>system", "start>user", "system>user", "user>assistant", "assistant>user")


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escaped(text: Column) -> Column:
    text = _replace(text, ESCAPE, ESCAPE * 2)
    for mark in CONTROL:
        text = _replace(text, mark, mark[0] + ESCAPE + mark[1:])
    return text


def unescaped(text: Column) -> Column:
    for mark in CONTROL:
        text = _replace(text, mark[0] + ESCAPE + mark[1:], mark)
    return _replace(text, ESCAPE * 2, ESCAPE)


def _mark(role: Column) -> Column:
    mark = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]))
    for name, (text, _) in TEMPLATE.items():
        mark = F.when(role == name, F.lit(text)).otherwise(mark)
    return mark


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``segments`` array<struct<text, loss>>, ``formatted``, ``valid``, ``bad_turn``.

    ``bad_turn`` is the place (from 0) of the first turn that the machine rejects, else null.
    """
    rows = df.select(
        F.col(conv),
        F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"),
    )
    chats = rows.groupBy(conv).agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def step(state: Column, t: Column) -> Column:
        moves = F.concat(state["role"], F.lit(">"), t["role"]).isin(*TURNS)
        bad = F.when(state["bad"].isNull() & ~moves, state["at"]).otherwise(state["bad"])
        return F.struct(t["role"].alias("role"), (state["at"] + 1).alias("at"), bad.alias("bad"))

    begin = F.struct(F.lit("start").alias("role"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def segments_of(t: Column) -> Column:
        loss = t["role"].isin(*[name for name, (_, counts) in TEMPLATE.items() if counts])
        parts = ((_mark(t["role"]), F.lit(False)), (escaped(t["text"]), loss), (F.lit(END), F.lit(False)))
        return F.array(*[F.struct(x.alias("text"), y.alias("loss")) for x, y in parts])

    first = F.array(F.struct(F.lit(START).alias("text"), F.lit(False).alias("loss")))
    chats = chats.withColumn("segments", F.concat(first, F.flatten(F.transform("turns", segments_of))))
    chats = chats.withColumn("bad_turn", F.aggregate("turns", begin, step)["bad"])
    return chats.select(
        conv, "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("bad_turn").isNull().alias("valid"), "bad_turn",
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    body = formatted.substr(F.lit(len(START) + 1), F.length(formatted))
    turns = F.split(body, END, -1)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)

    def turn_of(x: Column) -> Column:
        close = F.locate(OTHER[1], x)
        role = unescaped(x.substr(F.lit(len(OTHER[0]) + 1), close - len(OTHER[0]) - 1))
        start = close + len(OTHER[1])
        for name, (mark, _) in TEMPLATE.items():
            role = F.when(x.startswith(mark), F.lit(name)).otherwise(role)
            start = F.when(x.startswith(mark), F.lit(len(mark) + 1)).otherwise(start)
        return F.struct(role.alias("role"), unescaped(x.substr(start, F.length(x))).alias("text"))

    return F.transform(turns, turn_of)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one of control strings, and describe what can be read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = format_chats(rows).withColumn("read", read_back(F.col("formatted")))
    told = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return chats.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def _escaped_sql(text: str) -> str:
    text = f"replace({text}, '{ESCAPE}', '{ESCAPE * 2}')"
    for mark in CONTROL:
        text = f"replace({text}, '{mark}', '{mark[0] + ESCAPE + mark[1:]}')"
    return text


_MARK_CHARS = (
    "CASE role " + " ".join(f"WHEN '{name}' THEN {len(mark)}" for name, (mark, _) in TEMPLATE.items())
    + f" ELSE {len(OTHER[0]) + len(OTHER[1])} + length({_escaped_sql('role')}) END"
)
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), 'start') || '>' || role AS move FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       ({len(START)} + sum({_MARK_CHARS} + length({_escaped_sql('text')}) + {len(END)}))::BIGINT AS formatted_chars,
       bool_and(move IN ({', '.join(f"'{x}'" for x in TURNS)})) AS valid
FROM o GROUP BY conv_id
"""
