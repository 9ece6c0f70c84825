"""Operator 2: chat formatting, with DataFrame expressions alone.

A conversation's turns are sorted, adjacent turns of one role merged under one header, and joined to

    <|turn|>ROLE<|text|>TEXT<|next|>TEXT<|end|>\\n<|turn|>...

Control strings that occur inside a role or a text (those of this template, and those in ALSO) get a backslash after
their first character; one that has backslashes there gets one more, so taking one away restores every text. No control
string holds its first character twice, so none can arise across a seam.

The result is a list of segments; a segment with `loss` is one assistant text. Turns are collected by (conversation,
turn div BLOCK) first and merged there, then by conversation, so what is shuffled by a long conversation's key is a row
for each block. A conversation's formatted text itself is one value by definition.

Defined results: null texts and roles count as empty strings; null turns come first, ties are ordered by role and text;
repeated rows are turns of their own; null conv_ids are one conversation; an empty table gives no row; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"
#: Control strings, as a pattern without their first character; the second half are those of other templates.
REST = r"(?:\|(?:turn|text|next|end)\|>|/?s>|/?INST\])"
BLOCK = 512
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({REST})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({REST})", "$1$2$3")


def _runs(items: str, role, texts) -> Column:
    """Merge neighbours of equal role in the array column `items` into (role, texts), in linear time."""
    array = F.col(items)
    starts = F.filter(
        F.sequence(F.lit(0), F.size(array) - 1), lambda i: (i == 0) | ~role(F.get(array, i)).eqNullSafe(role(F.get(array, i - 1)))
    )
    ends = F.concat(F.slice(starts, 2, F.size(array)), F.array(F.size(array)))
    return F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda x: F.struct(role(F.get(array, x["a"])).alias("role"), texts(F.slice(array, x["a"] + 1, x["b"] - x["a"])).alias("texts")),
    )


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: conv_id, segments (array of piece, loss), formatted."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        escape(F.coalesce(F.col(role), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    )
    blocks = (
        rows.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("items"))
        .select("conv_id", "block", _runs("items", lambda x: x["role"], lambda part: F.transform(part, lambda t: t["text"])).alias("runs"))
    )
    chats = (
        blocks.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("block", "runs"))).alias("blocks"))
        .select("conv_id", F.flatten(F.transform("blocks", lambda b: b["runs"])).alias("items"))
        .select("conv_id", _runs("items", lambda x: x["role"], lambda part: F.flatten(F.transform(part, lambda r: r["texts"]))).alias("runs"))
    )

    def segment(piece: Column, loss: Column) -> Column:
        return F.struct(piece.alias("piece"), loss.alias("loss"))

    def of_run(run: Column) -> Column:
        learned = run["role"] == F.lit(LEARNED_ROLE)
        texts = F.transform(
            run["texts"],
            lambda t, i: F.array(segment(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")), F.lit(False)), segment(t, learned)),
        )
        head = F.array(segment(F.concat(F.lit(TURN), run["role"], F.lit(TEXT)), F.lit(False)))
        return F.concat(head, F.flatten(texts), F.array(segment(F.lit(END), F.lit(False))))

    return chats.select("conv_id", F.flatten(F.transform("runs", of_run)).alias("segments")).withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["piece"]), "")
    )


def parse_chats(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    runs = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda x, i: i > 0)

    def of_run(run: Column) -> Column:
        halves = F.split(F.substring(run, F.lit(1), F.length(run) - len(END)), r"<\|text\|>", -1)
        texts = F.split(F.get(halves, F.lit(1)), r"<\|next\|>", -1)
        return F.transform(texts, lambda t: F.struct(unescape(F.get(halves, F.lit(0))).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(runs, of_run))


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `conversations` and conversation -1, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(
        f"SELECT -1L AS conv_id, turn, role, text FROM VALUES (0L, 'user', '{said}'), (1L, 'assistant', '{said}') AS t(turn, role, text)"
    )
    chats = format_chats(turns.unionByName(own)).withColumn("turns", parse_chats(F.col("formatted")))
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["piece"])), "")
    read = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.withColumn("learned", learned).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(read, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = r"regexp_replace({0}, '([<\[])(\\*)((?:\|(?:turn|text|next|end)\|>|/?s>|/?INST\]))', '\1\\\2\3', 'g')"

ORACLES = {
    "op2_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) THEN 0 ELSE 1 END AS head FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(length({_ESCAPED.format("text")}) + CASE WHEN head = 1 THEN {len(TURN) + len(TEXT) + len(END)} + length({_ESCAPED.format("role")}) ELSE {len(NEXT)} END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id"""
}
QUERIES = {"op2_chat_format": chat_format}
