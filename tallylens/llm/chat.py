"""Chat formatting with Spark expressions only.

The turns of a conversation are collected, sorted and merged: neighbours of one
role share a block. A block is ``<s>role``, ``[INST]text[/INST]`` for each turn
and ``</s>``; the formatted conversation is its blocks, one after another.

A text may hold these marks itself. In texts and roles every mark, plain or
starred, gets one more star behind its opening bracket (``</s>`` becomes
``<*/s>``, ``<*/s>`` becomes ``<**/s>``), so the output has no mark that the
template did not set, and taking one star away restores the text.

Turns are sorted by turn, then role and text, nulls first; a null role or text
is empty. Repeated rows are repeated turns. The output holds a conversation as
one string, so a conversation has to fit in memory; collecting turns is the
operator itself. Rows with a null conv_id are one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylens.llm.tables import pick

OPEN, CLOSE, BEGIN, END = "<s>", "</s>", "[INST]", "[/INST]"
MARK = r"([<\[])(\**/?(?:s>|INST\]))"
STARRED = r"([<\[])\*(\**/?(?:s>|INST\]))"
SPLIT_TEXTS = r"\[/?INST\]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), MARK, "$1*$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, STARRED, "$1$2")


def starts(turns: Column) -> Column:
    """Places (from 1) of the turns whose role differs from that of the turn in front."""
    def place(turn: Column, i: Column) -> Column:
        return F.when(i == 0, 1).when(turn["role"] != F.get(turns, i - 1)["role"], i + 1)

    return F.filter(F.transform(turns, place), F.isnotnull)


def pieces(block: Column, assistant: str) -> Column:
    """The parts of a block, a run of turns of one role: ``array<struct<part, loss>>``."""
    part = lambda text, loss: F.struct(text.alias("part"), loss.alias("loss"))
    no = F.lit(False)
    role = F.get(block, F.lit(0))["role"]
    texts = F.flatten(F.transform(block, lambda t: F.array(
        part(F.lit(BEGIN), no), part(t["text"], t["role"] == F.lit(assistant)), part(F.lit(END), no))))
    return F.concat(F.array(part(F.concat(F.lit(OPEN), role), no)), texts, F.array(part(F.lit(CLOSE), no)))


def chat(conversations: DataFrame, assistant: str = "assistant") -> DataFrame:
    """conv_id, ``formatted`` and ``mask``, one row per conversation.

    ``mask`` is the loss mask in runs: consecutive stretches of ``formatted`` in
    code points and whether they count; those that do are the assistant's texts.
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    turns = (
        rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(
            escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text"))).alias("turns")))
    cut = turns.withColumn("starts", starts(F.col("turns"))).withColumn("parts", F.flatten(F.transform("starts", lambda at, i: pieces(
        F.slice("turns", at, F.coalesce(F.get("starts", i + 1), F.size("turns") + 1) - at), assistant))))
    return cut.select(
        "conv_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"),
        F.transform("parts", lambda p: F.struct(F.length(p["part"]).alias("chars"), p["loss"].alias("loss"))).alias("mask"))


def _blocks(formatted: Column, made) -> Column:
    """``made(role, texts)`` of every block, one array after another. A block is split once."""
    def block(text: Column) -> Column:
        items = F.array(F.split(F.substr(text, F.lit(len(OPEN) + 1)), SPLIT_TEXTS))
        # role, text, nothing, text, nothing ...
        return F.flatten(F.transform(items, lambda x: made(F.get(x, F.lit(0)), F.filter(x, lambda _, i: i % 2 == 1))))

    return F.flatten(F.transform(F.filter(F.split(formatted, CLOSE), lambda b: b != ""), block))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``."""
    return _blocks(formatted, lambda role, texts: F.transform(
        texts, lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text"))))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order; null if the mask is not that of the text. The text is cut at its marks,
    and its parts are held against the runs of the mask."""
    parts = _blocks(formatted, lambda role, texts: F.concat(
        F.array(F.concat(F.lit(OPEN), role)), F.flatten(F.transform(texts, lambda t: F.array(F.lit(BEGIN), t, F.lit(END)))), F.array(F.lit(CLOSE))))
    both = F.zip_with(parts, mask, lambda part, run: F.struct(
        F.when(run["loss"], unescaped(part)).alias("text"), F.coalesce(F.length(part) == run["chars"], F.lit(False)).alias("fits")))
    # one evaluation of the pairs serves both
    return F.transform(F.array(both), lambda x: F.when(F.forall(x, lambda p: p["fits"]), F.array_join(F.transform(x, lambda p: p["text"]), "")))[0]


def digests(written: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted text."""
    back = written.select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("mask")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


# the formatted length adds the template's marks and one star for each mark inside texts and roles
SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM rows),
blocks AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY n) IS DISTINCT FROM role AS opens FROM turns),
lengths AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\**/?(s>|INST\])')) + 13
         + CASE WHEN opens THEN length(role) + len(regexp_extract_all(role, '[<\[]\**/?(s>|INST\])')) + 7 ELSE 0 END AS chars FROM blocks)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM lengths GROUP BY conv_id
"""
