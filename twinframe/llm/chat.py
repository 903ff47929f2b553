r"""Conversations as one training text each, with the parts of it that a model learns from.

A conversation's turns are collected as structs and sorted, adjacent turns of one role are merged by an array aggregate,
and the text is put together, all in SQL functions:

    <turn user>\n...\n</turn>\n<turn assistant>\n...\n<next/>\n...\n</turn>\n

``<next/>`` stands between merged turns, so they can be told apart again. A text that holds one of the control strings
``<turn ``, ``</turn>`` and ``<next/>`` gets one more backslash in front of each, which reading takes away again; a mark of
the template never stands behind a backslash, as a line break does. Role names have their own escapes.

The text comes as ``segments``: its pieces in order, each with ``loss`` (whether the model learns from it). Exactly the
texts of ``loss_role`` are learned from. The segments' lengths are the loss mask as run lengths.

Conversations of more than ``CHUNK`` turns are numbered, merged and escaped in chunks of as many turns by many tasks; only
finished chunks meet, in order. A conversation's text is one value, so the whole of it has to fit in one row.

Null texts and roles count as empty, null conversation ids form one conversation, null turn numbers come first. Turns of
equal number are ordered by role, then text; repeated rows are turns each. An empty table gives an empty result. Only the
four named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.llm.sharding import numbered
from twinframe.session import stage

CHUNK = 256
LOSS_ROLE = "assistant"
OPEN, CLOSE, NEXT = "<turn ", "\n</turn>\n", "\n<next/>\n"
_CONTROL = r"(<(?:turn |/turn>|next/>))"
_RUNS = "array<struct<role:string,texts:array<string>>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*){_CONTROL}", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\{_CONTROL}", "$1")


def escaped_role(role: Column) -> Column:
    for raw, mark in (("\\", "\\\\"), ("<", "\\l"), (">", "\\g"), ("\n", "\\n")):
        role = F.replace(role, F.lit(raw), F.lit(mark))
    return role


def unescaped_role(role: Column) -> Column:
    def plain(part: Column) -> Column:
        for raw, mark in (("<", "\\l"), (">", "\\g"), ("\n", "\\n")):
            part = F.replace(part, F.lit(mark), F.lit(raw))
        return part

    return F.array_join(F.transform(F.split(role, r"\\\\"), plain), "\\")


def merged(turns: Column) -> Column:
    """Runs of turns of one role, with their escaped texts, from sorted structs of ``role`` and ``text``."""

    def add(runs: Column, turn: Column) -> Column:
        last = F.element_at(runs, -1)
        longer = F.struct(last["role"].alias("role"), F.array_append(last["texts"], escaped(turn["text"])).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(escaped(turn["text"])).alias("texts"))
        same = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["role"] == turn["role"])
        return F.when(same, F.array_append(F.slice(runs, 1, F.size(runs) - 1), longer)).otherwise(F.array_append(runs, fresh))

    return F.aggregate(turns, F.array().cast(_RUNS), add)


def segments_of(runs: Column, loss_role: str, goes_on: Column, stays_open: Column) -> Column:
    """Pieces of text from runs. ``goes_on``: the first run continues the one before; ``stays_open``: the last is continued."""

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def run(each: Column, at: Column) -> Column:
        header = F.concat(F.lit(OPEN), escaped_role(each["role"]), F.lit(">\n"))
        first = F.when((at == 0) & goes_on, F.lit(NEXT)).otherwise(header)
        body = F.transform(
            each["texts"],
            lambda text, i: F.array(piece(F.when(i == 0, first).otherwise(F.lit(NEXT)), F.lit(False)), piece(text, each["role"] == loss_role)),
        )
        is_last = at == F.size(runs) - 1
        footer = F.when(is_last & stays_open, F.lit("")).otherwise(F.lit(CLOSE))
        return F.array_append(F.flatten(body), piece(footer, F.lit(False)))

    return F.flatten(F.transform(runs, run))


def formatted(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = LOSS_ROLE
) -> DataFrame:
    """``conv_col`` and ``segments`` (``text``, ``loss``) of every conversation."""
    turns = rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    lengths = turns.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    long = stage(lengths.select(F.col("conv").alias("long")), "long-conversations")
    is_long = F.col("conv").eqNullSafe(F.col("long"))
    closed = F.lit(False)
    usual = turns.join(long, is_long, "left_anti").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = usual.select("conv", segments_of(merged(F.col("turns")), loss_role, closed, closed).alias("segments"))
    if not long.isEmpty():
        order = [F.col(c) for c in ("conv", "turn", "role", "text")]
        placed = numbered(turns.join(long, is_long, "left_semi"), order, "place").withColumn("chunk", F.floor(F.col("place") / CHUNK))
        whole = whole.union(_long(placed, loss_role))
    return whole.withColumnRenamed("conv", conv_col)


def _long(placed: DataFrame, loss_role: str) -> DataFrame:
    """``conv`` and ``segments`` from turns with ``place`` and ``chunk``."""
    turns = F.sort_array(F.collect_list(F.struct("place", "role", "text")))
    chunks = placed.groupBy("conv", "chunk").agg(turns.alias("turns")).select("conv", "chunk", merged(F.col("turns")).alias("runs"))
    order = Window.partitionBy("conv").orderBy("chunk")
    first, last = F.col("runs")[0]["role"], F.element_at("runs", -1)["role"]
    joined = chunks.withColumns({"goes_on": F.coalesce(F.lag(last).over(order) == first, F.lit(False)), "stays_open": F.coalesce(F.lead(first).over(order) == last, F.lit(False))})
    parts = joined.select("conv", "chunk", segments_of(F.col("runs"), loss_role, F.col("goes_on"), F.col("stays_open")).alias("part"))
    lists = parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("chunk", "part"))).alias("parts"))
    return lists.select("conv", F.flatten(F.transform("parts", lambda p: p["part"])).alias("segments"))


def text_of(segments: Column) -> Column:
    """The formatted text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def mask_of(segments: Column) -> Column:
    """Run lengths in characters, and whether the model learns from each."""
    return F.transform(segments, lambda s: F.struct(F.char_length(s["text"]).alias("length"), s["loss"].alias("loss")))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before escaping, with nothing between."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: unescaped(s["text"])), "")


def turns_of(text: Column) -> Column:
    """The turns (``role``, ``text``) that a formatted text holds, one for each that went in."""
    blocks = F.split(text, CLOSE)

    def read(block: Column) -> Column:
        parts = F.split(block, ">\n", 2)
        role = unescaped_role(F.substring(parts[0], F.lit(len(OPEN) + 1), F.char_length(parts[0])))
        return F.transform(F.split(parts[1], NEXT), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), read))
