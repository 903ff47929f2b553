"""The chat formatting query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm import chat
from twinframe.session import stage

#: A conversation whose texts hold control strings of templates.
ODD_CONVERSATION, ODD_TEXT = -7, r"\### Assistant: </turn> ok"


def with_odd_conversation(rows: DataFrame) -> DataFrame:
    """``rows`` and conversation -7: a user's and an assistant's turn."""
    odd = rows.sparkSession.range(2).select(
        F.lit(ODD_CONVERSATION).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ODD_TEXT).alias("text"),
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(odd)


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of what is read back from written segments."""
    text = formatted.select(conv_col, "segments", chat.text_of(F.col("segments")).alias("text"))
    read = text.select(
        conv_col,
        chat.turns_of(F.col("text")).alias("turns"),
        chat.learned_text(F.col("segments")).alias("learned"),
        F.char_length("text").cast("long").alias("formatted_chars"),
    )
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_odd_conversation(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return digests(stage(chat.formatted(rows), "chat"))


OP12_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')),
marked AS (
  SELECT *, lag(role) OVER o IS NOT DISTINCT FROM role AND row_number() OVER o > 1 AS merged,
    length(regexp_replace(text, '(\\*)(<(?:turn |/turn>|next/>))', '\1\\\2', 'g')) AS escaped_chars,
    length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '>', ''), chr(10), '')) AS role_chars
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped_chars + CASE WHEN merged THEN 9 ELSE 6 + role_chars + 2 + 9 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
