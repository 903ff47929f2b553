"""Folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_crc(id_col: str) -> Column:
    """CRC-32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def bounded(rows: DataFrame, id_col: str, most: int, seed: int = 0) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of the id: all rows if there are no more, else an even sample.

    The same ids are chosen whatever the partitioning. The sample may exceed ``most`` by chance by a few hundredths.
    """
    n = rows.count()
    if n <= most:
        return rows
    share = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) < int((1 << 30) * most / n)
    return rows.where(share)


def chosen_texts(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``docs`` rows of a bounded table of ids, with its other columns. The ids are broadcast: their bound is a parameter
    of the caller, so the texts are filtered where they are read and never shuffled."""
    return docs.join(F.broadcast(ids), id_col)
