"""Text encodings of files, recognised from their bytes inside Spark tasks."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from twinframe.functions.text import ident

UTF8, UTF16, LATIN1, CP1252 = "utf-8", "utf-16", "iso-8859-1", "cp1252"

# Encoding names as users write them, and the character set Spark's reader accepts for each.
# cp1252 is read as iso-8859-1 and its own characters are put in afterwards.
SPARK_CHARSETS = {
    "utf-8": "UTF-8",
    "utf8": "UTF-8",
    "utf-8-sig": "UTF-8",
    "utf-16": "UTF-16",
    "utf-16le": "UTF-16LE",
    "utf-16be": "UTF-16BE",
    "iso-8859-1": "ISO-8859-1",
    "latin-1": "ISO-8859-1",
    "latin1": "ISO-8859-1",
    "ascii": "US-ASCII",
    "cp1252": "ISO-8859-1",
    "windows-1252": "ISO-8859-1",
}
_CP1252_NAMES = ("cp1252", "windows-1252")

# The bytes 0x80-0x9F that cp1252 defines, as iso-8859-1 and as cp1252 characters.
_HIGH = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", errors="ignore")]
_AS_LATIN1 = "".join(map(chr, _HIGH))
_AS_CP1252 = bytes(_HIGH).decode("cp1252")


def encoding_of(content: Column) -> Column:
    """UTF-8 when the bytes are valid UTF-8, UTF-16 when they start with its byte order mark, else Latin-1."""
    head = F.hex(F.substring(content, 1, 2))
    return (
        F.when(F.is_valid_utf8(content.cast("string")), UTF8).when(head.isin("FFFE", "FEFF"), UTF16).otherwise(LATIN1)
    )


def detect_encoding(files: DataFrame) -> DataFrame:
    """``path`` and ``encoding`` for a frame of ``path`` and ``content``."""
    return files.select("path", encoding_of(F.col("content")).alias("encoding"))


def decoded(content: Column) -> Column:
    """Text of a file's bytes in its recognised encoding, without a byte order mark."""
    kind = encoding_of(content)
    text = (
        F.when(kind == UTF8, F.decode(content, "UTF-8"))
        .when(kind == UTF16, F.decode(content, "UTF-16"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )
    return F.regexp_replace(text, "^﻿", "")


def text_facts(spark: SparkSession, path: str) -> list[Row]:
    """What the reader must know about the text files under ``path``, from one pass over their raw lines.

    One row for all files that are alike in these: ``valid``: every line is UTF-8; ``marked``: a line starts with a UTF-16
    byte order mark; ``open_quotes``: a line holds an odd number of quotes, that is, a quoted cell spans lines; ``head``:
    the first line as it stands. ``files`` has their paths, which the reader lists on the driver in any case. Lines are
    read as bytes, in splits, so large files are looked at by many tasks.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    place = "struct(block, monotonically_increasing_id())"
    each = lines.selectExpr("*", f"{place} AS place").groupBy("file").agg(
        F.expr("bool_and(is_valid_utf8(value))").alias("valid"),
        F.expr("bool_or(hex(substring(CAST(value AS BINARY), 1, 2)) IN ('FFFE', 'FEFF'))").alias("marked"),
        F.expr("bool_or((octet_length(value) - octet_length(replace(value, '\"', ''))) % 2 = 1)").alias("open_quotes"),
        F.expr("hex(CAST(min_by(value, place) AS BINARY))").alias("head"),
    )
    groups = each.groupBy("valid", "marked", "open_quotes", "head").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return groups.orderBy(F.col("files")[0]).collect()


def encoding_from(facts: Row) -> str:
    if facts.valid:
        return UTF8
    return UTF16 if facts.marked else LATIN1


def spark_charset(name: str) -> str:
    charset = SPARK_CHARSETS.get(name.lower().replace("_", "-"))
    if charset is None:
        raise ValueError(f"Unsupported encoding: {name}. Supported: {sorted(SPARK_CHARSETS)}")
    return charset


def restore_cp1252(df: DataFrame, name: str, others: Collection[str] = ()) -> DataFrame:
    """Put in the cp1252 characters of columns that were read as iso-8859-1, all but ``others``."""
    if name.lower() not in _CP1252_NAMES:
        return df
    text = [c for c in df.columns if c not in others]
    return df.select(*[F.translate(F.col(ident(c)), _AS_LATIN1, _AS_CP1252).alias(c) for c in text], *(F.col(ident(c)) for c in others))
