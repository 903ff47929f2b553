"""Object borders of JSON files that are read in splits.

Files are read as fragments that end at a closing brace, so a file of one line is split between tasks like any other. What a
fragment does to the reader's state (inside a string or not, depth of brackets) can be told without knowing the state it
begins in: the number of its quotes, and its change of depth for either beginning. These numbers are added up inside each
block of a file and then over its blocks, which gives the state at every fragment, and with it where objects begin and end.
Only the numbers are shuffled for that, some 50 bytes for a fragment.

Layouts: objects one after the other (on lines of their own, or with any space between, or none), and one array of objects.
Files of one object on each line are left to Spark's reader. Others are put together and written to the shared folder with
one object on each line. What stands outside of objects must be what the layout asks for; anything else is an error that
names the file, as are open strings and brackets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from twinframe.session import scratch_path, stage

_ESCAPE, _STRING = r"(?s)\\.", r'"[^"]*+(?:"|$)'
# Sizes of packed files do not tell whether a brace ends them; there the depth has to.
_PACKED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst)$"
_BEFORE, _SO_FAR = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)
_ALL = Window.unboundedPreceding, Window.unboundedFollowing


def fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value`` (up to a closing brace, without it), and its place: ``file``, ``block`` and ``at`` (rising inside a block)."""
    rows = spark.read.text(path, lineSep="}")
    meta = {"file": "file_path", "block": "file_block_start", "bytes": "file_size"}
    picked = rows.select("value", *(F.col(f"_metadata.{name}").alias(alias) for alias, name in meta.items()))
    return picked.withColumn("at", F.monotonically_increasing_id())


def _in_block() -> WindowSpec:
    return Window.partitionBy("file", "block").orderBy("at")


def _in_file() -> WindowSpec:
    return Window.partitionBy("file").orderBy("block")


def _number(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def with_numbers(rows: DataFrame) -> DataFrame:
    """Fragments with what each does to the state, and what of its text the layouts are told by."""
    bare = F.regexp_replace("value", _ESCAPE, "")  # escapes stand in strings only
    quotes = _number(bare, '"')
    outside = [F.regexp_replace(F.concat(F.lit(begin), bare), _STRING, "") for begin in ("", '"')]
    depth = [_number(text, "{[") - _number(text, "]}") for text in outside]
    return rows.withColumns(
        {
            "size": F.octet_length("value") + 1,
            "quotes": quotes,
            "depth0": depth[0],
            "depth1": depth[1],
            "head": F.regexp_extract("value", r"(?s)^[\x{FEFF}\s]*(.?)", 1),
            "fresh": F.col("value").rlike(r"^[ \t\r]*\n\s*\S"),
            "broken": F.contains(F.regexp_replace("value", r"^\s+", ""), F.lit("\n")),
            "wide": F.contains("value", F.lit("\0")),
        }
    )


def located(numbers: DataFrame) -> DataFrame:
    """Every fragment of ``with_numbers`` with ``record`` (objects of its file that end before it), ``opens`` and ``ends`` (it
    is the first or last of an object), ``closed`` (a brace ends it), and of its file ``objects``, ``base`` (depth between
    objects) and ``left_open`` (the state at its end is not that of a whole document)."""
    inner = numbers.drop("value").withColumn("before", F.coalesce(F.sum("quotes").over(_in_block().rowsBetween(*_BEFORE)), F.lit(0)) % 2)
    blocks = inner.groupBy("file", "block").agg(
        F.max("bytes").alias("bytes"),
        F.sum("size").alias("read"),
        F.sum("quotes").alias("quotes"),
        F.sum(_change("depth0", "depth1", 0)).alias("change0"),
        F.sum(_change("depth0", "depth1", 1)).alias("change1"),
        F.min_by(F.when(F.col("head") != "", F.col("head")), F.when(F.col("head") != "", F.col("at"))).alias("head"),
    )
    started = blocks.withColumn("start", F.coalesce(F.sum("quotes").over(_in_file().rowsBetween(*_BEFORE)), F.lit(0)) % 2)
    changed = started.withColumn("change", F.when(F.col("start") == 0, F.col("change0")).otherwise(F.col("change1")))
    whole = Window.partitionBy("file")
    depth, quotes = F.sum("change").over(whole), F.sum("quotes").over(whole) % 2
    # the reader takes a byte order mark of three bytes away; without a brace at the end one byte too many was counted
    missing = F.max("bytes").over(whole) - F.sum("read").over(whole)
    brace = F.when(F.col("file").rlike(_PACKED), depth == 0).otherwise(missing.isin(0, 3))
    states = changed.select(
        F.col("file"),
        F.col("block"),
        F.col("start"),
        F.coalesce(F.sum("change").over(_in_file().rowsBetween(*_BEFORE)), F.lit(0)).alias("start_depth"),
        F.coalesce((F.first("head", ignorenulls=True).over(_in_file().rowsBetween(*_ALL)) == "[").cast("int"), F.lit(0)).alias("base"),
        brace.alias("brace_at_end"),
        ((quotes != 0) | (depth + F.when(brace, 0).otherwise(1) != 0)).alias("left_open"),
        F.lead("block").over(_in_file()).isNull().alias("last_block"),
    )
    known = inner.join(states, ["file", "block"])
    is_last = F.col("last_block") & F.lead("at").over(_in_block()).isNull()
    inside = (F.col("start") + F.col("before")) % 2
    after = (inside + F.col("quotes")) % 2 == 0
    step = F.when(inside == 0, F.col("depth0")).otherwise(F.col("depth1")) - F.when(after, 1).otherwise(0)
    depths = known.withColumns({"closed": ~is_last | F.col("brace_at_end"), "deep": F.col("start_depth") + F.sum(step).over(_in_block().rowsBetween(*_SO_FAR))})
    ended = depths.withColumn("ends", F.col("closed") & after & (F.col("deep") == F.col("base")))
    per_block = ended.groupBy("file", "block").agg(F.count_if("ends").alias("n"), F.max_by("ends", "at").alias("last_ends"))
    offsets = per_block.select(
        "file",
        "block",
        F.coalesce(F.sum("n").over(_in_file().rowsBetween(*_BEFORE)), F.lit(0)).alias("earlier"),
        F.sum("n").over(whole).alias("objects"),
        F.coalesce(F.lag("last_ends").over(_in_file()), F.lit(True)).alias("begins"),
    )
    own = F.coalesce(F.sum(F.col("ends").cast("int")).over(_in_block().rowsBetween(*_BEFORE)), F.lit(0))
    opens = F.coalesce(F.lag("ends").over(_in_block()), F.col("begins"))
    return ended.join(offsets, ["file", "block"]).withColumns({"record": F.col("earlier") + own, "opens": opens})


def _change(outside: str, inside: str, start: int) -> Column:
    """Change of depth over a fragment and its brace, if the block begins inside (1) or outside (0) of a string."""
    here = (F.lit(start) + F.col("before")) % 2
    closing = F.when((here + F.col("quotes")) % 2 == 0, 1).otherwise(0)
    return F.when(here == 0, F.col(outside)).otherwise(F.col(inside)) - closing


def object_lines(spark: SparkSession, path: str) -> str | None:
    """A path whose files have one object on each line: ``path`` itself, or a new folder. None if the files are not in UTF-8.

    Objects of the new folder come in the order of files and objects.
    """
    found = located(stage(with_numbers(fragments(spark, path)).drop("value"), "json-numbers"))
    blank = F.col("head") == ""
    # a line of its own: breaks only before the first fragment of an object, and there always
    fits = F.when(F.col("opens"), (F.col("record") == 0) | F.col("fresh")).otherwise(~F.col("fresh")) & ~F.col("broken")
    behind = (F.col("record") == F.col("objects")) & ~blank
    seen = found.agg(
        F.bool_and((fits | blank) & (F.col("base") == 0) & ~behind).alias("lines"),
        F.bool_or("wide").alias("wide"),
        F.min(F.when(F.col("left_open"), F.col("file"))).alias("open"),
    ).first()
    if seen.wide:
        return None
    if seen.open is not None:
        raise ValueError(f"Not JSON of the expected layout: open string or bracket at the end of {seen.open}")
    return path if seen.lines is None or seen.lines else _written(spark, path)


def _written(spark: SparkSession, path: str) -> str:
    """The objects of ``path`` as a folder of lines. Fragments are staged once, so that all passes see the same places."""
    rows = stage(with_numbers(fragments(spark, path)), "json-fragments")
    found = located(rows).select(F.col("at").alias("place"), "record", "closed", "base", "ends")
    pieces = rows.select("file", "block", "at", "value").join(found, F.col("at") == F.col("place"))
    text = F.concat("value", F.when(F.col("closed"), "}").otherwise(""))
    whole = pieces.withColumn("text", text).repartitionByRange("file", "record").groupBy("file", "record").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "text"))), lambda p: p["text"]), "").alias("text"),
        F.bool_or("ends").alias("is_object"),
        F.max("base").alias("base"),
    )
    clean = F.regexp_replace("text", r"^\x{FEFF}", "")
    start = F.when(F.col("base") == 0, r"^\s*\{").when(F.col("record") == 0, r"^\s*\[\s*\{").otherwise(r"^\s*,\s*\{")
    tail = F.when(F.col("base") == 0, r"^\s*$").when(F.col("record") == 0, r"^\s*\[\s*\]\s*$").otherwise(r"^\s*\]\s*$")
    right = F.regexp_like(clean, F.when(F.col("is_object"), start).otherwise(tail))
    message = F.concat(F.lit("Not JSON of the expected layout: "), F.col("file"), F.lit(" has outside of its objects: "), F.left(F.trim(clean), F.lit(80)))
    checked = whole.where(F.when(right, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).where("is_object")
    line = F.translate(F.regexp_replace(clean, r"^[\s\[,]*", ""), "\r\n", "  ")
    folder = scratch_path(spark, "json-lines")
    checked.sortWithinPartitions("file", "record").select(line.alias("value")).write.text(folder)
    return folder
