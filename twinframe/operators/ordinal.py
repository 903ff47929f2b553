"""Row positions without pulling rows into one task."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions import types as ty
from twinframe.functions.text import ident
from twinframe.session import stage

POSITION = "_pos"
# The offset table has one row per file or split (paths and numbers), so this many rows stay near 20 MB.
BROADCAST_FILES = 100_000
# Fixed value: the part number in the names of staged files, by which they are ordered.
_PART = r"part-(\d+)-"
# Fixed value: pages of staged files are told apart by paths, which differ at their ends only.
_WHOLE_PATHS = {"parquet.columnindex.truncate.length": "4096"}


@dataclass(frozen=True)
class Positions:
    """Rows that stand in files, and runs of rows that follow each other there.

    ``located`` has ``columns`` and of every row its file ``_file``, its number ``_row`` in it and what else tells its run.
    ``runs``, written once, has the columns ``of`` that name a run, its first row number ``_first``, its rows ``_n``,
    whether they are ``_whole`` (no row number is left out) and ``_offset``: position = offset + row number.
    """

    located: DataFrame
    runs: DataFrame
    of: list[str]
    columns: list[str]

    @cached_property
    def whole(self) -> bool:
        return self.runs.where("NOT _whole").isEmpty()

    @cached_property
    def _totals(self) -> tuple[int, int]:
        row = self.runs.agg(F.count("*").alias("runs"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).first()
        return row.runs, row.rows

    @property
    def count(self) -> int:
        return self._totals[1]

    @property
    def parts(self) -> int:
        """How many files or splits the rows are in."""
        return self._totals[0]

    @property
    def rows(self) -> DataFrame:
        return self._numbered(self.located, self.runs)

    def between(self, start: int, end: int) -> DataFrame:
        """The rows from position ``start`` to before ``end``; files, or pages of staged files, without any are not read."""
        start_of = F.col("_offset") + F.col("_first")
        runs = self.runs.where((start_of < end) & (start_of + F.col("_n") > start))
        located = self.located
        if "_origin" in self.of:
            split = F.struct("_origin", "_block")
            first, last = runs.agg(F.min(split), F.max(split)).first()
            located = located.where(F.col("_origin").between(first["_origin"], last["_origin"]))
            if first["_origin"] == last["_origin"]:
                located = located.where(F.col("_block").between(first["_block"], last["_block"]))
        elif self.parts <= BROADCAST_FILES:
            located = located.where(F.col("_file").isin([r["_file"] for r in runs.select("_file").collect()]))
        rows = self._numbered(located, runs)
        return rows.where((F.col(POSITION) >= start) & (F.col(POSITION) < end))

    def _numbered(self, located: DataFrame, runs: DataFrame) -> DataFrame:
        offsets = runs.select(*self.of, "_offset")
        if self.parts <= BROADCAST_FILES:
            offsets = F.broadcast(offsets)
        return located.join(offsets, self.of).select(
            (F.col("_offset") + F.col("_row")).alias(POSITION), *[F.col(ident(c)) for c in self.columns]
        )


def with_position(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """``df`` plus a 0-based position, see ``positions``."""
    return positions(df, order_by).rows


def positions(df: DataFrame, order_by: list[str] | None = None) -> Positions:
    """The 0-based positions of the rows of ``df``.

    With ``order_by`` the rows are sorted by range partitioning and written to the shared folder; ties are
    ordered by the remaining columns, and identical rows are spread by a seeded random number so that a large
    group of copies is split over tasks. Without it the position is the row order of the input files, by path; rows
    that a filter left are numbered without gaps. Rows of files without row numbers are written as their splits are
    read, not sorted: where a split stands among the others and a row in its split gives the position.
    """
    if order_by:
        rest = [f.name for f in df.schema.fields if f.name not in order_by and _sortable(f.dataType)]
        spread = F.rand(17)
        df = df.orderBy(*[F.col(ident(c)) for c in [*order_by, *rest]], spread)
        return _in_files(stage(df, "ordered"), numbered=True)
    names = df.columns
    try:
        found = _in_files(df, numbered=False)
        place = ["_file", "_row"]
    except AnalysisException:
        try:
            origin = F.col("_metadata.file_path").alias("_origin"), F.col("_metadata.file_block_start").alias("_block")
            found = _in_splits(stage(df.select("*", *origin), "located", **_WHOLE_PATHS), names)
            place = ["_origin", "_block", _part(), "_file", "_row"]
        except AnalysisException:  # not a plain file scan: keep the order the rows arrive in
            return _in_files(stage(df, "arrival"), numbered=True)
    if found.whole:  # else a filter left gaps in the row numbers, or the rows of a split were dealt out
        return found
    ordered = found.located.orderBy(*place).select(*[F.col(ident(c)) for c in names])
    return _in_files(stage(ordered, "ordered"), numbered=True)


def _sortable(dtype: T.DataType) -> bool:
    return not ty.contains_map(dtype)


def _part() -> Column:
    return F.regexp_extract("_file", _PART, 1).cast("int")


def _located(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def _in_files(df: DataFrame, numbered: bool) -> Positions:
    """Position = rows in earlier files + row index inside the file."""
    located = _located(df)
    sizes = located.groupBy("_file").agg(F.lit(0).cast("long").alias("_first"), F.count("*").alias("_n"), (F.max("_row") + 1).alias("_size"))
    # Staged files carry their partition number; other inputs are ordered by path.
    return _offsets(located, sizes, ["_file"], [*([_part()] if numbered else []), F.col("_file")], df.columns)


def _in_splits(staged: DataFrame, columns: list[str]) -> Positions:
    """Position = rows in earlier splits + row index in the staged file since the first row of the split.

    A split is read by one task, which writes its rows one after the other.
    """
    located, of = _located(staged), ["_origin", "_block", "_file"]
    first = F.min("_row").alias("_first")
    sizes = located.groupBy(*of).agg(first, F.count("*").alias("_n"), (F.max("_row") - F.min("_row") + 1).alias("_size"))
    return _offsets(located, sizes, of, [F.col("_origin"), F.col("_block"), _part(), F.col("_file")], columns)


def _offsets(located: DataFrame, sizes: DataFrame, of: list[str], order: list[Column], columns: list[str]) -> Positions:
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per file or split, so the running sum is over their counts, not over rows.
    earlier = F.coalesce(F.sum("_size").over(before), F.lit(0))
    runs = sizes.select(*of, "_first", "_n", (F.col("_n") == F.col("_size")).alias("_whole"), (earlier - F.col("_first")).alias("_offset"))
    return Positions(located, stage(runs, "runs"), of, columns)
