"""Per-column statistics of both sides: nulls, empty strings, date ranges and distinct values.

Each side is scanned once for nulls, empty strings and date ranges. The statistics of all columns travel as
arrays in one row, so the two sides meet without a join, and one row per column comes back. Only text columns in which
both sides hold values that look like dates are read again, to try the forms of dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions import canon as cn
from twinframe.functions import text as tx
from twinframe.functions import types as ty
from twinframe.operators import messages as m
from twinframe.operators.keys import NULL_MASK
from twinframe.operators.ordinal import POSITION
from twinframe.operators.results import FAIL, PASS, fixed_rows, row_columns, row_sql, union_all
from twinframe.plans.pair import Pair

# How dates inside text may be written: the shape of a value, and its pattern (none: the ISO form). Words
# are capitalised and dashes around named months are blanks before the pattern is tried. Of forms that read equally many
# values of a column the first counts, so month and day are taken in this order where every value allows both.
_TIME = r"([ T][0-9].*)?$"
_MONTH, _DAY = "(0?[1-9]|1[0-2])", "(0?[1-9]|[12][0-9]|3[01])"  # failing to parse costs far more than not to match
DATE_FORMS = (
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}" + _TIME, None),
    (f"^{_MONTH}/{_DAY}/[0-9]{{4}}" + _TIME, "M/d/yyyy[ H:mm[:ss]]"),
    (f"^{_DAY}/{_MONTH}/[0-9]{{4}}" + _TIME, "d/M/yyyy[ H:mm[:ss]]"),
    (f"^[0-9]{{4}}/{_MONTH}/{_DAY}" + _TIME, "yyyy/M/d[ H:mm[:ss]]"),
    (f"^{_DAY}[.]{_MONTH}[.][0-9]{{4}}" + _TIME, "d.M.yyyy[ H:mm[:ss]]"),
    (f"^{_DAY}-{_MONTH}-[0-9]{{4}}" + _TIME, "d-M-yyyy[ H:mm[:ss]]"),
    (f"^{_MONTH}-{_DAY}-[0-9]{{4}}" + _TIME, "M-d-yyyy[ H:mm[:ss]]"),
    (r"^[0-9]{4}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])$", "yyyyMMdd"),
    (f"^{_DAY}[- ][A-Za-z]{{3}}[- ][0-9]{{4}}" + _TIME, "d MMM yyyy[ H:mm[:ss]]"),
    (f"^[A-Za-z]{{3}} {_DAY}, [0-9]{{4}}" + _TIME, "MMM d, yyyy[ H:mm[:ss]]"),
)

# How a value of any of these forms begins: one look tells cells that hold no date.
DATE_START = r"^([0-9]{1,4}[-/. ][0-9A-Za-z]{1,3}[-/. ][0-9]|[0-9]{8}|[A-Za-z]{3} [0-9]{1,2}, )"

SHORTEST_START = 5

# Columns profiled by one aggregate; wider tables are profiled in groups so that generated code stays small.
GROUP_WIDTH, DATE_GROUP_WIDTH = 64, 3
LONG_TEXT = 64


def _may_be_date(x: str) -> str:
    # No date begins with fewer characters than the shortest beginning, so short texts need no pattern.
    return f"(octet_length({x}) >= {SHORTEST_START} AND substring(trim({x}), 1, 12) RLIKE r'{DATE_START}')"


def _read_date(x: str, shape: str, pattern: str | None) -> str:
    if pattern is None:
        value = f"TRY_CAST(trim({x}) AS TIMESTAMP_NTZ)"
    else:
        spelled = f"initcap(replace(trim({x}), '-', ' '))" if "MMM" in pattern else f"trim({x})"
        value = f"CAST(try_to_timestamp({spelled}, '{pattern}') AS TIMESTAMP_NTZ)"
    return f"CASE WHEN trim({x}) RLIKE r'{shape}' THEN {value} END"


def _text_date_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row, ``forms``: per column and form how many values it reads, and the first and last date."""
    forms = range(len(DATE_FORMS))
    readings, aggregates, cells = [], [], []
    for i, x in enumerate(map(tx.ident, columns)):
        read = ", ".join(_read_date(x, *form) for form in DATE_FORMS)
        readings.append(f"CASE WHEN {_may_be_date(x)} THEN array({read}) END AS r{i}")
        for k in forms:
            value = f"get(r{i}, {k})"
            aggregates += [f"count({value}) AS n{i}_{k}", f"min({value}) AS low{i}_{k}", f"max({value}) AS high{i}_{k}"]
        bounds = (f"{tx.timestamp_text(f'low{i}_{k}')} AS low, {tx.timestamp_text(f'high{i}_{k}')} AS high" for k in forms)
        cells.append("array(" + ", ".join(f"struct(n{i}_{k} AS n, {b})" for k, b in zip(forms, bounds)) + ")")
    return df.selectExpr(*readings).selectExpr(*aggregates).selectExpr(f"array({', '.join(cells)}) AS forms")


def _best_form(own: list, other: list | None):
    """The form that reads most values; of equal ones the one that reads more of the other side, then the first."""
    return own[max(range(len(own)), key=lambda k: (own[k].n, other[k].n if other else 0, -k))]


STATISTICS = ("nulls", "empties", "dated", "lows", "highs")


def _side_profile(df: DataFrame, columns: list[str], wanted: list[str], dates: list[bool]) -> DataFrame:
    """One row: an array per statistic, in the order of ``columns``. ``dated`` counts text cells that may be dates."""
    aggregates = {}
    for i, (name, is_date) in enumerate(zip(columns, dates)):
        dtype, x = df.schema[name].dataType, tx.ident(name)
        if "nulls" in wanted:
            aggregates[f"nulls{i}"] = f"count_if({cn.is_missing(x, dtype)})"
        if "empties" in wanted and ty.family(dtype) == ty.STRING:
            aggregates[f"empties{i}"] = f"count_if({x} = '')"
        if "dates" in wanted and is_date:
            if ty.family(dtype) == ty.STRING:
                aggregates[f"dated{i}"] = f"count_if({_may_be_date(x)})"
            else:
                date = f"CAST({x} AS TIMESTAMP_NTZ)"
                aggregates |= {f"lows{i}": f"min({date})", f"highs{i}": f"max({date})"}
    row = df.selectExpr(*[f"{a} AS {n}" for n, a in aggregates.items()] or ["count(*) AS none"])

    def collected(mark: str) -> str:
        names = [f"{mark}{i}" for i in range(len(columns))]
        if mark in ("lows", "highs"):
            cells = [tx.timestamp_text(n) if n in aggregates else "CAST(NULL AS STRING)" for n in names]
        else:
            cells = [n if n in aggregates else "0L" for n in names]
        return f"array({', '.join(cells)}) AS {mark}"

    return row.selectExpr(*[collected(mark) for mark in STATISTICS])


def _profile_group(pair: Pair, columns: list[str], wanted: list[str]) -> DataFrame:
    """One row holding both sides' arrays."""
    dates = [all(ty.family(t) in (ty.DATETIME, ty.STRING) for t in pair.types(c)) for c in columns]
    sides = []
    for mark, df in (("s", pair.source), ("t", pair.target)):
        sides.append(_side_profile(df, columns, wanted, dates).withColumn("side", F.lit(mark)))
    picks = [
        f"any_value(CASE WHEN side = '{mark}' THEN {name} END, true) AS {mark}_{name}"
        for name in STATISTICS
        for mark in ("s", "t")
    ]
    return sides[0].unionByName(sides[1]).selectExpr(*picks)


def column_profile(pair: Pair, wanted: list[str]) -> DataFrame:
    """One row per common column: place, column, and the statistics of both sides."""
    frames = []
    for start in range(0, len(pair.common), GROUP_WIDTH):
        group = pair.common[start : start + GROUP_WIDTH]
        names = ", ".join(tx.literal(c) for c in group)
        arrays = ", ".join(f"{mark}_{name}" for name in STATISTICS for mark in ("s", "t"))
        row = _profile_group(pair, group, wanted).selectExpr(f"array({names}) AS column", "*")
        row = row.selectExpr(f"posexplode(arrays_zip(column, {arrays})) AS (place, z)")
        frames.append(row.selectExpr(f"place + {start} AS place", "z.*"))
    return union_all(frames)


class Profile:
    """Checks answered by column statistics; the statistics come from one job over both sides."""

    def __init__(self, pair: Pair, wanted: list[str]) -> None:
        self.pair = pair
        # As many rows as there are common columns.
        self.rows = column_profile(pair, wanted).orderBy("place").collect() if pair.common else []
        self.ranges = self._date_ranges() if "dates" in wanted else {}

    def _date_ranges(self) -> dict[str, tuple]:
        """First and last date of both sides for columns where both hold some.

        Text is read a second time, where both sides may hold dates; one form is chosen for each side's column, and where
        several read it equally well the other side decides.
        """
        typed = {r.column: ((r.s_lows, r.s_highs), (r.t_lows, r.t_highs)) for r in self.rows}
        both = [r.column for r in self.rows if (r.s_lows or r.s_dated) and (r.t_lows or r.t_dated)]
        found: dict[tuple[int, str], list] = {}
        for side, df in enumerate((self.pair.source, self.pair.target)):
            texts = [c for c in both if ty.family(df.schema[c].dataType) == ty.STRING]
            groups = [texts[k : k + DATE_GROUP_WIDTH] for k in range(0, len(texts), DATE_GROUP_WIDTH)]
            for group in groups:
                forms = _text_date_bounds(df, group).first().forms
                found |= {(side, c): own for c, own in zip(group, forms)}
        ranges = {}
        for column in both:
            bounds = []
            for side in (0, 1):
                own, other = (found.get((k, column)) for k in (side, 1 - side))
                best = _best_form(own, other) if own else None
                bounds += [best.low, best.high] if best else typed[column][side]
            if bounds[0] and bounds[2]:
                ranges[column] = tuple(bounds)
        return ranges

    def nulls(self) -> DataFrame:
        found = [
            {
                "check_no": 5,
                "part": r.place,
                "validation": m.NULLS,
                "result": PASS if r.s_nulls == r.t_nulls else FAIL,
                "column": r.column,
                "detail": m.NULL_COUNTS % (r.s_nulls, r.t_nulls),
                "source_value": r.s_nulls,
                "target_value": r.t_nulls,
            }
            for r in self.rows
            if r.s_nulls or r.t_nulls
        ]
        passed = {"check_no": 5, "validation": m.NULLS, "result": PASS, "detail": m.NO_NULLS}
        return fixed_rows(self.pair.spark, found or [passed | {"source_value": 0, "target_value": 0}])

    def date_ranges(self) -> DataFrame:
        """Columns where both sides hold dates and the first or last date differs."""
        differing = [(r.place, r.column, self.ranges[r.column]) for r in self.rows if r.column in self.ranges]
        found = [
            {
                "check_no": 11,
                "part": place,
                "validation": m.DATE_RANGE,
                "result": FAIL,
                "column": column,
                "detail": m.DATES_DIFFER,
                "source_value": m.DATE_RANGE_TEXT % dates[:2],
                "target_value": m.DATE_RANGE_TEXT % dates[2:],
            }
            for place, column, dates in differing
            if dates[:2] != dates[2:]
        ]
        passed = {"check_no": 11, "validation": m.DATE_RANGE, "result": PASS, "detail": m.DATES_MATCH}
        return fixed_rows(self.pair.spark, found or [passed])

    def empty_strings(self, all_columns: bool = False) -> DataFrame:
        """Exactly empty strings, per side: the first column holding any, with up to three rows.

        Only columns known to hold some are read again, and the filter goes down into the scan.
        """
        frames = []
        for side in (0, 1):
            counts = [(r.place, r.column, (r.s_empties, r.t_empties)[side]) for r in self.rows]
            holding = [c for c in counts if c[2] > 0]
            frames += [self._empty_rows(side, *c) for c in (holding if all_columns else holding[:1])]
        passed = {"check_no": 6, "validation": m.EMPTY_STRING, "result": PASS, "detail": m.NO_EMPTY}
        return union_all(frames) if frames else fixed_rows(self.pair.spark, [passed])

    def _empty_rows(self, side: int, place: int, column: str, count: int) -> DataFrame:
        pair, name = self.pair, ("Source", "Target")[side]
        empty = f"{tx.ident(column)} = ''"
        if pair.keys:
            df = (pair.source, pair.target)[side].where(empty)
            order = pair.shape.order()
            first = df.select(*pair.shape.columns(df.schema)).orderBy(*order)
        else:
            df = (pair.positioned_source, pair.positioned_target)[side].where(empty)
            order = [F.col(POSITION)]
            first = df.select(POSITION).orderBy(*order)
        return (
            first.limit(m.EMPTY_EXAMPLES)
            .select(pair.row_label().alias("pk"), F.row_number().over(Window.orderBy(*order)).alias("i"))
            .select(
                *row_columns(
                    6,
                    m.EMPTY_STRING,
                    FAIL,
                    part=side * len(pair.common) + place,
                    example=F.col("i"),
                    column=column,
                    pk=F.col("pk"),
                    detail=m.EMPTY_FOUND % (name, count),
                    **{f"{name.lower()}_value": "''"},
                )
            )
        )


def _distinct_value(x: str, dtype: T.DataType) -> str:
    """A value in a form that groups exactly like the value but stays short.

    Long text is replaced by its SHA-256, which no short text can equal because of its length.
    """
    kind = ty.family(dtype)
    if kind in (ty.STRING, ty.BINARY):
        text = f"CAST({x} AS STRING)"
        return f"CASE WHEN octet_length({text}) <= {LONG_TEXT} THEN {text} ELSE concat('#', sha2({text}, 256)) END"
    if kind == ty.NESTED:
        return f"sha2({tx.nested_text(x, dtype)}, 256)"
    return cn.nan_as_null(x, dtype)


# Value columns that every type fits into without loss: whole numbers, doubles, texts, dates and times.
_SLOTS = {"i": "BIGINT", "d": "DOUBLE", "s": "STRING", "t": "TIMESTAMP_NTZ"}


def _slot(x: str, dtype: T.DataType) -> tuple[str, str]:
    if ty.is_integral(dtype) or isinstance(dtype, T.BooleanType):
        return "i", x
    if isinstance(dtype, T.TimestampType):
        return "i", f"unix_micros({x})"
    if ty.is_floating(dtype):
        return "d", x
    if isinstance(dtype, (T.DateType, T.TimestampNTZType)):
        return "t", x
    return "s", x


def _side_distinct(df: DataFrame, columns: dict[int, str], mark: str) -> list[DataFrame]:
    """Distinct counts of one side: rows ``c`` (column number), ``n_s`` and ``n_t``, one of them 0.

    Columns of one slot are stacked into (column, value) pairs. A columnar scan reads each column once however
    many slots there are, and pairs of one native type are far cheaper to group than pairs of mixed types.
    """
    members: dict[str, list[str]] = {}
    for i, name in columns.items():
        dtype = df.schema[name].dataType
        slot, value = _slot(_distinct_value(tx.ident(name), dtype), dtype)
        pair = f"named_struct('c', {i}, 'v', CAST({value} AS {_SLOTS[slot]}))"
        members.setdefault(slot, []).append(f"CASE WHEN {value} IS NOT NULL THEN {pair} END")
    counts = [f"{'count(*)' if mark == side else '0L'} AS n_{side}" for side in ("s", "t")]
    return [
        df.selectExpr(f"inline(array({', '.join(stacked)}))")
        .where("c IS NOT NULL")
        .distinct()
        .groupBy("c")
        .agg(*[F.expr(x) for x in counts])
        for stacked in members.values()
    ]


def _key_distinct(pair: Pair, columns: dict[int, int]) -> DataFrame:
    """Distinct counts of both sides for key columns (column number: place in the key), from the key table: it has fewer
    rows than the sides, and one look at a value serves both."""
    stacked = [f"named_struct('c', {c}, 'v', CASE WHEN ({NULL_MASK} & {1 << i}) = 0 THEN _k{i} END)" for c, i in columns.items()]
    values = pair.key_table.selectExpr("ns > 0 AS s", "nt > 0 AS t", f"inline(array({', '.join(stacked)}))").where("v IS NOT NULL")
    once = values.groupBy("c", "v").agg(F.max("s").alias("s"), F.max("t").alias("t"))
    return once.groupBy("c").agg(F.count_if("s").alias("n_s"), F.count_if("t").alias("n_t"))


def distinct_counts(pair: Pair) -> DataFrame:
    """Exact distinct counts per common column and side, nulls left out: rows ``c``, ``n_s``, ``n_t``.

    Pairs are made unique inside each task before the shuffle, which spreads them by value: neither a frequent
    value nor one column lands in one task.
    """
    # Whole-number keys stand in the key table as they are.
    whole = {k for k, t in zip(pair.keys, pair.shape.types) if isinstance(t, T.LongType)} if pair.shape else set()
    by_key = {c: pair.keys.index(name) for c, name in enumerate(pair.common) if name in whole}
    others = {c: name for c, name in enumerate(pair.common) if name not in whole}
    frames = _side_distinct(pair.source, others, "s") + _side_distinct(pair.target, others, "t")
    frames += [_key_distinct(pair, by_key)] if by_key else []
    return union_all(frames).groupBy("c").agg(F.sum("n_s").alias("n_s"), F.sum("n_t").alias("n_t"))


def distinct_check(pair: Pair, estimate: bool = False) -> DataFrame:
    """FAIL per column whose distinct counts differ, else one PASS row.

    With ``estimate`` the counts are estimated, and they differ if they do so by more than four standard errors of both.
    """
    counted, differ = (distinct_counts, "n_s <> n_t")
    if estimate:
        counted, differ = distinct_estimates, f"abs(n_s - n_t) > {4 * SKETCH_ERROR} * sqrt(1D * n_s * n_s + 1D * n_t * n_t)"
    passed = {"check_no": 10, "validation": m.DISTINCT, "result": PASS, "detail": m.DISTINCT_MATCHES}
    if not pair.common:
        return fixed_rows(pair.spark, [passed])
    seed = pair.spark.range(1).selectExpr("-1 AS c", "0L AS n_s", "0L AS n_t")
    names = ", ".join(tx.literal(c) for c in pair.common)
    # As many rows as there are columns, so they may meet in one window.
    rows = counted(pair).unionByName(seed).selectExpr("*", f"count_if({differ}) OVER () AS found")
    return rows.where(f"{differ} OR (c = -1 AND found = 0)").selectExpr(
        *row_sql(
            10,
            f"'{m.DISTINCT}'",
            f"CASE WHEN c = -1 THEN '{PASS}' ELSE '{FAIL}' END",
            part="greatest(c, 0)",
            column=f"CASE WHEN c = -1 THEN '' ELSE get(array({names}), c) END",
            detail=f"CASE WHEN c = -1 THEN '{m.DISTINCT_MATCHES}' ELSE '{m.DISTINCT_DIFFERS}' END",
            source_value="CASE WHEN c = -1 THEN '' ELSE CAST(n_s AS STRING) END",
            target_value="CASE WHEN c = -1 THEN '' ELSE CAST(n_t AS STRING) END",
        )
    )


#: Logarithm of the number of registers of a distinct-count sketch, and the standard error that follows from it.
SKETCH_SIZE = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_SIZE / 2)


def distinct_estimates(pair: Pair, size: int = SKETCH_SIZE) -> DataFrame:
    """Estimated distinct counts per common column and side: rows ``c``, ``n_s`` and ``n_t`` as ``distinct_counts`` has them.

    One sketch per column and task, of at most ``2 ** size`` bytes, is all that is shuffled; sketches merge, so the
    estimate does not depend on how rows are spread. Its relative standard error is ``SKETCH_ERROR`` at the given size.
    """
    frames = []
    for mark, df in (("s", pair.source), ("t", pair.target)):
        for start in range(0, len(pair.common), GROUP_WIDTH):
            cells = []
            for i, name in enumerate(pair.common[start : start + GROUP_WIDTH], start):
                value = _distinct_value(tx.ident(name), df.schema[name].dataType)
                slot, value = _slot(value, df.schema[name].dataType)
                value = f"CAST({value} AS STRING)" if slot in "dt" else value
                cells.append(f"struct({i} AS c, coalesce(hll_sketch_estimate(hll_sketch_agg({value}, {size})), 0L) AS n)")
            rows = df.selectExpr(f"array({', '.join(cells)}) AS cells").selectExpr("inline(cells)")
            frames.append(rows.selectExpr("c", *[f"{'n' if mark == side else '0L'} AS n_{side}" for side in ("s", "t")]))
    return union_all(frames).groupBy("c").agg(F.sum("n_s").alias("n_s"), F.sum("n_t").alias("n_t"))


def source_profile(df: DataFrame) -> DataFrame:
    """One row per column: name, type, null count, and the frame's row and column counts."""
    columns = df.columns
    nulls = [f"count_if({cn.is_missing(tx.ident(f.name), f.dataType)})" for f in df.schema.fields]
    one = df.selectExpr("count(*) AS row_count", f"array({', '.join(nulls)}) AS nulls")
    named = F.arrays_zip(
        F.array(*[F.lit(c) for c in columns]).alias("name"),
        F.array(*[F.lit(df.schema[c].dataType.simpleString()) for c in columns]).alias("dtype"),
        F.col("nulls").alias("null_count"),
    )
    return one.select(F.explode(named).alias("z"), "row_count").select(
        "z.name", "z.dtype", "z.null_count", "row_count", F.lit(len(columns)).cast("long").alias("column_count")
    )
