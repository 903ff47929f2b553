"""Checks on matched rows: cell values, case, leading zeros, characters and row checksums.

All of them read one join. A row is looked at closely only when some column differs as written; its findings
are then counted per check and column, and the first few per check and column are kept as examples.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions import cells
from twinframe.functions import text as tx
from twinframe.operators import messages as m
from twinframe.operators.ordinal import POSITION
from twinframe.operators.results import FAIL, INFO, PASS, SKIP, fixed_rows, row_sql
from twinframe.plans.pair import Pair
from twinframe.session import stage

VALUE, CASING, ZERO, SPECIAL, HASH = 7, 12, 13, 14, 15
CHECK_NAMES = {VALUE: m.DATA, CASING: m.CASE, ZERO: m.LEADING_ZERO, SPECIAL: m.SPECIAL_CHAR, HASH: m.CHECKSUM}
EXAMPLES = {VALUE: m.VALUE_EXAMPLES, CASING: 1, ZERO: 1, SPECIAL: 1, HASH: m.CHECKSUM_EXAMPLES}
ROW_LEVEL = -1  # column number of findings about a whole row
SEED = -2  # column number of the row that stands for "this check ran"


def row_hash(schema: T.StructType, columns: list[str]) -> Column:
    """MD5 of the row's value texts joined by a bar."""
    texts = [tx.present_text(tx.ident(c), schema[c].dataType) for c in columns]
    return F.expr(f"md5(concat_ws('|', {', '.join(texts)}))")


class RowChecks:
    """Builds the findings of the chosen checks over the matched rows of a pair."""

    def __init__(
        self,
        pair: Pair,
        checks: list[int],
        robust_zeros: bool = False,
        checksum_columns: str = "common",
    ) -> None:
        self.pair = pair
        self.checks = checks
        self.robust_zeros = robust_zeros
        self.columns = pair.common
        self.hash_all = HASH in checks and checksum_columns == "all"
        self.source_columns, self.target_columns = list(pair.common), list(pair.common)
        if self.hash_all:
            self.source_columns += [c for c in pair.source_schema.names if c not in pair.common]
            self.target_columns += [c for c in pair.target_schema.names if c not in pair.common]

    def matched(self, between: tuple[int, int] | None = None) -> tuple[DataFrame, list[str]]:
        return self.pair.matched(self.source_columns, self.target_columns, between)

    def _hash(self, mark: str, names: list[str], schema: T.StructType, own: list[str]) -> str:
        """Row hash written over an array of cells, so that its code does not grow with the columns."""
        chosen = [c for c in (own if self.hash_all else self.columns) if c not in self.pair.keys]
        if not chosen:
            return "md5('')"
        types = [schema[c].dataType for c in chosen]
        texts = ", ".join(cells.raw(f"{mark}_{names.index(c)}", t) for c, t in zip(chosen, types))
        kinds = ", ".join(f"'{cells.kind_of(t)}'" for t in types)
        spelled = f"zip_with(array({texts}), array({kinds}), (cell, kind) -> {cells.plain_text('cell', 'kind')})"
        return f"md5(array_join({spelled}, '|'))"

    def _hashes(self) -> tuple[str, str]:
        pair = self.pair
        return (
            self._hash("s", self.source_columns, pair.full_source.schema, pair.source_schema.names),
            self._hash("t", self.target_columns, pair.full_target.schema, pair.target_schema.names),
        )

    @cached_property
    def _differing(self) -> tuple[DataFrame, list[str]]:
        """Matched rows that some cell tells apart, and their names. They are written once: counts and examples read them,
        so the sides are joined a single time, rows without keys by ranges of positions. Rows equal in every cell, most as
        a rule, are not written."""
        found = None if self.hash_all else self.pair.differing()
        if found is not None:
            return stage(found[0], "differing"), found[1]
        flags = [cells.may_differ(*p[1:]) for p in self.pair.cells()]
        if self.hash_all:
            flags.append(" <> ".join(self._hashes()))
        slices = [None] if self.pair.comparable_by_key else self.pair.slices()
        found = [self.matched(between if len(slices) > 1 else None) for between in slices]
        frames = (rows.where(" OR ".join(flags) or "false") for rows, _ in found)
        return stage(next(frames), "differing", *frames), found[0][1]

    def _row_differs(self) -> str:
        """Whether the hashes of a row's sides differ; told by the texts that go into them where that is cheaper."""
        if self.hash_all:
            return " <> ".join(self._hashes())
        spelled = [cells.text_differs(*p[1:]) for p in self.pair.cells() if self.columns[p[0]] not in self.pair.keys]
        return " OR ".join(spelled) or "false"

    @cached_property
    def findings(self) -> tuple[DataFrame, list[str]]:
        """One row per finding: row names, check ``f``, column number ``c`` and the two cells ``sv``, ``tv`` (empty where a
        finding is about the row). They are written once, for counts and examples.

        Differing rows are taken apart into differing cells, and the checks look at cells, not at columns. Cells of one
        pair of kinds go together, as code for all kinds at once is too long for the JVM to compile.
        """
        rows, names = self._differing
        sure, kinds = [], {}
        for p in self.pair.cells():
            sk, tk = cells.kind_of(p[3]), cells.kind_of(p[4])
            if sk != tk or sk not in cells.DIFFER_AS_THEY_ARE:
                kinds.setdefault((sk, tk), []).append(p)
            elif VALUE in self.checks and self.columns[p[0]] not in self.pair.keys:
                sure.append(p)

        def taken(pairs: list[tuple]) -> DataFrame:
            return rows.selectExpr(*names, f"inline(array({', '.join(cells.differing_cell(*p) for p in pairs)}))").where("c IS NOT NULL")

        frames = [taken(sure).selectExpr(*names, f"{VALUE} AS f", "c", "sv", "tv")] if sure else []
        tests = ", ".join(f"CASE WHEN {test} THEN {check} END" for check, test in self._tests() if check != HASH)
        for (sk, tk), pairs in kinds.items() if tests else ():
            found = cells.described(taken(pairs).withColumns({"sk": F.lit(sk), "tk": F.lit(tk)}), {"sv": "sk", "tv": "tk"})
            frames.append(found.selectExpr(*names, f"explode(array({tests})) AS f", "c", "sv", "tv").where("f IS NOT NULL"))
        if HASH in self.checks:
            frames.append(rows.where(self._row_differs()).selectExpr(*names, f"{HASH} AS f", f"{ROW_LEVEL} AS c", "'' AS sv", "'' AS tv"))
        nothing = rows.where("false").selectExpr(*names, "0 AS f", "0 AS c", "'' AS sv", "'' AS tv")
        return stage(reduce(DataFrame.unionByName, frames, nothing), "findings"), names

    def _described(self, cell_rows: DataFrame) -> DataFrame:
        """Cells with their kinds ``sk`` and ``tk`` and the texts the checks compare."""
        kinds = {}
        for side, name in enumerate(("sk", "tk")):
            listed = ", ".join(f"'{cells.kind_of(self.pair.types(c)[side])}'" for c in self.columns)
            kinds[name] = F.expr(f"get(array({listed or repr('')}), c)")
        return cells.described(cell_rows.withColumns(kinds), {"sv": "sk", "tv": "tk"})

    def _tests(self) -> list[tuple[int, str]]:
        # Case, zeros and characters can only differ where at least one side is a text.
        texty = f"c >= 0 AND ({cells.is_texty('sk')} OR {cells.is_texty('tk')})"
        s, t = "sv_plain", "tv_plain"
        bare = tx.drop_leading_zeros if self.robust_zeros else tx.drop_first_zero
        value_cell = " AND ".join(["c >= 0", *[f"c <> {i}" for i, n in enumerate(self.columns) if n in self.pair.keys]])
        tests = {
            VALUE: f"{value_cell} AND {cells.differs('sk', 'tk', 'sv_canon', 'tv_canon')}",
            CASING: f"{texty} AND lower({s}) = lower({t}) AND {s} <> {t}",
            ZERO: f"{texty} AND startswith({s}, '0') <> startswith({t}, '0') AND {bare(s)} = {bare(t)}",
            SPECIAL: f"{texty} AND {tx.is_ascii(s)} <> {tx.is_ascii(t)}",
            HASH: f"c = {ROW_LEVEL}",
        }
        return [(check, tests[check]) for check in self.checks]

    def report(self) -> DataFrame:
        """Counts, examples and one seed row per check, seen together; every input row is one of a few."""
        found, names = self.findings
        counts = found.groupBy("f", "c").agg(F.count(F.lit(1)).alias("n"))
        seeds = self.pair.spark.range(1).selectExpr(
            f"explode(array({', '.join(map(str, self.checks))})) AS f", f"{SEED} AS c", "0L AS n"
        )
        totals = counts.unionByName(seeds).selectExpr("f", "c", "n", "0 AS i", "'' AS pk", "'' AS sv", "'' AS tv")
        if self.pair.comparable_by_key or VALUE not in self.checks:
            examples = self._first_per_column(found.where(f"f <> {HASH}"), names)
            if HASH in self.checks:
                examples = examples.unionByName(self._first_hashes(names))
        else:
            # Keyless value examples are capped over all columns together, in row order.
            rowwise = found.where(f"f = {VALUE}").orderBy(POSITION, "c").limit(m.POSITION_EXAMPLES)
            examples = rowwise.withColumn("i", F.row_number().over(Window.orderBy(POSITION, "c")))
            if len(self.checks) > 1:
                examples = examples.unionByName(self._first_per_column(found.where(f"f <> {VALUE}"), names))
        examples = self._described(examples).select(
            "f",
            "c",
            F.lit(None).cast("long").alias("n"),
            "i",
            self.pair.row_label().alias("pk"),
            self._shown("sv", "sk"),
            self._shown("tv", "tk"),
        )
        both = totals.unionByName(examples).selectExpr(
            "f", "c", "i", "pk", "sv", "tv", "max(n) OVER (PARTITION BY f, c) AS n",
            "sum(CASE WHEN i = 0 THEN n END) OVER (PARTITION BY f) AS total",
        )
        return both.where(self._kept()).selectExpr(*self._row())

    def _shown(self, x: str, kind: str) -> Column:
        """How the report spells a cell of an example."""
        plain = f"{x}_plain"
        return F.expr(
            f"""CASE f
              WHEN {HASH} THEN substring({x}, 1, {m.HASH_DIGITS})
              WHEN {VALUE} THEN {tx.clipped(cells.shown(x, kind, plain))}
              WHEN {SPECIAL} THEN {tx.clipped(tx.quoted(plain))}
              ELSE {plain} END"""
        ).alias(x)

    def _first_per_column(self, found: DataFrame, names: list[str]) -> DataFrame:
        """First findings per check and column; each task keeps its own first few before the shuffle."""
        place = F.row_number().over(Window.partitionBy("f", "c").orderBy(*names))
        limits = " ".join(f"WHEN {check} THEN {limit}" for check, limit in EXAMPLES.items())
        kept = found.withColumn("i", place).where(f"i <= {max(EXAMPLES.values())}")
        return kept.where(f"i <= CASE f {limits} END")

    def _first_hashes(self, names: list[str]) -> DataFrame:
        """First rows whose hashes differ. Only these few rows are hashed."""
        first = self._differing[0].where(self._row_differs()).orderBy(*names).limit(EXAMPLES[HASH])
        s_hash, t_hash = self._hashes()
        i = F.row_number().over(Window.orderBy(*names)).alias("i")
        return first.selectExpr("*", f"{HASH} AS f", f"{ROW_LEVEL} AS c", f"{s_hash} AS sv", f"{t_hash} AS tv").select(*names, "f", "c", "sv", "tv", i)

    def _overflow(self) -> str:
        """Rows that say how many findings are not shown."""
        overflow = f"(f = {HASH} AND c = {ROW_LEVEL} AND total > {m.CHECKSUM_EXAMPLES})"
        if not self.pair.comparable_by_key:
            overflow += f" OR (f = {VALUE} AND c = {SEED} AND total > {m.POSITION_EXAMPLES})"
        return f"(i = 0 AND ({overflow}))"

    def _kept(self) -> str:
        """Which bookkeeping rows become result rows; examples always do."""
        summary = f"f = {VALUE} AND c >= 0" if self.pair.comparable_by_key else "false"
        return f"i > 0 OR (c = {SEED} AND total = 0) OR ({summary}) OR {self._overflow()}"

    def _row(self) -> list[str]:
        pair, keyed, width = self.pair, self.pair.comparable_by_key, len(self.columns)
        names = ", ".join(tx.literal(c) for c in self.columns) or "''"
        column = f"CASE WHEN c >= 0 THEN get(array({names}), c) ELSE '' END"
        passed, overflow = f"(c = {SEED} AND total = 0)", self._overflow()
        if keyed:
            all_match = m.ALL_VALUES_MATCH.format(k=pair.stats.common, c=width)
            example = f"format_string('{m.VALUE_MISMATCH}', i, n)"
        else:
            rows = min(pair.stats.source_rows, pair.stats.target_rows)
            all_match = m.ALL_POSITIONS_MATCH.format(n=rows, c=width)
            example = f"'{m.POSITION_MISMATCH}'"
        passes = {
            VALUE: all_match,
            CASING: m.CASE_MATCHES,
            ZERO: m.ZERO_MATCHES,
            SPECIAL: m.SPECIAL_MATCHES,
            HASH: m.CHECKSUMS_MATCH.format(n=pair.stats.common),
        }
        detail = f"""CASE
          WHEN {passed} THEN CASE f {' '.join(f"WHEN {f} THEN '{text}'" for f, text in passes.items())} END
          WHEN {overflow} AND f = {HASH} THEN format_string('{m.MORE_CHECKSUMS}', total - {m.CHECKSUM_EXAMPLES})
          WHEN {overflow} THEN format_string('{m.MORE_POSITIONS}', total - {m.POSITION_EXAMPLES})
          WHEN f = {VALUE} AND i > 0 THEN {example}
          WHEN f = {VALUE} THEN format_string('{m.COLUMN_MISMATCHES}', n, {column})
          WHEN f = {CASING} THEN format_string({tx.literal(m.CASE_DIFFERS)}, sv, tv)
          WHEN f = {ZERO} THEN format_string({tx.literal(m.ZERO_DIFFERS)}, sv, tv)
          WHEN f = {SPECIAL} THEN '{m.SPECIAL_DIFFERS}'
          ELSE '{m.CHECKSUM_DIFFERS}' END"""
        # Value rows follow the key match rows of check 7; an overflow row follows its examples.
        return row_sql(
            "f",
            f"CASE f {' '.join(f'WHEN {f} THEN {name!r}' for f, name in CHECK_NAMES.items())} END",
            f"CASE WHEN {passed} THEN '{PASS}' WHEN {overflow} THEN '{INFO}' ELSE '{FAIL}' END",
            part=f"CASE WHEN f = {VALUE} THEN 10 ELSE 0 END + "
            + ("greatest(c, 0)" if keyed else f"CASE WHEN f = {VALUE} THEN 0 ELSE greatest(c, 0) END"),
            example=f"CASE WHEN {overflow} THEN {2**31 - 1} ELSE i END",
            column=column,
            pk=f"CASE WHEN i > 0 AND f IN ({VALUE}, {HASH}) THEN pk ELSE '' END",
            detail=detail,
            source_value="sv",
            target_value="tv",
        )


def row_checks(pair: Pair, checks: list[int], **options) -> DataFrame | None:
    """The chosen checks over matched rows, or the rows that say why they were left out."""
    fixed, run = [], list(checks)
    if not pair.keys and pair.configured_keys and VALUE in run:
        run.remove(VALUE)
        lost = [
            [k for k in pair.configured_keys if k not in schema.names]
            for schema in (pair.source_schema, pair.target_schema)
        ]
        detail = m.KEY_COLUMNS_MISSING.format(s=lost[0], t=lost[1])
        fixed.append({"check_no": 7, "part": 10, "validation": m.DATA, "result": FAIL, "detail": detail})
    if not pair.keys and HASH in run:
        run.remove(HASH)
        fixed.append({"check_no": 15, "validation": m.CHECKSUM, "result": SKIP, "detail": m.NO_KEY})
    if pair.keys and pair.stats.common == 0 and VALUE in run:
        run.remove(VALUE)  # nothing to compare and nothing to report
    frames = [fixed_rows(pair.spark, fixed)] if fixed else []
    if run:
        frames.append(RowChecks(pair, run, **options).report())
    return reduce(DataFrame.unionByName, frames) if frames else None
