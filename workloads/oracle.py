"""SQL for the checks, written apart from the Spark code: plain joins, CASE and window functions."""

from __future__ import annotations

from dataclasses import dataclass

from workloads.pairs import plain

COLUMNS = 'validation, result, "column", pk, detail, source_value, target_value'


def row(
    validation: str,
    result: str,
    column: str = "''",
    pk: str = "''",
    detail: str = "''",
    source: str = "''",
    target: str = "''",
) -> str:
    """Select list of one result row; arguments other than the name are SQL expressions."""
    return (
        f"'{validation}' AS validation, {result} AS result, {column} AS \"column\", {pk} AS pk, "
        f"{detail} AS detail, CAST({source} AS VARCHAR) AS source_value, CAST({target} AS VARCHAR) AS target_value"
    )


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')"


def canon(x: str) -> str:
    t = stripped(x)
    digits = f"regexp_replace(regexp_replace({t}, '^[+]', ''), '^(-?)0+([0-9])', '\\1\\2')"
    number = f"CAST({t} AS DOUBLE)"
    return f"""(CASE
      WHEN regexp_matches({t}, '^[+-]?[0-9]+$')
        THEN 'n:' || CASE WHEN {digits} = '-0' THEN '0' ELSE {digits} END
      WHEN regexp_matches({t}, '^[+-]?[0-9]+[.][0-9]*$')
        THEN 'n:' || CASE WHEN {number} = round({number}) THEN CAST(CAST({number} AS BIGINT) AS VARCHAR)
                          ELSE CAST({number} AS VARCHAR) END
      ELSE 's:' || {t} END)"""


def text(x: str, kind: str) -> str:
    return f"CAST({x} AS VARCHAR)" if kind != "string" else x


def present(x: str, kind: str) -> str:
    return f"coalesce({text(x, kind)}, 'None')"


def quoted(x: str) -> str:
    body = f"replace(replace(replace(replace({x}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    return (
        f"(CASE WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"' || {body} || '\"' "
        f"ELSE '''' || replace({body}, '''', '\\''') || '''' END)"
    )


def shown(x: str, kind: str) -> str:
    if kind == "string":
        full = quoted(x)
    elif kind == "timestamp":
        full = f"'Timestamp(''' || CAST({x} AS VARCHAR) || ''')'"
    else:
        full = text(x, kind)
    return f"substr(coalesce({full}, 'None'), 1, 100)"


@dataclass
class SqlPair:
    """Two derivations, the key, and each common column's kind on both sides."""

    source: str
    target: str
    keys: list[str]
    kinds: dict[str, tuple[str, str]]
    reduced: str | None = None  # side reduced to the other side's keys

    @property
    def columns(self) -> list[str]:
        return sorted(self.kinds)

    @property
    def values(self) -> list[str]:
        return [c for c in self.columns if c not in self.keys]

    @property
    def key_list(self) -> str:
        return ", ".join(self.keys)

    def on(self, a: str, b: str) -> str:
        return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in self.keys)

    def label(self, a: str) -> str:
        parts = []
        for k in self.keys:
            parts.append(f"'{k}=' || {shown(f'{a}.{k}', self.kinds[k][0])}")
        return " || ', ' || ".join(parts)

    def ctes(self) -> str:
        """s, t: the sides after reduction; sk, tk: rows per key; s1, t1: first row per key; j: common keys."""
        source, target = plain(self.source), plain(self.target)
        parts = [f"s0 AS ({source})", f"t0 AS ({target})"]
        for side, other in (("s", "t"), ("t", "s")):
            reduced = {"s": "source", "t": "target"}[side] == self.reduced
            where = f" WHERE EXISTS (SELECT 1 FROM {other}0 o WHERE {self.on('o', 'b')})" if reduced else ""
            parts.append(f"{side} AS (SELECT b.* FROM {side}0 b{where})")
        if self.keys:
            order = ", ".join(f"{c} NULLS FIRST" for c in self.values) or "1"
            for side in "st":
                parts.append(f"{side}k AS (SELECT {self.key_list}, count(*) AS n FROM {side} GROUP BY {self.key_list})")
                parts.append(
                    f"{side}1 AS (SELECT * FROM (SELECT *, row_number() OVER "
                    f"(PARTITION BY {self.key_list} ORDER BY {order}) AS _rn FROM {side}) WHERE _rn = 1)"
                )
            fields = ", ".join(
                [f"s1.{k} AS {k}" for k in self.keys]
                + [f"s1.{c} AS s_{c}, t1.{c} AS t_{c}" for c in self.values]
            )
            parts.append(f"j AS (SELECT {fields} FROM s1 JOIN t1 ON {self.on('s1', 't1')})")
            parts.append(f"so AS (SELECT sk.* FROM sk WHERE NOT EXISTS (SELECT 1 FROM tk WHERE {self.on('sk', 'tk')}))")
            parts.append(f"xo AS (SELECT tk.* FROM tk WHERE NOT EXISTS (SELECT 1 FROM sk WHERE {self.on('sk', 'tk')}))")
        return "WITH " + ",\n".join(parts)

    def query(self, *bodies: str) -> str:
        body = "\nUNION ALL\n".join(f"SELECT {COLUMNS} FROM ({b})" for b in bodies)
        return f"{self.ctes()}\n{body}"

    # One SELECT per check.

    def record_count(self) -> str:
        note = " (Note: Smart sub-setting applied - records filtered to matching PKs)" if self.reduced else ""
        detail = f"'Source: ' || a || ' rows, Target: ' || b || ' rows{note}'"
        verdict = "CASE WHEN a = b THEN 'PASS' ELSE 'FAIL' END"
        counts = "(SELECT (SELECT count(*) FROM s) AS a, (SELECT count(*) FROM t) AS b)"
        return f"SELECT {row('record_count_check', verdict, detail=detail, source='a', target='b')} FROM {counts}"

    def subset_note(self) -> str:
        side = self.reduced[0]
        removed = f"((SELECT count(*) FROM {side}0) - (SELECT count(*) FROM {side}))"
        detail = f"'Smart sub-setting removed ' || {removed} || ' rows from {self.reduced.capitalize()}'"
        return f"SELECT {row('record_count_check', repr('INFO'), detail=detail)}"

    def duplicates(self) -> str:
        bodies = []
        for side, name in (("s", "Source"), ("t", "Target")):
            value = "source" if side == "s" else "target"
            groups = f"(SELECT *, sum(n) OVER () AS total FROM {side}k WHERE n > 1)"
            detail = f"'{name} has ' || n || ' duplicate rows (showing first 5 of ' || total || ')'"
            found = row("duplicate_check", "'FAIL'", pk=self.label("g"), detail=detail, **{value: "n"})
            bodies.append(f"(SELECT {found} FROM {groups} g ORDER BY {self.key_list} LIMIT 5)")
            none = row("duplicate_check", "'PASS'", detail=f"'No duplicates found in {name}'", **{value: "'0'"})
            bodies.append(f"SELECT {none} WHERE NOT EXISTS (SELECT 1 FROM {side}k WHERE n > 1)")
        return " UNION ALL ".join(bodies)

    def nulls(self) -> str:
        per = " UNION ALL ".join(
            f"SELECT '{c}' AS c, (SELECT count(*) FROM s WHERE {c} IS NULL) AS a, "
            f"(SELECT count(*) FROM t WHERE {c} IS NULL) AS b"
            for c in self.columns
        )
        detail = "'Source: ' || a || ' nulls, Target: ' || b || ' nulls'"
        found = row("null_check", "CASE WHEN a = b THEN 'PASS' ELSE 'FAIL' END", "c", "''", detail, "a", "b")
        none = row("null_check", "'PASS'", detail="'No null values found in any common columns'", source="'0'", target="'0'")
        return (
            f"WITH per AS ({per}) SELECT {found} FROM per WHERE a > 0 OR b > 0 "
            f"UNION ALL SELECT {none} WHERE (SELECT sum(a + b) FROM per) = 0"
        )

    def empties(self) -> str:
        bodies = []
        for side, name, index in (("s", "Source", 0), ("t", "Target", 1)):
            texts = [c for c in self.columns if self.kinds[c][index] == "string"]
            if not texts:
                continue
            cells = " UNION ALL ".join(
                f"SELECT '{c}' AS c, {self.label('x')} AS pk, {', '.join('x.' + k for k in self.keys)} "
                f"FROM {side} x WHERE x.{c} = ''"
                for c in texts
            )
            detail = f"'{name} contains empty string (showing first 3 of ' || n || ')'"
            value = "source" if side == "s" else "target"
            found = row("empty_string_check", "'FAIL'", "c", "pk", detail, **{value: "''''''"})
            bodies.append(
                f"SELECT {found} FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY {self.key_list}) AS i, "
                f"count(*) OVER (PARTITION BY c) AS n, min(c) OVER () AS first_c FROM ({cells})) "
                "WHERE i <= 3 AND c = first_c"
            )
        none = row("empty_string_check", "'PASS'", detail="'No empty strings found'")
        found = " UNION ALL ".join(bodies)
        return f"WITH e AS ({found}) SELECT * FROM e UNION ALL SELECT {none} WHERE NOT EXISTS (SELECT 1 FROM e)"

    def key_match(self) -> str:
        counts = (
            "(SELECT (SELECT count(*) FROM j) AS c, (SELECT count(*) FROM so) AS a, (SELECT count(*) FROM xo) AS b, "
            "(SELECT count(*) FROM sk) AS x, (SELECT count(*) FROM tk) AS y)"
        )
        detail = "'Common: ' || c || ', Source-only: ' || a || ', Target-only: ' || b"
        verdict = "CASE WHEN a + b = 0 THEN 'PASS' ELSE 'FAIL' END"
        summary = row("primary_key_match", verdict, detail=detail, source="x", target="y")
        bodies = [f"SELECT {summary} FROM {counts}"]
        for name, here, there in (("so", "Source", "Target"), ("xo", "Target", "Source")):
            detail = (
                f"'Primary key exists in {here} but not in {there} (showing first 5 of ' || "
                f"(SELECT count(*) FROM {name}) || ')'"
            )
            present = {here.lower(): "'EXISTS'", there.lower(): "'MISSING'"}
            found = row("primary_key_match", "'FAIL'", pk=self.label(name), detail=detail, **present)
            bodies.append(f"(SELECT {found} FROM {name} ORDER BY {self.key_list} LIMIT 5)")
        return " UNION ALL ".join(bodies)

    def differs(self, c: str, a: str, b: str) -> str:
        left, right = self.kinds[c]
        if left == right != "string":
            return f"({a} IS DISTINCT FROM {b})"
        return f"({canon(text(a, left))} IS DISTINCT FROM {canon(text(b, right))})"

    def values_check(self) -> str:
        cells = " UNION ALL ".join(
            f"SELECT '{c}' AS c, {self.label('j')} AS pk, {self.key_list}, "
            f"{shown(f's_{c}', self.kinds[c][0])} AS sv, {shown(f't_{c}', self.kinds[c][1])} AS tv "
            f"FROM j WHERE {self.differs(c, f's_{c}', f't_{c}')}"
            for c in self.values
        )
        numbered = (
            f"(SELECT *, row_number() OVER (PARTITION BY c ORDER BY {self.key_list}) AS i, "
            f"count(*) OVER (PARTITION BY c) AS n FROM ({cells}))"
        )
        example = row(
            "data_validation", "'FAIL'", "c", "pk", "'Value mismatch (example ' || i || ' of ' || n || ')'", "sv", "tv"
        )
        summary = row("data_validation", "'FAIL'", "c", detail="n || ' mismatches in column ' || c")
        passed = row(
            "data_validation",
            "'PASS'",
            detail=f"'All values match for ' || (SELECT count(*) FROM j) || ' common records across {len(self.columns)} columns'",
        )
        return (
            f"WITH m AS ({numbered}) SELECT {example} FROM m WHERE i <= 3 "
            f"UNION ALL SELECT {summary} FROM m WHERE i = 1 "
            f"UNION ALL SELECT {passed} WHERE NOT EXISTS (SELECT 1 FROM m) AND EXISTS (SELECT 1 FROM j)"
        )

    def distinct(self) -> str:
        per = " UNION ALL ".join(
            f"SELECT '{c}' AS c, (SELECT count(DISTINCT {c}) FROM s) AS a, (SELECT count(DISTINCT {c}) FROM t) AS b"
            for c in self.columns
        )
        found = row("distinct_value_check", "'FAIL'", "c", "''", "'Distinct value count differs'", "a", "b")
        none = row("distinct_value_check", "'PASS'", detail="'All columns have matching distinct value counts'")
        return (
            f"WITH per AS ({per}) SELECT {found} FROM per WHERE a <> b "
            f"UNION ALL SELECT {none} WHERE NOT EXISTS (SELECT 1 FROM per WHERE a <> b)"
        )

    def dates(self) -> str:
        found = [c for c in self.columns if self.kinds[c] == ("timestamp", "timestamp")]
        none = row("date_range_check", "'PASS'", detail="'All date ranges match'")
        if not found:
            return f"SELECT {none}"
        per = " UNION ALL ".join(
            f"SELECT '{c}' AS c, (SELECT min({c}) FROM s) AS a, (SELECT max({c}) FROM s) AS b, "
            f"(SELECT min({c}) FROM t) AS x, (SELECT max({c}) FROM t) AS y"
            for c in found
        )
        differ = row("date_range_check", "'FAIL'", "c", "''", "'Date range mismatch'", "a || ' to ' || b", "x || ' to ' || y")
        return (
            f"WITH per AS ({per}) SELECT {differ} FROM per WHERE a <> x OR b <> y "
            f"UNION ALL SELECT {none} WHERE NOT EXISTS (SELECT 1 FROM per WHERE a <> x OR b <> y)"
        )

    def _text_check(self, name: str, condition: str, detail: str, passed: str, clip: bool) -> str:
        """First row in key order per column with a string on either side; {a} and {b} are the two texts."""
        texts = [c for c in self.values if "string" in self.kinds[c]]
        none = row(name, "'PASS'", detail=f"'{passed}'")
        if not texts:
            return f"SELECT {none}"
        cells = " UNION ALL ".join(
            f"SELECT '{c}' AS c, {self.key_list}, {present(f's_{c}', self.kinds[c][0])} AS a, "
            f"{present(f't_{c}', self.kinds[c][1])} AS b FROM j"
            for c in texts
        )
        a, b = ("substr({}, 1, 100)".format(quoted("a")), "substr({}, 1, 100)".format(quoted("b"))) if clip else ("a", "b")
        found = row(name, "'FAIL'", "c", "''", detail, a, b)
        return (
            f"WITH m AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY {self.key_list}) AS i "
            f"FROM ({cells}) WHERE {condition}) "
            f"SELECT {found} FROM m WHERE i = 1 UNION ALL SELECT {none} WHERE NOT EXISTS (SELECT 1 FROM m)"
        )

    def casing(self) -> str:
        return self._text_check(
            "case_sensitivity_check",
            "lower(a) = lower(b) AND a <> b",
            "'Case difference detected: ''' || a || ''' vs ''' || b || ''''",
            "No case sensitivity mismatches found",
            False,
        )

    def zeros(self) -> str:
        return self._text_check(
            "leading_zero_check",
            "starts_with(a, '0') <> starts_with(b, '0') "
            "AND regexp_replace(a, '0', '') = regexp_replace(b, '0', '')",
            "'Leading zero mismatch: ''' || a || ''' vs ''' || b || ''''",
            "No leading zero mismatches found",
            False,
        )

    def special(self) -> str:
        return self._text_check(
            "special_char_check",
            "(strlen(a) = length(a)) <> (strlen(b) = length(b))",
            "'Special/Unicode character difference detected'",
            "No special character integrity issues found",
            True,
        )

    def checksums(self) -> str:
        def digest(side: str, index: int) -> str:
            parts = ", ".join(present(f"{side}_{c}", self.kinds[c][index]) for c in self.values)
            return f"md5(concat_ws('|', {parts}))"

        found = row(
            "checksum_check", "'FAIL'", "''", self.label("m"), "'Row checksum mismatch'", "substr(a, 1, 16)", "substr(b, 1, 16)"
        )
        more = row("checksum_check", "'INFO'", detail="'... and ' || (n - 5) || ' more checksum mismatches'")
        none = row("checksum_check", "'PASS'", detail="'All ' || (SELECT count(*) FROM j) || ' row checksums match'")
        return (
            f"WITH m AS (SELECT *, row_number() OVER (ORDER BY {self.key_list}) AS i, count(*) OVER () AS n FROM "
            f"(SELECT *, {digest('s', 0)} AS a, {digest('t', 1)} AS b FROM j) WHERE a <> b) "
            f"SELECT {found} FROM m WHERE i <= 5 UNION ALL SELECT {more} FROM m WHERE i = 1 AND n > 5 "
            f"UNION ALL SELECT {none} WHERE NOT EXISTS (SELECT 1 FROM m)"
        )

    def symmetric(self) -> str:
        counts = "(SELECT (SELECT count(*) FROM so) AS a, (SELECT count(*) FROM xo) AS b)"
        detail = "'Symmetric difference: ' || (a + b) || ' records (Source-only: ' || a || ', Target-only: ' || b || ')'"
        verdict = "CASE WHEN a + b = 0 THEN 'PASS' ELSE 'FAIL' END"
        return f"SELECT {row('symmetric_difference_check', verdict, detail=detail, source='a', target='b')} FROM {counts}"

    def literal(self, rows: list[tuple]) -> str:
        """Result rows that follow from the two schemas alone."""
        def quote(value: object) -> str:
            return "'" + str(value).replace("'", "''") + "'"

        return " UNION ALL ".join(
            "SELECT " + row(r[0], quote(r[1]), quote(r[2]), "''", quote(r[3]), quote(r[4]), quote(r[5])) for r in rows
        )
