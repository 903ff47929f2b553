"""The two sides of a validation and what is known about their keys."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from twinframe.functions import cells
from twinframe.functions import types as ty
from twinframe.functions.canon import canon
from twinframe.functions.text import ident, nested_text
from twinframe.operators import keys as ks
from twinframe.operators.align import common_columns
from twinframe.operators.ordinal import POSITION, Positions, positions
from twinframe.session import stage

# Above this share of rows with repeated keys, parting them from the others costs more than it saves.
REPEATED_SHARE = 0.1
# Up to this many rows of each key, rows are shuffled without combining those of a key inside each task first.
MANY_COPIES = 10_000
# Rows without keys are brought together in so many ranges of positions at most, of so many rows of a side at least.
SLICES, SLICE_ROWS = 16, 10_000_000


@dataclass(frozen=True)
class KeyStats:
    """Counts over the key table, taken after the larger side was reduced if it was."""

    source_rows: int
    target_rows: int
    source_keys: int = 0
    target_keys: int = 0
    common: int = 0
    source_only: int = 0
    target_only: int = 0
    source_dup_rows: int = 0
    target_dup_rows: int = 0
    most_copies: int = 0  # rows of the most frequent key of a side
    reduced: str | None = None  # side reduced to the other side's keys
    removed_rows: int = 0


def _comparable(df: DataFrame) -> DataFrame:
    """Maps have no order, so they are carried as sorted JSON text; untyped nulls become text nulls."""

    def shaped(field):
        name = ident(field.name)
        if isinstance(field.dataType, NullType):
            return F.col(name).cast("string").alias(field.name)
        if ty.contains_map(field.dataType):
            return F.expr(nested_text(name, field.dataType)).alias(field.name)
        return F.col(name)

    if not any(isinstance(f.dataType, NullType) or ty.contains_map(f.dataType) for f in df.schema.fields):
        return df
    return df.select(*[shaped(f) for f in df.schema.fields])


def _marked(columns: list[str], mark: str) -> list:
    return [F.col(ident(c)).alias(f"{mark}_{i}") for i, c in enumerate(columns)]


class Pair:
    """Source and target with aligned column names."""

    def __init__(
        self,
        source: DataFrame,
        target: DataFrame,
        keys: list[str] | None = None,
        *,
        key_mode: str = "strict",
        subset: bool = True,
        stage_subset: bool = False,
        order_by: list[str] | None = None,
        already_reduced: bool = False,
    ) -> None:
        self.source_schema, self.target_schema = source.schema, target.schema
        self.full_source, self.full_target = _comparable(source), _comparable(target)
        self.configured_keys = list(keys or [])
        self.keys = [k for k in self.configured_keys if k in source.columns and k in target.columns]
        self.common = common_columns(source.columns, target.columns)
        self.subset = subset
        self.stage_subset = stage_subset
        self.order_by = [c for c in order_by or [] if c in self.common]
        self.already_reduced = already_reduced
        self.shape = (
            ks.KeyShape.of(self.full_source.schema, self.full_target.schema, self.keys, key_mode)
            if self.keys
            else None
        )

    @property
    def spark(self):
        return self.full_source.sparkSession

    @property
    def comparable_by_key(self) -> bool:
        """True when every row has a key: some were configured and at least one exists on both sides."""
        return bool(self.keys)

    @property
    def value_columns(self) -> list[str]:
        return [c for c in self.common if c not in self.keys]

    def types(self, column: str):
        return self.full_source.schema[column].dataType, self.full_target.schema[column].dataType

    def cells(self) -> list[tuple]:
        """Column pairs that can differ; key columns only where the join compares them by value."""
        skipped = self.keys if self.shape and self.shape.mode == "strict" else []
        return [(i, f"s_{i}", f"t_{i}", *self.types(c)) for i, c in enumerate(self.common) if c not in skipped]

    @cached_property
    def full_key_table(self) -> DataFrame:
        """Written once: the counts that plan a run, the duplicate and key checks and the split of repeated keys read it."""
        return stage(ks.key_table(self.full_source, self.full_target, self.shape), "keys")

    @cached_property
    def stats(self) -> KeyStats:
        """One pass over the key columns alone; a single row comes back.

        It decides the plan of the wide passes: whether a side is reduced, and whether a side needs
        de-duplication before the join.
        """
        if not self.comparable_by_key:
            # Where positions are known, the rows are counted and text need not be read once more.
            known = [self.__dict__.get(f"{side}_positions", getattr(self, f"full_{side}").count) for side in ("source", "target")]
            return KeyStats(*(k.count if isinstance(k, Positions) else k() for k in known))
        both, ns, nt = (F.col("ns") > 0) & (F.col("nt") > 0), F.col("ns"), F.col("nt")

        def total(value, when=F.lit(True)):
            return F.coalesce(F.sum(F.when(when, value)), F.lit(0))

        row = self.full_key_table.agg(
            total(ns).alias("s_rows"),
            total(nt).alias("t_rows"),
            total(ns, both).alias("s_rows_both"),
            total(nt, both).alias("t_rows_both"),
            F.count_if(both).alias("common"),
            F.count_if(nt == 0).alias("s_only"),
            F.count_if(ns == 0).alias("t_only"),
            total(ns, ns > 1).alias("s_dup"),
            total(nt, nt > 1).alias("t_dup"),
            total(ns, both & (ns > 1)).alias("s_dup_both"),
            total(nt, both & (nt > 1)).alias("t_dup_both"),
            F.coalesce(F.max(F.greatest(ns, nt)), F.lit(0)).alias("most"),
        ).first()
        reduce_target = self.subset and row.s_rows < row.t_rows and row.common > 0
        reduce_source = self.subset and row.s_rows > row.t_rows and row.common > 0
        s_only = 0 if reduce_source else row.s_only
        t_only = 0 if reduce_target else row.t_only
        return KeyStats(
            source_rows=row.s_rows_both if reduce_source else row.s_rows,
            target_rows=row.t_rows_both if reduce_target else row.t_rows,
            source_keys=row.common + s_only,
            target_keys=row.common + t_only,
            common=row.common,
            source_only=s_only,
            target_only=t_only,
            source_dup_rows=row.s_dup_both if reduce_source else row.s_dup,
            target_dup_rows=row.t_dup_both if reduce_target else row.t_dup,
            most_copies=row.most,
            reduced="source" if reduce_source else "target" if reduce_target else None,
            removed_rows=(row.s_rows - row.s_rows_both if reduce_source else 0)
            + (row.t_rows - row.t_rows_both if reduce_target else 0),
        )

    @property
    def subset_applied(self) -> bool:
        return self.already_reduced or self.stats.reduced is not None

    @cached_property
    def key_table(self) -> DataFrame:
        """The key table after reduction."""
        kept = {"source": "nt > 0", "target": "ns > 0", None: "true"}[self.stats.reduced]
        return self.full_key_table.where(kept)

    @cached_property
    def source(self) -> DataFrame:
        return self._side("source", self.full_source)

    @cached_property
    def target(self) -> DataFrame:
        return self._side("target", self.full_target)

    def _side(self, name: str, own: DataFrame) -> DataFrame:
        if self.stats.reduced != name:
            return own
        if self._met is not None:
            return self._met.drop(self._other)
        reduced = ks.keep_keys(own, self.full_key_table.where("ns > 0 AND nt > 0"), self.shape)
        return stage(reduced, f"{name}-subset") if self.stage_subset else reduced

    @property
    def _other(self) -> str:
        """Name of the column of ``_met`` beside those of the reduced side."""
        taken, name = self.full_source.columns + self.full_target.columns, "_other"
        while name in taken:
            name += "_"
        return name

    @cached_property
    def _met(self) -> DataFrame | None:
        """The reduced side, written once, with the other side's first row of the key in ``_other`` where a row is the first
        of its key and some cell may differ. So one join both reduces the side and compares the rows.

        ``None`` if no side is reduced, the reduced side is not staged, most of its rows go (what remains is then cheaper to
        find by keys alone), or a key has so many rows that no task should see all of them.
        """
        stats = self.stats
        if not self.stage_subset or not stats.reduced or stats.most_copies > MANY_COPIES:
            return None
        sides = [
            ("s", self.full_source, stats.source_dup_rows, stats.source_rows),
            ("t", self.full_target, stats.target_dup_rows, stats.target_rows),
        ]
        (mark, own, repeated, kept), (other, df, *counts) = sides if stats.reduced == "source" else sides[::-1]
        if stats.removed_rows > kept:
            return None
        held = {c: f"o_{i}" for i, c in enumerate(own.columns)}
        rows = ks.keyed(own, self.shape, *[F.col(ident(c)).alias(o) for c, o in held.items()])
        named = {f"{mark}_{i}": held[c] for i, c in enumerate(self.common)}
        flags = [cells.may_differ(named.get(s, s), named.get(t, t), *types) for _, s, t, *types in self.cells()]
        chosen = F.expr(" OR ".join(flags) or "false")
        if repeated:  # numbered before the join, which then needs no other order of the rows
            order = [F.expr(x) for x in self._copy_order(own, held) or []] + [F.col(held[c]) for c in self.common]
            place = F.row_number().over(Window.partitionBy(*self.shape.names).orderBy(*order))
            rows = ks.by_key(rows, self.shape.names, max(stats.source_rows, stats.target_rows)).withColumn("_place", place)
            chosen &= F.col("_place") == 1
        rows = rows.join(self._keyed_side(df, self.common, other, *counts), self.shape.names)
        met = F.when(chosen, F.struct(*[f"{other}_{i}" for i in range(len(self.common))])).alias(self._other)
        return stage(rows.select(*[F.col(o).alias(c) for c, o in held.items()], met), f"{stats.reduced}-subset")

    def differing(self) -> tuple[DataFrame, list[str]] | None:
        """The rows of ``matched`` over the common columns in which some cell may differ, where the reduction has found them."""
        if not self.comparable_by_key or self._met is None:
            return None
        found = self._met.where(F.col(self._other).isNotNull())
        own = _marked(self.common, self.stats.reduced[0])
        return ks.keyed(found, self.shape, *own, F.col(f"{self._other}.*")), [ks.NULL_MASK, *ks.key_names(self.keys)]

    def slices(self) -> list[tuple[int, int]]:
        """Ranges of positions that are brought together one after the other, so that only the rows of one lie shuffled on
        disk at a time. There are not more than files or splits on a side, as a slice reads these whole."""
        sides = self.source_positions, self.target_positions
        rows = min(side.count for side in sides)
        n = max(1, min(SLICES, -(-rows // SLICE_ROWS), *(side.parts for side in sides)))
        cuts = [rows * i // n for i in range(n + 1)]
        return list(zip(cuts, cuts[1:]))

    def matched(
        self, source_columns: list[str], target_columns: list[str], between: tuple[int, int] | None = None
    ) -> tuple[DataFrame, list[str]]:
        """Rows of both sides brought together, and the names identifying them.

        Columns come out as ``s_<i>`` and ``t_<i>``. With keys, one row per common key; otherwise one row
        per common position, of a range of them if ``between`` is given.
        """
        if self.comparable_by_key:
            source, target = self._for_join("source"), self._for_join("target")
            stats = self.stats
            left = self._keyed_side(source, source_columns, "s", stats.source_dup_rows, stats.source_rows)
            right = self._keyed_side(target, target_columns, "t", stats.target_dup_rows, stats.target_rows)
            return left.join(right, self.shape.names, "inner"), [ks.NULL_MASK, *ks.key_names(self.keys)]
        sides = self.source_positions, self.target_positions
        left, right = [side.between(*between) if between else side.rows for side in sides]
        left = left.select(POSITION, *_marked(source_columns, "s"))
        right = right.select(POSITION, *_marked(target_columns, "t"))
        return left.join(right, POSITION, "inner"), [POSITION]

    def _for_join(self, name: str) -> DataFrame:
        """A side to be joined on the key: the join reduces it anyway, so only a staged reduction is used."""
        staged = self.stage_subset and self.stats.reduced == name
        return getattr(self, name if staged else f"full_{name}")

    @cached_property
    def source_positions(self) -> Positions:
        return positions(self.full_source, self.order_by)

    @cached_property
    def target_positions(self) -> Positions:
        return positions(self.full_target, self.order_by)

    @property
    def positioned_source(self) -> DataFrame:
        return self.source_positions.rows

    @property
    def positioned_target(self) -> DataFrame:
        return self.target_positions.rows

    def _keyed_side(self, df: DataFrame, columns: list[str], mark: str, repeated_rows: int, rows: int) -> DataFrame:
        """One row per key. Rows of unique keys cannot be skewed and go straight into the join; only rows of repeated keys
        are aggregated to the first of each key. If those are many, all rows are, as parting them would cost a shuffle."""
        if not repeated_rows:
            return ks.keyed(df, self.shape, *_marked(columns, mark))
        fields = [F.col(f"row.{ident(c)}").alias(f"{mark}_{i}") for i, c in enumerate(columns)]
        if repeated_rows > REPEATED_SHARE * rows:
            combine = self.stats.most_copies > MANY_COPIES
            most = max(self.stats.source_rows, self.stats.target_rows)
            first = ks.first_per_key(df, self.shape, columns, self._copy_order(df), combine, most)
            return first.select(*self.shape.names, *fields)
        names = self.shape.names
        repeated = self.full_key_table.where(f"n{mark} > 1").select(*names)
        unique = ks.keyed(df, self.shape, *_marked(columns, mark)).join(repeated, names, "left_anti")
        copies = ks.semi_join(df, repeated, self.shape)
        first = ks.first_per_key(copies, self.shape, columns, self._copy_order(df)).select(*names, *fields)
        return unique.unionByName(first)

    def _copy_order(self, df: DataFrame, held: dict[str, str] | None = None) -> list[str] | None:
        """How copies of a key are ordered: by canonical values where a column has another type on the other side, as
        the least number and the least text of the same values may stand in different rows. ``held`` gives columns
        that have other names by now."""
        if all(a == b for a, b in map(self.types, self.common)):
            return None
        return [canon(held[c] if held else ident(c), df.schema[c].dataType) for c in self.common]

    def row_label(self):
        """Text naming a matched row."""
        if self.comparable_by_key:
            return self.shape.display()
        return F.concat(F.lit("index="), F.col(POSITION).cast("string"))
