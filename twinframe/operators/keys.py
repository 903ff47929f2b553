"""Row identity: normalised key columns, key tables, de-duplication and key sets.

A key column is normalised once into a non-null column plus one shared null mask. Equal nulls therefore match
with plain equality, and grouping, semi joins and joins on the key all share one hash partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions import canon as cn
from twinframe.functions import text as tx
from twinframe.functions import types as ty
from twinframe.operators.selection import first_rows

NULL_MASK = "_kn"
#: Rows of a shuffle partition by key, from which on there are more partitions than the session's.
PART_ROWS = 2_000_000
_TAGGED = T.NullType()  # marks a key compared by canonical text


def key_names(keys: list[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(keys))]


@dataclass(frozen=True)
class KeyShape:
    """The common type each key column is compared in; ``_TAGGED`` for canonical text."""

    keys: list[str]
    types: list[T.DataType]
    mode: str

    @classmethod
    def of(cls, source: T.StructType, target: T.StructType, keys: list[str], mode: str = "strict") -> KeyShape:
        return cls(list(keys), [_shared_type(source[k].dataType, target[k].dataType, mode) for k in keys], mode)

    @property
    def names(self) -> list[str]:
        return [*key_names(self.keys), NULL_MASK]

    def columns(self, schema: T.StructType) -> list[Column]:
        """Normalised key columns of one side, then the null mask."""
        raw = [self._normal(schema[k].dataType, k, t) for k, t in zip(self.keys, self.types)]
        filled = [
            F.expr(f"coalesce({x}, {_filler(t)})").alias(n) for x, t, n in zip(raw, self.types, key_names(self.keys))
        ]
        mask = " + ".join(f"CASE WHEN {x} IS NULL THEN {1 << i}L ELSE 0L END" for i, x in enumerate(raw))
        return [*filled, F.expr(mask).alias(NULL_MASK)]

    def _normal(self, dtype: T.DataType, name: str, shared: T.DataType) -> str:
        x = tx.ident(name)
        if shared is _TAGGED:
            return cn.canon(x, dtype) if self.mode == "coerce" else cn.canon_strict(x, dtype)
        if ty.is_floating(dtype):
            return cn.nan_as_null(tx.as_double(x, dtype), T.DoubleType())
        return f"CAST({x} AS {shared.simpleString()})"

    def display(self) -> Column:
        """``a=1, b='x'`` from the normalised columns."""
        pairs = []
        for i, (key, dtype, x) in enumerate(zip(self.keys, self.types, key_names(self.keys))):
            if dtype is _TAGGED:
                body = f"substring({x}, 3)"
                shown = f"CASE WHEN startswith({x}, 's:') THEN {tx.quoted(body)} ELSE {body} END"
            else:
                shown = tx.display(x, dtype)
            missing = f"({NULL_MASK} & {1 << i}) <> 0"
            pairs.append(
                f"concat({tx.literal(key + '=')}, CASE WHEN {missing} THEN '{tx.MISSING_TEXT}' ELSE {shown} END)"
            )
        return F.expr(f"concat_ws(', ', {', '.join(pairs)})")

    def order(self) -> list[Column]:
        return [F.col(n) for n in (NULL_MASK, *key_names(self.keys))]


def _shared_type(source: T.DataType, target: T.DataType, mode: str) -> T.DataType:
    kinds = (ty.family(source), ty.family(target))
    if ty.is_integral(source) and ty.is_integral(target):
        return T.LongType()
    if ty.is_floating(source) and ty.is_floating(target):
        return T.DoubleType()
    if source == target and isinstance(source, (T.DecimalType, T.DateType, T.BooleanType)):
        return source
    if kinds == (ty.STRING, ty.STRING) and mode == "strict":
        return T.StringType()
    if kinds == (ty.DATETIME, ty.DATETIME):
        return T.TimestampNTZType()
    return _TAGGED


def _filler(dtype: T.DataType) -> str:
    if dtype is _TAGGED or isinstance(dtype, T.StringType):
        return "''"
    value = "'1970-01-01'" if isinstance(dtype, (T.DateType, T.TimestampNTZType)) else "0"
    return f"CAST({value} AS {dtype.simpleString()})"


def keyed(df: DataFrame, shape: KeyShape, *payload: Column) -> DataFrame:
    return df.select(*shape.columns(df.schema), *payload)


def key_counts(df: DataFrame, shape: KeyShape, count_name: str) -> DataFrame:
    """Rows per key. Copies of one key collapse inside each task before the shuffle."""
    return keyed(df, shape).groupBy(*shape.names).agg(F.count(F.lit(1)).alias(count_name))


def key_table(source: DataFrame, target: DataFrame, shape: KeyShape) -> DataFrame:
    """One row per key of either side with its row count on each side, 0 where absent.

    Both sides go through one aggregate: joining two aggregates would keep two hash tables and two sorts in a task.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = keyed(source, shape, one.alias("ns"), none.alias("nt")).unionByName(keyed(target, shape, none.alias("ns"), one.alias("nt")))
    return both.groupBy(*shape.names).agg(F.sum("ns").alias("ns"), F.sum("nt").alias("nt"))


def by_key(df: DataFrame, names: list[str], rows: int = 0) -> DataFrame:
    """Rows shuffled by key, with ``rows`` that many to more partitions than usual, so that what a task sorts stays small."""
    parts = ceil(rows / PART_ROWS)
    keys = [F.col(n) for n in names]
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(parts, *keys)
    return df.repartition(*keys)


def first_per_key(
    df: DataFrame, shape: KeyShape, columns: list[str], order: list[str] | None = None, combine: bool = True, rows: int = 0
) -> DataFrame:
    """Key columns plus the first row of ``columns`` per key, as struct ``row``.

    Rows are ordered by the SQL expressions ``order``, if given, then by ``columns``. With ``combine`` the minimum is taken
    inside each task first, so a key holding most of the rows ships one row per task. Without it rows are shuffled as they
    are, which saves sorting them before and shipping what they are ordered by; no key may hold many rows then. ``rows``
    is then the number of rows of ``df``, or of a larger frame that the result is joined with.
    """
    row = F.struct(*[F.col(tx.ident(c)) for c in columns]) if columns else F.struct(F.lit(0).alias("none"))
    if not combine:  # numbered, not aggregated: an aggregate would go over the shuffled rows twice
        used = [F.col(tx.ident(c)) for c in (df.columns if order else columns)]
        df = by_key(df.select(*shape.columns(df.schema), *used), shape.names, rows)
        by = [*map(F.expr, order or []), *[F.col(tx.ident(c)) for c in columns]] or shape.order()
        place = F.row_number().over(Window.partitionBy(*shape.names).orderBy(*by))
        return df.select(*shape.names, row.alias("row"), place.alias("_place")).where("_place = 1").drop("_place")
    names = shape.columns(df.schema)
    if not order:
        return df.select(*names, row.alias("row")).groupBy(*shape.names).agg(F.min("row").alias("row"))
    first = F.struct(F.struct(*[F.expr(x).alias(f"o{i}") for i, x in enumerate(order)]).alias("order"), row.alias("row"))
    least = df.select(*names, first.alias("first")).groupBy(*shape.names).agg(F.min("first").alias("first"))
    return least.select(*shape.names, F.col("first.row").alias("row"))


def dedup_first(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the first in the order of all columns."""
    shape = KeyShape.of(df.schema, df.schema, keys)
    return first_per_key(df, shape, df.columns).select("row.*")


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    shape = KeyShape.of(df.schema, df.schema, keys)
    groups = key_counts(df, shape, "row_count").where("row_count > 1")
    return groups.select(shape.display().alias("pk"), "row_count")


def semi_join(df: DataFrame, keys_of: DataFrame, shape: KeyShape) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys_of`` (a frame with the shape's normalised columns)."""
    tagged = df.select(*[F.col(tx.ident(c)) for c in df.columns], *shape.columns(df.schema))
    return tagged.join(keys_of.select(*shape.names), shape.names, "left_semi").select(
        *[F.col(tx.ident(c)) for c in df.columns]
    )


def distinct_keys(df: DataFrame, shape: KeyShape) -> DataFrame:
    return keyed(df, shape).distinct()


def keep_keys(df: DataFrame, keys_of: DataFrame, shape: KeyShape) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys_of``, which has every key once. Unlike a semi join, which goes below a union,
    the join then runs once however many parts ``df`` is put together from."""
    tagged = df.select(*[F.col(tx.ident(c)) for c in df.columns], *shape.columns(df.schema))
    return tagged.join(keys_of.select(*shape.names), shape.names, "inner").select(*[F.col(tx.ident(c)) for c in df.columns])


def restrict_to_keys(df: DataFrame, other: DataFrame, keys: list[str], mode: str = "strict") -> DataFrame:
    """Push a key set into a scan: rows of ``df`` whose key occurs in ``other``; nulls match nulls."""
    shape = KeyShape.of(df.schema, other.schema, keys, mode)
    return semi_join(df, distinct_keys(other, shape), shape)


def sample_keys(df: DataFrame, shape: KeyShape, size: int, seed: int) -> DataFrame:
    """``size`` distinct keys in the order of a seeded hash of the key text: the same keys on every run."""
    parts = [
        F.expr(tx.present_text(n, T.StringType() if t is _TAGGED else t))
        for n, t in zip(key_names(shape.keys), shape.types)
    ]
    token = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return first_rows(distinct_keys(df, shape), [token, *shape.order()], size)


def key_set_ops(source: DataFrame, target: DataFrame, keys: list[str], mode: str = "strict") -> DataFrame:
    """Every key with the side it occurs on: both, source or target."""
    shape = KeyShape.of(source.schema, target.schema, keys, mode)
    side = F.when(F.col("ns") == 0, "target").when(F.col("nt") == 0, "source").otherwise("both")
    return key_table(source, target, shape).select(shape.display().alias("pk"), side.alias("side"))
