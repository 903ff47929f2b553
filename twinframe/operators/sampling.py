"""Working on part of the data on purpose: row limits and seeded key samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.functions import types as ty
from twinframe.functions.text import ident
from twinframe.operators import keys as ks
from twinframe.operators.selection import first_rows
from twinframe.session import stage


def limited(df: DataFrame, limit: int, order_by: list[str] | None = None) -> DataFrame:
    """The first ``limit`` rows in key order; without a key, any ``limit`` rows."""
    return first_rows(df, [F.col(ident(c)) for c in order_by or []], limit)


def sampled_keys(
    source: DataFrame, target: DataFrame, source_keys: list[str], target_keys: list[str], size: int, seed: int
) -> tuple[ks.KeyShape, DataFrame]:
    """How keys compare, and ``size`` sampled source keys as a written frame."""
    renamed = target.select(*[F.col(ident(t)).alias(s) for s, t in zip(source_keys, target_keys)])
    alike = all(
        ty.family(source.schema[k].dataType) == ty.family(renamed.schema[k].dataType) for k in source_keys
    )
    shape = ks.KeyShape.of(source.schema, renamed.schema, source_keys, "strict" if alike else "coerce")
    return shape, stage(ks.sample_keys(source, shape, size, seed), "sample")  # chosen once, used for both sides


def quick_sample(
    source: DataFrame, target: DataFrame, source_keys: list[str], target_keys: list[str], size: int, seed: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides restricted to ``size`` sampled source keys.

    Key columns of one family compare as they are; text against numbers compares by value, as a warehouse
    does with quoted literals.
    """
    shape, sample = sampled_keys(source, target, source_keys, target_keys, size, seed)
    to_target = ks.KeyShape(list(target_keys), shape.types, shape.mode)
    return ks.semi_join(source, sample, shape), ks.semi_join(target, sample, to_target)
