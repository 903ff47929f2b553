"""One validation: load, align, sample, reduce, check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.operators import key_checks, profile_checks, schema_checks, summaries
from twinframe.operators.align import (
    Alignment,
    apply_alignment,
    pick_target_keys,
    resolve_alignment,
    target_key_candidates,
)
from twinframe.operators.results import ALL_COLUMNS, FAIL, ORDER_COLUMNS, public, union_all
from twinframe.operators.sampling import quick_sample, sampled_keys
from twinframe.operators.value_checks import CASING, HASH, SPECIAL, VALUE, ZERO, row_checks
from twinframe.plans.pair import Pair
from twinframe.session import named_paths, release, stage
from twinframe.sources.pushdown import key_predicates, key_values
from twinframe.sources.registry import is_columnar, load_source
from twinframe.sources.tables import is_jdbc, load_table
from twinframe.spec import ValidationSpec

_custom_checks: dict[str, tuple[Callable[[Pair], DataFrame], bool]] = {}


def register_check(name: str, check: Callable[[Pair], DataFrame], regression_only: bool = False) -> None:
    """Add a check. It gets the pair and returns the seven result columns."""
    _custom_checks[name] = (check, regression_only)


def unregister_check(name: str) -> None:
    _custom_checks.pop(name, None)


@dataclass
class ValidationResult:
    spec: ValidationSpec
    rows: DataFrame  # result columns plus the order columns
    pair: Pair
    alignment: Alignment = field(default_factory=Alignment)
    staged: list[str] = field(default_factory=list)  # folders that the run has written

    @property
    def df(self) -> DataFrame:
        return public(self.rows)

    def ordered(self) -> DataFrame:
        """Result rows in report order."""
        return public(self.rows.orderBy(*ORDER_COLUMNS, "column", "source_value", "target_value"))

    def named(self) -> DataFrame:
        """Result rows with the validation's name in front, for consolidation."""
        return self.df.select(F.lit(self.spec.name).alias("validation_name"), "*")

    def materialized(self) -> ValidationResult:
        """Run once: write the result rows to the shared folder and read them from there on."""
        before = named_paths()
        rows = stage(self.rows, "results")
        return replace(self, rows=rows, staged=[*self.staged, *named_paths(before)])

    def close(self) -> None:
        """Delete what the run has written to the shared folder; the result rows cannot be read after that."""
        release(self.pair.spark, self.staged)

    def summary(self) -> DataFrame:
        return summaries.run_summary(self.rows)

    def signoff(self) -> DataFrame:
        return summaries.signoff_summary(self.rows)

    def failed(self) -> bool:
        return not self.rows.where(F.col("result") == FAIL).isEmpty()


def check_rows(pair: Pair, spec: ValidationSpec) -> DataFrame:
    """All checks of a validation as one plan."""
    frames = [key_checks.record_count(pair), key_checks.notes(pair)]
    frames += [
        schema_checks.column_count(pair, spec.strict_columns),
        schema_checks.metadata_types(pair),
        key_checks.duplicates(pair),
    ]
    profile = profile_checks.Profile(pair, ["nulls", "empties", *(["dates"] if spec.regression else [])])
    frames += [profile.nulls(), profile.empty_strings(spec.all_empty_columns)]
    if pair.keys:
        frames.append(key_checks.key_match(pair))
    by_row = [VALUE]
    if spec.regression:
        frames += [
            schema_checks.column_order(pair),
            schema_checks.column_specs(pair),
            profile_checks.distinct_check(pair, spec.distinct == "estimate"),
            profile.date_ranges(),
            key_checks.symmetric_difference(pair),
        ]
        by_row += [CASING, ZERO, SPECIAL, HASH]
    frames.append(
        row_checks(
            pair,
            by_row,
            robust_zeros=spec.robust_zeros,
            checksum_columns=spec.checksum_columns,
        )
    )
    for place, (check, regression_only) in enumerate(_custom_checks.values()):
        if spec.regression or not regression_only:
            extra = check(pair).select(
                F.lit(100 + place).alias("check_no"), F.lit(0).alias("part"), F.lit(0).alias("example"), "*"
            )
            frames.append(extra.select(*ALL_COLUMNS))
    return union_all(f for f in frames if f is not None)


def validate_frames(source: DataFrame, target: DataFrame, spec: ValidationSpec) -> ValidationResult:
    """Validate two DataFrames that are already loaded."""
    before = named_paths()
    keys = spec.primary_keys
    sampled = False
    if spec.quick_sample_pks and str(spec.target.get("type", "table")).lower() == "table":
        source, target, sampled = _sampled(source, target, spec)
    alignment = resolve_alignment(
        source.columns,
        target.columns,
        spec.column_mapping,
        spec.auto_match_by_suffix,
        spec.source_prefixes_to_strip,
        spec.target_prefixes_to_strip,
    )
    source = apply_alignment(source, alignment)
    pair = Pair(
        source,
        target,
        [alignment.target_name(k) for k in keys],
        key_mode=spec.key_mode,
        subset=spec.subset,
        stage_subset=spec.stage_subset,
        order_by=[alignment.target_name(c) for c in spec.order_by],
        already_reduced=sampled,
    )
    rows = check_rows(pair, spec)
    return ValidationResult(spec, rows, pair, alignment, named_paths(before))


def _sampled(source: DataFrame, target: DataFrame, spec: ValidationSpec) -> tuple[DataFrame, DataFrame, bool]:
    """Restrict both sides to sampled keys; where the target has no such key, it stays whole."""
    keys = spec.primary_keys
    if not keys or not set(keys).issubset(source.columns):
        return source, target, False
    candidates = target_key_candidates(keys, spec.column_mapping, spec.source_prefixes_to_strip)
    target_keys = pick_target_keys(candidates, target.columns)
    size, seed = spec.quick_sample_pks, spec.quick_sample_seed
    if target_keys is None:
        return quick_sample(source, source, keys, keys, size, seed)[0], target, False
    return (*quick_sample(source, target, keys, target_keys, size, seed), True)


def validate(spark: SparkSession, spec: ValidationSpec | dict[str, Any]) -> ValidationResult:
    """Load both sides as the spec says and validate them."""
    if isinstance(spec, dict):
        spec = ValidationSpec.from_dict(spec)
    before = named_paths()
    sides = [_opened(spark, spec, config) for config in (spec.source, spec.target)]
    if spec.quick_sample_pks and is_jdbc(spec.target):
        sides[1] = _read_by_keys(spark, spec, *sides)
    result = validate_frames(*sides, spec)
    return replace(result, staged=named_paths(before))


def _read_by_keys(spark: SparkSession, spec: ValidationSpec, source: DataFrame, target: DataFrame) -> DataFrame:
    """A JDBC target of which only rows of the sampled keys are asked for, one chunk of keys a partition.

    The keys are the ones that ``quick_sample`` takes, as many as the spec says. The database may find more rows (its
    comparison of texts may ignore case or blanks), so the sides are still restricted by the sample afterwards.
    """
    keys = spec.primary_keys
    if not keys or not set(keys).issubset(source.columns) or spec.target.get("limit", spec.target.get("row_limit")):
        return target
    target_keys = pick_target_keys(target_key_candidates(keys, spec.column_mapping, spec.source_prefixes_to_strip), target.columns)
    if target_keys is None:
        return target
    shape, sample = sampled_keys(source, target, keys, target_keys, spec.quick_sample_pks, spec.quick_sample_seed)
    values = key_values(sample, shape, [target.schema[k].dataType for k in target_keys])
    if values is None:
        return target
    written = {c.lower(): c for c in load_table(spark, spec.target).columns}
    predicates = key_predicates([written[k] for k in target_keys], values)
    return load_source(spark, {**spec.target, "predicates": predicates}, order_by=keys)


def _opened(spark: SparkSession, spec: ValidationSpec, config: dict[str, Any]) -> DataFrame:
    """A side as configured. What is not stored by columns is parsed once and kept in the shared folder, as every check
    reads its own columns; without keys it stays as it is, as its files tell the order of rows."""
    df = load_source(spark, config, order_by=spec.primary_keys)
    if not spec.primary_keys or spec.quick_sample_pks or is_columnar(config):
        return df
    return stage(df, "side")
