"""Declarative descriptions of validations, read from dictionaries or YAML."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

# Settings given once for a validation and passed on to both of its sides.
SHARED_SETTINGS = ("sep", "encoding", "format", "sheet_name", "json_orient")
DEFAULT_SAMPLE_SEED = 42


def parse_keys(text: Any) -> list[str]:
    """Column names from ``a,b``, ``a; b`` or ``a|b``."""
    names = text if isinstance(text, (list, tuple)) else re.split(r"[;,|]", str(text or ""))
    return [n.strip() for n in map(str, names) if n.strip()]


def positive_int(value: Any, label: str) -> int | None:
    if value is None:
        return None
    try:
        number = int(value)
    except (TypeError, ValueError):
        number = 0
    if number <= 0:
        raise ValueError(f"{label} must be a positive integer")
    return number


def _prefixes(values: Any) -> list[str]:
    return [str(v).lower() for v in values or [] if str(v).strip()]


@dataclass
class ValidationSpec:
    name: str = "Validation"
    source: dict[str, Any] = field(default_factory=dict)
    target: dict[str, Any] = field(default_factory=dict)
    primary_keys: list[str] = field(default_factory=list)
    regression: bool = False
    column_mapping: dict[str, str] = field(default_factory=dict)
    auto_match_by_suffix: bool = False
    source_prefixes_to_strip: list[str] = field(default_factory=list)
    target_prefixes_to_strip: list[str] = field(default_factory=list)
    quick_sample_pks: int | None = None
    quick_sample_seed: int = DEFAULT_SAMPLE_SEED
    output_dir: str = "./results"
    # Options of this engine.
    key_mode: str = "strict"  # strict: text never equals a number in keys; coerce: keys compare like values
    subset: bool = True  # reduce the larger side to the smaller side's keys
    stage_subset: bool = True  # write a reduced side to the shared folder once, not reduce it in every check
    strict_columns: bool = False  # column_count_check fails on differing column sets
    all_empty_columns: bool = False  # empty_string_check reports every column, not the first per side
    robust_zeros: bool = False  # leading_zero_check strips all leading zeros
    checksum_columns: str = "common"  # common: shared columns in name order; all: each side's own columns
    distinct: str = "exact"  # estimate: distinct counts by sketches, which shuffle no values
    order_by: list[str] = field(default_factory=list)  # row order of keyless comparison; default file order

    def __post_init__(self) -> None:
        self.primary_keys = [k.lower() for k in parse_keys(self.primary_keys)]
        self.order_by = [k.lower() for k in parse_keys(self.order_by)]
        self.column_mapping = {str(a).lower(): str(b).lower() for a, b in (self.column_mapping or {}).items()}
        self.source_prefixes_to_strip = _prefixes(self.source_prefixes_to_strip)
        self.target_prefixes_to_strip = _prefixes(self.target_prefixes_to_strip)
        self.quick_sample_pks = positive_int(self.quick_sample_pks, "'quick_sample_pks'")
        self.quick_sample_seed = int(self.quick_sample_seed)
        if self.key_mode not in ("strict", "coerce"):
            raise ValueError("key_mode must be 'strict' or 'coerce'")
        if self.checksum_columns not in ("common", "all"):
            raise ValueError("checksum_columns must be 'common' or 'all'")
        if self.distinct not in ("exact", "estimate"):
            raise ValueError("distinct must be 'exact' or 'estimate'")

    @property
    def fuzzy_alignment(self) -> bool:
        return bool(
            self.auto_match_by_suffix or self.source_prefixes_to_strip or self.target_prefixes_to_strip
        )

    @classmethod
    def from_dict(cls, config: dict[str, Any]) -> ValidationSpec:
        known = {k: v for k, v in config.items() if k in cls.__dataclass_fields__}
        shared = {k: config[k] for k in SHARED_SETTINGS if k in config}
        for side in ("source", "target"):
            known[side] = {**shared, **(config.get(side) or {})}
        return cls(**known)


@dataclass
class SuiteSpec:
    validations: list[ValidationSpec]

    @classmethod
    def from_dict(
        cls,
        config: dict[str, Any],
        name: str | None = None,
        target_limit: int | None = None,
        quick_sample_pks: int | None = None,
        output_dir: str | None = None,
    ) -> SuiteSpec:
        """Select by name and apply run-wide overrides; the row limit reaches table targets only."""
        entries = list((config or {}).get("validations") or [])
        if not entries:
            raise ValueError("No validations found in configuration")
        if name is not None:
            entries = [e for e in entries if e.get("name") == name]
            if not entries:
                raise ValueError(f"Validation '{name}' not found in configuration")
        limit = positive_int(target_limit, "'target_limit'")
        specs = []
        for entry in entries:
            spec = ValidationSpec.from_dict(entry)
            if limit is not None and str(spec.target.get("type", "")).lower() == "table":
                spec.target["limit"] = limit
            if quick_sample_pks is not None:
                spec.quick_sample_pks = positive_int(quick_sample_pks, "'quick_sample_pks'")
            if output_dir is not None:
                spec.output_dir = output_dir
            specs.append(spec)
        return cls(specs)

    @classmethod
    def from_yaml(cls, path: str, **overrides: Any) -> SuiteSpec:
        import yaml

        with open(path, encoding="utf-8") as handle:
            return cls.from_dict(yaml.safe_load(handle), **overrides)
