"""Column alignment: which source column is which target column."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.functions import types as ty
from twinframe.functions.text import ident, strip_ws


@dataclass
class Alignment:
    """``renames`` maps source names to target names; the rest says what stayed unmapped and why."""

    renames: dict[str, str] = field(default_factory=dict)
    missing: list[tuple[str, str]] = field(default_factory=list)
    ambiguous: dict[str, list[str]] = field(default_factory=dict)
    contested: dict[str, list[str]] = field(default_factory=dict)

    def target_name(self, column: str) -> str:
        return self.renames.get(column, column)


def common_columns(source: Iterable[str], target: Iterable[str]) -> list[str]:
    return sorted(set(source) & set(target))


def strip_prefix(name: str, prefixes: Iterable[str]) -> str:
    """Remove the first listed prefix the name starts with."""
    return next((name[len(p) :] for p in prefixes if name.startswith(p)), name)


def _name_forms(name: str, prefixes: Iterable[str]) -> set[str]:
    return {name, strip_prefix(name, prefixes)}


def _tails(name: str) -> set[str]:
    """Every part of the name that follows an underscore: the names it is a suffix variant of."""
    return {name[i + 1 :] for i, char in enumerate(name) if char == "_"}


def resolve_alignment(
    source: list[str],
    target: list[str],
    mapping: dict[str, str] | None = None,
    by_suffix: bool = False,
    source_prefixes: Iterable[str] = (),
    target_prefixes: Iterable[str] = (),
) -> Alignment:
    """Explicit mapping first, then equal names, then prefix and suffix variants; always one to one.

    A source column with several variants, or a target column wanted by several sources, stays unmapped.
    """
    source_prefixes, target_prefixes = list(source_prefixes), list(target_prefixes)
    result = Alignment()
    for left, right in (mapping or {}).items():
        if left in source and right in target and right not in result.renames.values():
            result.renames[left] = right
        else:
            result.missing.append((left, right))
    if not (by_suffix or source_prefixes or target_prefixes):
        return result

    taken = set(result.renames.values())
    for name in source:
        if name not in result.renames and name in target and name not in taken:
            result.renames[name] = name
            taken.add(name)

    # Look-up tables by name form and by tail keep this linear in the number of columns.
    by_form, by_tail = defaultdict(set), defaultdict(set)
    for name in target:
        if name in taken:
            continue
        for form in _name_forms(name, target_prefixes):
            by_form[form].add(name)
            for tail in _tails(form):
                by_tail[tail].add(name)

    wanted = defaultdict(list)
    for name in source:
        if name in result.renames:
            continue
        found: set[str] = set()
        for form in _name_forms(name, source_prefixes):
            found |= by_form.get(form, set())
            if by_suffix:
                found |= by_tail.get(form, set())
                for tail in _tails(form):
                    found |= by_form.get(tail, set())
        if len(found) > 1:
            result.ambiguous[name] = sorted(found)
        elif found:
            wanted[found.pop()].append(name)
    for name, claimants in wanted.items():
        if len(claimants) == 1:
            result.renames[claimants[0]] = name
        else:
            result.contested[name] = sorted(claimants)
    return result


def apply_alignment(df: DataFrame, alignment: Alignment) -> DataFrame:
    """Rename source columns. A column whose name a rename takes over keeps its data under ``<name>__source``."""
    moved = {a: b for a, b in alignment.renames.items() if a != b}
    taken = set(moved.values())
    names = [moved.get(c, f"{c}__source" if c in taken else c) for c in df.columns]
    return df.toDF(*names)


def target_key_candidates(
    keys: list[str], mapping: dict[str, str], source_prefixes: Iterable[str] = ()
) -> list[list[str]]:
    """Names the key may have on the target side: mapped, as given, without prefix; tried in this order."""
    prefixes = list(source_prefixes)
    options = [
        [mapping.get(k, k) for k in keys],
        list(keys),
        [strip_prefix(k, prefixes) for k in keys],
    ]
    unique = dict.fromkeys(tuple(o) for o in options if all(n.strip() for n in o))
    return [list(o) for o in unique]


def pick_target_keys(candidates: list[list[str]], columns: Iterable[str]) -> list[str] | None:
    present = set(columns)
    return next((c for c in candidates if present.issuperset(c)), None)


def lower_columns(df: DataFrame) -> DataFrame:
    names = [c.lower() for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"columns differ only in case: {clashes}")
    return df.toDF(*names)


def normalize_strings(df: DataFrame) -> DataFrame:
    """Strip white space from every string column."""
    return df.select(
        *[
            F.expr(strip_ws(ident(f.name)) if ty.family(f.dataType) == ty.STRING else ident(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )
