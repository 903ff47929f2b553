"""Sampled keys as predicates of a JDBC read, so that the database sends only rows of these keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from twinframe.functions import types as ty
from twinframe.operators.keys import NULL_MASK, KeyShape

#: Keys of one predicate, which is one partition of the read, and keys up to which a set is sent at all.
CHUNK, MAX_KEYS = 500, 100_000

Key = tuple[int | str | None, ...]


def key_values(sample: DataFrame, shape: KeyShape, target_types: list[T.DataType]) -> list[Key] | None:
    """Keys of a bounded sample on the driver, None where a database might compare them in another way than Spark.

    Sent are whole numbers against whole numbers and plain ASCII text against text. At most ``MAX_KEYS`` rows are collected.
    """
    for shared, own in zip(shape.types, target_types):
        if not (isinstance(shared, T.LongType) and ty.is_integral(own) or isinstance(shared, T.StringType) and isinstance(own, T.StringType)):
            return None
    rows = sample.limit(MAX_KEYS + 1).collect()
    if len(rows) > MAX_KEYS:
        return None
    names = [n for n in shape.names if n != NULL_MASK]
    keys = [tuple(None if r[NULL_MASK] >> i & 1 else r[n] for i, n in enumerate(names)) for r in rows]
    texts = [v for key in keys for v in key if isinstance(v, str)]
    if any(not v.isascii() or not v.isprintable() or "\\" in v for v in texts):
        return None
    return keys


def key_predicates(columns: list[str], keys: list[Key], chunk: int = CHUNK) -> list[str]:
    """Conditions of about ``chunk`` keys each. Keys that differ in case or outer blanks only share one, as a database may
    hold them for equal, and a row must not be read twice."""

    def folded(key: Key) -> list[tuple[bool, str]]:
        return [(v is None, "" if v is None else str(v).strip().lower()) for v in key]

    chunks: list[list[Key]] = []
    last = None
    for key in sorted(keys, key=folded):
        if not chunks or len(chunks[-1]) >= chunk and folded(key) != last:
            chunks.append([])
        chunks[-1].append(key)
        last = folded(key)
    return [_condition(columns, part) for part in chunks] or ["1 = 0"]


def _condition(columns: list[str], keys: list[Key]) -> str:
    names = ['"{}"'.format(c.replace('"', '""')) for c in columns]
    if len(names) == 1:
        found = [_literal(v) for (v,) in keys if v is not None]
        parts = [f"{names[0]} IN ({', '.join(found)})"] if found else []
        return " OR ".join(parts + [f"{names[0]} IS NULL"] * any(v is None for (v,) in keys))
    rows = (" AND ".join(f"{n} IS NULL" if v is None else f"{n} = {_literal(v)}" for n, v in zip(names, key)) for key in keys)
    return " OR ".join(f"({row})" for row in rows)


def _literal(value: int | str) -> str:
    return str(value) if isinstance(value, int) else "'{}'".format(value.replace("'", "''"))
