"""Table sources: catalog tables and tables behind JDBC."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from twinframe.sources.environments import URL_TEMPLATE, connection_settings

_CONNECTION_KEYS = ("environment", "host", "url")
DEFAULT_PARTITIONS = 32
# Reading a large table over one connection is slow; these settings split the read by a numeric column.
_SPLIT_OPTIONS = {
    "partition_column": "partitionColumn",
    "lower_bound": "lowerBound",
    "upper_bound": "upperBound",
    "num_partitions": "numPartitions",
    "fetch_size": "fetchsize",
}


def jdbc_options(config: Mapping[str, Any], variables: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options for Spark's JDBC reader; it prunes columns and pushes filters and limits down itself."""
    if config.get("url"):
        options = {"url": config["url"], "dbtable": _qualified(config.get("schema"), config["table"])}
        options |= {k: config[k] for k in ("user", "password", "driver") if config.get(k)}
    else:
        settings = connection_settings(config, variables)
        options = {
            "url": URL_TEMPLATE.format(**settings),
            "dbtable": _qualified(settings["schema"], config["table"]),
            "user": settings["user"],
            "password": settings["password"],
        }
        if config.get("driver"):
            options["driver"] = config["driver"]
    options |= {spark_name: str(config[name]) for name, spark_name in _SPLIT_OPTIONS.items() if name in config}
    return options


def _qualified(schema: str | None, table: str) -> str:
    return ".".join('"{}"'.format(part.replace('"', '""')) for part in (schema, table) if part)


def is_jdbc(config: Mapping[str, Any]) -> bool:
    return any(config.get(k) for k in _CONNECTION_KEYS)


def learned_bounds(options: Mapping[str, str], first: Callable[[dict[str, str]], Sequence[Any]]) -> dict[str, str]:
    """``options`` with the bounds of a split read completed: least and greatest value from one aggregate in the database.

    ``first`` reads the first row with the options it gets. An empty column is read over one connection.
    """
    column = options.get("partitionColumn")
    if not column or {"lowerBound", "upperBound"} <= set(options):
        return dict(options)
    split = ("partitionColumn", "lowerBound", "upperBound", "numPartitions", "dbtable")
    rest = {k: v for k, v in options.items() if k not in split}
    name = _qualified(None, column)
    low, high = first({**rest, "query": f"SELECT min({name}) AS low, max({name}) AS high FROM {options['dbtable']}"})
    if low is None:
        return {**rest, "dbtable": options["dbtable"]}
    return {"numPartitions": str(DEFAULT_PARTITIONS), **options, "lowerBound": str(low), "upperBound": str(high)}


def load_table(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """A JDBC table when connection settings are given, else a table or view of the session's catalog.

    ``predicates`` in the settings of a JDBC table are read as one partition each.
    """
    if is_jdbc(config):
        options = jdbc_options(config)
        if config.get("predicates"):
            properties = {k: v for k, v in options.items() if k in ("user", "password", "driver", "fetchsize")}
            return spark.read.jdbc(options["url"], options["dbtable"], predicates=config["predicates"], properties=properties)
        options = learned_bounds(options, lambda o: spark.read.format("jdbc").options(**o).load().first())
        return spark.read.format("jdbc").options(**options).load()
    schema, table = config.get("schema"), config["table"]
    return spark.table(f"{schema}.{table}" if schema else table)
