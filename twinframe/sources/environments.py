"""Connection profiles for table sources, read from environment variables."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from typing import Any

# The URL form, variable names and defaults of a profile.
URL_PATTERN = r"jdbc:redshift://([^:]+):(\d+)/(.+)"
URL_TEMPLATE = "jdbc:redshift://{host}:{port}/{database}"
DEFAULT_SCHEMA = "public"
DEFAULT_PORT = 5439


def parse_jdbc_url(url: str) -> dict[str, Any]:
    found = re.match(URL_PATTERN, url)
    if found is None:
        raise ValueError(f"Invalid JDBC URL format: {url}")
    return {"host": found[1], "port": int(found[2]), "database": found[3]}


def list_environments(variables: Mapping[str, str] | None = None) -> list[str]:
    names = os.environ if variables is None else variables
    return sorted(n.removesuffix("_JDBC_URL") for n in names if n.endswith("_JDBC_URL"))


def environment_profile(name: str, variables: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Connection settings of a named environment: URL and user are required."""
    found = os.environ if variables is None else variables
    prefix = name.upper()
    values = {k: found.get(f"{prefix}_{k}") for k in ("JDBC_URL", "USER", "PASSWORD", "SCHEMA")}
    for key in ("JDBC_URL", "USER"):
        if not values[key]:
            known = list_environments(found)
            raise ValueError(f"Environment '{prefix}' needs the variable {prefix}_{key}. Known: {known}")
    return {
        **parse_jdbc_url(values["JDBC_URL"]),
        "user": values["USER"],
        "password": values["PASSWORD"] or "",
        "schema": values["SCHEMA"] or DEFAULT_SCHEMA,
    }


def is_valid_environment(name: str, variables: Mapping[str, str] | None = None) -> bool:
    try:
        environment_profile(name, variables)
    except ValueError:
        return False
    return True


def connection_settings(config: Mapping[str, Any], variables: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Settings of a table source: a named environment, else direct settings completed from variables."""
    found = os.environ if variables is None else variables
    if config.get("environment"):
        profile = environment_profile(config["environment"], found)
        return {**profile, "schema": config.get("schema", profile["schema"])}
    direct = {
        "host": config.get("host", found.get("REDSHIFT_HOST")),
        "port": int(config.get("port", found.get("REDSHIFT_PORT", DEFAULT_PORT))),
        "database": config.get("database", found.get("REDSHIFT_DB")),
        "user": config.get("user", found.get("REDSHIFT_USER")),
        "password": config.get("password", found.get("REDSHIFT_PASSWORD")) or "",
        "schema": config.get("schema", found.get("REDSHIFT_SCHEMA", DEFAULT_SCHEMA)),
    }
    if not (direct["host"] and direct["database"] and direct["user"]):
        raise ValueError("Missing connection settings: name an environment, or give host, database and user")
    return direct
