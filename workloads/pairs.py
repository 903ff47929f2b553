"""Source and target sides derived from the given tables.

Each side is one SELECT that both engines run, so the defects are the same rows on both. ``{name}`` stands
for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a derivation on the tables it names."""
    names = [n for n in TABLES if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def plain(sql: str) -> str:
    """The derivation as SQL over the registered views."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


ORDERS_SOURCE = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
       CASE WHEN o_orderkey % 43 = 0 THEN concat('0', CAST(o_orderkey AS STRING))
            ELSE CAST(o_orderkey AS STRING) END AS code
FROM {orders}
"""

_ORDERS_EDITED = """
SELECT o_orderkey,
       CAST(o_custkey AS STRING) AS o_custkey,
       CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 53 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderkey % 89 = 0 THEN o_orderdate + INTERVAL 3650 DAY ELSE o_orderdate END AS o_orderdate,
       CASE WHEN o_orderkey % 71 = 0 THEN ''
            WHEN o_orderkey % 41 = 0 THEN lower(o_orderpriority)
            WHEN o_orderkey % 67 = 0 THEN concat(o_orderpriority, 'é')
            ELSE o_orderpriority END AS o_orderpriority,
       CAST(o_orderkey AS STRING) AS code
FROM {orders}
WHERE o_orderkey % 97 <> 3
"""

ORDERS_TARGET = f"""
WITH edited AS ({_ORDERS_EDITED})
SELECT * FROM edited
UNION ALL
SELECT -o_orderkey - 1 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, code
FROM edited WHERE o_orderkey % 101 = 0
UNION ALL
SELECT * FROM edited WHERE o_orderkey % 211 = 0
"""

LINEITEM_SOURCE = "SELECT * FROM {lineitem}"

_LINE = "(l_orderkey * 7 + l_linenumber)"
LINEITEM_TARGET = f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
       CASE WHEN {_LINE} % 53 = 0 THEN l_extendedprice + 1 ELSE l_extendedprice END AS l_extendedprice,
       l_discount, l_tax,
       CASE WHEN {_LINE} % 41 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS l_returnflag,
       CASE WHEN {_LINE} % 61 = 0 THEN NULL ELSE l_linestatus END AS l_linestatus,
       CASE WHEN {_LINE} % 89 = 0 THEN l_shipdate + INTERVAL 3650 DAY ELSE l_shipdate END AS l_shipdate
FROM {{lineitem}}
WHERE {_LINE} % 97 <> 3
"""

DOCUMENTS_SOURCE = "SELECT doc_id, text, lang, source, n_chars FROM {documents}"
DOCUMENTS_TARGET = """
SELECT CASE WHEN doc_id % 59 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id,
       CASE WHEN doc_id % 7 = 0 THEN upper(text)
            WHEN doc_id % 11 = 0 THEN concat('  ', text, ' ')
            WHEN doc_id % 13 = 0 THEN concat(text, ' ‽')
            ELSE text END AS text,
       CASE WHEN doc_id % 17 = 0 THEN NULL ELSE lang END AS lang,
       CASE WHEN doc_id % 19 = 0 THEN '' ELSE source END AS source,
       CASE WHEN doc_id % 23 = 0 THEN concat('0', CAST(n_chars AS STRING))
            ELSE concat(CAST(n_chars AS STRING), '.0') END AS n_chars
FROM {documents}
"""

CONVERSATIONS_SOURCE = "SELECT conv_id, turn, role, text FROM {conversations}"
CONVERSATIONS_TARGET = """
SELECT conv_id, turn,
       CASE WHEN (conv_id + turn) % 5 = 0 THEN upper(role) ELSE role END AS role,
       CASE WHEN (conv_id + turn) % 9 = 0 THEN concat(text, '!') ELSE text END AS text
FROM {conversations}
"""

# Result rows as a table: events play the part of findings, so that reports are tested on many rows.
RESULT_ROWS = """
SELECT event_type AS validation,
       CASE WHEN event_id % 5 = 0 THEN 'FAIL' WHEN event_id % 7 = 0 THEN 'SKIP'
            WHEN event_id % 11 = 0 THEN 'INFO' ELSE 'PASS' END AS result,
       CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('col_', CAST(user_id % 30 AS STRING)) END AS column,
       CAST(event_id AS STRING) AS pk,
       props AS detail,
       CAST(user_id AS STRING) AS source_value,
       CAST(user_id AS STRING) AS target_value,
       concat('suite_', CAST(user_id % 40 AS STRING)) AS validation_name,
       CAST(event_id AS INT) AS check_no, 0 AS part, 0 AS example
FROM {events}
"""

# Dashboard measurements.
MEASUREMENTS = """
SELECT concat('dash_', CAST(user_id % 50 AS STRING)) AS label,
       concat('http://bi.example/', CAST(user_id % 50 AS STRING)) AS url,
       CAST(event_id AS INT) AS iteration,
       CASE WHEN event_id % 10 = 0 OR user_id % 50 = 7 THEN -1.0E0
            ELSE CAST((event_id * 37) % 30000 AS DOUBLE) END AS first_render_ms,
       CASE WHEN event_id % 4 = 0 OR user_id % 50 = 9 THEN -1.0E0
            ELSE CAST((event_id * 53) % 16000 AS DOUBLE) END AS interaction_ms
FROM {events}
"""

SCORES = """
SELECT concat('tab_', CAST(l_partkey AS STRING)) AS tab_name,
       concat('scenario_', CAST(l_suppkey % 9 AS STRING)) AS scenario_label,
       CASE WHEN l_linenumber = 7 THEN NULL
            WHEN l_linenumber = 6 THEN 0.0E0
            ELSE 1 - l_discount / 4 END AS ssim_score
FROM {lineitem}
"""

TABS_A = "SELECT c_name AS name, CAST(c_custkey AS INT) AS index FROM {customer}"
TABS_B = """
SELECT CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS name, CAST(c_custkey + 1 AS INT) AS index
FROM {customer} WHERE c_custkey % 17 <> 0
UNION ALL
SELECT s_name AS name, CAST(s_suppkey AS INT) AS index FROM {supplier}
"""

ELEMENTS = """
SELECT concat('tab_', p_brand) AS tab, p_name AS text,
       CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN 'Comic Sans MS'
            WHEN p_partkey % 2 = 0 THEN 'ARIAL, sans-serif' ELSE '"Segoe UI", Roboto' END AS font_family,
       concat(CAST(8 + p_size % 10 AS STRING), CASE WHEN p_partkey % 4 = 0 THEN 'PX' ELSE 'px' END) AS font_size,
       CASE WHEN p_partkey % 3 = 0 THEN '#4e79a7' WHEN p_partkey % 7 = 0 THEN '#123abc'
            WHEN p_partkey % 2 = 0 THEN '#FFFFFF' ELSE 'red' END AS color
FROM {part}
"""
FONTS = ["Arial", "Roboto"]
FONT_SIZES = ["10px", "11px", "12px", "13px", "14px", "16px"]
COLOURS = ["#FFFFFF", "#000000", "#4E79A7"]

# Text forms of numbers and words, to compare canonical values.
SPELLINGS = """
SELECT o_orderkey,
       CASE o_orderkey % 12
            WHEN 0 THEN concat(' ', CAST(o_orderkey AS STRING), ' ')
            WHEN 1 THEN concat('+00', CAST(o_orderkey AS STRING))
            WHEN 2 THEN concat(CAST(o_orderkey AS STRING), '.')
            WHEN 3 THEN concat(CAST(o_orderkey AS STRING), '.50')
            WHEN 4 THEN concat('-0', CAST(o_orderkey AS STRING), '.000')
            WHEN 5 THEN concat('.', CAST(o_orderkey AS STRING))
            WHEN 6 THEN concat(CAST(o_orderkey AS STRING), 'e5')
            WHEN 7 THEN concat(o_orderpriority, ' ')
            WHEN 8 THEN ''
            WHEN 9 THEN '-0'
            WHEN 10 THEN concat('900000000000000000000000', CAST(o_orderkey AS STRING))
            ELSE NULL END AS spelled
FROM {orders}
"""
