"""The registered queries, and for each the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinframe.functions import canon as cn
from twinframe.functions import text as tx
from twinframe.operators import (
    align,
    dashboards,
    key_checks,
    keys,
    profile_checks,
    sampling,
    schema_checks,
    selection,
    summaries,
    value_checks,
)
from twinframe.operators.results import RESULT_COLUMNS, public
from twinframe.plans.metadata import METADATA_COLUMNS, compare_counts
from twinframe.plans.metadata import metadata_compare as compare_metadata
from twinframe.plans.pair import Pair
from twinframe.plans.suite import run_suite
from twinframe.plans.validate import validate, validate_frames
from twinframe.session import scratch_path, shuffles_released
from twinframe.sources import encoding, files, sinks, workbook, xlsx
from twinframe.sources.registry import load_source
from twinframe.spec import SuiteSpec, ValidationSpec
from workloads import containers, pairs
from workloads.oracle import SqlPair, canon, present, quoted, stripped
from workloads.pairs import derive, plain, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


# --- Pairs -----------------------------------------------------------------------------------------------

ORDERS_KINDS = {
    "o_orderkey": ("int", "int"),
    "o_custkey": ("int", "string"),
    "o_orderstatus": ("string", "string"),
    "o_totalprice": ("double", "double"),
    "o_orderdate": ("timestamp", "timestamp"),
    "o_orderpriority": ("string", "string"),
    "code": ("string", "string"),
}
LINE_KEYS = ["l_orderkey", "l_linenumber"]
LINE_KINDS = (
    dict.fromkeys(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], ("int", "int"))
    | dict.fromkeys(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ("double", "double"))
    | dict.fromkeys(["l_returnflag", "l_linestatus"], ("string", "string"))
    | {"l_shipdate": ("timestamp", "timestamp")}
)
DOC_KINDS = {
    "doc_id": ("int", "int"),
    "text": ("string", "string"),
    "lang": ("string", "string"),
    "source": ("string", "string"),
    "n_chars": ("int", "string"),
}
CHAT_KEYS = ["conv_id", "turn"]

ORDERS_SQL = SqlPair(pairs.ORDERS_SOURCE, pairs.ORDERS_TARGET, ["o_orderkey"], ORDERS_KINDS)
REDUCED_SQL = SqlPair(pairs.ORDERS_SOURCE, pairs.ORDERS_TARGET, ["o_orderkey"], ORDERS_KINDS, reduced="target")
LINES_SQL = SqlPair(pairs.LINEITEM_SOURCE, pairs.LINEITEM_TARGET, LINE_KEYS, LINE_KINDS)
REDUCED_LINES_SQL = SqlPair(pairs.LINEITEM_SOURCE, pairs.LINEITEM_TARGET, LINE_KEYS, LINE_KINDS, reduced="source")
DOCS_SQL = SqlPair(pairs.DOCUMENTS_SOURCE, pairs.DOCUMENTS_TARGET, ["doc_id"], DOC_KINDS)


def orders_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return derive(spark, d, pairs.ORDERS_SOURCE), derive(spark, d, pairs.ORDERS_TARGET)


def orders(spark: SparkSession, d: str, subset: bool = False) -> Pair:
    return Pair(*orders_sides(spark, d), ["o_orderkey"], subset=subset)


def line_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return derive(spark, d, pairs.LINEITEM_SOURCE), derive(spark, d, pairs.LINEITEM_TARGET)


def lines(spark: SparkSession, d: str, subset: bool = False) -> Pair:
    return Pair(*line_sides(spark, d), LINE_KEYS, subset=subset)


def docs(spark: SparkSession, d: str) -> Pair:
    sides = derive(spark, d, pairs.DOCUMENTS_SOURCE), derive(spark, d, pairs.DOCUMENTS_TARGET)
    return Pair(*sides, ["doc_id"], subset=False)


# --- Sources ---------------------------------------------------------------------------------------------

_AS_TEXT = (
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_custkey, nullif(o_orderstatus, '') AS o_orderstatus, "
    "nullif(o_orderpriority, '') AS o_orderpriority, code, "
    "CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM ({})"
)


def _text_sides(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("o_orderkey").cast("string"),
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        "code",
        F.expr(tx.timestamp_text("o_orderdate")).alias("o_orderdate"),
    )


@query("csv_roundtrip", _AS_TEXT.format(plain(pairs.ORDERS_TARGET)))
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "orders-csv")
    sinks.write_table(_text_sides(derive(spark, d, pairs.ORDERS_TARGET)), path)
    return load_source(spark, {"type": "file", "format": "csv", "path": path})


@query(
    "csv_quoted_text",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(text, '') AS text, lang, source FROM documents",
)
def csv_quoted_text(spark: SparkSession, d: str) -> DataFrame:
    """Whole document texts with separators, quotes and line breaks, tab separated."""
    path = scratch_path(spark, "documents-tsv")
    whole = table(spark, d, "documents").select(F.col("doc_id").cast("string"), "text", "lang", "source")
    whole.write.options(header=True, sep="\t", quote='"', escape='"', quoteAll=True).csv(path)
    return load_source(spark, {"type": "file", "format": "csv", "path": path, "sep": "\t"})


_ENCODED = """
SELECT CAST(doc_id AS STRING) AS path, text, CASE doc_id % 3 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'UTF-16'
       ELSE 'ISO-8859-1' END AS charset FROM {documents}
"""


@query(
    "detect_encoding",
    """SELECT CAST(doc_id AS VARCHAR) AS path,
       CASE WHEN doc_id % 3 = 1 THEN 'utf-16'
            WHEN doc_id % 3 = 2 AND regexp_matches(
              regexp_replace(text, '[^\\x{0}-\\x{FF}]', '?', 'g'), '[^\\x{0}-\\x{7F}]') THEN 'iso-8859-1'
            ELSE 'utf-8' END AS encoding
       FROM documents""",
)
def detect_encoding(spark: SparkSession, d: str) -> DataFrame:
    spelled = derive(spark, d, _ENCODED)
    latin = F.regexp_replace("text", r"[^\x{0}-\x{FF}]", "?")
    content = (
        F.when(F.col("charset") == "UTF-8", F.encode("text", "UTF-8"))
        .when(F.col("charset") == "UTF-16", F.encode("text", "UTF-16"))
        .otherwise(F.encode(latin, "ISO-8859-1"))
    )
    return encoding.detect_encoding(spelled.select("path", content.alias("content")))


@query(
    "decode_files",
    "SELECT CAST(doc_id AS VARCHAR) AS path, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n FROM documents",
)
def decode_files(spark: SparkSession, d: str) -> DataFrame:
    """Texts written in UTF-8 or UTF-16 come back whole."""
    spelled = derive(spark, d, _ENCODED)
    content = F.when(F.col("charset") == "UTF-16", F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    text = encoding.decoded(F.col("content"))
    return spelled.select("path", content.alias("content")).select(
        "path", F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("n")
    )


def _json_documents(spark: SparkSession, d: str, orient: str) -> DataFrame:
    """One JSON document per 250 customers, in the given layout."""
    cells = "c_name, CAST(c_custkey AS STRING) AS c_custkey, c_mktsegment"
    rows = derive(spark, d, f"SELECT c_custkey AS k, floor(c_custkey / 250) AS block, {cells} FROM {{customer}}")
    names = ["c_custkey", "c_name", "c_mktsegment"]
    grouped = rows.groupBy(F.concat(F.lit("block-"), F.col("block").cast("string")).alias("path"))
    if orient == "values":
        content = F.to_json(F.collect_list(F.array(*names)))
    elif orient == "index":
        cell = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
        content = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("string"), cell))))
    else:
        per_column = [
            F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("string"), F.col(n)))).alias(n) for n in names
        ]
        return grouped.agg(*per_column).select("path", F.to_json(F.struct(*names)).alias("content"))
    return grouped.agg(content.alias("content"))


_CUSTOMER_TEXT = "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer"


@query(
    "json_orients",
    f"WITH c AS ({_CUSTOMER_TEXT}) SELECT 'index' AS orient, * FROM c UNION ALL SELECT 'columns', * FROM c "
    "UNION ALL SELECT 'values', * FROM c",
)
def json_orients(spark: SparkSession, d: str) -> DataFrame:
    names = ["c_custkey", "c_name", "c_mktsegment"]
    frames = []
    for orient in ("index", "columns", "values"):
        rows = files.json_table(_json_documents(spark, d, orient), orient)
        rows = rows.toDF(*names) if orient == "values" else rows.select(*names)
        frames.append(rows.select(F.lit(orient).alias("orient"), "*"))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("json_records", "SELECT event_id, event_type, props FROM events")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "events-json")
    records = table(spark, d, "events").select("event_id", "event_type", "props")
    records.groupBy(F.floor(F.col("event_id") / 1000)).agg(
        F.to_json(F.collect_list(F.struct("event_id", "event_type", "props"))).alias("value")
    ).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return load_source(spark, {"type": "file", "format": "json", "path": path}).select("event_id", "event_type", "props")


_DOCUMENT_OBJECTS = "SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, text || '}' || lang AS \"in\" FROM documents"


def _document_objects(spark: SparkSession, d: str) -> DataFrame:
    """Documents as JSON objects with an object inside; texts hold line breaks, quotes and, at the end, a brace."""
    inner = F.struct(F.length("text").cast("long").alias("n"), F.concat("text", F.lit("}"), "lang").alias("in"))
    return table(spark, d, "documents").select("doc_id", F.to_json(F.struct("doc_id", "text", inner.alias("deep"))).alias("value"))


def _read_objects(spark: SparkSession, path: str) -> DataFrame:
    rows = load_source(spark, {"type": "file", "format": "json", "path": path})
    return rows.select("doc_id", "text", F.col("deep.n").alias("n"), F.col("deep.in").alias("in"))


@query("json_lines", _DOCUMENT_OBJECTS)
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """One object on each line, in several files; the reader splits them."""
    path = scratch_path(spark, "documents-lines")
    _document_objects(spark, d).select("value").write.text(path)
    return _read_objects(spark, path)


@query("json_large_array", _DOCUMENT_OBJECTS)
def json_large_array(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of 500 documents, each in a file without line breaks, which several tasks can read."""
    path = scratch_path(spark, "documents-arrays")
    objects = _document_objects(spark, d).withColumn("part", F.floor(F.col("doc_id") / 500))
    # a window keeps the rows of a file in one task and in order; a repartition before a join may be read by map task
    in_file = Window.partitionBy("part").orderBy("doc_id")
    opening = F.when(F.row_number().over(in_file) == 1, "[").otherwise("")
    closing = F.when(F.lead(F.lit(1)).over(in_file).isNull(), "]").otherwise(",")
    placed = objects.select("part", F.concat(opening, "value", closing).alias("value"))
    placed.write.partitionBy("part").option("lineSep", " ").text(path)
    return _read_objects(spark, path)


@query(
    "xlsx_rows",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal, "
    "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer",
)
def xlsx_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = derive(
        spark,
        d,
        "SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END "
        "AS c_mktsegment FROM {customer}",
    )
    return xlsx.xlsx_table(containers.xlsx_files(rows, "c_custkey"), "data")


@query(
    "workbook_extract",
    "SELECT p_partkey, p_name || ', ' || p_type AS p_name, p_brand, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
)
def workbook_extract(spark: SparkSession, d: str) -> DataFrame:
    """Commas inside names show in tab separated members that the comma is not their separator."""
    name = F.concat("p_name", F.lit(", "), "p_type").alias("p_name")
    rows = table(spark, d, "part").select("p_partkey", name, "p_brand", "p_size", "p_retailprice")
    return workbook.workbook_extract(containers.embedded_workbooks(rows, "p_partkey"))


def _catalogs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name", "c_nationkey")
    return containers.catalog_workbooks(rows, "c_custkey", "c_mktsegment", "c_name", "c_nationkey")


@query(
    "workbook_catalog",
    """SELECT 'block-' || lpad(CAST(c_custkey // 500 AS VARCHAR), 8, '0') AS path, c_mktsegment AS datasource_name,
       c_name AS column_name, CAST(c_nationkey AS VARCHAR) AS datatype, '[' || c_name || ']' AS raw_name FROM customer""",
)
def workbook_catalog(spark: SparkSession, d: str) -> DataFrame:
    return workbook.workbook_catalog(_catalogs(spark, d)).select("path", *workbook.CATALOG_COLUMNS)


@query(
    "workbook_profile",
    """SELECT 'block-' || lpad(CAST(c_custkey // 500 AS VARCHAR), 8, '0') AS path, 'catalog' AS workbook_name,
       CAST(count(DISTINCT c_mktsegment) AS INT) AS datasource_count, CAST(count(*) % 7 AS INT) AS worksheet_count,
       CAST(count(*) % 3 AS INT) AS dashboard_count, false AS has_embedded_data, 'metadata' AS data_source_type
       FROM customer GROUP BY c_custkey // 500""",
)
def workbook_profile(spark: SparkSession, d: str) -> DataFrame:
    return workbook.workbook_profile(_catalogs(spark, d))


@query(
    "fuzzy_name_match",
    f"""WITH pairs AS (SELECT p_brand, 'Smal ' || p_brand || ' rngs' AS wanted, p_name AS name, min(p_partkey) AS place
                     FROM part GROUP BY p_brand, p_name),
    scored AS (SELECT *, CASE WHEN wanted = name THEN 2.0 ELSE 1 - CAST(levenshtein(lower(wanted), lower(name)) AS DOUBLE)
                         / greatest(length(wanted), length(name), 1) END AS ratio FROM pairs)
    SELECT p_brand, wanted, arg_min(name, (-ratio, place)) FILTER (ratio > {workbook.LEAST_SIMILARITY}) AS match
    FROM scored GROUP BY p_brand, wanted""",
)
def fuzzy_name_match(spark: SparkSession, d: str) -> DataFrame:
    """Per part brand the part name most like a misspelled request."""
    pairs_of_brand = derive(
        spark,
        d,
        "SELECT p_brand, concat('Smal ', p_brand, ' rngs') AS wanted, p_name AS name, "
        "min(p_partkey) AS place FROM {part} GROUP BY p_brand, p_name",
    )
    return workbook.fuzzy_name_match(pairs_of_brand, "p_brand")


@query(
    "table_scan",
    "SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem",
)
def table_scan(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "lineitem").createOrReplaceTempView("scan_lineitem")
    columns = ["L_SHIPDATE", "l_quantity", "L_ORDERKEY", "no_such_column"]
    return load_source(spark, {"type": "table", "table": "scan_lineitem", "columns": columns})


@query("project_columns", "SELECT o_custkey, o_orderdate FROM orders")
def project_columns(spark: SparkSession, d: str) -> DataFrame:
    config = {"type": "file", "path": f"{d}/orders.parquet", "columns": ["o_orderdate", "o_custkey"]}
    return load_source(spark, config)


@query(
    "target_limit",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000",
)
def target_limit(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("limit_orders")
    columns = ["o_orderkey", "o_custkey", "o_totalprice"]
    config = {"type": "table", "table": "limit_orders", "columns": columns, "limit": 1000}
    return load_source(spark, config, order_by=["o_orderkey"])


_HALF_LINES = "SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem"


@query(
    "target_limit_half",
    f"{_HALF_LINES} ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT (SELECT count(*) // 2 FROM lineitem)",
)
def target_limit_half(spark: SparkSession, d: str) -> DataFrame:
    """The first half of the lines by ship date: no task sees more than a range of them."""
    lineitem = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber")]
    return selection.first_rows(lineitem, order, lineitem.count() // 2, few=0)


@query(
    "pk_pushdown",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem "
    "WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
)
def pk_pushdown(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").where("o_orderstatus = 'F'")
    wanted = wanted.select(F.col("o_orderkey").alias("l_orderkey"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return keys.restrict_to_keys(rows, wanted, ["l_orderkey"])


@query(
    "pk_pushdown_coerced",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer "
    "WHERE c_mktsegment = 'BUILDING')",
)
def pk_pushdown_coerced(spark: SparkSession, d: str) -> DataFrame:
    """Text keys of a file restrict the number keys of a table."""
    wanted = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    wanted = wanted.select(F.concat(F.lit("00"), F.col("c_custkey").cast("string")).alias("o_custkey"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return keys.restrict_to_keys(rows, wanted, ["o_custkey"], "coerce").drop("o_custkey")


def _profile_sql(source: str, types: dict[str, str]) -> str:
    return f"WITH t AS ({plain(source)}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS name, '{k}' AS dtype, (SELECT count(*) FROM t WHERE {c} IS NULL) AS null_count, "
        f"(SELECT count(*) FROM t) AS row_count, CAST({len(types)} AS BIGINT) AS column_count"
        for c, k in types.items()
    )


@query(
    "source_profile",
    _profile_sql(
        pairs.ORDERS_TARGET,
        {
            "o_orderkey": "bigint",
            "o_custkey": "string",
            "o_orderstatus": "string",
            "o_totalprice": "double",
            "o_orderdate": "timestamp_ntz",
            "o_orderpriority": "string",
            "code": "string",
        },
    ),
)
def source_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile_checks.source_profile(derive(spark, d, pairs.ORDERS_TARGET))


def _small_results(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, pairs.RESULT_ROWS)


_RESULTS_SQL = plain(pairs.RESULT_ROWS).replace("AS column,", 'AS "column",')


@query("results_sink", f'SELECT validation, result, "column", pk, detail, source_value, target_value FROM ({_RESULTS_SQL})')
def results_sink(spark: SparkSession, d: str) -> DataFrame:
    path = sinks.write_results(public(_small_results(spark, d)), scratch_path(spark, "sink"), "Orders / Nightly run")
    return sinks.read_results(spark, path)


# --- Alignment -------------------------------------------------------------------------------------------


def _aligned(spark: SparkSession, d: str, target: DataFrame, **options) -> DataFrame:
    source = table(spark, d, "orders")
    return align.apply_alignment(source, align.resolve_alignment(source.columns, target.columns, **options))


def _renamed_orders(spark: SparkSession, d: str, *names: str) -> DataFrame:
    return table(spark, d, "orders").toDF(*names)


_ORDER_FIELDS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _renaming_sql(names: list[str]) -> str:
    return "SELECT " + ", ".join(f"{a} AS {b}" for a, b in zip(_ORDER_FIELDS, names)) + " FROM orders"


_EXPLICIT = ["id", "customer", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("align_explicit", _renaming_sql(_EXPLICIT))
def align_explicit(spark: SparkSession, d: str) -> DataFrame:
    mapping = {"o_orderkey": "id", "o_custkey": "customer", "no_such": "id2", "o_orderdate": "absent"}
    return _aligned(spark, d, _renamed_orders(spark, d, *_EXPLICIT), mapping=mapping)


_PREFIX = ["orderkey", "custkey", "orderstatus", "totalprice", "orderdate", "orderpriority"]


@query("align_prefix", _renaming_sql(_PREFIX))
def align_prefix(spark: SparkSession, d: str) -> DataFrame:
    target = _renamed_orders(spark, d, *[f"t_{n}" for n in _PREFIX])
    aligned = _aligned(spark, d, target, source_prefixes=["x_", "o_"], target_prefixes=["t_"])
    return aligned.toDF(*[c.removeprefix("t_") for c in aligned.columns])


_SUFFIX = ["orderkey", "dim_o_custkey", "orderstatus", "o_totalprice", "orderdate", "orderpriority"]


@query("align_suffix", _renaming_sql(_SUFFIX))
def align_suffix(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d, _renamed_orders(spark, d, *_SUFFIX), by_suffix=True)


_AUTO = ["id", "custkey", "o_orderstatus", "o_totalprice", "x_o_orderdate", "o_orderpriority"]


@query("align_auto", _renaming_sql([*_AUTO[:5], "o_orderpriority"]))
def align_auto(spark: SparkSession, d: str) -> DataFrame:
    """Explicit, equal, prefix and suffix rules together; two names fit the last column, so it stays."""
    target = _renamed_orders(spark, d, *_AUTO[:5], "orderpriority")
    target = target.withColumn("x_o_orderpriority", F.col("orderpriority"))
    return _aligned(
        spark, d, target, mapping={"o_orderkey": "id"}, by_suffix=True, source_prefixes=["o_"], target_prefixes=["x_"]
    )


@query(
    "common_columns",
    ORDERS_SQL.ctes()
    + " "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", (SELECT count(*) FROM s WHERE {c} IS NULL) AS s_nulls, "
        f"(SELECT count(*) FROM t WHERE {c} IS NULL) AS t_nulls"
        for c in ORDERS_SQL.columns
    ),
)
def common_columns(spark: SparkSession, d: str) -> DataFrame:
    return profile_checks.column_profile(orders(spark, d), ["nulls"]).select("column", "s_nulls", "t_nulls")


@query(
    "normalize_strings",
    "SELECT doc_id, " + stripped("chr(9) || '  ' || text || chr(10) || ' '") + " AS text, lang FROM documents",
)
def normalize_strings(spark: SparkSession, d: str) -> DataFrame:
    padded = F.concat(F.lit("\t  "), F.col("text"), F.lit("\n "))
    return align.normalize_strings(table(spark, d, "documents").select("doc_id", padded.alias("text"), "lang"))


@query("normalize_columns", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def normalize_columns(spark: SparkSession, d: str) -> DataFrame:
    return align.lower_columns(
        table(spark, d, "customer").select(F.col("c_custkey").alias("C_CUSTKEY"), "c_name", F.col("c_acctbal").alias("C_AcctBal"))
    )


# --- Reducing and sampling -------------------------------------------------------------------------------


@query("smart_subset", REDUCED_SQL.ctes() + " SELECT * FROM t")
def smart_subset(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d, subset=True).target


@query("smart_subset_source", REDUCED_LINES_SQL.ctes() + " SELECT l_orderkey, l_linenumber, l_extendedprice FROM s")
def smart_subset_source(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d, subset=True).source.select(*LINE_KEYS, "l_extendedprice")


_SAMPLE = "(SELECT o_orderkey FROM s0 GROUP BY o_orderkey ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 500)"


@query(
    "quick_sample",
    ORDERS_SQL.ctes()
    + f" SELECT 'source' AS side, o_orderkey, o_totalprice FROM s WHERE o_orderkey IN {_SAMPLE}"
    + f" UNION ALL SELECT 'target', o_orderkey, o_totalprice FROM t WHERE o_orderkey IN {_SAMPLE}",
)
def quick_sample(spark: SparkSession, d: str) -> DataFrame:
    source, target = orders_sides(spark, d)
    target = target.withColumnRenamed("o_orderkey", "orderkey")
    left, right = sampling.quick_sample(source, target, ["o_orderkey"], ["orderkey"], 500, 42)
    left = left.select(F.lit("source").alias("side"), "o_orderkey", "o_totalprice")
    return left.unionByName(
        right.select(F.lit("target").alias("side"), F.col("orderkey").alias("o_orderkey"), "o_totalprice")
    )


@query(
    "dedup_first",
    LINES_SQL.ctes() + " SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
    "ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag NULLS FIRST, "
    "l_linestatus NULLS FIRST, l_shipdate) AS _rn FROM t) WHERE _rn = 1",
)
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return keys.dedup_first(derive(spark, d, pairs.LINEITEM_TARGET), LINE_KEYS)


@query(
    "duplicate_keys",
    LINES_SQL.ctes() + f" SELECT {LINES_SQL.label('g')} AS pk, n AS row_count FROM sk g WHERE n > 1",
)
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return keys.duplicate_groups(table(spark, d, "lineitem"), LINE_KEYS)


@query(
    "key_set_ops",
    LINES_SQL.ctes()
    + f" SELECT {LINES_SQL.label('x')} AS pk, 'both' AS side FROM (SELECT sk.* FROM sk JOIN tk USING (l_orderkey, l_linenumber)) x"
    + f" UNION ALL SELECT {LINES_SQL.label('so')}, 'source' FROM so UNION ALL SELECT {LINES_SQL.label('xo')}, 'target' FROM xo",
)
def key_set_ops(spark: SparkSession, d: str) -> DataFrame:
    return keys.key_set_ops(*line_sides(spark, d), LINE_KEYS)


@query("source_only_keys", ORDERS_SQL.ctes() + f" SELECT {ORDERS_SQL.label('so')} AS pk FROM so")
def source_only_keys(spark: SparkSession, d: str) -> DataFrame:
    return key_checks.one_sided_keys(orders(spark, d), "source")


@query("target_only_keys", ORDERS_SQL.ctes() + f" SELECT {ORDERS_SQL.label('xo')} AS pk FROM xo")
def target_only_keys(spark: SparkSession, d: str) -> DataFrame:
    return key_checks.one_sided_keys(orders(spark, d), "target")


# --- Checks ----------------------------------------------------------------------------------------------


def _check(name: str, sql: SqlPair, body: str, run: Callable[[SparkSession, str], DataFrame]) -> None:
    query(name, sql.query(body))(lambda spark, d: public(run(spark, d)))


_check("record_count", ORDERS_SQL, ORDERS_SQL.record_count(), lambda s, d: key_checks.record_count(orders(s, d)))
_check(
    "record_count_reduced",
    REDUCED_LINES_SQL,
    REDUCED_LINES_SQL.record_count(),
    lambda s, d: key_checks.record_count(lines(s, d, True)),
)
_check("duplicate_check", LINES_SQL, LINES_SQL.duplicates(), lambda s, d: key_checks.duplicates(lines(s, d)))
_check(
    "duplicate_check_orders", ORDERS_SQL, ORDERS_SQL.duplicates(), lambda s, d: key_checks.duplicates(orders(s, d))
)
_check(
    "null_check",
    ORDERS_SQL,
    ORDERS_SQL.nulls(),
    lambda s, d: profile_checks.Profile(orders(s, d), ["nulls"]).nulls(),
)
_check("empty_string", ORDERS_SQL, ORDERS_SQL.empties(), lambda s, d: profile_checks.Profile(orders(s, d), ["empties"]).empty_strings())
_check("pk_match", ORDERS_SQL, ORDERS_SQL.key_match(), lambda s, d: key_checks.key_match(orders(s, d)))
_check("pk_match_composite", LINES_SQL, LINES_SQL.key_match(), lambda s, d: key_checks.key_match(lines(s, d)))
_check(
    "data_compare_pk",
    ORDERS_SQL,
    ORDERS_SQL.values_check(),
    lambda s, d: value_checks.row_checks(orders(s, d), [value_checks.VALUE]),
)
_check(
    "data_compare_duplicate_keys",
    LINES_SQL,
    LINES_SQL.values_check(),
    lambda s, d: value_checks.row_checks(lines(s, d), [value_checks.VALUE]),
)
_check(
    "data_compare_text",
    DOCS_SQL,
    DOCS_SQL.values_check(),
    lambda s, d: value_checks.row_checks(docs(s, d), [value_checks.VALUE]),
)
_check("distinct_count", LINES_SQL, LINES_SQL.distinct(), lambda s, d: profile_checks.distinct_check(lines(s, d)))
_check("distinct_count_text", DOCS_SQL, DOCS_SQL.distinct(), lambda s, d: profile_checks.distinct_check(docs(s, d)))
@query(
    "distinct_estimate",
    "SELECT unnest(['l_orderkey', 'l_linenumber', 'l_extendedprice', 'l_returnflag', 'l_shipdate']) AS \"column\", "
    "unnest([count(DISTINCT l_orderkey), count(DISTINCT l_linenumber), count(DISTINCT l_extendedprice), "
    "count(DISTINCT l_returnflag), count(DISTINCT l_shipdate)]) AS exact, true AS within FROM lineitem",
)
def distinct_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Exact distinct counts, and whether the estimates of a side lie within four standard errors of them."""
    lineitem = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate")
    pair = Pair(lineitem, lineitem.limit(0))
    names = F.array(*[F.lit(c) for c in pair.common])
    both = profile_checks.distinct_counts(pair).select("c", F.col("n_s").alias("exact")).join(profile_checks.distinct_estimates(pair), "c")
    near = F.abs(F.col("n_s") - F.col("exact")) <= 4 * profile_checks.SKETCH_ERROR * F.col("exact")
    return both.select(F.get(names, F.col("c")).alias("column"), "exact", near.alias("within"))


_check(
    "date_range",
    ORDERS_SQL,
    ORDERS_SQL.dates(),
    lambda s, d: profile_checks.Profile(orders(s, d), ["dates"]).date_ranges(),
)
_check(
    "case_sensitivity",
    ORDERS_SQL,
    ORDERS_SQL.casing(),
    lambda s, d: value_checks.row_checks(orders(s, d), [value_checks.CASING]),
)
_check(
    "leading_zero",
    ORDERS_SQL,
    ORDERS_SQL.zeros(),
    lambda s, d: value_checks.row_checks(orders(s, d), [value_checks.ZERO]),
)
_check(
    "special_char",
    DOCS_SQL,
    DOCS_SQL.special(),
    lambda s, d: value_checks.row_checks(docs(s, d), [value_checks.SPECIAL]),
)
_check(
    "row_checksum",
    ORDERS_SQL,
    ORDERS_SQL.checksums(),
    lambda s, d: value_checks.row_checks(orders(s, d), [value_checks.HASH]),
)
_check(
    "row_checksum_duplicate_keys",
    LINES_SQL,
    LINES_SQL.checksums(),
    lambda s, d: value_checks.row_checks(lines(s, d), [value_checks.HASH]),
)
_check(
    "symmetric_difference",
    LINES_SQL,
    LINES_SQL.symmetric(),
    lambda s, d: key_checks.symmetric_difference(lines(s, d)),
)


def _positional_sql(source: str, target: str, order: str, columns: list[str]) -> str:
    """First hundred differing cells by row and column, and how many more there are."""
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS c, i, {present_quoted(f's_{c}', c)} AS sv, {present_quoted(f't_{c}', c)} AS tv FROM j "
        f"WHERE {canon(f'CAST(s_{c} AS VARCHAR)')} IS DISTINCT FROM {canon(f'CAST(t_{c} AS VARCHAR)')}"
        for c in columns
    )
    fields = ", ".join(f"s.{c} AS s_{c}, t.{c} AS t_{c}" for c in columns)
    return f"""
WITH s AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS i FROM ({plain(source)})),
t AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS i FROM ({plain(target)})),
j AS (SELECT s.i AS i, {fields} FROM s JOIN t ON s.i = t.i),
m AS (SELECT *, row_number() OVER (ORDER BY i, c) AS rn, count(*) OVER () AS n FROM ({cells}))
SELECT 'data_validation' AS validation, 'FAIL' AS result, c AS "column", 'index=' || i AS pk,
       'Values do not match' AS detail, substr(sv, 1, 100) AS source_value, substr(tv, 1, 100) AS target_value
FROM m WHERE rn <= 100
UNION ALL SELECT 'data_validation', 'INFO', '', '', '... and ' || (n - 100) || ' more mismatches (showing first 100)', '', ''
FROM m WHERE rn = 1 AND n > 100
UNION ALL SELECT 'data_validation', 'PASS', '', '', 'All ' || (SELECT count(*) FROM j) || ' rows match across {len(columns)} common columns', '', ''
WHERE NOT EXISTS (SELECT 1 FROM m)"""


def present_quoted(x: str, column: str) -> str:
    return quoted(x) if column in ("role", "text", "lang", "source") else f"CAST({x} AS VARCHAR)"


@query(
    "data_compare_positional",
    _positional_sql(
        pairs.CONVERSATIONS_SOURCE, pairs.CONVERSATIONS_TARGET, "conv_id, turn", ["conv_id", "role", "text", "turn"]
    ),
)
def data_compare_positional(spark: SparkSession, d: str) -> DataFrame:
    sides = derive(spark, d, pairs.CONVERSATIONS_SOURCE), derive(spark, d, pairs.CONVERSATIONS_TARGET)
    return public(value_checks.row_checks(Pair(*sides, order_by=CHAT_KEYS), [value_checks.VALUE]))


@query(
    "data_compare_shifted",
    _positional_sql(
        "SELECT c_custkey, c_nationkey FROM {customer}",
        "SELECT c_custkey, c_nationkey FROM {customer} WHERE c_custkey <> 11",
        "c_custkey",
        ["c_custkey", "c_nationkey"],
    ),
)
def data_compare_shifted(spark: SparkSession, d: str) -> DataFrame:
    """One missing row moves every later position."""
    source = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    pair = Pair(source, source.where("c_custkey <> 11"), order_by=["c_custkey"])
    return public(value_checks.row_checks(pair, [value_checks.VALUE]))


@query(
    "data_compare_file_order",
    "SELECT 'data_validation' AS validation, 'PASS' AS result, '' AS \"column\", '' AS pk, "
    "'All ' || count(*) || ' rows match across 11 common columns' AS detail, '' AS source_value, '' AS target_value "
    "FROM lineitem",
)
def data_compare_file_order(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "lineitem")
    return public(value_checks.row_checks(Pair(source, table(spark, d, "lineitem")), [value_checks.VALUE]))


def _agree(rows: str, columns: int) -> str:
    """SQL for one row that says that all rows agree."""
    return (
        f"SELECT 'data_validation' AS validation, 'PASS' AS result, '' AS \"column\", '' AS pk, "
        f"'All ' || ({rows}) || ' rows match across {columns} common columns' AS detail, '' AS source_value, '' AS target_value"
    )


def _values(source: DataFrame, target: DataFrame) -> DataFrame:
    return public(value_checks.row_checks(Pair(source, target), [value_checks.VALUE]))


#: Rows for which a table is sorted in a given few partitions; larger tables get that many more.
SORTED_ROWS = 4_000_000


def _parts(rows: DataFrame, few: int) -> int:
    return few * max(1, -(-rows.count() // SORTED_ROWS))


@query("data_compare_csv_order", _agree("SELECT count(*) FROM lineitem", 6))
def data_compare_csv_order(spark: SparkSession, d: str) -> DataFrame:
    """One table written twice as CSV, in one order but cut into files differently, compared row by row."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"]
    rows = table(spark, d, "lineitem").select(*columns)
    sides = []
    for parts in (3, 7):
        path = scratch_path(spark, f"lines-{parts}")
        sorted_rows = rows.repartitionByRange(_parts(rows, parts), *columns).sortWithinPartitions(*columns)
        with shuffles_released(spark):  # many small files, each read whole, so they may be packed
            sorted_rows.write.options(header=True, maxRecordsPerFile=5000 * parts, compression="gzip").csv(path)
        sides.append(load_source(spark, {"type": "file", "format": "csv", "path": path}))
    return _values(*sides)


@query("data_compare_filtered_order", _agree("SELECT count(*) FROM lineitem WHERE l_orderkey % 3 = 0", 11))
def data_compare_filtered_order(spark: SparkSession, d: str) -> DataFrame:
    """A filtered scan of several files against the same rows written without the others."""
    rows = table(spark, d, "lineitem")
    paths = scratch_path(spark, "lines-whole"), scratch_path(spark, "lines-third")
    for path, part, n in zip(paths, (rows, rows.where("l_orderkey % 3 = 0")), (6, 2)):
        part.repartitionByRange(_parts(rows, n), *rows.columns).sortWithinPartitions(*rows.columns).write.parquet(path)
    return _values(spark.read.parquet(paths[0]).where("l_orderkey % 3 = 0"), spark.read.parquet(paths[1]))


@query(
    "data_compare_mixed_duplicates",
    "SELECT 'data_validation' AS validation, 'PASS' AS result, '' AS \"column\", '' AS pk, 'All values match for ' || "
    "(SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) || ' common records across 11 columns' "
    "AS detail, '' AS source_value, '' AS target_value",
)
def data_compare_mixed_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Rows with repeated keys against themselves with numbers as text: both sides must choose the same copy."""
    source = table(spark, d, "lineitem")
    texts = {c: F.col(c).cast("string") for c in ("l_partkey", "l_suppkey")}
    pair = Pair(source, source.withColumns(texts), LINE_KEYS)
    return public(value_checks.row_checks(pair, [value_checks.VALUE]))


_DATE_FORMS = {
    "compact": "yyyyMMdd",
    "named": "dd-MMM-yyyy",
    "dotted": "dd.MM.yyyy",
    "dashed": "d-M-yyyy",
    "slashed": "MM/dd/yyyy",
    "iso": "yyyy-MM-dd",
}


@query(
    "date_range_text",
    " UNION ALL ".join(
        f"SELECT 'date_range_check' AS validation, 'FAIL' AS result, '{name}' AS \"column\", '' AS pk, "
        "'Date range mismatch' AS detail, min(a) || ' to ' || max(a) AS source_value, min(b) || ' to ' || max(b) AS target_value "
        "FROM (SELECT date_trunc('day', o_orderdate) AS a, date_trunc('day', o_orderdate) + INTERVAL 400 DAY AS b FROM orders)"
        for name in sorted(_DATE_FORMS)
    ),
)
def date_range_text(spark: SparkSession, d: str) -> DataFrame:
    """Order dates as text in several forms, against dates over a year later in the same forms."""
    days = [F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 400 DAY")]
    sides = [
        table(spark, d, "orders").select(*[F.date_format(day, _DATE_FORMS[c]).alias(c) for c in sorted(_DATE_FORMS)])
        for day in days
    ]
    return public(profile_checks.Profile(Pair(*sides), ["dates"]).date_ranges())


@query(
    "date_range_ambiguous",
    "SELECT 'date_range_check' AS validation, 'FAIL' AS result, 'day' AS \"column\", '' AS pk, 'Date range mismatch' AS detail, "
    "min(a) || ' to ' || max(a) AS source_value, min(b) || ' to ' || max(b) AS target_value FROM (SELECT "
    "CASE WHEN day(o_orderdate) <= 12 THEN date_trunc('day', o_orderdate) END AS a, "
    "date_trunc('day', o_orderdate) + INTERVAL 400 DAY AS b FROM orders)",
)
def date_range_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    """A side where every date reads as day or month first, against one that allows only day first."""
    orders_table = table(spark, d, "orders")
    early = orders_table.where("day(o_orderdate) <= 12").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    later = F.col("o_orderdate") + F.expr("INTERVAL 400 DAY")
    late = orders_table.select(F.date_format(later, "dd/MM/yyyy").alias("day"))
    return public(profile_checks.Profile(Pair(early, late), ["dates"]).date_ranges())


_MIXED = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(text, '') AS text, lang FROM documents"


@query("csv_mixed_folder", _MIXED)
def csv_mixed_folder(spark: SparkSession, d: str) -> DataFrame:
    """A folder of UTF-8, UTF-16 and Latin-1 files, some with line breaks in cells, read as one table."""
    path = scratch_path(spark, "mixed")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string"), "text", "lang")
    fits = F.encode(F.regexp_replace("text", "[^\\x00-\\xFF]", ""), "ISO-8859-1")
    latin = (F.decode(fits, "ISO-8859-1") == F.col("text")) & (F.col("doc_id") % 3 == 2)
    kinds = {"UTF-16": F.col("doc_id") % 3 == 1, "ISO-8859-1": latin}
    kinds["UTF-8"] = ~kinds["UTF-16"] & ~latin
    for charset, rows in kinds.items():
        quoted = {"header": True, "quote": '"', "escape": '"', "quoteAll": True, "encoding": charset}
        docs.where(rows).write.mode("append").options(**quoted).csv(path)
    return load_source(spark, {"type": "file", "format": "csv", "path": path})


@query("data_compare_mixed_order", _agree("SELECT count(*) FROM customer", 5))
def data_compare_mixed_order(spark: SparkSession, d: str) -> DataFrame:
    """A folder in which the middle file has its columns in another order, against the same rows with one header, by place."""
    path, rows = scratch_path(spark, "customers-mixed"), table(spark, d, "customer")
    cut = rows.agg(F.min("c_custkey").alias("a"), F.max("c_custkey").alias("b")).first()
    third = (cut.b - cut.a) // 3 + 1
    for name, k in (("a", 0), ("b", 1), ("c", 2)):
        part = rows.where(F.col("c_custkey").between(cut.a + k * third, cut.a + (k + 1) * third - 1)).orderBy("c_custkey")
        part.select(*(reversed(rows.columns) if name == "b" else rows.columns)).write.options(header=True).csv(f"{path}/mixed/{name}")
    rows.orderBy("c_custkey").write.options(header=True).csv(f"{path}/plain")
    sides = [load_source(spark, {"type": "file", "format": "csv", "path": f"{path}/{p}"}) for p in ("mixed/*", "plain")]
    return public(value_checks.row_checks(Pair(*sides), [value_checks.VALUE]))


@query("csv_header_orders", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_header_orders(spark: SparkSession, d: str) -> DataFrame:
    """Files of one folder with their columns in different orders."""
    path = scratch_path(spark, "headers")
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    rows.where("c_custkey % 2 = 0").write.options(header=True).csv(path)
    rows.where("c_custkey % 2 = 1").select(*reversed(rows.columns)).write.mode("append").options(header=True).csv(path)
    return load_source(spark, {"type": "file", "format": "csv", "path": path}).select(*rows.columns)


@query(
    "json_key_order",
    """SELECT column_name AS name, CAST(row_number() OVER (ORDER BY ordinal_position DESC) - 1 AS INTEGER) AS place,
       (SELECT count(*) FROM supplier) AS n
       FROM information_schema.columns WHERE table_name = 'supplier'""",
)
def json_key_order(spark: SparkSession, d: str) -> DataFrame:
    """Column order of objects whose keys are not in the order of the alphabet."""
    path = scratch_path(spark, "objects")
    rows = table(spark, d, "supplier")
    several = F.floor(F.col("s_suppkey") / 500)  # the objects of one file
    objects = F.to_json(F.collect_list(F.struct(*reversed(rows.columns))))
    rows.groupBy(several).agg(objects.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    read = files.read_json(spark, path)
    names = F.posexplode(F.array(*[F.lit(c) for c in read.columns])).alias("place", "name")
    return read.agg(F.count("*").alias("n")).select(names, "n").select("name", "place", "n")


@query(
    "metadata_compare_bad_file",
    """SELECT 'good' AS name, CAST(count(*) AS VARCHAR) AS csv_rows, '2' AS csv_cols, CAST(count(*) AS VARCHAR) AS table_rows,
       '2' AS table_cols, 'YES' AS rows_match, 'YES' AS cols_match, 'PASSED' AS status FROM customer
       UNION ALL SELECT 'bad', 'ERROR', 'ERROR', 'N/A', 'N/A', 'ERROR', 'ERROR', 'FAILED'""",
)
def metadata_compare_bad_file(spark: SparkSession, d: str) -> DataFrame:
    """One of two files has a line with more cells than its header, which only shows while it is read."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string"), "c_name")
    paths = [scratch_path(spark, name) for name in ("good", "bad")]
    for path in paths:
        rows.write.options(header=True).csv(path)
    lines = rows.where("c_custkey % 100 = 0").select(F.concat_ws(",", "c_custkey", "c_name", F.lit("more")).alias("c_custkey,c_name"))
    lines.write.mode("append").options(header=True, quote="").csv(paths[1])
    side = {"type": "file", "format": "csv"}
    specs = [
        ValidationSpec(name=name, source={**side, "path": path}, target={**side, "path": paths[0]})
        for name, path in zip(("good", "bad"), paths)
    ]
    return compare_metadata(spark, specs).drop("csv_file", "table")


# --- Schema checks ---------------------------------------------------------------------------------------


def _bare_pair(spark: SparkSession, d: str) -> Pair:
    """Customers against suppliers with table prefixes taken off."""
    source, target = table(spark, d, "customer"), table(spark, d, "supplier")
    return Pair(
        source.toDF(*[c.removeprefix("c_") for c in source.columns]),
        target.toDF(*[c.removeprefix("s_") for c in target.columns]),
        subset=False,
    )


def _described(name: str) -> str:
    return (
        f"(SELECT substr(column_name, 3) AS name, row_number() OVER (ORDER BY ordinal_position) - 1 AS place, "
        f"CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' "
        f"WHEN 'DOUBLE' THEN 'double' END AS dtype FROM information_schema.columns WHERE table_name = '{name}')"
    )


_DESCRIBED = f"WITH a AS {_described('customer')}, b AS {_described('supplier')}"


@query(
    "column_count",
    f"""{_DESCRIBED}, x AS (SELECT (SELECT count(*) FROM a) AS s, (SELECT count(*) FROM b) AS t,
    (SELECT count(*) FROM a JOIN b USING (name)) AS c,
    (SELECT string_agg('''' || name || '''', ', ' ORDER BY name) FROM a WHERE name NOT IN (SELECT name FROM b)) AS so,
    (SELECT string_agg('''' || name || '''', ', ' ORDER BY name) FROM b WHERE name NOT IN (SELECT name FROM a)) AS xo)
    SELECT 'column_count_check' AS validation, 'PASS' AS result, '' AS "column", '' AS pk,
    'Source: ' || s || ' columns, Target: ' || t || ' columns, Common: ' || c || ' | Source-only: [' || so ||
    '] | Target-only: [' || xo || ']' AS detail, CAST(s AS VARCHAR) AS source_value, CAST(t AS VARCHAR) AS target_value
    FROM x""",
)
def column_count(spark: SparkSession, d: str) -> DataFrame:
    return public(schema_checks.column_count(_bare_pair(spark, d)))


@query(
    "column_order",
    f"""{_DESCRIBED} SELECT 'column_order_check' AS validation, 'FAIL' AS result, a.name AS "column", '' AS pk,
    'Column order differs' AS detail, CAST(a.place AS VARCHAR) AS source_value, CAST(b.place AS VARCHAR) AS target_value
    FROM a JOIN b USING (name) WHERE a.place <> b.place
    UNION ALL SELECT 'column_order_check', 'PASS', '', '', 'Column order matches', '', ''
    WHERE NOT EXISTS (SELECT 1 FROM a JOIN b USING (name) WHERE a.place <> b.place)""",
)
def column_order(spark: SparkSession, d: str) -> DataFrame:
    return public(schema_checks.column_order(_bare_pair(spark, d)))


@query(
    "metadata_types",
    f"""{_DESCRIBED} SELECT 'metadata_type_check' AS validation, 'PASS' AS result, name AS "column", '' AS pk,
    'Compatible types: Source ''' || a.dtype || ''', Target ''' || b.dtype || '''' AS detail,
    a.dtype AS source_value, b.dtype AS target_value FROM a JOIN b USING (name)""",
)
def metadata_types(spark: SparkSession, d: str) -> DataFrame:
    return public(schema_checks.metadata_types(_bare_pair(spark, d)))


_DIGITS = "length(CAST(CAST(floor(max(o_totalprice)) AS BIGINT) AS VARCHAR)) + 2"


@query(
    "column_specs",
    f"""SELECT 'column_precision_check' AS validation, 'FAIL' AS result, 'o_totalprice' AS "column", '' AS pk,
    'Precision/Scale mismatch: ' || p || ',2 vs ' || (p + 2) || ',3' AS detail, p || ',2' AS source_value,
    (p + 2) || ',3' AS target_value FROM (SELECT {_DIGITS} AS p FROM orders)""",
)
def column_specs(spark: SparkSession, d: str) -> DataFrame:
    """Prices as decimals just wide enough for the largest one, against wider ones."""
    rows = table(spark, d, "orders")
    digits = len(str(int(rows.agg(F.max("o_totalprice")).first()[0]))) + 2
    sides = [rows.withColumn("o_totalprice", F.col("o_totalprice").cast(t)) for t in (f"decimal({digits},2)", f"decimal({digits + 2},3)")]
    return public(schema_checks.column_specs(Pair(*sides, ["o_orderkey"], subset=False)))


# --- Scalar functions ------------------------------------------------------------------------------------


@query("canonical_values", f"SELECT o_orderkey, {canon('spelled')} AS canonical FROM ({plain(pairs.SPELLINGS)})")
def canonical_values(spark: SparkSession, d: str) -> DataFrame:
    rows = derive(spark, d, pairs.SPELLINGS)
    return rows.select("o_orderkey", F.expr(cn.canon("spelled", rows.schema["spelled"].dataType)).alias("canonical"))


@query(
    "row_hash",
    "SELECT l_orderkey, l_linenumber, md5(concat_ws('|', "
    + ", ".join(
        present(c, LINE_KINDS[c][0])
        for c in ("l_partkey", "l_extendedprice", "l_discount", "l_linestatus", "l_shipdate")
    )
    + f")) AS row_md5 FROM ({plain(pairs.LINEITEM_TARGET)})",
)
def row_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = derive(spark, d, pairs.LINEITEM_TARGET)
    names = ["l_partkey", "l_extendedprice", "l_discount", "l_linestatus", "l_shipdate"]
    return rows.select(*LINE_KEYS, value_checks.row_hash(rows.schema, names).alias("row_md5"))


@query(
    "float_text",
    "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice * 1000000000000 AS VARCHAR) AS large, "
    "CAST(l_extendedprice * 1000 AS VARCHAR) AS middle, CAST(l_discount / 1048576 AS VARCHAR) AS small FROM lineitem",
)
def float_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.select(
        *LINE_KEYS,
        F.expr(tx.float_text("(l_extendedprice * 1000000000000)")).alias("large"),
        F.expr(tx.float_text("(l_extendedprice * 1000)")).alias("middle"),
        F.expr(tx.float_text("(l_discount / 1048576)")).alias("small"),
    )


@query(
    "text_forms",
    """SELECT p_partkey, substr(lower(trim(regexp_replace(p_type || ' / ' || p_name || '!', '[^A-Za-z0-9_]+', '_', 'g'), '_')), 1, 40)
       AS slug, CASE WHEN length(p_name || p_type) <= 16 THEN p_name || p_type
       ELSE substr(p_name || p_type, 1, 13) || '...' END AS truncated FROM part""",
)
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    name = "concat(p_type, ' / ', p_name, '!')"
    return table(spark, d, "part").selectExpr(
        "p_partkey", f"{tx.slug(name)} AS slug", f"{tx.truncated('concat(p_name, p_type)', 16)} AS truncated"
    )


# --- Reports ---------------------------------------------------------------------------------------------


def _count(result: str) -> str:
    return f"count(*) FILTER (result = '{result}')"


@query(
    "run_summary",
    f"SELECT {_count('PASS')} AS pass_count, {_count('FAIL')} AS fail_count, {_count('SKIP')} AS skip_count, "
    f"count(*) AS total_count, CASE WHEN {_count('FAIL')} = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({_RESULTS_SQL})",
)
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return summaries.run_summary(_small_results(spark, d))


@query(
    "validation_breakdown",
    f"SELECT validation, {_count('PASS')} AS passes, {_count('FAIL')} AS fails, {_count('SKIP')} AS skips, "
    f"{_count('INFO')} AS infos FROM ({_RESULTS_SQL}) GROUP BY validation",
)
def validation_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return summaries.validation_breakdown(_small_results(spark, d))


@query(
    "culprit_columns",
    f"SELECT \"column\", count(*) AS failures FROM ({_RESULTS_SQL}) WHERE result = 'FAIL' AND \"column\" <> '' "
    'GROUP BY "column" ORDER BY failures DESC, "column" LIMIT 20',
)
def culprit_columns(spark: SparkSession, d: str) -> DataFrame:
    return summaries.culprit_columns(_small_results(spark, d))


@query(
    "consolidated_summary",
    f"SELECT validation_name, CASE WHEN {_count('FAIL')} = 0 THEN 'PASS' ELSE 'FAIL' END AS status, "
    f"{_count('PASS')} AS passed, {_count('FAIL')} AS failed, count(*) AS total FROM ({_RESULTS_SQL}) GROUP BY validation_name",
)
def consolidated_summary(spark: SparkSession, d: str) -> DataFrame:
    return summaries.consolidated_summary(_small_results(spark, d))


@query(
    "signoff_summary",
    f"""WITH r AS ({_RESULTS_SQL}), f AS (SELECT * FROM r WHERE result = 'FAIL'),
    first AS (SELECT * FROM f ORDER BY check_no LIMIT 1),
    parts AS (SELECT string_agg(n || ' ' || replace(validation, '_', ' '), ', ' ORDER BY validation) AS p
              FROM (SELECT validation, count(*) AS n FROM f GROUP BY validation))
    SELECT CASE WHEN (SELECT count(*) FROM f) = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
    (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM r WHERE result = 'PASS') AS passed,
    (SELECT count(*) FROM f) AS failed,
    'Failures: ' || p || CASE WHEN "column" <> '' THEN ' (e.g. column "' || "column" || '")' ELSE '' END || ' — ' ||
    CASE WHEN length(detail) > 120 THEN substr(detail, 1, 120) || '…' ELSE detail END AS reason FROM first, parts""",
)
def signoff_summary(spark: SparkSession, d: str) -> DataFrame:
    return summaries.signoff_summary(_small_results(spark, d))


@query(
    "metadata_compare",
    f"""WITH o AS ({plain(pairs.ORDERS_SOURCE)}), t AS ({plain(pairs.ORDERS_TARGET)}), c AS (
    SELECT 'orders' AS name, 'orders.csv' AS csv_file, (SELECT count(*) FROM o) AS a, 7 AS x, 'orders' AS "table",
           (SELECT count(*) FROM t) AS b, 7 AS y
    UNION ALL SELECT 'lines', 'lines.csv', (SELECT count(*) FROM lineitem), 11, 'lineitem', (SELECT count(*) FROM lineitem), 11
    UNION ALL SELECT 'parties', 'customer.csv', (SELECT count(*) FROM customer), 5, 'supplier', (SELECT count(*) FROM supplier), 4)
    SELECT name, csv_file, CAST(a AS VARCHAR) AS csv_rows, CAST(x AS VARCHAR) AS csv_cols, "table",
    CAST(b AS VARCHAR) AS table_rows, CAST(y AS VARCHAR) AS table_cols,
    CASE WHEN a = b THEN 'YES' ELSE 'NO' END AS rows_match, CASE WHEN x = y THEN 'YES' ELSE 'NO' END AS cols_match,
    CASE WHEN a = b AND x = y THEN 'PASSED' ELSE 'FAILED' END AS status FROM c
    UNION ALL SELECT 'gone', 'gone.csv', 'ERROR', 'ERROR', 'orders', 'N/A', 'N/A', 'ERROR', 'ERROR', 'FAILED'
    UNION ALL SELECT 'no_table', 'orders.csv', CAST((SELECT count(*) FROM o) AS VARCHAR), '7', 'gone', 'ERROR', 'ERROR',
    'ERROR', 'ERROR', 'FAILED'""",
)
def metadata_compare(spark: SparkSession, d: str) -> DataFrame:
    source, target = orders_sides(spark, d)
    item = table(spark, d, "lineitem")
    return compare_counts(
        spark,
        [
            ("orders", "orders.csv", source, "orders", target),
            ("lines", "lines.csv", item, "lineitem", item),
            ("parties", "customer.csv", table(spark, d, "customer"), "supplier", table(spark, d, "supplier")),
            ("gone", "gone.csv", None, "orders", target),
            ("no_table", "orders.csv", source, "gone", None),
        ],
    ).select(*METADATA_COLUMNS)


# --- Dashboards ------------------------------------------------------------------------------------------


@query(
    "catalog_align",
    f"""WITH a AS (SELECT lower(name) AS key, name, "index" FROM ({plain(pairs.TABS_A).replace('AS index', 'AS "index"')})),
    b AS (SELECT lower(name) AS key, name, "index" FROM ({plain(pairs.TABS_B).replace('AS index', 'AS "index"')}))
    SELECT coalesce(a.key, b.key) AS key, coalesce(a.name, b.name) AS name_a, coalesce(a."index", -1) AS index_a,
    coalesce(b.name, a.name) AS name_b, coalesce(b."index", -1) AS index_b,
    CASE WHEN a.key IS NULL THEN 'Missing in Old' WHEN b.key IS NULL THEN 'Missing in New' ELSE '' END AS reason
    FROM a FULL JOIN b ON a.key = b.key""",
)
def catalog_align(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.catalog_align(derive(spark, d, pairs.TABS_A), derive(spark, d, pairs.TABS_B), "Old", "New")


_RULES = f"""WITH e AS ({plain(pairs.ELEMENTS)}), v AS (
  SELECT *, 'font_family' AS violation_type, 'Arial, Roboto' AS expected, font_family AS found FROM e
  WHERE font_family <> '' AND NOT (contains(lower(font_family), 'arial') OR contains(lower(font_family), 'roboto'))
  UNION ALL SELECT *, 'font_size', '10px, 11px, 12px, 13px, 14px, 16px', font_size FROM e
  WHERE font_size <> '' AND lower(font_size) NOT IN ('10px', '11px', '12px', '13px', '14px', '16px')
  UNION ALL SELECT *, 'color', '#FFFFFF, #000000, #4E79A7', upper(color) FROM e
  WHERE starts_with(color, '#') AND upper(color) NOT IN ('#FFFFFF', '#000000', '#4E79A7'))"""


@query("allowlist_conformance", f"{_RULES} SELECT * FROM v")
def allowlist_conformance(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.allowlist_violations(
        derive(spark, d, pairs.ELEMENTS), pairs.FONTS, pairs.FONT_SIZES, pairs.COLOURS
    )


@query(
    "allowlist_verdict",
    f"{_RULES} SELECT e.tab AS tab, (SELECT count(*) FROM v WHERE v.tab = e.tab) AS violations, "
    "CASE WHEN (SELECT count(*) FROM v WHERE v.tab = e.tab) = 0 THEN 'PASS' ELSE 'FAIL' END AS result "
    "FROM (SELECT DISTINCT tab FROM e) e",
)
def allowlist_verdict(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.allowlist_verdict(
        derive(spark, d, pairs.ELEMENTS), pairs.FONTS, pairs.FONT_SIZES, pairs.COLOURS
    )


def _timing_sql(col: str, mark: str) -> str:
    valid = f"FILTER ({col} >= 0)"
    return (
        f"count(*) {valid} AS {mark}_valid, coalesce(min({col}) {valid}, 0.0) AS {mark}_min, "
        f"coalesce(max({col}) {valid}, 0.0) AS {mark}_max, "
        f"round(coalesce(avg({col}) {valid}, 0.0), 6) AS {mark}_avg"
    )


_PERF = (
    f"SELECT label, {_timing_sql('first_render_ms', 'first_render')}, {_timing_sql('interaction_ms', 'interaction')} "
    f"FROM ({plain(pairs.MEASUREMENTS)}) GROUP BY label"
)
_PERF_VERDICT = (
    f"SELECT *, first_render_valid > 0 AND first_render_avg <= 15000 AS first_render_pass, "
    f"interaction_valid = 0 OR interaction_avg <= 8000 AS interaction_pass, "
    "CASE WHEN first_render_valid > 0 AND first_render_avg <= 15000 AND (interaction_valid = 0 OR interaction_avg <= 8000) "
    f"THEN 'PASS' ELSE 'FAIL' END AS result FROM ({_PERF})"
)


@query("perf_threshold", _PERF_VERDICT)
def perf_threshold(spark: SparkSession, d: str) -> DataFrame:
    verdict = dashboards.perf_threshold(derive(spark, d, pairs.MEASUREMENTS))
    return verdict.withColumns({c: F.round(c, 6) for c in ("first_render_avg", "interaction_avg")})


@query(
    "perf_report",
    f"""WITH v AS ({_PERF_VERDICT}), m AS ({plain(pairs.MEASUREMENTS)})
    SELECT m.label AS dashboard_label, m.url AS dashboard_url, m.iteration AS iteration,
    CASE WHEN first_render_ms >= 0 THEN CAST(CAST(first_render_ms AS BIGINT) AS VARCHAR) ELSE 'ERROR' END AS first_render_ms,
    CASE WHEN interaction_ms >= 0 THEN CAST(CAST(interaction_ms AS BIGINT) AS VARCHAR) ELSE 'ERROR' END AS interaction_ms,
    '15000' AS first_render_threshold_ms, '8000' AS interaction_threshold_ms,
    CAST(CAST(round_even(first_render_avg, 0) AS BIGINT) AS VARCHAR) AS first_render_avg_ms,
    CAST(CAST(round_even(interaction_avg, 0) AS BIGINT) AS VARCHAR) AS interaction_avg_ms,
    first_render_pass, interaction_pass, result = 'PASS' AS overall_pass FROM m JOIN v USING (label)""",
)
def perf_report(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.perf_report(derive(spark, d, pairs.MEASUREMENTS))


@query(
    "diff_score_summary",
    f"""SELECT scenario_label, count(*) FILTER (s >= 0.98) AS passed, count(*) FILTER (s < 0.98) AS failed,
    count(*) AS total, round(avg(s) FILTER (s > 0), 4) AS avg_score
    FROM (SELECT scenario_label, coalesce(ssim_score, 0.0) AS s FROM ({plain(pairs.SCORES)})) GROUP BY scenario_label""",
)
def diff_score_summary(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.diff_score_summary(derive(spark, d, pairs.SCORES))


@query(
    "similarity_verdicts",
    f"SELECT tab_name, scenario_label, coalesce(ssim_score, 0.0) AS ssim_score, CASE WHEN coalesce(ssim_score, 0.0) >= 0.98 "
    f"THEN 'PASS' ELSE 'FAIL' END AS result FROM ({plain(pairs.SCORES)})",
)
def similarity_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.similarity_verdicts(derive(spark, d, pairs.SCORES))


# --- Whole validations -----------------------------------------------------------------------------------


def _schema_rows(kinds: dict[str, tuple[str, str]], names: dict[str, tuple[str, str]]) -> list[tuple]:
    """Column count and type rows, which follow from the schemas."""
    width = len(kinds)
    rows = [
        (
            "column_count_check",
            "PASS",
            "",
            f"Source: {width} columns, Target: {width} columns, Common: {width}",
            width,
            width,
        )
    ]
    for column in sorted(kinds):
        left, right = names[column]
        fits = kinds[column][0] == kinds[column][1]
        detail = f"{'Compatible' if fits else 'Incompatible'} types: Source '{left}', Target '{right}'"
        rows.append(("metadata_type_check", "PASS" if fits else "FAIL", column, detail, left, right))
    return rows


_SPARK_NAMES = {"int": "bigint", "string": "string", "double": "double", "timestamp": "timestamp_ntz"}


def _standard(sql: SqlPair, ints: tuple[str, ...] = ()) -> list[str]:
    names = {
        c: tuple("int" if c in ints and k == "int" else _SPARK_NAMES[k] for k in kinds)
        for c, kinds in sql.kinds.items()
    }
    bodies = [sql.record_count()]
    if sql.reduced:
        bodies.append(sql.subset_note())
    bodies += [sql.literal(_schema_rows(sql.kinds, names)), sql.duplicates(), sql.nulls(), sql.empties()]
    return [*bodies, sql.key_match(), sql.values_check()]


def _regression(sql: SqlPair, ints: tuple[str, ...] = ()) -> list[str]:
    same = sql.literal(
        [
            ("column_order_check", "PASS", "", "Column order matches", "", ""),
            ("column_specs_check", "PASS", "", "All column specifications match", "", ""),
        ]
    )
    more = [same, sql.distinct(), sql.dates(), sql.casing(), sql.zeros(), sql.special(), sql.checksums()]
    return [*_standard(sql, ints), *more, sql.symmetric()]


@query("validate_standard", REDUCED_SQL.query(*_standard(REDUCED_SQL)))
def validate_standard(spark: SparkSession, d: str) -> DataFrame:
    return validate_frames(*orders_sides(spark, d), ValidationSpec(primary_keys=["o_orderkey"])).df


@query("validate_regression", REDUCED_SQL.query(*_regression(REDUCED_SQL)))
def validate_regression(spark: SparkSession, d: str) -> DataFrame:
    return validate_frames(*orders_sides(spark, d), ValidationSpec(primary_keys=["o_orderkey"], regression=True)).df


@query(
    "validate_regression_lineitem",
    REDUCED_LINES_SQL.query(*_regression(REDUCED_LINES_SQL, ints=("l_linenumber",))),
)
def validate_regression_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return validate_frames(*line_sides(spark, d), ValidationSpec(primary_keys=LINE_KEYS, regression=True)).df


def _suite(spark: SparkSession, d: str) -> SuiteSpec:
    """Two validations over catalog tables, with key names that differ between the sides."""
    source, target = orders_sides(spark, d)
    source.toDF(*[f"X_{c}" for c in source.columns]).createOrReplaceTempView("suite_orders_source")
    target.createOrReplaceTempView("suite_orders_target")
    left, right = line_sides(spark, d)
    left.createOrReplaceTempView("suite_lines_source")
    right.createOrReplaceTempView("suite_lines_target")
    return SuiteSpec.from_dict(
        {
            "validations": [
                {
                    "name": "orders",
                    "source": {"type": "table", "table": "suite_orders_source"},
                    "target": {"type": "table", "table": "suite_orders_target"},
                    "primary_keys": "X_o_orderkey",
                    "source_prefixes_to_strip": ["x_"],
                },
                {
                    "name": "lines",
                    "source": {"type": "table", "table": "suite_lines_source"},
                    "target": {"type": "table", "table": "suite_lines_target"},
                    "primary_keys": "l_orderkey; l_linenumber",
                },
            ]
        }
    )


def _suite_sql() -> str:
    parts = [
        f"SELECT '{name}' AS validation_name, * FROM ({sql.query(*_standard(sql, ints))})"
        for name, sql, ints in (
            ("orders", REDUCED_SQL, ()),
            ("lines", REDUCED_LINES_SQL, ("l_linenumber",)),
        )
    ]
    return " UNION ALL ".join(parts)


@query("run_suite", _suite_sql())
def suite(spark: SparkSession, d: str) -> DataFrame:
    return run_suite(spark, _suite(spark, d)).df


@query("consolidated_results", _suite_sql())
def consolidated_results(spark: SparkSession, d: str) -> DataFrame:
    path = sinks.write_results(run_suite(spark, _suite(spark, d)).df, scratch_path(spark, "suite"), "consolidated")
    return sinks.read_results(spark, path).select("validation_name", *RESULT_COLUMNS)
