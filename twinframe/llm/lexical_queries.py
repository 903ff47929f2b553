"""The ranked search query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinframe.llm import lexical_search


def op13_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = (
    "unnest(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
)
OP13_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
items AS (SELECT row_number() OVER () AS iid, item_id, text FROM benchmark),
words AS (SELECT rid, {_TERMS.format("text")} AS term FROM docs),
lengths AS (SELECT rid, count(*) AS n FROM words GROUP BY rid),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
counted AS (SELECT rid, term, count(*) AS tf FROM words GROUP BY rid, term),
weighted AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(c.docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM counted, corpus c GROUP BY term),
asked AS (SELECT iid, term, count(*) AS qf FROM (SELECT iid, {_TERMS.format("text")} AS term FROM items) GROUP BY iid, term),
slow AS (SELECT rid, 100 - 75 + (75 * n * c.docs) // c.terms AS m FROM lengths, corpus c),
scores AS (
  SELECT iid, rid, CAST(sum(qf * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weighted USING (term) JOIN counted USING (term) JOIN slow USING (rid) GROUP BY iid, rid),
ranked AS (
  SELECT iid, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores JOIN docs USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN items USING (iid) WHERE rank <= {lexical_search.K}
"""
