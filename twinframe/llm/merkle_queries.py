"""The Merkle manifest query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Rows whose id's checksum this divides are shown with another length; a null id is never one of them.
TAMPERED = 7


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    leaves = docs.select(
        "doc_id",
        "lang",
        merkle.leaf_digest([F.col(c) for c in FIELDS]).alias("leaf"),
        F.when(tampered & F.col("n_chars").isNotNull(), merkle.leaf_digest(changed)).alias("changed"),
    )
    return merkle.proofs(merkle.manifest(leaves, "doc_id", "lang", "leaf", "changed")).withColumnRenamed("id", "doc_id")


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = " || ".join(_FIELD.format(c) for c in FIELDS)
_CHANGED = _LEAF.replace("CAST(n_chars AS VARCHAR)", "CAST(n_chars + 1 AS VARCHAR)")
_BITS = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
OP11_SQL = f"""
WITH RECURSIVE rows_of AS (
  SELECT doc_id, lang, sha256({_LEAF}) AS leaf, sha256({_CHANGED}) AS other,
    xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')], lambda c, b: {_BITS})) % {TAMPERED} = 0 AS hit
  FROM documents),
leaves AS (
  SELECT doc_id, leaf, CASE WHEN hit THEN other ELSE leaf END AS shown, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM rows_of),
inner_nodes AS (
  SELECT g, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM inner_nodes WHERE n > 1
  GROUP BY g, level, pos // 2, n),
subroots AS (SELECT g AS pos, digest, count(*) OVER () AS n FROM inner_nodes WHERE n = 1),
top_nodes AS (
  SELECT 0 AS level, pos, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM top_nodes WHERE n > 1 GROUP BY level, pos // 2, n),
depths AS (SELECT g, max(level) AS depth FROM inner_nodes GROUP BY g),
all_nodes AS (
  SELECT g, level, pos, digest FROM inner_nodes WHERE n > 1
  UNION ALL SELECT g, depth + level, t.pos, digest FROM top_nodes t, depths WHERE t.n > 1),
walks AS (
  SELECT row_number() OVER () AS rid, doc_id, leaf, g, 0 AS level, pos, shown AS digest, '' AS proof, l.n, false AS above FROM leaves l
  UNION ALL
  SELECT rid, doc_id, leaf, w.g, w.level + (w.n > 1)::INT, CASE WHEN w.n > 1 THEN w.pos // 2 ELSE w.g END,
    CASE WHEN w.n = 1 THEN w.digest WHEN a.digest IS NULL THEN sha256(w.digest)
      WHEN w.pos % 2 = 1 THEN sha256(a.digest || w.digest) ELSE sha256(w.digest || a.digest) END,
    proof || CASE WHEN w.n > 1 THEN coalesce(a.digest, '') ELSE '' END,
    CASE WHEN w.n > 1 THEN (w.n + 1) // 2 ELSE (SELECT count(*) FROM subroots) END, above OR w.n = 1
  FROM walks w LEFT JOIN all_nodes a ON a.g = w.g AND a.level = w.level AND a.pos = xor(w.pos, 1)
  WHERE w.n > 1 OR NOT above),
ends AS (SELECT * FROM walks WHERE above AND n = 1)
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, e.digest AS folded_root, e.digest = r.digest AS verified
FROM ends e JOIN subroots s ON s.pos = e.g, (SELECT digest FROM top_nodes WHERE n = 1) r
"""
