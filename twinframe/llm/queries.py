"""One registered query for each operator of this package, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm import decontamination, jaccard_join, language_model, license_scan, packing, pseudonyms, quality_classifier, quality_rules, sharding, toxicity
from twinframe.llm.chat_queries import OP12_SQL, op12_chat_format
from twinframe.llm.labels import id_crc
from twinframe.llm.lexical_queries import OP13_SQL, op13_ball_tree_search
from twinframe.llm.merkle_queries import OP11_SQL, op11_merkle_manifest

MIN_QUALITY = 0.7
MIN_TOXICITY = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    return id_crc(id_col) % folds == fold


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """Distinct ids of the training fold with one label each; an id with contradicting labels counts as 0 for quality and
    1 for toxicity. Null ids and labels are left out."""
    one = F.min(label) if label == "quality" else F.max(label)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    return known.groupBy("doc_id").agg(one.alias(label))


def trained_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_classifier.Model | None:
    """The quality model of ``docs``, as query and pipeline use it."""
    positives = training_labels(table(spark, sf_dir, "labels"), "quality").where("quality = 1")
    return quality_classifier.train(docs, positives)


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality_classifier.scored(docs, trained_quality(spark, docs, sf_dir))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= MIN_QUALITY).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with their own columns."""
    return quality_classifier.accepted(docs, trained_quality(spark, docs, sf_dir), MIN_QUALITY)


def op2_gru_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out(folds=10, fold=0)
    scores = language_model.likelihoods(docs, ~held)
    return scores.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def tokenizer_files() -> tuple[str, str]:
    """Vocabulary and rank file of the public byte-level BPE tokenizer, at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def packed_digest(docs: DataFrame) -> DataFrame:
    """Places of all pieces, and a checksum of each in place of its ids."""
    pieces = packing.token_pieces(docs, *tokenizer_files())
    return packing.packed(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences."""
    return packed_digest(docs)


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised_docs(docs, "n_replaced")


def pseudonymised_docs(docs: DataFrame, count_col: str | None = None) -> DataFrame:
    return pseudonyms.pseudonymised(docs, count_col=count_col)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data, and their new length."""
    return pseudonymised_docs(docs).withColumn("n_chars", F.length("text").cast("long"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op6_benchmark_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = sharding.sharded(docs, ["doc_id", "text_crc32", "size"], shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_texts(table(spark, sf_dir, "documents"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return jaccard_join.one_of_each(docs)


def op9_toxic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, training_labels(table(spark, sf_dir, "labels"), "toxic"))
    scores = toxicity.scored(docs, model)
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= MIN_TOXICITY).cast("int").alias("predicted"))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SPACE = r"[\x20\x09-\x0D]+"
OP10_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT rid, i, w FROM (
    SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i
    FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM docs))),
windows AS (
  SELECT rid, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w1, w2) AS n FROM windows WHERE w2 IS NOT NULL) WHERE n > 1),
repeats AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
facts AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM docs LEFT JOIN repeats USING (rid) LEFT JOIN lines USING (rid)),
marked AS (
  SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    100 * n_symbols > {quality_rules.MAX_SYMBOL_PERCENT} * n_words OR 100 * n_dup_lines > {quality_rules.MAX_DUP_LINE_PERCENT} * n_lines AS other_failed
  FROM facts),
hosts AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed OR other_failed) AS DOUBLE) AS f
  FROM marked WHERE source IS NOT NULL GROUP BY source),
total AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS s, count(*) / sum(n) AS h FROM hosts),
prior AS (
  SELECT m, CASE WHEN s - m * m - m * (1 - m) * h > 0
    THEN least(1e6, greatest(1.0, m * (1 - m) / (s - m * m - m * (1 - m) * h) - 1)) ELSE 1e6 END AS k FROM total),
verdicts AS (SELECT source, (f + m * k) / (n + k) > {quality_rules.MAX_HOST_RATE} AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM marked LEFT JOIN verdicts USING (source)
"""

EDGE = r"[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP8_SQL = rf"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
stripped AS (SELECT doc_id, [coalesce(nullif(regexp_replace(regexp_replace(w, '^{EDGE}', ''), '{EDGE}$', ''), ''), w) FOR w IN ws] AS ws FROM lowered),
sets AS (
  SELECT doc_id, list_sort(list_distinct(
    [array_to_string(ws[i:i + {jaccard_join.WIDTH - 1}], ' ') FOR i IN range(1, greatest(2, len(ws) - {jaccard_join.WIDTH - 2}))])) AS x
  FROM stripped WHERE len(ws) > 0),
classes AS (SELECT x, min(doc_id) AS copy_id, count(*) AS n_copies, len(x) AS n FROM sets GROUP BY x),
items AS (SELECT copy_id, n, unnest(x) AS item FROM classes),
pairs AS (
  SELECT a.copy_id AS a, b.copy_id AS b FROM items a JOIN items b ON a.item = b.item AND a.copy_id < b.copy_id
  GROUP BY a.copy_id, b.copy_id, a.n, b.n
  HAVING count(*) >= {jaccard_join.THRESHOLD} * (a.n + b.n - count(*)) - 1e-9),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT DISTINCT a AS id, a AS root FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
degrees AS (SELECT a AS id, count(*) AS n_links FROM edges GROUP BY a)
SELECT l.doc_id, coalesce(r.root, c.copy_id, l.doc_id) AS class_id, coalesce(c.copy_id, l.doc_id) AS copy_id,
  CAST(coalesce(c.n_copies, 1) AS BIGINT) AS n_copies, CAST(coalesce(d.n_links, 0) AS BIGINT) AS n_links
FROM lowered l LEFT JOIN sets s ON l.doc_id = s.doc_id LEFT JOIN classes c ON s.x = c.x
LEFT JOIN roots r ON c.copy_id = r.id LEFT JOIN degrees d ON c.copy_id = d.id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pu_quality": op1_pu_quality,
    "op2_gru_likelihood": op2_gru_likelihood,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_license_scan": op5_license_scan,
    "op6_benchmark_search": op6_benchmark_search,
    "op7_feistel_shards": op7_feistel_shards,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_toxic_pairs": op9_toxic_pairs,
    "op10_host_rules": op10_host_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_chat_format": op12_chat_format,
    "op13_ball_tree_search": op13_ball_tree_search,
}
ORACLES: dict[str, str] = {
    "op5_license_scan": license_scan.oracle_sql(),
    "op6_benchmark_search": decontamination.oracle_sql(),
    "op8_jaccard_join": OP8_SQL,
    "op10_host_rules": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_chat_format": OP12_SQL,
    "op13_ball_tree_search": OP13_SQL,
}
