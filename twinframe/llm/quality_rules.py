"""Host-level quality rules.

Every text is measured, rules mark failures, failures are added up by host, each host's failure rate is shrunk towards
the rate of all hosts by a beta prior fitted to the hosts themselves, and the verdict on a host goes back to its texts.

Null or empty texts have no words and so fail the word-count rule. Texts without a host (null) get no host verdict.
Repeated rows are measured and counted each. Empty tables give empty results. Of the input only the named columns are
read, so other columns cannot clash with the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.arrow_text import Powers, Texts, counts_per_text, mixed, repeated_words, texts_of, word_bytes
from twinframe.session import stage

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Symbols for 100 words, and repeated lines for 100 lines, beyond which a text counts against its host.
MAX_SYMBOL_PERCENT = 50
MAX_DUP_LINE_PERCENT = 50
#: A host whose shrunk failure rate is above this is rejected.
MAX_HOST_RATE = 0.5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def line_counts(texts: Texts, powers: Powers, sums: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line, of each text."""
    start, end = texts.runs(texts.data != 0x0A)
    total = np.zeros(len(in_word) + 1, dtype=np.int64)
    np.cumsum(in_word, out=total[1:])
    filled = total[end] > total[start]
    start, end = start[filled], end[filled]
    of = texts.text_of(start)
    keys = mixed(texts.span_hash(sums, start, end, powers) ^ mixed(of.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(keys, return_index=True)
    later = np.ones(len(keys), dtype=bool)
    later[first] = False
    return np.bincount(of, minlength=len(texts)), np.bincount(of[later], minlength=len(texts))


def measures(texts: Texts, powers: Powers) -> list[np.ndarray]:
    """The columns of MEASURES for a run of texts."""
    words = texts.words(powers)
    in_word = word_bytes()[texts.data]
    sums = texts.prefix_hash(powers)
    symbol = np.zeros(256, dtype=bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    points = in_word & ((texts.data & 0xC0) != 0x80)
    lines, repeated = line_counts(texts, powers, sums, in_word)
    return [
        np.bincount(words.text, minlength=len(texts)),
        counts_per_text(texts, points),
        counts_per_text(texts, symbol[texts.data]),
        lines,
        repeated,
        repeated_words(words, len(texts)),
    ]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``id_col``, ``host`` and the measures of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            parts = [measures(texts, powers) for texts in texts_of(batch.column(2))]
            if parts:
                columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    names = [id_col, "host", *MEASURES]
    picked = docs.select(F.col(id_col), F.col(host_col).alias("host"), F.col(text_col).cast("string").alias("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:2]]
    return picked.mapInArrow(run, ", ".join([*fields, *(f"{m} long" for m in MEASURES)]))


def with_rules(facts: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``failed`` (any rule) to measured texts."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    symbols = 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words")
    lines = 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines")
    return facts.withColumns({"base_failed": base, "failed": base | symbols | lines})


def host_rates(facts: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: texts, failures, failure rate shrunk by the hosts' beta prior, verdict.

    The prior has the mean of all texts, and as its spread what the hosts' rates vary beyond binomial noise.
    """
    hosts = (
        facts.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count("*").alias("host_texts"), F.sum(F.col("failed").cast("long")).alias("host_failed"))
    )
    n, f = F.col("host_texts"), F.col("host_failed")
    total = hosts.agg(
        F.sum(n).alias("n"), F.sum(f).alias("f"), F.count("*").alias("hosts"), F.sum(f * f / n).alias("squares")
    ).first()
    mean = total.f / total.n if total.n else 0.0
    spread = (total.squares / total.n - mean**2 - mean * (1 - mean) * total.hosts / total.n) if total.n else 0.0
    strength = min(1e6, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6
    shrunk = (f + F.lit(mean * strength)) / (n + F.lit(strength))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > max_rate)


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_host_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """Every text with its measures, ``base_failed``, its host's rate and ``kept``.

    The measures (numbers only) are written once to the shared folder, so texts are read once. The host table joins
    back on the host; a host with a large share of the texts is a skewed key, which adaptive execution splits, as the
    other side holds one row per host.
    """
    facts = stage(with_rules(measured(docs, id_col, text_col, host_col)), "rules")
    hosts = host_rates(facts, max_host_rate)
    rejected = F.coalesce(F.col("host_rejected"), F.lit(False))
    return facts.join(hosts, "host", "left").withColumn("kept", ~F.col("base_failed") & ~rejected)
