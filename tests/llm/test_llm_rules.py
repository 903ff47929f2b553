"""Host rules, shards and packing."""

import zlib

import check_queries
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.llm import packing, quality_rules, queries, sharding

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_against_sql(spark, name, monkeypatch):
    monkeypatch.setitem(check_queries.QUERIES, name, queries.QUERIES[name])
    monkeypatch.setitem(check_queries.ORACLES, name, queries.ORACLES[name])
    verdict, _, _ = check_queries.compare(spark, check_queries.open_views(SF), SF, name)
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", ["op5_license_scan", "op6_benchmark_search", "op10_host_rules"])
def test_edges_against_sql(spark, edges, tmp_path, name):
    import duckdb

    edges.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(edges.where("doc_id = 6").first()["text"].split()[:14])), (2, None), (3, ""), (4, "too short")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = queries.QUERIES[name](spark, str(tmp_path))
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    cursor = connection.execute(queries.ORACLES[name])
    wanted = check_queries.rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert check_queries.rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == wanted
    assert name == "op5_license_scan" or wanted


def test_rules_mark_a_bad_host(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good, "good") for i in range(40)] + [(100 + i, "few words", "bad") for i in range(40)] + [(200, good, "bad"), (201, good, None)]
    kept = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(40))
    assert not kept[200] and kept[201]


def test_rules_shrink_small_hosts(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(10 * h + i, good, f"h{h}") for h in range(30) for i in range(10)] + [(1000, "few words", "tiny"), (1001, good, "tiny2")]
    facts = quality_rules.with_rules(quality_rules.measured(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    rates = {r.host: r.host_rate for r in quality_rules.host_rates(facts).collect()}
    assert rates["tiny"] < 0.9 and rates["tiny"] > rates["h1"] >= 0


def test_rules_on_nothing(nothing):
    assert quality_rules.judged(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_and_its_inverse(n):
    numbers = np.arange(n)
    p = sharding.Permutation(n, "k")
    moved = p.forward(numbers)
    assert sorted(moved.tolist()) == numbers.tolist()
    assert (p.backward(moved) == numbers).all()
    assert n < 64 or (moved != sharding.Permutation(n, "other").forward(numbers)).any()


def check_shards(rows, n, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards(spark, edges, nothing):
    columns = ["doc_id", "source", "n_chars"]
    rows = sharding.sharded(edges, columns).collect()
    check_shards(rows, edges.count(), 8)
    again = sharding.sharded(edges.repartition(7), columns).collect()
    place = lambda rows: sorted((str(r.doc_id), r.shard, r.slot) for r in rows)
    assert place(rows) == place(again)
    assert sharding.sharded(nothing, columns).count() == 0


def test_shards_of_repeated_rows(spark):
    rows = sharding.sharded(spark.range(1000).select(F.lit(1).alias("doc_id")), ["doc_id"], 7).collect()
    check_shards(rows, 1000, 7)


def test_shard_files(spark, tmp_path):
    sharding.write_shards(spark.range(100).withColumnRenamed("id", "doc_id"), ["doc_id"], f"{tmp_path}/shards", 4)
    check_shards(spark.read.parquet(f"{tmp_path}/shards").collect(), 100, 4)


def test_shard_query(spark, tables):
    rows = queries.op7_feistel_shards(spark, SF).collect()
    check_shards(rows, tables("documents").count(), 8)
    texts = {r.doc_id: r.text for r in tables("documents").collect()}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode())) for r in rows)


def check_packing(rows, wanted, capacity):
    assert sorted((str(r[0]), *r[1:]) for r in rows) == sorted((str(w[0]), *w[1:]) for w in wanted)


def plain_pieces(docs, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        n = -(-len(ids) // capacity)
        cuts = [0] + [len(ids) - capacity * (n - 1 - k) for k in range(n)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            yield doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())


def check_slots(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(edges, capacity):
    pieces = packing.token_pieces(edges, *queries.tokenizer_files(), capacity=capacity)
    rows = packing.packed(pieces.withColumn("crc", F.crc32("ids")), capacity).collect()
    wanted = list(plain_pieces([(r.doc_id, r.text) for r in edges.collect()], capacity))
    check_packing([(r.doc_id, r.piece, r.start, r.length, r.crc) for r in rows], wanted, capacity)
    assert check_slots(rows, capacity) <= 1 + -(-sum(w[3] for w in wanted) * 10 // (9 * capacity))


def test_packing_with_the_vocabulary_file_alone(edges):
    json, ranks = queries.tokenizer_files()
    small = edges.where("doc_id <> 5 AND doc_id <> 13 OR doc_id IS NULL")
    both = [packing.token_pieces(small, json, r).orderBy("doc_id", "piece").collect() for r in (None, ranks)]
    assert both[0] == both[1]


def test_packing_nothing(nothing):
    assert packing.pack_texts(nothing, *queries.tokenizer_files()).count() == 0


def test_packing_query(spark, tables):
    rows = queries.op3_best_fit_packing(spark, SF).collect()
    wanted = list(plain_pieces([(r.doc_id, r.text) for r in tables("documents").collect()], 2048))
    check_packing([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], wanted, 2048)
    assert check_slots(rows, 2048) <= 1.02 * sum(w[3] for w in wanted) / 2048 + 1


def test_chunks_encode_like_whole_texts():
    import random

    import pyarrow as pa

    from twinframe.llm.arrow_text import texts_of

    json, ranks = queries.tokenizer_files()
    encoder = packing.Encoder(json, ranks)
    random.seed(3)
    parts = ["a", "Bc", "é", "  ", " ", "\n", "\t", " ", "　", "\u0085", "\x1c", "\x1f", "<|endoftext|>", "'s", "12", "!!", "|", "漢", "😀", "\r\n"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(5000)]
    got = []
    for part in texts_of(pa.array(texts)):
        ids, bounds = encoder.encode(part)
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_plan_places_every_piece():
    random = np.random.default_rng(2)
    for capacity, lengths in ((16, random.integers(1, 17, 3000)), (2048, np.minimum(2048, random.lognormal(5, 1.5, 20000)).astype(int) + 0)):
        values, counts = np.unique(np.maximum(lengths, 1), return_counts=True)
        rows = packing.plan(dict(zip(values.tolist(), counts.tolist())), capacity)
        room = {}
        for length, _, n, first, offset in rows.tolist():
            for s in range(first, first + n):
                assert room.get(s, 0) == offset
                room[s] = offset + length
        assert max(room.values()) <= capacity and rows[:, 2].sum() == len(lengths)
        assert len(room) <= 1.01 * np.maximum(lengths, 1).sum() / capacity + 1
