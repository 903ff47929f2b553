"""Similarity join, window searches, pseudonyms and the pipeline."""

import random
import re

import duckdb
import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinframe.llm import decontamination, jaccard_join, license_scan, pseudonyms, quality_classifier, queries, windows
from twinframe.llm.components import components

SF = "/root/testdata/sf0.001"
KEY = "pseudonym-key-1"


def joined(rows):
    return {r.doc_id: (r.class_id, r.copy_id, r.n_copies, r.n_links) for r in rows}


def test_join_query(spark, tables):
    rows = queries.op8_jaccard_join(spark, SF).collect()
    assert joined(rows) == plain.similar([(r.doc_id, r.text) for r in tables("documents").collect()])


def test_join_large_group_of_near_copies(spark, monkeypatch):
    """More near copies than a block holds, all linked; and a chain in which only neighbours are."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    random.seed(1)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(150):
        words = list(base)
        words[random.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(260)]
    docs += [(1000 + k, " ".join(chain[8 * k : 8 * k + 100])) for k in range(20)]
    docs += [(2000 + i, docs[i % 7][1]) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = joined(jaccard_join.similar_texts(frame).collect())
    wanted = plain.similar(docs)
    assert got == wanted
    assert len({wanted[1000 + k][0] for k in range(20)}) == 1


def test_join_edges(edges, nothing):
    rows = jaccard_join.similar_texts(edges).collect()
    assert len(rows) == edges.count()
    by = {r.doc_id: r for r in rows}
    assert by[7].class_id == by[9].class_id == 6 and by[6].n_copies == 4 and by[8].class_id in (6, 8)
    assert [by[i].class_id for i in (1, 2, 3, 4)] == [1, 2, 3, 4]
    assert jaccard_join.similar_texts(nothing).count() == 0
    kept = jaccard_join.one_of_each(edges)
    assert kept.columns == edges.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert {1, 2, 3, 4, 5, 6, 10, None} <= set(ids) and not {7, 9} & set(ids) and len(ids) == len(set(ids))


def test_pruning_keeps_likely_pairs():
    assert jaccard_join.least_matches(150) < 0.8 * 150 < 150
    assert [jaccard_join.least_matches(n) / n for n in (30, 90, 150)] == sorted(jaccard_join.least_matches(n) / n for n in (30, 90, 150))
    factors = jaccard_join.multipliers()
    draw = np.random.default_rng(0)
    common = draw.integers(0, 2**63, 85).astype(np.uint64)
    sets = [np.sort(np.concatenate([common, draw.integers(0, 2**63, 10).astype(np.uint64)])) for _ in range(2)] + [common[:20]]
    bounds = np.cumsum([0, *map(len, sets)])
    signatures = jaccard_join.minhashes(np.concatenate(sets), bounds, factors)
    i, j = jaccard_join.candidates(signatures, signatures, True)
    assert (0, 1) in set(zip(i.tolist(), j.tolist())) and len(i) == 1
    assert jaccard_join.verified([np.sort(s) for s in sets], i, j).tolist() == [85 / 105 >= 0.8]


@pytest.mark.parametrize("n", [1, 2, 70])
def test_components_of_a_path(spark, n):
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(500, 501)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {**{k: 0 for k in range(n + 1)}, 500: 500, 501: 500}


@pytest.mark.parametrize("probes", [windows.MAX_PROBES, 0])
def test_benchmark_inside_long_texts(spark, monkeypatch, probes):
    monkeypatch.setattr(windows, "MAX_PROBES", probes)
    random.seed(4)
    noise = lambda n: " ".join(f"n{random.randrange(10**6)}" for _ in range(n))
    items = [(i, " ".join(f"i{i}t{k}" for k in range(n))) for i, n in enumerate((5, 6, 9, 14, 30, 59, 200, 700))]
    docs = [(i, f"{noise(3000)} {text.upper()}, {noise(2000)}") for i, text in items]
    near = items[5][1].split()
    near[30] = "changed"
    docs += [(50, f"{noise(100)} {' '.join(near)} {noise(100)}"), (51, noise(50) + " " + " ".join(items[6][1].split()[:120])), (52, noise(4000))]
    found = decontamination.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {*((i, i) for i, _ in items), (50, 5)}
    assert {r.containment for r in found if r.doc_id < 50} == {1.0}


@pytest.mark.parametrize("probes", [windows.MAX_PROBES, 0])
def test_search_edges(spark, edges, nothing, monkeypatch, probes):
    monkeypatch.setattr(windows, "MAX_PROBES", probes)
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "jumps over the lazy dog and then")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(edges, benchmark).collect()}
    assert found == {(6, 3), (7, 3), (8, 3), (9, 3)}
    cleaned = decontamination.clean(edges, benchmark)
    assert cleaned.columns == edges.columns and cleaned.count() == edges.count() - 5
    assert decontamination.contaminated(nothing, benchmark).count() == 0
    assert decontamination.contaminated(edges, benchmark.limit(0)).count() == 0
    assert license_scan.licenses(edges).count() == 0 and license_scan.licenses(nothing).count() == 0


@pytest.mark.parametrize("probes", [windows.MAX_PROBES, 0])
def test_short_items(spark, monkeypatch, probes):
    """Items of one to four words, next to a long one, in Spark and in SQL."""
    monkeypatch.setattr(windows, "MAX_PROBES", probes)
    items = [(1, "Alpha beta GAMMA delta"), (2, "beta"), (3, "one two"), (4, " ... "), (5, None), (6, "a b c d e f"), (3, "six"), (7, "beta")]
    docs = [
        (1, "x alpha, beta gamma delta y beta"), (2, "alpha beta gamma"), (3, "one one two two one two"), (4, ""), (5, None),
        (6, "six a b c d e f two one"), (6, "six a b c d e f two one"), (None, "one-two"), (8, "w " * 600 + "one two"),
    ]
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = [tuple(r) for r in decontamination.contaminated(texts, benchmark).collect()]
    assert sorted(found, key=str) == sorted(
        [(1, 1, 1.0, 1), (1, 2, 1.0, 2), (1, 7, 1.0, 2), (2, 2, 1.0, 1), (2, 7, 1.0, 1), (3, 3, 1.0, 1), (6, 3, 1.0, 0), (6, 6, 1.0, 0), (None, 3, 1.0, 0), (8, 3, 1.0, 600)],
        key=str,
    )
    connection = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        connection.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        connection.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert sorted(connection.execute(decontamination.oracle_sql()).fetchall(), key=str) == sorted(found, key=str)
    kept = decontamination.clean(texts, benchmark.where("item_id = 3")).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [1, 2, 4, 5]


def test_size_classes_have_no_end():
    bounds = windows.size_classes()
    assert bounds[:6] == [1, 2, 3, 5, 8, 12] and bounds[-1] >= 2**31 - 1


def test_licenses(spark):
    texts = [f"some code here {text} and more words after it" for _, text in license_scan.TEMPLATES]
    found = license_scan.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.template) for r in found} >= {(i, i) for i in range(len(texts))}
    assert all(r.license == license_scan.TEMPLATES[r.template][0] for r in found)


def hidden(spark, texts, key=KEY):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pseudonyms.pseudonymised(frame, key=key).orderBy("doc_id").collect()]


def test_pseudonyms_against_a_plain_version(spark, tables):
    docs = tables("documents").select("doc_id", "text").collect()
    got = {r.doc_id: r.text for r in queries.op4_pseudonyms(spark, SF).collect()}
    assert got == {r.doc_id: plain.pseudonymised(r.text) for r in docs}
    assert sum(got[r.doc_id] != r.text for r in docs) > 5


def test_pseudonyms_keep_format_and_links(spark):
    random.seed(5)
    cards = []
    while len(cards) < 40:
        text = "".join(random.choice("0123456789") for _ in range(random.choice((13, 15, 16, 19))))
        if plain.luhn(text):
            cards.append(text)
    phones = [f"({random.randrange(200, 999)}) {random.randrange(200, 999)}-{random.randrange(10000):04d}" for _ in range(40)]
    days = [f"{random.randrange(1900, 2100)}-{random.randrange(1, 13):02d}-{random.randrange(1, 29):02d}" for _ in range(60)]
    ssns = [f"{random.randrange(1, 600):03d}-{random.randrange(1, 100):02d}-{random.randrange(1, 10000):04d}" for _ in range(40)]
    values = cards + phones + days + ssns
    new = hidden(spark, [f"a {v} b, again {v}." for v in values])
    again = [re.fullmatch(r"a (.+) b, again (.+)\.", t).groups() for t in new]
    assert all(a == b and a != v and len(a) == len(v) for (a, b), v in zip(again, values))
    assert len({a for a, _ in again}) == len(set(values))
    assert all(plain.luhn(a) for a, _ in again[:40])
    assert all(a[1] >= "2" and a[6] >= "2" for a, _ in again[40:80])
    assert all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", a) for a, _ in again[80:140])
    assert hidden(spark, [f"a {values[0]} b"], key="other")[0] != f"a {again[0][0]} b"


def test_feistel_can_be_undone():
    for high, low in ((10**4, 10**3), (1 << 16, 1 << 16), (300, 300)):
        moved = [plain.feistel(KEY, "t", v, high, low) for v in range(0, high * low, high * low // 500)]
        assert len(set(moved)) == len(moved)
        assert [plain.unfeistel(KEY, "t", v, high, low) for v in moved] == list(range(0, high * low, high * low // 500))


def test_one_date_written_in_three_ways(spark):
    iso, slash, dot = hidden(spark, ["1990-05-17", "05/17/1990", "17.05.1990"])
    year, month, day = iso.split("-")
    assert (slash, dot) == (f"{month}/{day}/{year}", f"{day}.{month}.{year}")


@pytest.mark.parametrize(
    "text",
    ["4565410125667262", "999.1.1.1", "1990-02-30", "31.02.1990", "000-12-3456", "666-12-3456", "version 4.0.", "(123) 555-1234", "GB00 WEST 1234 5698 7654 32", "1789-07-14", ""],
)
def test_invalid_values_stay(spark, text):
    assert hidden(spark, [text]) == [text]


def test_iban_checks_stay_right(spark):
    (new,) = hidden(spark, ["GB82 WEST 1234 5698 7654 32"])
    flat = new.replace(" ", "")
    moved = flat[4:] + flat[:4]
    assert new != "GB82 WEST 1234 5698 7654 32" and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def test_pseudonym_edges(edges, nothing):
    new = pseudonyms.pseudonymised(edges, count_col="n_words")
    assert sorted(new.columns) == sorted(edges.columns)
    assert {r.doc_id: r.text for r in new.where("doc_id < 5").collect()} == {r.doc_id: r.text for r in edges.where("doc_id < 5").collect()}
    assert pseudonyms.pseudonymised(nothing).count() == 0
    with pytest.raises(ValueError):
        pseudonyms.pseudonymised(edges, key="it's")


def test_pseudonyms_need_no_long_sql(edges, monkeypatch):
    parsed = []
    monkeypatch.setattr(pseudonyms.F, "expr", lambda text, expr=F.expr: parsed.append(text) or expr(text))
    pseudonyms.pseudonymised(edges)
    assert sum(map(len, parsed)) < 1000  # the parser keeps some 50 MB in the driver for 20,000 characters


def plain_pipeline(spark, sf_dir):
    """The stages after the classifier, which the test gets from its model and plain feature rows."""
    import pyarrow as pa
    from twinframe.llm.arrow_text import texts_of

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = queries.trained_quality(spark, docs, sf_dir)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    features = quality_classifier.Features()
    scores = np.concatenate([model.score(features.rows(t)) for t in texts_of(pa.array([t for _, t in rows], pa.string()))])
    rows = [r for r, s in zip(rows, scores) if s >= queries.MIN_QUALITY]
    classes = plain.similar(rows)
    rows = [(d, t) for d, t in rows if classes[d][0] == d]
    bad = plain.contaminated(rows, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    return [(d, plain.pseudonymised(t)) for d, t in rows if d not in bad]


def test_pipeline(spark):
    from test_llm_rules import check_slots, plain_pieces

    rows = corpus_pipeline.run(spark, SF).collect()
    wanted = sorted(plain_pieces(plain_pipeline(spark, SF), 2048))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    check_slots(rows, 2048)


def test_pipeline_stages_keep_columns(spark, edges, tmp_path):
    docs = edges.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(6, 1, 0), (4, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "again and again again and again again and again")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs, docs.limit(0)):
        for _, step in corpus_pipeline.STAGES[:-1]:
            frame = step(spark, frame, str(tmp_path))
            assert frame.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).count() >= 0


@pytest.mark.parametrize(
    "before, value, after",
    [("", "4111 1111 1111 1111", " 12/27"), ("", "4111 1111 1111 1111", " 123"), ("12 ", "4111 1111 1111 1111", ""), ("2024 ", "4111 1111 1111 1111", "")],
)
def test_card_beside_other_numbers(spark, before, value, after):
    (new,) = hidden(spark, [before + value + after])
    inner = new[len(before) : len(new) - len(after)]
    assert new == before + inner + after and inner != value and plain.luhn(inner.replace(" ", "")) and len(inner) == len(value)


@pytest.mark.parametrize("value, after", [("ES91 2100 0418 4502 0005 1332", " CAD"), ("FR14 2004 1010 0505 0001 3M02 606", ".")])
def test_iban_beside_words_and_with_letters(spark, value, after):
    (new,) = hidden(spark, [value + after])
    flat = new[: len(value)].replace(" ", "")
    assert new.endswith(after) and len(new) == len(value + after) and new != value + after
    assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def test_phone_behind_a_card_is_hidden_too(spark):
    (new,) = hidden(spark, ["4111 1111 1111 1111 212-555-0123"])
    assert not new.startswith("4111 1111 1111 1111") and not new.endswith("212-555-0123") and len(new) == 32


def test_phones_with_country_code_and_dates_with_time(spark):
    odd = [f"+1 ({a:03d}) {b}-7713" for a in (17, 132, 136, 212) for b in ("055", "155", "055")] + ["+1 (017) 555-7713", "+1 (136) 555-7479"]
    new = hidden(spark, [*odd, "+12125550123", "at 2024-03-05T10:22:00Z"])
    assert all(a != b and re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b) for a, b in zip(odd, new))
    assert len(set(new[: len(odd)])) == len(set(odd)) and all(n[4] < "2" or n[9] < "2" for n in new[: len(odd)])
    assert re.fullmatch(r"\+1[2-9]\d\d[2-9]\d{6}", new[-2]) and new[-2] != "+12125550123"
    assert re.fullmatch(r"at \d{4}-\d\d-\d\dT10:22:00Z", new[-1]) and new[-1] != "at 2024-03-05T10:22:00Z"


def test_licenses_keep_versions_and_variants_apart(spark):
    said = {
        "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0"},
        "This work is licensed under the GNU General Public License, version 3.": {"GPL-3.0"},
        "This work is licensed under the GNU Affero General Public License, version 3.": {"AGPL-3.0"},
        "Licensed under CC BY 4.0.": {"CC-BY-4.0"},
        "Licensed under CC BY-NC 4.0.": {"CC-BY-NC-4.0"},
        "Licensed under CC BY-NC-SA 4.0.": {"CC-BY-NC-SA-4.0"},
        **{f"x {text} y": {name} for name, text in license_scan.TEMPLATES},
    }
    found = license_scan.licenses(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).collect()
    got = [{r.license for r in found if r.doc_id == k} for k in range(len(said))]
    assert got == list(said.values())


def test_components_of_random_graphs(spark):
    """Stars, cliques of chains and long paths of rising, falling and mixed numbers, against a plain union."""
    draw = random.Random(6)
    edges = [(k, k + 1) for k in range(300)] + [(10_000 - k, 9_999 - k) for k in range(300)] + [(20_000, 20_001 + k) for k in range(200)]
    numbers = draw.sample(range(30_000, 40_000), 400)
    edges += list(zip(numbers, numbers[1:200])) + [(draw.choice(numbers[200:]), draw.choice(numbers[200:])) for _ in range(150)] + [(7, 7), (1, 0), (50_000, 50_000)]
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    linked = {n for a, b in edges if a != b for n in (a, b)}
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert found == {n: root(n) for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages_tell_rows_of_one_id_apart(spark):
    """Null and repeated ids: only the contaminated row goes, and of near copies one stays, whatever ids they have."""
    item = " ".join(f"item{i}" for i in range(20))
    own = [" ".join(f"{name}{i}" for i in range(60)) for name in ("ant", "bee", "cow")]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    schema = "doc_id long, text string"
    rows = [(None, f"{own[0]} {item} end"), (None, own[1]), (None, own[2]), (5, own[0]), (5, f"{own[2]} {item}")]
    left = decontamination.clean(spark.createDataFrame(rows, schema), benchmark)
    assert sorted(left.collect(), key=str) == sorted([r for r in rows if item not in r[1]], key=str)
    near = [f"{own[0]} more", own[0], f"{own[1]} more", own[1], own[2], f"{own[2]} more", f"{own[2]} less"]
    ids = [None, None, None, 4, 4, 9, None]
    kept = [r.text for r in jaccard_join.one_of_each(spark.createDataFrame(list(zip(ids, near)), schema)).collect()]
    assert sorted(t[:3] for t in kept) == ["ant", "bee", "cow"] and near[2] in kept and near[6] in kept
