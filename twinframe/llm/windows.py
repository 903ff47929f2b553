"""Search of known short texts (items) inside long texts by MinHash over overlapping windows, in built-in functions only.

Items are partitioned by size. For a size class with at most u shingles, texts are looked at in windows of W shingles, one
every s shingles, so long that every stretch of u + u/4 shingles lies inside one of them. With an item contained to 0.8 in
a window, their Jaccard similarity is at least MIN_SIMILARITY in every class, and one of BANDS bands (of one MinHash value
each) agrees with a probability of 1 - 1e-6 or more.

A band can only agree where the text holds the very shingle at which the item has its minimum. So bands are evaluated where
this is so: texts' shingles are joined with these minimum shingles, and only for windows around such a place are MinHash
values computed and compared, which gives the same collisions as computing all. Colliding windows are verified by the exact
share of the item's shingles that they hold.

Words are runs of letters and digits, lower-cased; a shingle is five in a row. An item of fewer words is one shingle of all
of them, and found where a text has these words in a row; its minimum is that shingle, so no other hash has to agree. Items
without words are not found. Null texts have no words. Results are per id: repeated rows give the same result once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.session import stage

WIDTH = 5
THRESHOLD = 0.8
MIN_SIMILARITY = 0.28
BANDS = 43  # (1 - MIN_SIMILARITY) ** BANDS < 1e-6
#: Distinct minimum shingles that are sent to all tasks as one array (8 bytes each).
MAX_PROBES = 20_000
#: Windows that hold the shingle at ``at``.
WINDOWS_AT = "sequence(greatest(0L, (at - window + stride) div stride), at div stride)"


def size_classes(most: int = 1 << 31) -> list[int]:
    """Upper bounds of the size classes, each half as large again as the one before, up to the longest array there can be."""
    bounds = [1]
    while bounds[-1] < most:
        bounds.append(-(-3 * bounds[-1] // 2))
    return bounds


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(text_col: str, width: int = WIDTH) -> tuple[Column, Column]:
    """The words of a text under a name of their own, and the hashes of its shingles in order, from these."""
    hashes = F.expr(
        f"CASE WHEN size(__words) >= {width} THEN transform(sequence(0, size(__words) - {width}), i -> xxhash64("
        + ", ".join(f"__words[i + {k}]" for k in range(width))
        + ")) ELSE cast(array() as array<bigint>) END"
    )
    return words(F.col(text_col)).alias("__words"), hashes


def hashed(texts: DataFrame, id_col: str, text_col: str, id_name: str, width: int = WIDTH) -> DataFrame:
    """``id_name`` and ``shingles`` of every text."""
    split, hashes = shingles(text_col, width)
    return texts.select(F.col(id_col).alias(id_name), split).select(id_name, hashes.alias("shingles"))


def item_table(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per item with shingles: its set, size and window settings."""
    bounds = ", ".join(f"{b}L" for b in size_classes())
    sets = hashed(items, id_col, text_col, "item").select("item", F.array_distinct("shingles").alias("shingles"))
    rows = stage(sets, "sets")  # else every use of the set would make it anew
    return (
        rows.where("size(shingles) > 0")
        .withColumn("n", F.size("shingles"))
        .withColumn("u", F.expr(f"array_min(filter(array({bounds}), b -> b >= n))"))
        .withColumn("stride", F.expr("greatest(1L, u div 2)"))
        .withColumn("window", F.expr("u + stride + (u + 3) div 4"))
    )


def anchors(items: DataFrame) -> DataFrame:
    """For each shingle at which an item has the minimum of a band: these bands and items."""
    least = F.expr(
        f"transform(sequence(1, {BANDS}), k -> named_struct('k', k, 'x', array_min(transform(shingles, x -> named_struct('v', xxhash64(x, k), 'x', x))).x))"
    )
    rows = items.select("item", "stride", "window", F.explode(least).alias("band"))
    return rows.select(F.col("band.x").alias("x"), F.col("band.k").alias("k"), "item", "stride", "window")


def hits_in_place(texts: DataFrame, probes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``id``, a band at whose minimum shingle the text has one, window number ``no`` and the window's shingles.

    All is done in the row of the text: its shingles are intersected with the probes, which come as one array, and windows
    are cut from it. No text is shuffled or read twice.
    """
    every = probes.agg(F.collect_set("x")).scalar()
    none = F.expr("cast(array() as array<struct<at: int, x: bigint>>)")

    at = F.filter(F.sequence(F.lit(0), F.size("shingles") - 1), lambda i: F.array_contains("known", F.get("shingles", i)))
    found = F.when(F.size("known") == 0, none).otherwise(F.transform(at, lambda i: F.struct(i.alias("at"), F.get("shingles", i).alias("x"))))
    marked = hashed(texts, id_col, text_col, "id").select("id", "shingles", F.array_intersect("shingles", every).alias("known"))
    # "outer": else a filter on the array's size is inferred and put below, where it makes the words again for each shingle
    hits = marked.select("id", "shingles", F.explode_outer(found).alias("h")).where("h.x is not null")
    by_shingle = probes.groupBy("x").agg(F.collect_list(F.struct("k", "item", "stride", "window")).alias("bands"))
    met = hits.select("id", "shingles", "h.at", "h.x").join(F.broadcast(by_shingle), "x")
    bands = met.select("id", "shingles", "at", "x", F.explode("bands").alias("band")).select("id", "shingles", "at", "x", "band.*")
    near = bands.withColumn("no", F.explode(F.expr(WINDOWS_AT)))
    held = F.expr("slice(shingles, cast(no * stride + 1 as int), cast(window as int))")
    return near.select("id", "item", "stride", "no", F.array(F.struct("k", "x")).alias("bands"), held.alias("held"))


def hits_by_join(texts: DataFrame, probes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same rows for any number of probes: texts' shingles are joined with them, and texts with hits are read again."""
    places = hashed(texts, id_col, text_col, "id").select("id", F.posexplode_outer("shingles").alias("at", "x")).where("x is not null")
    by_shingle = probes.groupBy("x").agg(F.collect_list(F.struct("k", "item", "stride", "window")).alias("bands"))
    hits = places.join(by_shingle, "x").select("id", "at", "x", F.explode("bands").alias("band")).select("id", "at", "x", "band.*")
    near = hits.withColumn("no", F.explode(F.expr(WINDOWS_AT)))
    wanted = near.groupBy("id", "item", "stride", "window", "no").agg(F.collect_set(F.struct("k", "x")).alias("bands"))
    per_text = stage(
        wanted.groupBy("id").agg(F.collect_list(F.struct("item", "stride", "window", "no", "bands")).alias("wanted")), "wanted"
    )
    split, hashes = shingles("text")
    source = texts.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    met = source.join(per_text, F.col("__id").eqNullSafe(F.col("id"))).select("id", "wanted", split).select("id", "wanted", hashes.alias("shingles"))
    cut = F.expr("transform(wanted, w -> named_struct('w', w, 'held', slice(shingles, cast(w.no * w.stride + 1 as int), cast(w.window as int))))")
    return met.select("id", F.explode_outer(cut).alias("c")).select("id", "c.w.*", "c.held")


def short_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item``, ``width`` and ``x`` of every item of fewer words than a shingle has: number and hash of its words."""
    split = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("__words"))
    hashes = [f"WHEN size(__words) = {w} THEN xxhash64({', '.join(f'__words[{k}]' for k in range(w))})" for w in range(1, WIDTH)]
    rows = split.where(F.size("__words").between(1, WIDTH - 1))
    return rows.select("item", F.size("__words").alias("width"), F.expr(f"CASE {' '.join(hashes)} END").alias("x")).distinct()


def short_hits(texts: DataFrame, short: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """``id``, ``item``, ``containment`` and ``back`` (the place, negative) of short items, a frame for each width."""
    frames = []
    for r in short.groupBy("width").agg(F.count_distinct("x").alias("probes")).collect():
        probes = short.where(F.col("width") == r["width"])
        runs = hashed(texts, id_col, text_col, "id", r["width"])
        if r["probes"] <= MAX_PROBES:  # as in hits_in_place: only what is found leaves the text's row
            known = F.array_intersect("shingles", probes.agg(F.collect_set("x")).scalar())
            first = F.transform("known", lambda x: F.struct(x.alias("x"), (F.array_position("shingles", x) - 1).alias("at")))
            places = runs.withColumn("known", known).select("id", F.explode_outer(first).alias("h")).where("h.x is not null").select("id", "h.*")
        else:
            places = runs.select("id", F.posexplode_outer("shingles").alias("at", "x")).where("x is not null")
        met = places.join(probes, "x")
        frames.append(met.groupBy("id", "item").agg(F.lit(1.0).alias("containment"), (-F.min("at")).cast("long").alias("back")))
    return frames


def found_items(
    texts: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, threshold: float = THRESHOLD
) -> DataFrame:
    """``id``, ``item``, ``containment``, ``first_word`` (where the best window begins) for every item found in a text.

    Of equally good windows the first counts. Up to ``MAX_PROBES`` minimum shingles go to all tasks; more are joined.
    """
    known = stage(item_table(items, item_col, item_text_col), "items")
    probes = stage(anchors(known), "anchors")
    few = probes.select("x").distinct().count() <= MAX_PROBES
    windows = (hits_in_place if few else hits_by_join)(texts, probes, id_col, text_col)
    collide = F.expr("exists(bands, b -> array_min(transform(held, y -> xxhash64(y, b.k))) = xxhash64(b.x, b.k))")
    checked = windows.where(collide).join(known.select("item", F.col("shingles").alias("__set"), "n"), "item")
    share = F.size(F.array_intersect("__set", "held")) / F.col("n")
    good = checked.withColumn("containment", share).where(F.col("containment") >= threshold - 1e-9)
    places = good.select("id", "item", "containment", (-F.col("no") * F.col("stride")).alias("back"))
    for more in short_hits(texts, stage(short_items(items, item_col, item_text_col), "short-items"), id_col, text_col):
        places = places.unionByName(more)
    best = places.groupBy("id", "item").agg(F.max(F.struct("containment", "back")).alias("best"))
    return best.select("id", "item", F.col("best.containment").alias("containment"), (-F.col("best.back")).alias("first_word"))


def search_sql(items_sql: str) -> str:
    """DuckDB SQL with the rows of ``found_items`` for all of ``documents``; ``items_sql`` gives (item, t)."""
    bounds = ", ".join(str(b) for b in size_classes())

    def table(name: str, source: str, key: str) -> str:
        return f"""
{name}_words AS (SELECT {key}, [w FOR w IN regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+') IF w <> ''] AS ws FROM ({source})),
{name}_shingles AS (
  SELECT {key}, i - 1 AS pos, array_to_string(ws[i:i + {WIDTH - 1}], ' ') AS x
  FROM (SELECT {key}, ws, unnest(range(1, len(ws) - {WIDTH - 2})) AS i FROM {name}_words WHERE len(ws) >= {WIDTH}))"""

    return f"""
WITH {table("doc", "SELECT DISTINCT doc_id AS id, coalesce(text, '') AS t FROM documents", "id")},
{table("item", items_sql, "item")},
sets AS (SELECT DISTINCT item, x FROM item_shingles),
sizes AS (
  SELECT item, n, greatest(1, u // 2) AS stride, u + greatest(1, u // 2) + (u + 3) // 4 AS win
  FROM (SELECT item, n, list_min([b FOR b IN [{bounds}] IF b >= n]) AS u
        FROM (SELECT item, count(*) AS n FROM sets GROUP BY item))),
hits AS (
  SELECT id, item, n, stride, x, unnest(range(greatest(0, (pos - win + stride) // stride), pos // stride + 1)) AS no
  FROM doc_shingles JOIN sets USING (x) JOIN sizes USING (item)),
shares AS (
  SELECT id, item, CAST(count(DISTINCT x) AS DOUBLE) / n AS containment, no * stride AS first_word FROM hits GROUP BY id, item, n, stride, no
  UNION ALL
  SELECT id, item, 1.0, i - 1
  FROM (SELECT id, ws, width, unnest(range(1, len(ws) - width + 2)) AS i
        FROM doc_words JOIN (SELECT DISTINCT len(ws) AS width FROM item_words WHERE len(ws) BETWEEN 1 AND {WIDTH - 1}) ON len(ws) >= width) AS d
  JOIN item_words AS s ON len(s.ws) = d.width AND s.ws = d.ws[d.i:d.i + d.width - 1])
SELECT id, item, max(containment) AS containment, CAST(arg_min(first_word, (-containment, first_word)) AS BIGINT) AS first_word
FROM shares WHERE containment >= {THRESHOLD} - 1e-9 GROUP BY id, item"""
