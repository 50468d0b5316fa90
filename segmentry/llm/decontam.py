"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts are lower-cased and cut at characters that are neither letters nor digits. A seed is the hash
of the tokens at the offsets of a mask, so tokens between them may differ. Seeds of benchmark items
and documents are joined; around every hit the item's tokens are laid over the document's, and the
hit counts if in a window of WINDOW item tokens (the whole item if it is shorter) at least
IDENTITY of the tokens are equal.

The masks lose nothing: wherever the substitutions that IDENTITY allows fall in a window, a mask has a place without
one (the tests enumerate them). One spaced mask of five tokens does that for a window of WINDOW tokens, where a
contiguous one could have four at most; items of SHORTEST to WINDOW - 1 tokens need two masks of four. Items of EXACT to
SHORTEST - 1 tokens count where they stand whole and unchanged, and shorter ones never do: any text holds such words.

While the seeds of the benchmark are within BROADCAST_SEEDS the join reads the documents once and shuffles none of them;
beyond it, (seed, document, position) are shuffled, salted so that a frequent passage is dealt out, and only
the texts of documents with hits are read again to verify them. Both ways give the same rows.

Results for odd rows: null texts, documents and items of fewer than EXACT tokens give no rows; repeated documents
and items give one row per pair of ids; equal items all count, those with a null id too; a null doc_id gives rows with a
null doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, small_or_not, table

WINDOW = 13
IDENTITY = 0.8
SHORTEST = 8
EXACT = 4
#: Token offsets of the masks for items of WINDOW tokens or more, of SHORTEST or more, and, for exact matches, of each length from EXACT on.
LONG, SHORT = ((0, 1, 4, 6, 7),), ((0, 1, 2, 4), (0, 1, 4, 6))
MASKS = (*LONG, *SHORT, *(tuple(range(n)) for n in range(EXACT, SHORTEST)))
#: Most seeds of the benchmark that are broadcast, and parts that a seed is dealt to beyond it.
BROADCAST_SEEDS, SALT = 1_000_000, 16


def token_hashes(text: str) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seed(mask: int, h: Column, p: Column) -> Column:
    """The seed of a mask at position p of the hashes h."""
    return F.xxhash64(F.lit(mask), *[F.get(h, p + o) for o in MASKS[mask]])


def masks_for(n: Column) -> Column:
    """The masks of an item of n tokens."""
    several = [F.when(n >= WINDOW, F.array(*[F.lit(k) for k in range(len(LONG))])), F.when(n >= SHORTEST, F.array(*[F.lit(len(LONG) + k) for k in range(len(SHORT))]))]
    return F.coalesce(*several, F.array(n - EXACT + len(LONG) + len(SHORT)))


def seed_table(items: DataFrame, text: str = "text", id_column: str = "item_id") -> DataFrame:
    """(mask, seed, before, around, items): the item tokens that a window around the seed can cover, how many of them are before it, and the items that have them."""
    span, value = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k, m in enumerate(MASKS):
        span, value = F.when(F.col("mask") == k, m[-1]).otherwise(span), F.when(F.col("mask") == k, seed(k, F.col("h"), F.col("p"))).otherwise(value)
    first, last = F.greatest(F.col("p") + span - (WINDOW - 1), F.lit(0)), F.least(F.col("p") + WINDOW, F.col("n"))
    whole = F.col("n") < WINDOW
    return (
        items.select(F.struct(F.col(id_column).alias("id")).alias("item"), token_hashes(text).alias("h"))
        .select("item", "h", F.size("h").alias("n"))
        .where(F.col("n") >= EXACT)
        .select("item", "h", "n", F.explode(masks_for(F.col("n"))).alias("mask"))
        .select("item", "h", "n", "mask", F.explode(F.sequence(F.lit(0), F.col("n") - span - 1)).alias("p"))
        .select("item", "h", "n", "mask", "p", value.alias("seed"), F.when(whole, 0).otherwise(first).alias("first"), F.when(whole, F.col("n")).otherwise(last).alias("last"))
        .select("item", "mask", "seed", (F.col("p") - F.col("first")).alias("before"), F.slice("h", F.col("first") + 1, F.col("last") - F.col("first")).alias("around"))
        .groupBy("mask", "seed", "before", "around")
        .agg(F.collect_set("item").alias("items"))
    )


def places(hashed: DataFrame, masks: list[int], *carried: str) -> DataFrame:
    """The carried columns, p and seed: every seed of every document; hashed has the token hashes h."""
    n = F.size("h")
    seeds = F.array(*[F.when(F.col("p") + MASKS[k][-1] < n, seed(k, F.col("h"), F.col("p"))) for k in masks])
    at = hashed.where(n >= EXACT).select(*carried, "h", F.explode(F.sequence(F.lit(0), n - EXACT)).alias("p"))
    return at.select(*carried, "p", F.explode(seeds).alias("seed")).where("seed is not null")


def near(h: Column) -> list[Column]:
    """The document's tokens that an item's window can cover, and how many of them are missing before the first."""
    first = F.col("p") - F.col("before")
    return [F.slice(h, F.greatest(first, F.lit(0)) + 1, F.lit(2 * WINDOW)).alias("near"), F.greatest(-first, F.lit(0)).alias("lost")]


def hits_of(docs: DataFrame, known: DataFrame, count: int, text: str, id_column: str) -> DataFrame:
    """(doc, items, around, near, lost) of every place of a document that has a seed of an item."""
    masks = sorted(r["mask"] for r in known.select("mask").distinct().collect()) or [0]
    known = known.drop("mask")
    if count <= BROADCAST_SEEDS:
        # Row numbers keep Spark from computing hashes twice, in a filter below, and from verifying inside the join, where
        # rows that hold a whole document would be copied for every position.
        hashed = docs.select(F.col(id_column).alias("doc"), token_hashes(text).alias("h"), F.monotonically_increasing_id().alias("row")).where("row >= 0")
        return places(hashed, masks, "doc", "h").join(F.broadcast(known), "seed").select("doc", "items", "around", *near(F.col("h")))
    keyed = docs.select(F.col(id_column).alias("doc"), F.col(text).alias("text"), F.xxhash64(id_column, text).alias("key"))
    salt = F.pmod(F.xxhash64("key", "p"), F.lit(SALT)).cast("int")
    found = places(keyed.select("key", token_hashes("text").alias("h")), masks, "key").withColumn("salt", salt)
    dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    found = keep(found.join(dealt, ["seed", "salt"]).select("key", "p", "before", "around", "items"))
    hit = keep(found.select("key").distinct())
    # repeated rows have one key
    texts = keyed.join(small_or_not(hit, hit.count()), "key", "left_semi").dropDuplicates(["key"]).select("key", "doc", token_hashes("text").alias("h"))
    return found.join(texts, "key").select("doc", "items", "around", *near(F.col("h")))


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", id_column: str = "doc_id", item_column: str = "item_id") -> DataFrame:
    """(doc_id, item_id, compared, matched): documents that hold a passage of an item; matched of compared tokens are equal in the best window."""
    known = keep(seed_table(items, text, item_column))
    hits = hits_of(docs, known, known.count(), text, id_column).withColumn("hit", F.monotonically_increasing_id())
    same = F.transform(F.col("around"), lambda x, k: F.when((k >= F.col("lost")) & (F.get("near", k - F.col("lost")) == x), 1).otherwise(0))
    width = F.least(F.lit(WINDOW), F.size("around"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - F.col("compared") + 1), lambda s: F.aggregate(F.slice("same", s, F.col("compared")), F.lit(0), lambda a, x: a + x)))
    least = F.when(F.col("compared") < SHORTEST, F.col("compared")).otherwise(F.ceil(F.col("compared") * IDENTITY))
    return (
        hits.select("doc", "items", "hit", same.alias("same"), width.alias("compared"))
        .select("doc", "items", "hit", "compared", best.alias("matched"))
        .where((F.col("matched") >= least) & (F.col("hit") >= 0))
        .select("doc", F.explode("items").alias("item"), "compared", "matched")
        .groupBy("doc", "item")
        .agg(F.max(F.struct("matched", "compared")).alias("best"))
        .select(F.col("doc").alias(id_column), F.col("item.id").alias(item_column), F.col("best.compared").cast("long").alias("compared"), F.col("best.matched").cast("long").alias("matched"))
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pipeline stage: the documents without a leak; rows without an id stay."""
    gone = keep(leaks(docs, items).where("doc_id is not null").select(F.col("doc_id").alias("gone")).distinct())
    # one column holds the row, so that no name of it can clash
    rows = docs.select(F.struct("*").alias("doc"))
    return rows.join(small_or_not(gone, gone.count()), F.col("doc.doc_id") == F.col("gone"), "left_anti").select("doc.*")


OP8_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents),
b AS MATERIALIZED (SELECT row_number() OVER () AS rid, item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM benchmark),
w AS (SELECT 0 AS side, rid, unnest(range(len(t))) AS p, unnest(t) AS a FROM d UNION ALL SELECT 1, rid, unnest(range(len(t))), unnest(t) FROM b WHERE len(t) >= 8),
l AS MATERIALIZED (SELECT side, rid, p, a, lead(a, 1) OVER x AS a1, lead(a, 2) OVER x AS a2, lead(a, 3) OVER x AS a3, lead(a, 4) OVER x AS a4, lead(a, 5) OVER x AS a5, lead(a, 6) OVER x AS a6 FROM w WINDOW x AS (PARTITION BY side, rid ORDER BY p)),
s AS MATERIALIZED (SELECT side, rid, p, 0 AS mask, a || ' ' || a1 || ' ' || a2 || ' ' || a3 AS k FROM l WHERE a3 IS NOT NULL
  UNION ALL SELECT side, rid, p, 1, a || ' ' || a1 || ' ' || a3 || ' ' || a4 FROM l WHERE a4 IS NOT NULL
  UNION ALL SELECT side, rid, p, 2, a || ' ' || a2 || ' ' || a3 || ' ' || a5 FROM l WHERE a5 IS NOT NULL),
bs AS (SELECT item_id, greatest(p - 12, 0) AS f, p - greatest(p - 12, 0) AS before, t[greatest(p - 12, 0) + 1 : least(len(t), p + 18)] AS around, mask, k FROM s JOIN b USING (rid) WHERE side = 1),
hit AS (SELECT DISTINCT s.rid, item_id, p - before AS place, around FROM s JOIN bs USING (mask, k) WHERE side = 0),
same AS (SELECT doc_id, item_id, least(13, len(around)) AS compared, [CASE WHEN place + i >= 0 AND o[i + 1] = around[i + 1] THEN 1 ELSE 0 END for i in range(len(around))] AS s
  FROM (SELECT doc_id, item_id, place, around, [NULL::VARCHAR for i in range(greatest(-place, 0))] || t[greatest(place, 0) + 1 : greatest(place + len(around), 0)] AS o FROM hit JOIN d USING (rid))),
dk AS (SELECT rid, a || ' ' || a1 || ' ' || a2 || ' ' || a3 AS k, 4 AS n FROM l WHERE side = 0 AND a3 IS NOT NULL
  UNION ALL SELECT rid, a || ' ' || a1 || ' ' || a2 || ' ' || a3 || ' ' || a4, 5 FROM l WHERE side = 0 AND a4 IS NOT NULL
  UNION ALL SELECT rid, a || ' ' || a1 || ' ' || a2 || ' ' || a3 || ' ' || a4 || ' ' || a5, 6 FROM l WHERE side = 0 AND a5 IS NOT NULL
  UNION ALL SELECT rid, a || ' ' || a1 || ' ' || a2 || ' ' || a3 || ' ' || a4 || ' ' || a5 || ' ' || a6, 7 FROM l WHERE side = 0 AND a6 IS NOT NULL),
whole AS (SELECT DISTINCT doc_id, item_id, n AS compared, n AS matched FROM dk JOIN b ON len(b.t) = n AND array_to_string(b.t, ' ') = k JOIN d ON d.rid = dk.rid),
best AS (SELECT doc_id, item_id, compared, list_max([list_sum(s[j : j + compared - 1]) for j in range(1, len(s) - compared + 2)]) AS matched FROM same)
SELECT doc_id, item_id, CAST(arg_max(compared, matched * 100 + compared) AS BIGINT) AS compared, CAST(max(matched) AS BIGINT) AS matched
FROM (SELECT * FROM best WHERE matched >= ceil(compared * 0.8) UNION ALL SELECT * FROM whole) GROUP BY doc_id, item_id
"""
