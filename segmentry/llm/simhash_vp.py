"""SimHash near-duplicates by vantage-point shards.

A document's fingerprint has one bit per bit position of the XXH64 hashes (seed 42) of its 4-word
shingles, set where more than half of the hashes have it. Fingerprints link at RADIUS or fewer
differing bits; components are the transitive closure.

A vantage-point tree over whole 64-bit fingerprints prunes next to nothing: distances between
unrelated fingerprints crowd around 32, so a ball of radius 4 crosses nearly every split (see the
README). The search is therefore a forest: the 64 bits are cut into 6 blocks, and fingerprints
that differ in 4 bits or fewer agree wholly on at least 2 blocks, so each of the 15 pairs of blocks
gives one tree. In a tree the distance on its two blocks partitions the fingerprints; the triangle
bound for radius 0 leaves one shard to search. In a shard the vantage point is the fingerprint of
most documents. Members within the radius of it link to it. Every other member (the fringe)
queries the shard: a member x can be within the radius of y only if |d(x, v) - d(y, v)| <= RADIUS,
so only overlapping rings are read, and only links that join two parts are returned.

A hot shard is cut into bands of RADIUS + 1 distances, and a band of many members into cells of about PART by
hash. By the triangle bound links lie within a band or between neighbouring ones, so a part is one cell, or one pair of cells of
the same or of neighbouring bands: no part holds more than two cells, and every pair that can link meets in one.
Exact copies have one fingerprint and are one member of a shard, with a count.

Results for odd rows: a null text counts as empty; texts without words have fingerprint zero and
link like any other; repeated doc_ids are one node of the graph and each row is returned; a row with a null
doc_id links like any other and gets the smallest doc_id of its component, null if there is none.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, give_back, joined, keep, per_slice, small_or_not, table

RADIUS = 4
#: Widths of the blocks, from the highest bits on.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Members of a shard that are compared in one part, and about so many of a cell; a part is two cells at most.
PART = 4096


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").lower().split()


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the shingles of width words, repeats included; 0 without words."""
    import xxhash

    words = words_of(text)
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *[e + 1 for e in ends]]
    shingles = [line[a:b] for a, b in zip(starts, ends[width - 1 :])]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        part = shingles[at : at + (1 << 16)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(42)), np.uint64, len(part))
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def make():
        def signed(x):
            return x - (1 << 64) if x >> 63 else x

        return lambda ids, texts: [ids, [signed(fingerprint(t)) for t in texts]]

    return docs.select(F.col(id_column).cast("long"), F.col(text)).mapInArrow(per_slice(make, schema), "doc_id long, fp long")


def masks() -> list[int]:
    """The bits of each tree, as signed longs."""
    lows = [64 - s for s in accumulate(BLOCKS)]
    block = [((1 << n) - 1) << low for n, low in zip(BLOCKS, lows)]
    return [m - (1 << 64) if m >> 63 else m for m in (a | b for a, b in combinations(block, 2))]


def ring_links(node: np.ndarray, fp: np.ndarray, d: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of the fringe (d > radius) of one part of a shard; those that would close a cycle are left out.

    d: distances to the vantage point. Rows may repeat a node.
    """
    order = np.argsort(d, kind="stable")
    node, fp, d = node[order], fp[order], d[order]
    parent = np.where(d <= radius, 0, np.arange(len(d)))  # the ball is joined through the vantage point
    out = []

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    first = int(np.searchsorted(d, radius, "right"))
    if first:
        parent[:first] = 0
    for y in range(first, len(d)):
        low = int(np.searchsorted(d, d[y] - radius, "left"))
        # members of rings further out query back in turn
        near = np.flatnonzero(np.bitwise_count(fp[low:y] ^ fp[y]) <= radius) + low
        last = -1
        for x in near:
            p = int(parent[x])
            if p == last:
                continue
            last = p
            a, b = root(int(x)), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(node[x]), int(node[y])))
    return out


def shard_links(batches):
    """Rows (tree, key, part, node, fp, d) sorted by shard and part, to rows (a, b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[np.ndarray] = []

    def flush():
        rows = np.concatenate(held) if held else np.zeros((0, 6), np.int64)
        held.clear()
        if not len(rows):
            return None
        cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        links = [x for part in np.split(rows, cuts) if len(part) > 1 for x in ring_links(part[:, 3], part[:, 4].view(np.uint64), part[:, 5])]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=schema)

    for batch in batches:
        rows = np.ascontiguousarray(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
        if not len(rows):
            continue
        # all but the last shard part of the batch are complete
        cut = int(np.flatnonzero((rows != rows[-1])[:, :3].any(axis=1))[-1]) + 1 if (rows[0, :3] != rows[-1, :3]).any() else 0
        if cut:
            held.append(rows[:cut])
            yield flush()
        elif held and (held[-1][-1, :3] != rows[0, :3]).any():
            yield flush()
        held.append(rows[cut:])
    if (last := flush()) is not None:
        yield last
    give_back()


def links(members: DataFrame) -> DataFrame:
    """Links (a, b) that connect, and only connect, fingerprints within the radius; members: (fp, node, n), a row per fingerprint."""
    trees = F.array(*[F.struct(F.lit(k).alias("tree"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks())])
    dealt = members.select("fp", "node", "n", F.inline(trees))
    vantage = dealt.groupBy("tree", "key").agg(F.count("*").alias("size"), F.max(F.struct("n", "fp", "node")).alias("v")).where("size > 1").select("tree", "key", "size", F.col("v.fp").alias("v_fp"), F.col("v.node").alias("v_node"))
    shards = keep(dealt.join(vantage, ["tree", "key"]).select("tree", "key", "size", "fp", "node", "v_node", F.bit_count(F.col("fp").bitwiseXOR(F.col("v_fp"))).cast("long").alias("d")))
    near = shards.where((F.col("d") <= RADIUS) & (F.col("node") != F.col("v_node"))).select(F.col("v_node").alias("a"), F.col("node").alias("b"))
    rows = parts_of(shards)
    rings = rows.repartition("tree", "key", "part").sortWithinPartitions("tree", "key", "part").mapInArrow(shard_links, "a long, b long")
    return near.unionByName(rings)


def parts_of(shards: DataFrame) -> DataFrame:
    """(tree, key, part, node, fp, d): the members of every part of the shards that have a fringe."""
    fringed = shards.where(f"d > {RADIUS} and size > 2").select("tree", "key").distinct()
    members = shards.join(fringed, ["tree", "key"], "left_semi")
    whole = members.where(F.col("size") <= PART).select("tree", "key", F.lit(0).cast("long").alias("part"), "node", "fp", "d")
    hot = members.where(F.col("size") > PART).withColumn("band", F.floor(F.col("d") / (RADIUS + 1)))
    cells = keep(hot.groupBy("tree", "key", "band").agg(F.ceil(F.count("*") / PART).cast("long").alias("n")).groupBy("tree", "key").agg(F.map_from_entries(F.collect_list(F.struct("band", "n"))).alias("cells")))
    # the cells of a shard are few: its distances end at 64
    hot = hot.join(small_or_not(cells, cells.count()), ["tree", "key"])

    def count(band):
        return F.coalesce(F.try_element_at("cells", band), F.lit(0).cast("long"))

    own = F.pmod(F.xxhash64("fp"), count(F.col("band")))

    def label(low_band, low, high_band, high):
        # the number of a pair of cells: bands are below 13, cells of a band below 2^24
        return ((low_band * 16 + high_band) * (1 << 24) + low) * (1 << 24) + high

    def with_cells(n, make):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), make)).otherwise(F.expr("cast(array() as array<bigint>)"))

    band = F.col("band")
    same = with_cells(count(band), lambda c: label(band, F.least(own, c), band, F.greatest(own, c)))
    up = with_cells(count(band + 1), lambda c: label(band, own, band + 1, c))
    down = with_cells(F.when(band > 0, count(band - 1)).otherwise(F.lit(0).cast("long")), lambda c: label(band - 1, c, band, own))
    dealt = hot.select("tree", "key", F.explode(F.concat(same, up, down)).alias("part"), "node", "fp", "d")
    return whole.unionByName(dealt)


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    prints = keep(fingerprints(docs, text, id_column))
    members = prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    # fingerprints that only rows without an id have get numbers above all ids
    last = prints.agg(F.max("doc_id")).first()[0] or 0
    members = keep(members.withColumn("node", F.coalesce("id", F.lit(last) + 1 + F.monotonically_increasing_id())))
    roots = components(links(members).unionByName(same_id(prints)))
    named = members.join(roots, "node", "left").select("fp", "n", F.coalesce("root", "node").alias("component_id"))
    named = named.withColumn("component_id", F.when(F.col("component_id") <= last, F.col("component_id")))
    return joined(prints, named, "fp").select("doc_id", "fp", "component_id")


def same_id(prints: DataFrame) -> DataFrame:
    """Links of the rows that share a doc_id but not a fingerprint: one node of the graph."""
    twice = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("f"), F.max("fp").alias("g")).where("f <> g").select("doc_id")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    return prints.join(twice, "doc_id", "left_semi").join(least, "fp").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each group of near duplicates (see near_sets) the row of the smallest doc_id stays; rows without an id stay."""
    from . import near_sets

    return near_sets.one_of_each(docs)
