"""Near duplicates by the Jaccard similarity of word shingles, for the pipeline: SimHash, vantage-point shards, whole sets.

Two texts are near duplicates if their sets of WIDTH-word shingles have a similarity of SIMILARITY or more; groups are the
transitive closure. The method is that of simhash_vp, with fingerprints long enough for that similarity: of op3's 64 bits such
texts differ in some 10, beyond any radius that a table of 64 bits can be searched for.

* Equal texts are one node. Its fingerprint has a bit per bit position of the hashes of its distinct shingles, set where more than half
  have it. Repeats don't count, since the similarity is one of sets. Sets of similarity 0.8 differ in 15 % of the bits.
* The search is a forest, as in simhash_vp: a tree partitions the fingerprints by the distance on bits of its own, and the bound for radius 0
  leaves one shard. A pair of similarity 0.8 agrees wholly on the 8 bits of a tree with probability 0.27, and on those of one of 32 trees with 0.99995;
  larger tables take more bits and more trees for the same probability (see forest). Sets of at most SMALL shingles, whose
  bits are few values of chance, are in shards of their smallest hashes too, one of which any two similar ones share.
* In a shard the distance to the vantage point gives rings; only the same and neighbouring rings are compared (the triangle bound), and of them
  only sets whose sizes can be similar. Big shards are cut into cells and dealt out in pairs of cells.
* First every member of a shard links to one member within RADIUS, so a group of copies costs a star, not all pairs; whole sets verify the links.
* Then members within RADIUS of one of another group are compared by their whole sets inside the tasks, with lists of the nodes
  of each shingle. Only links that join two groups leave a task, so a group of near misses costs no rows of pairs. No link between
  groups that the fingerprints find is lost, and pairs inside a group that is known already are never made.

Joins on a node, text or group of very many rows take the few frequent keys apart (see joined).

Results for odd rows: a null text counts as empty; texts without words have the empty set and are equal to each other only where
the texts are equal; rows without an id are in no group and always stay; of rows that share a doc_id each text is a node of
its own; of equal rows one stays.
"""

from __future__ import annotations

from itertools import accumulate, repeat
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, give_back, joined, keep, per_slice, small_or_not
from .simhash_vp import words_of

WIDTH, SIMILARITY = 5, 0.8
#: Share of the bits in which sets of similarity SIMILARITY agree, and the probability that such a pair shares no shard.
AGREE, MISS = 1 - acos(2 * SIMILARITY / (1 + SIMILARITY)) / pi, 5e-5
#: 64-bit words of the fingerprints that are compared, and the radius. Sets of similarity SIMILARITY are 39 +- 6 of the 256 bits
#: apart, those of 4 and 5 shingles 48 +- 6, unrelated ones 128 +- 8.
WORDS, RADIUS = 4, 80
#: Least bits of a tree, and members of a shard that more rows get more bits for.
BITS, SHARD = 8, 1000
#: Shingles of a set that is in shards of its smallest hashes too.
SMALL = 16
#: Links of a node, and nodes of a shard and shingles of their sets, in one part; a part is two cells at most.
DEGREE, CELL, CELL_SHINGLES = 10_000, 1000, 1_000_000
#: Rows of a part that are compared with others at one time.
BLOCK = 64


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of fewer words the hash of all of them; empty without words."""
    import xxhash

    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *[e + 1 for e in ends]]
    parts = (line[a:b] for a, b in zip(starts, ends[width - 1 :]))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(words) - width + 1))


def forest(rows: int) -> tuple[int, int]:
    """Bits of a tree and number of trees, for tables of so many rows."""
    bits = max(BITS, round(log2(max(1, rows) / SHARD)))
    return bits, ceil(log(MISS) / log(1 - AGREE**bits))


def fingerprint(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """64 * words bits of a set that isn't empty, each set where more than half of the shingles have it; ties go by the smallest hash."""
    salt = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(64 * words, np.int64)
    first = None
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096, None] + salt
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1)
        first = bits[0].astype(np.int64) if first is None else first
        counts += bits.sum(axis=0, dtype=np.uint16)
    return counts * 2 + first > len(hashes)


def shards_of(hashes: np.ndarray, bits: np.ndarray, each: int, trees: int) -> list[int]:
    """The numbers of a set's shards: one of each tree, and of a small set those of its smallest hashes."""
    keys = bits[: each * trees].reshape(trees, each) @ (1 << np.arange(each))
    shards = ((np.arange(trees) << 32) + keys).tolist()
    if len(hashes) <= SMALL:
        # of similar sets one holds at least SIMILARITY of the other, so these hashes can't all be different
        shards += [1 << 62 | int(h) >> 2 for h in hashes[: len(hashes) - ceil(SIMILARITY * len(hashes) - 1e-9) + 1]]
    return shards


def signatures(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """(doc_id, key, n, fp, shards) of every row with an id: key is a hash of the text, n the size of its set."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("fp", pa.list_(pa.int64())), ("shards", pa.list_(pa.int64()))])
    each, trees = forest(docs.count())
    words = max(WORDS, ceil(each * trees / 64))

    def f(ids, keys, texts):
        sets = [shingle_set(t) for t in texts]
        bits = [fingerprint(s, words) if len(s) else None for s in sets]
        prints = [[] if b is None else np.packbits(b[: 64 * WORDS]).view(np.int64) for b in bits]
        return [ids, keys, [len(s) for s in sets], prints, [[] if b is None else shards_of(s, b, each, trees) for s, b in zip(sets, bits)]]

    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long"), key_of(text), text)
    return keep(rows.mapInArrow(per_slice(lambda: f, schema), "doc_id long, key binary, n long, fp array<long>, shards array<long>"))


def key_of(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def sets_of(nodes: DataFrame, members: DataFrame, docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """(node, s): the shingle sets of the nodes, from the texts; nodes: (node), distinct."""
    nodes = keep(nodes.join(members.select("node", "id", "key"), "node"))
    texts = docs.select(F.col(id_column).cast("long").alias("id"), key_of(text).alias("key"), F.col(text).alias("text"))
    schema = pa.schema([("node", pa.int64()), ("s", pa.list_(pa.int64()))])

    def f(nodes, texts):
        return [nodes, [shingle_set(t).view(np.int64) for t in texts]]

    return keep(texts.join(small_or_not(nodes, nodes.count()), ["id", "key"]).select("node", "text").mapInArrow(per_slice(lambda: f, schema), "node long, s array<long>"))


def verified(edges: DataFrame, members: DataFrame, docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """The edges (a, b) whose whole shingle sets are similar; edges are kept rows."""
    sets = sets_of(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), members, docs, text, id_column)
    # the set of a node of very many links goes to several parts
    hubs = keep(edges.groupBy("a").agg(F.ceil(F.count("*") / DEGREE).cast("int").alias("parts")).where("parts > 1"))
    hubs = small_or_not(hubs, hubs.count())
    parts = F.coalesce("parts", F.lit(1))
    dealt = edges.join(hubs, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    first = sets.select(F.col("node").alias("a"), F.col("s").alias("s_a")).join(hubs, "a", "left").select("a", "s_a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    both = dealt.join(sets.select(F.col("node").alias("b"), F.col("s").alias("s_b")), "b").join(first, ["a", "part"])
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.select("a", "b", common.alias("c"), F.size("s_a").alias("n_a"), F.size("s_b").alias("n_b")).where(F.col("c") >= SIMILARITY * (F.col("n_a") + F.col("n_b") - F.col("c"))).select("a", "b")


def cell_links(root: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between different groups of some nodes; those that would close a cycle are left out."""
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(shingle, kind="stable")
    nodes, first = row[by], np.searchsorted(shingle[by], np.arange(shingle.max(initial=-1) + 2))
    at = np.concatenate([[0], np.cumsum(size)])
    parent = {int(g): int(g) for g in root}
    out = []

    def find(g):
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    groups, times = np.unique(root, return_counts=True)
    # pairs need a node outside the largest group
    for y in np.flatnonzero(root != groups[times.argmax()]):
        own = shingle[at[y] : at[y + 1]]
        length = first[own + 1] - first[own]
        places = np.repeat(first[own] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        shared = np.bincount(nodes[places], minlength=len(sets))
        for x in np.flatnonzero((shared >= SIMILARITY * (size + size[y] - shared)) & (root != root[y])):
            a, b = find(int(root[x])), find(int(root[y]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(root[x]), int(root[y])))
    return out


def parts_links(batches):
    """Rows (part, root, s) sorted by part, to rows (a, b) of groups."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    now, roots, sets = None, [], []

    def flush():
        links = cell_links(np.array(roots), sets) if len(set(roots)) > 1 else []
        roots.clear()
        sets.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=schema)

    for batch in batches:
        for k, (part, root) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if part != now:
                yield flush()
                now = part
            roots.append(root)
            sets.append(batch.column(2)[k].values.to_numpy(zero_copy_only=False).copy())
    yield flush()
    give_back()


def near_pairs(fp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of the members of a part within RADIUS whose sizes can be similar, sorted; fp: a row of words each, n: sizes, ascending."""
    # distances to the vantage point; members of rings that aren't neighbours are further than RADIUS apart
    ring = np.bitwise_count(fp ^ fp[0]).sum(axis=1, dtype=np.int64) // (RADIUS + 1)
    rings = [np.flatnonzero(ring == k) for k in range(int(ring.max()) + 1)]
    words = np.ascontiguousarray(fp.T)
    found = []
    for k, x in enumerate(rings):
        for y in rings[k : k + 2]:
            size, x_words, y_words = n[y], words[:, x], words[:, y]
            for at in range(0, len(x), BLOCK):
                own = n[x[at : at + BLOCK]]
                low = at if y is x else int(np.searchsorted(size, int(SIMILARITY * own[0]), "left"))
                high = int(np.searchsorted(size, ceil(own[-1] / SIMILARITY), "right"))
                if low >= high:
                    continue
                apart = np.zeros((len(own), high - low), np.uint16)
                for u, v in zip(x_words[:, at : at + BLOCK], y_words[:, low:high]):
                    apart += np.bitwise_count(u[:, None] ^ v)
                i, j = np.nonzero(apart <= RADIUS)
                i, j = x[i + at], y[j + low]
                if y is x:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    found.append(np.stack([np.minimum(i, j), np.maximum(i, j)]).astype(np.int32))
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    i, j = np.concatenate(found, axis=1)
    order = np.lexsort((j, i))
    return i[order], j[order]


def stars(i: np.ndarray, j: np.ndarray, members: int) -> list[tuple[int, int]]:
    """Some of the sorted pairs (i, j), fewer than members: every member of a pair is in one, most with a member that many are near."""
    free = np.ones(members, bool)
    out = []
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    for x, near in zip(i[starts].tolist(), np.split(j, starts[1:])):
        new = near[free[near]]
        if len(new):
            out += [(x, y) for y in new.tolist()]
            free[new] = free[x] = False
        elif free[x]:
            out.append((int(near[0]), x))
            free[x] = False
    return out


def whole_parts(batches):
    """The parts of rows sorted by their first column, each an array of longs; all columns are longs."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        if not len(rows):
            continue
        if held and held[-1][0, 0] != rows[0, 0]:
            yield np.concatenate(held)
            held.clear()
        first, *more = np.split(rows, np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1)
        held.append(first)
        if more:
            yield np.concatenate(held)
            yield from more[:-1]
            held[:] = more[-1:]
    if held:
        yield np.concatenate(held)


def star_links(batches):
    """Rows (part, node, n, words of fp) sorted by part, to rows (a, b): links of every node that is within RADIUS of another."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for rows in whole_parts(batches):
        if len(rows) < 2:
            continue
        rows = rows[np.lexsort((rows[:, 1], rows[:, 2]))]
        i, j = near_pairs(np.ascontiguousarray(rows[:, 3:]).view(np.uint64), rows[:, 2])
        if len(i):
            a, b = rows[np.array(stars(i, j, len(rows))).T, 1]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)
    give_back()


def clusters(batches):
    """Rows (part, node, n, words of fp, root) sorted by part, to rows (part, node, root): nodes that pairs of different roots within RADIUS connect."""
    import xxhash

    schema = pa.schema([("part", pa.int64()), ("node", pa.int64()), ("root", pa.int64())])
    for rows in whole_parts(batches):
        if len(rows) < 2 or (rows[:, -1] == rows[0, -1]).all():
            continue
        rows = rows[np.lexsort((rows[:, 1], rows[:, 2]))]
        node, root = rows[:, 1], rows[:, -1]
        i, j = near_pairs(np.ascontiguousarray(rows[:, 3:-1]).view(np.uint64), rows[:, 2])
        i, j = i[root[i] != root[j]], j[root[i] != root[j]]
        if not len(i):
            continue
        label = np.arange(len(rows))
        while (label[i] != label[j]).any():
            np.minimum.at(label, i, label[j])
            np.minimum.at(label, j, label[i])
            label = label[label]
        live = np.unique(np.concatenate([i, j]))
        live = live[np.lexsort((node[live], label[live]))]
        for one in np.split(live, np.flatnonzero(np.diff(label[live])) + 1):
            # the same nodes of another tree get the same number
            number = xxhash.xxh64_intdigest(node[one].tobytes()) >> 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), number)), pa.array(node[one]), pa.array(root[one])], schema=schema)
    give_back()


def dealt(members: DataFrame, *more: str) -> DataFrame:
    """(part, node, n, words of fp, more) sorted by part: members (node, n, fp, shards, more) by shard, those of big shards in pairs of cells."""
    rows = members.select("node", "n", *[F.col("fp")[k].alias(f"f{k}") for k in range(WORDS)], *more, F.explode("shards").alias("shard"))
    cells = F.ceil(F.greatest(F.count("*") / CELL, F.sum("n") / CELL_SHINGLES)).cast("int")
    # two cells are one part anyway
    hot = keep(rows.groupBy("shard").agg(F.count("*").alias("size"), cells.alias("cells")).where("cells > 2 and size > 2").select("shard", "cells"))
    rows = rows.join(small_or_not(hot, hot.count()), "shard", "left").withColumn("own", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    others = F.array_remove(F.sequence(F.lit(0), F.col("cells") - 1), F.col("own"))
    pairs = F.transform(others, lambda c: F.xxhash64("shard", F.least("own", c), F.greatest("own", c)))
    part = F.explode(F.when(F.col("cells").isNull(), F.array("shard")).otherwise(pairs)).alias("part")
    return rows.select(part, "node", "n", *[f"f{k}" for k in range(WORDS)], *more).repartition("part").sortWithinPartitions("part")


def between_groups(near: DataFrame, members: DataFrame, docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """Links (a, b) of groups: a node of one shares a shard with a node of the other, within RADIUS, and their sets are similar; near: (node, n, fp, shards, root)."""
    rows = keep(dealt(near, "root").mapInArrow(clusters, "part long, node long, root long").distinct())
    sets = sets_of(rows.select("node").distinct(), members, docs, text, id_column)
    together = rows.join(sets, "node").select("part", "root", "s")
    return together.repartition("part").sortWithinPartitions("part").mapInArrow(parts_links, "a long, b long").distinct()


def groups(prints: DataFrame, docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """(key, copies, root): the group of every text."""
    members = prints.groupBy("key").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "fp", "shards")])
    members = keep(members.withColumn("node", F.monotonically_increasing_id()))
    star = keep(dealt(members).mapInArrow(star_links, "a long, b long").distinct())
    roots = keep(components(verified(star, members, docs, text, id_column)))
    live = star.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    near = keep(members.select("node", "n", "fp", "shards").join(live, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    above = keep(components(between_groups(near, members, docs, text, id_column))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    named = members.select("key", "copies", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return named.join(small_or_not(above, above.count()), "root", "left").select("key", "copies", F.coalesce("top", "root").alias("root"))


def one_of_each(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows of docs but for all near duplicates except one: that of the smallest doc_id of each group, and of its texts the one of the smallest hash."""
    prints = signatures(docs, text, id_column)
    named = keep(groups(prints, docs, text, id_column))
    rows = joined(prints.select("doc_id", "key"), named.select("key", "root", F.col("copies").alias("n")), "key")
    rows = keep(rows.groupBy("root", "doc_id", "key").agg(F.count("*").alias("times")))
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count("*").alias("n"))
    others = joined(rows, first.where("n > 1"), "root")
    gone = keep(others.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("key") != F.col("first.key"))).select("doc_id", "key"))
    twice = keep(rows.where("times > 1").select("doc_id", "key"))
    # one column holds the row, so that no name of it can clash
    all_rows = docs.select(F.struct("*").alias("doc"), F.col(id_column).cast("long").alias("doc_id"), key_of(text).alias("key"))
    kept = all_rows.join(small_or_not(gone, gone.count()), ["doc_id", "key"], "left_anti")
    n = twice.count()
    if not n:
        return kept.select("doc.*")
    again = kept.join(small_or_not(twice, n), ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
    return kept.join(small_or_not(twice, n), ["doc_id", "key"], "left_anti").unionByName(again).select("doc.*")
