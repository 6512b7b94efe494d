"""SimHash near-duplicate detection with BK-trees.

Fingerprints of 64 bits that differ in at most r bits agree in at least b - r of b blocks of bits. So each distinct
fingerprint goes to one shard for every choice of b - r blocks, and each shard is searched by a BK-tree (children keyed by
their Hamming distance to the parent; only edges within the radius are followed). The trees are built where their shard lies:
trees of all fingerprints grow with the corpus, so they can't be broadcast. Exact copies share a fingerprint and meet
once; a shard of more than shard_limit fingerprints is dealt out to pairs of salted parts. A shard yields a spanning
forest of its links, never its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, map_texts, table

BITS = 64
#: Crowded shards (16 bytes each) whose list is broadcast at most; a longer one is joined.
MOST_CROWDED = 200_000
#: Rows of one fingerprint that are joined in one task, and fingerprints of more rows that there can be.
COPIES, MOST_HOT = 512, 100_000
#: Links (16 bytes each) that one task connects at once; more are dealt out to parts.
PART = 1 << 20


def fingerprint(text: bytes | None, k: int = 4, block: int = 1 << 15) -> int:
    """The SimHash of the k-word shingles of text, repeats included, as a signed integer. No words: 0."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= k:
        hashes = np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(line[a:b], 42) for a, b in zip((ends - lengths)[: n - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), block):
        ones += np.unpackbits(hashes[i : i + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", k: int = 4) -> DataFrame:
    """The columns keep and fp, the fingerprint of the whole text (null or wordless: 0)."""
    return map_texts(docs, keep, text, "fp long", lambda: lambda texts: ([fingerprint(t, k) for t in texts],))


def masks(radius: int, blocks: int) -> list[int]:
    """Signed 64-bit masks, one for every choice of blocks - radius blocks."""
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in (sum(c) for c in combinations(parts, blocks - radius))]


def small_forest(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest, found by inserting one value after the other into a BK-tree and searching it first."""
    root = list(range(len(fps)))
    children: list[dict[int, int]] = [{} for _ in fps]

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i in range(1, len(fps)):
        todo = [0]
        while todo:
            j = todo.pop()
            d = (fps[i] ^ fps[j]).bit_count()
            if d <= radius and (a := top(i)) != (b := top(j)):
                root[a] = b
                links.append((fps[j], fps[i]))
            todo += [c for x, c in children[j].items() if d - radius <= x <= d + radius]
        at = 0
        while (nxt := children[at].setdefault((fps[i] ^ fps[at]).bit_count(), i)) != i:
            at = nxt
    return links


def apart(fps: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Differing bits of each fingerprint of fps, one word or a row of words each, and p."""
    bits = np.bitwise_count(fps ^ p)
    return bits if bits.ndim == 1 else bits.sum(1, dtype=np.int64)


def tree_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (places in fps) of a spanning forest; all values descend the BK-tree together, each node takes its distances at once."""
    label = np.arange(len(fps))
    links = []
    # A node's value is the first of its members; those that come later descend into the ring of their distance.
    # visitors: values that may link to members, of other rings.
    todo = [(np.arange(len(fps)), np.arange(0))]
    while todo:
        members, visitors = todo.pop()
        p, rest = members[0], members[1:]
        if (label[members] == label[p]).all():
            visitors = visitors[label[visitors] != label[p]]  # what is linked already needs no search
            if not len(visitors):
                continue
        d_rest, d_visit = (apart(fps[x], fps[p]) for x in (rest, visitors))
        near = np.concatenate([rest[d_rest <= radius], visitors[d_visit <= radius]])
        if len(near):
            labels, first = np.unique(label[near], return_index=True)
            fresh = labels != label[p]
            if fresh.any():
                links += [(int(p), int(near[i])) for i in first[fresh].tolist()]
                label[np.isin(label, labels[fresh])] = label[p]
        if not len(rest):
            continue
        order = np.argsort(d_rest, kind="stable")
        rings, at = np.unique(d_rest[order], return_index=True)
        parts = dict(zip(rings.tolist(), np.split(rest[order], at[1:])))
        for ring, own in parts.items():
            others = [x for other, x in parts.items() if ring < other <= ring + radius]
            todo.append((own, np.concatenate([visitors[(d_visit >= ring - radius) & (d_visit <= ring + radius)], *others])))
    return links


def large_forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """As small_forest(), by tree_links()."""
    return [(int(fps[a]), int(fps[b])) for a, b in tree_links(fps, radius)]


def shard_links(shards: DataFrame, radius: int, small: int = 48) -> DataFrame:
    """Links (a, b) of every shard; shards has columns shard, fp, and comes sorted by shard within its partitions."""

    def run(batches):
        def solve(fps):
            fps = np.unique(fps)
            return small_forest(fps.view(np.uint64).tolist(), radius) if len(fps) <= small else large_forest(fps.view(np.uint64), radius)

        def out(links):
            flat = np.array(links, object).reshape(-1, 2)
            a, b = ([x - (1 << BITS) if x >= 1 << (BITS - 1) else x for x in flat[:, i]] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        key, held, links = None, [], []
        for batch in batches:
            shard, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(shard):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
            some = np.diff(cuts) > 1  # a shard of one row has no links; the first and last may go on in other batches
            some[[0, -1]] = True
            for lo, hi in zip(cuts[:-1][some].tolist(), cuts[1:][some].tolist()):
                if held and shard[lo] != key:
                    links += solve(np.concatenate(held) if len(held) > 1 else held[0])
                    held = []
                key = shard[lo]
                held.append(fp[lo:hi].copy())
            if len(links) > 50_000:
                yield out(links)
                links = []
        if held:
            links += solve(np.concatenate(held))
        yield out(links)

    return shards.select("shard", "fp").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, radius: int = 4, blocks: int = 6, shard_limit: int = 8192) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column fp, distinct) within radius bits of each other."""
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks(radius, blocks)])).alias("choice", "mask"))
    keyed = keyed.select("fp", F.xxhash64("choice", F.col("fp").bitwiseAND(F.col("mask"))).alias("shard"))
    # Only crowded shards need their size; they are few, whatever the number of shards.
    sizes = checkpoint(keyed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > shard_limit))
    own = F.pmod(F.hash("fp"), F.col("parts"))
    pair = lambda x: F.xxhash64("shard", F.least(x, F.col("own")), F.greatest(x, F.col("own")))
    crowded = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("own")), pair)
    parts = sizes.select("shard", F.ceil(F.col("n") / shard_limit).cast("int").alias("parts"))
    dealt = keyed.join(F.broadcast(parts) if sizes.count() <= MOST_CROWDED else parts, "shard", "left").withColumn("own", own)
    dealt = dealt.select("fp", F.explode(F.when(F.col("parts").isNull(), F.array("shard")).otherwise(crowded)).alias("shard"))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shard_links(dealt.repartition(n, "shard").sortWithinPartitions("shard"), radius).distinct()


def lowest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every node of the links (u, v) that isn't the smallest it is connected to: the node, and that smallest one."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    ends, label = flat.reshape(2, -1), np.arange(len(nodes))
    while True:
        tops = label[ends]
        open_ = tops[0] != tops[1]
        if not open_.any():
            break
        ends, tops = ends[:, open_], tops[:, open_]
        np.minimum.at(label, tops.max(0), tops.min(0))  # a top is its own label, so this hangs it below a smaller one
        while ((up := label[label]) != label).any():
            label = up
    below = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[below], nodes[label[below]]


def components(edges: DataFrame, part: int = PART) -> DataFrame:
    """(node, root) for every node of edges (a, b) but the roots: root is the smallest node it is connected to.

    Parts of about part links are each connected by one task. Where there are several parts, large-star and small-star steps follow, and
    parts again, until no link changes; each round is written to the checkpoint folder. Links never lead to larger roots, so the
    rounds end, however long a chain is. One part is one round: each further one would cost the driver several stages.
    """

    def total(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    def star(both: DataFrame, keep: Column) -> DataFrame:
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(low, "u").where(keep)

    def connect(batches):
        held = [np.stack([batch.column(i).to_numpy() for i in (0, 1)]) for batch in batches]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in lowest(*np.concatenate(held, 1))], ["u", "v"])

    e, before = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), None
    while (now := total(e)) != before and now[0]:
        before, parts = now, -(-now[0] // part)
        e = checkpoint(e.repartition(parts).mapInArrow(connect, "u long, v long"))
        if parts == 1:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("s")).select("s.u", "s.v")
        e = checkpoint(small.where("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def clusters(docs: DataFrame, keep: list[str], doc_id: str, text: str, k: int, radius: int, blocks: int, shard_limit: int) -> DataFrame:
    """The columns keep, __fp, __root (the component's smallest fingerprint) and __component (its smallest doc_id)."""
    narrow = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__body"))
    made = checkpoint(fingerprints(narrow, [*keep, "__id"], "__body", k).withColumnRenamed("fp", "__fp"))
    distinct = checkpoint(made.groupBy("__fp").agg(F.min("__id").alias("low"), F.count("*").alias("n")).withColumnRenamed("__fp", "fp"))
    roots = components(links(distinct.select("fp"), radius, blocks, shard_limit))
    linked = distinct.join(roots.union(roots.select("root", "root")).distinct(), distinct.fp == F.col("node")).select("fp", "low", "root")
    lowest = linked.groupBy("root").agg(F.min("low").alias("lowest"))
    ids = linked.join(lowest, "root").select("fp", "root", "lowest")
    ids = distinct.select("fp", "low").join(ids, "fp", "left").select(F.col("fp").alias("__fp"), F.coalesce("root", "fp").alias("__root"), F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("lowest")).alias("__component"))
    # A group of copies is joined to one row. Fingerprints of many copies, of which there are MOST_HOT at most, are dealt out: their rows to
    # as many tasks as they need, to each of which their one row goes.
    limit = max(COPIES, made.count() // MOST_HOT)
    hot = F.broadcast(distinct.where(F.col("n") > limit).select(F.col("fp").alias("__fp"), F.ceil(F.col("n") / limit).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    made = made.join(hot, "__fp", "left").withColumn("__lot", F.pmod(F.hash("__id"), parts))
    ids = ids.join(hot, "__fp", "left").withColumn("__lot", F.explode(F.sequence(F.lit(0), parts - 1)))
    return made.join(ids, ["__fp", "__lot"]).select(*[F.col(f"`{c}`") for c in keep], "__id", "__fp", "__root", "__component")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, radius: int = 4, blocks: int = 6, shard_limit: int = 8192) -> DataFrame:
    """(doc_id, fp, component_id) for every row: its fingerprint, and the smallest doc_id reachable over fingerprints within radius bits.

    Null and wordless texts have fingerprint 0 and link like any other; repeated rows are members of the same component. A
    null doc_id is a member too but never the id of a component, unless all of its members' are null. Other columns don't matter.
    """
    found = clusters(docs, [], doc_id, text, k, radius, blocks, shard_limit)
    return found.select(F.col("__id").alias(doc_id), F.col("__fp").alias("fp"), F.col("__component").alias("component_id"))


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row; xxhash64 passes nulls over, so which columns are null enters it too."""
    return F.xxhash64(*df.columns, *[F.col(c).isNull() for c in df.columns])


def one_of_each(rows: DataFrame, found: DataFrame, own: str) -> DataFrame:
    """The row of rows (with __row, a hash of the whole row) of the smallest id in each __root of found (__id, __row, __root); of equal rows one."""
    first = F.min(F.struct("__id", "__row", "n")).alias("one")
    chosen = found.groupBy("__root", "__id", "__row").agg(F.count("*").alias("n")).groupBy("__root").agg(first).select(F.col("one.__id").alias("__id"), F.col("one.__row").alias("__chosen"), "one.n")
    kept = rows.join(chosen, (F.col("__row") == F.col("__chosen")) & F.col(own).eqNullSafe(F.col("__id")))
    return kept.where("n = 1").unionByName(kept.where("n > 1").dropDuplicates(["__row", own]))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, radius: int = 4, blocks: int = 6, shard_limit: int = 8192) -> DataFrame:
    """One row of each component of docs: that of the smallest doc_id (nulls first), and of rows that are equal in every column one."""
    safe = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own, body = (f"c{docs.columns.index(c)}" for c in (doc_id, text))
    safe = safe.withColumn("__row", row_hash(safe))
    found = clusters(safe, ["__row"], own, body, k, radius, blocks, shard_limit)
    return one_of_each(safe, found, own).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def hexadecimal(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")
