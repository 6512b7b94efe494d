"""Near-duplicate removal by SimHash candidates, decided by exact similarity: texts whose sets of k-word shingles have a Jaccard
similarity of 4/5 or more.

One fingerprint of 64 bits can't find such texts: at 4/5 two sets differ in 9.7 of 64 bits on average, and a radius that
catches them catches unrelated texts too. So the fingerprint here has 256 bits: 38.8 of them differ on average at 4/5 (standard
deviation 5.7), and the radius of 62 leaves out some 3 in 100,000 such pairs, while unrelated texts, even those that share a
shard, are some 7 standard deviations away. Blocks that must be equal, as near_duplicates() uses them, would be too short at
that radius; each fingerprint goes to the shards of several samples of its bits instead, so many that at 4/5 a pair
shares none with probability MISSED at most. A sample grows with the logarithm of the corpus, so that a shard has about
SHARD members at any size, and the number of samples follows from it.

Shards are searched by BK-trees and yield spanning forests of candidate links, never pairs. The candidates' components are
then decided by the whole sets: a component of many shingles is dealt out to parts, twice by different lots, after which most
of a dense group is connected; and where a component still isn't one, its largest connected part meets the others, which meet each
other, in pairs of parts. No link is left out there, and none is made by bits alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_texts, remove, written
from .simhash import components, one_of_each, row_hash, tree_links

#: Jaccard similarity that links, as a fraction, so that it is decided in whole numbers.
ALIKE = (4, 5)
WORDS, RADIUS = 4, 62
BITS = 64 * WORDS
#: Members of a shard on average, the least bits of a sample, and the share of pairs at the similarity that may share no shard.
SHARD, LEAST_BITS, MISSED = 256, 8, 1e-3
#: Fingerprints of a shard (48 bytes each), and shingles of a part (8 bytes each), beyond which it is dealt out.
CROWDED, SHARD_LIMIT = 8192, 1 << 17
#: Rows (16 bytes each) that are broadcast at most; more are joined.
MOST_ROWS = 2_000_000
BLOCK = 1 << 13
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
PRINT = [f"w{i}" for i in range(WORDS)]


def shingles(text: bytes | None, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the k-word shingles of the whole text; a text of fewer words is one shingle, no words none."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    m = max(n - k + 1, 1)
    return np.unique(np.fromiter((digest(line[a:b], 42) for a, b in zip((ends - lengths)[:m].tolist(), ends[min(k, n) - 1 :].tolist())), np.uint64, m))


def digest(found: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(found.tobytes(), 7), np.uint64).view(np.int64))


def long_fingerprint(found: np.ndarray) -> list[int]:
    """The SimHash of a set of shingles, as WORDS signed words; of no shingles 0."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(found), BLOCK):
        words = [found[at : at + BLOCK]]
        for _ in range(WORDS - 1):
            x = words[-1] * np.uint64(MIX[0])
            words.append((x ^ (x >> np.uint64(31))) * np.uint64(MIX[1]))
        flat = np.stack(words, 1).view(np.uint8).reshape(-1, 8 * WORDS)
        ones += np.unpackbits(flat, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(found), bitorder="little").view(np.int64).tolist()


def sketches(docs: DataFrame, keep: list[str], text: str, k: int) -> DataFrame:
    """The columns keep, digest (of the set), n (its size) and the words PRINT of its fingerprint."""

    def make():
        def work(texts):
            sets = [shingles(t, k) for t in texts]
            prints = [long_fingerprint(s) for s in sets]
            return [digest(s) for s in sets], [len(s) for s in sets], *[[p[i] for p in prints] for i in range(WORDS)]

        return work

    return map_texts(docs, keep, text, "digest long, n long, " + ", ".join(f"{w} long" for w in PRINT), make)


def samples(n: int) -> list[tuple[int, int]]:
    """Masks of the words, one for each sample of bits, for n fingerprints."""
    p, q = ALIKE
    cosine = 2 * p / (p + q)
    equal = 1 - math.acos(cosine) / math.pi  # the share of equal bits at the similarity
    bits = min(BITS, max(LEAST_BITS, math.ceil(math.log2(max(n, 1) / SHARD))))
    many = math.ceil(math.log(MISSED) / math.log(1 - equal**bits))
    random = np.random.default_rng(17)
    chosen = [random.choice(BITS, bits, replace=False) for _ in range(many)]
    words = [[sum(1 << int(b) % 64 for b in c if b // 64 == w) for w in range(WORDS)] for c in chosen]
    return [tuple(m - (1 << 64) if m >> 63 else m for m in c) for c in words]


def candidates(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) between nodes of prints (node and PRINT; distinct) that connect those within RADIUS that share a shard."""
    spark = prints.sparkSession
    masks = F.array(*[F.struct(*[F.lit(m).cast("long").alias(f"m{i}") for i, m in enumerate(c)]) for c in samples(prints.count())])
    keyed = prints.select(*PRINT, F.posexplode(masks).alias("choice", "m"))
    keyed = keyed.select(*PRINT, F.xxhash64("choice", *[F.col(w).bitwiseAND(F.col(f"m.m{i}")) for i, w in enumerate(PRINT)]).alias("shard"))
    sizes = written(keyed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("shard", F.ceil(F.col("n") / crowded).cast("int").alias("parts")))
    own = F.pmod(F.hash(*PRINT), F.col("parts"))
    pair = lambda x: F.xxhash64("shard", F.least(x, F.col("own")), F.greatest(x, F.col("own")))
    others = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("own")), pair)
    dealt = keyed.join(F.broadcast(sizes) if sizes.count() <= MOST_ROWS // 10 else sizes, "shard", "left").withColumn("own", own)
    dealt = dealt.select(*PRINT, F.explode(F.when(F.col("parts").isNull(), F.array("shard")).otherwise(others)).alias("shard"))

    def solve(fps: np.ndarray) -> list[tuple[int, int]]:
        if len(fps) > 2 * SHARD:
            return tree_links(fps, RADIUS)
        # Of a small shard only values that have a neighbour enter the tree: mostly none has.
        bits = sum(np.bitwise_count(fps[:, None, i] ^ fps[None, :, i]).astype(np.int16) for i in range(WORDS))
        some = np.flatnonzero((bits <= RADIUS).sum(1) > 1)
        return [(int(some[a]), int(some[b])) for a, b in tree_links(fps[some], RADIUS)] if len(some) else []

    ends = [f"{e}{i}" for e in "ab" for i in range(WORDS)]

    def run(batches):
        key, held, out = None, [], []

        def close():
            fps = np.concatenate(held)
            if len(fps) > 1:
                found = np.array(solve(fps.view(np.uint64)), np.int64).reshape(-1, 2)
                if len(found):
                    out.append(np.concatenate([fps[found[:, 0]], fps[found[:, 1]]], 1))

        def ready():
            flat = np.concatenate(out) if out else np.zeros((0, 2 * WORDS), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(flat[:, i]) for i in range(2 * WORDS)], ends)

        for batch in batches:
            shard = batch.column(0).to_numpy()
            if not len(shard):
                continue
            fps = np.stack([batch.column(1 + i).to_numpy() for i in range(WORDS)], 1)
            cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
            some = np.diff(cuts) > 1  # a shard of one row has no links; the first and last may go on in other batches
            some[[0, -1]] = True
            for lo, hi in zip(cuts[:-1][some].tolist(), cuts[1:][some].tolist()):
                if held and shard[lo] != key:
                    close()
                    held = []
                key = shard[lo]
                held.append(fps[lo:hi])
            if sum(map(len, out)) > 50_000:
                yield ready()
                out.clear()
        if held:
            close()
        yield ready()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(n, "shard").sortWithinPartitions("shard").select("shard", *PRINT).mapInArrow(run, ", ".join(f"{e} long" for e in ends))
    return found.select(F.xxhash64(*ends[:WORDS]).alias("a"), F.xxhash64(*ends[WORDS:]).alias("b")).distinct()


def forest(digests: np.ndarray, roots: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of a spanning forest between texts of other roots that are alike; sets are sorted, distinct and not empty."""
    p, q = ALIKE
    first = np.unique(digests, return_index=True)[1]
    order = first[np.argsort([len(sets[i]) for i in first.tolist()], kind="stable")]
    label, sizes = roots[order], np.array([len(sets[i]) for i in order.tolist()])
    stops = np.cumsum(sizes)
    starts = stops - sizes
    values, flat = np.unique(np.concatenate([sets[i] for i in order.tolist()]), return_inverse=True)
    seen = np.zeros(len(values), bool)
    # Ascending sizes: those that the size alone doesn't keep apart from i come right after it.
    reach = np.searchsorted(p * sizes, q * sizes, "right").tolist()
    links = []
    for i, hi in enumerate(reach):
        others = i + 1 + np.flatnonzero(label[i + 1 : hi] != label[i])
        if not len(others):
            continue
        own = flat[starts[i] : stops[i]]
        seen[own] = True
        if 4 * len(others) < hi - i - 1:
            common = np.array([np.count_nonzero(seen[flat[starts[j] : stops[j]]]) for j in others.tolist()])
        else:
            lo = others[0]
            common = np.add.reduceat(seen[flat[starts[lo] : stops[hi - 1]]], starts[lo:hi] - starts[lo], dtype=np.int64)[others - lo]
        seen[own] = False
        for j in others[(p + q) * common >= p * (sizes[i] + sizes[others])].tolist():
            if label[j] != label[i]:
                links.append((int(digests[order[i]]), int(digests[order[j]])))
                label[label == label[j]] = label[i]
    return links


def shard_links(shards: DataFrame) -> DataFrame:
    """Links (a, b) of every shard; shards has columns shard, digest, root, found, and comes sorted by shard within its partitions."""

    def run(batches):
        def solve(held):
            got = [] if len(held) < 2 else forest(np.array([x[0] for x in held]), np.array([x[1] for x in held]), [np.frombuffer(x[2], np.uint64) for x in held])
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], ["a", "b"])

        key, held = None, []
        for batch in batches:
            for part in chunks(batch, 3, 1 << 22):
                for shard, *row in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if shard != key:
                        yield solve(held)
                        key, held = shard, []
                    held.append(row)
        yield solve(held)

    return shards.select("shard", "digest", "root", "found").mapInArrow(run, "a long, b long")


def rooted(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """members (group, digest, n) with root, what links connect them to so far."""
    if links is None:
        return members.withColumn("root", F.col("digest"))
    roots = components(links)
    return members.join(roots, members.digest == roots.node, "left").select("group", "digest", "n", F.coalesce("root", "digest").alias("root"))


def unfinished(members: DataFrame, limit: int) -> DataFrame:
    """(group, parts) of the groups that aren't connected yet."""
    about = members.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("total"))
    return about.where("low <> high").select("group", F.ceil(F.col("total") / limit).cast("int").alias("parts"))


def decided(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within each shard of dealt (digest, root, shard), written; sets: (digest, found)."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(shard_links(dealt.join(sets, "digest").repartition(n, "shard").sortWithinPartitions("shard")).distinct())


def links(members: DataFrame, sets: DataFrame, limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (a, b) that connect all members (group, digest, n) of one group that are alike; sets: (digest, found)."""
    edges, now = None, rooted(members, None)
    for lot in range(2):
        open_ = written(unfinished(now, limit).where(F.col("parts") > (1 if lot else 0)))
        if open_.isEmpty():
            break
        shard = F.xxhash64("group", F.lit(lot), F.pmod(F.hash("digest", F.lit(lot)), F.col("parts")))
        more = decided(spread(now, open_, "group", "digest", "inner").select("digest", "root", shard.alias("shard")), sets)
        edges = edges.union(more) if edges is not None else more
        if open_.where("parts > 1").isEmpty():
            break
        now = rooted(members, edges)
    else:
        # What isn't connected by now: the largest connected part of a group (main) against all others, and these against each other.
        open_ = written(unfinished(now, limit).where("parts > 1").select("group"))
        if open_.isEmpty():
            return edges
        by_root = spread(now, open_, "group", "digest", "inner").groupBy("group", "root").agg(F.sum("n").alias("total"))
        best = by_root.groupBy("group").agg(F.max_by("root", F.struct("total", "root")).alias("main"), F.max("total").alias("most"), F.sum("total").alias("all"))
        count = lambda c: F.greatest(F.lit(1), F.ceil(c / limit)).cast("int")
        best = best.select("group", "main", count(F.col("most")).alias("p"), count(F.col("all") - F.col("most")).alias("q"))
        rows = spread(now, best, "group", "digest", "inner").withColumn("other", F.col("root") != F.col("main"))
        own = F.when(F.col("other"), F.col("p") + F.pmod(F.hash("digest"), F.col("q"))).otherwise(F.pmod(F.hash("digest"), F.col("p")))
        first = F.when(F.col("other"), F.lit(0)).otherwise(F.col("p"))
        meets = F.filter(F.sequence(first, F.col("p") + F.col("q") - 1), lambda x: x != F.col("own"))
        pair = lambda x: F.xxhash64("group", F.lit("pair"), F.least(x, F.col("own")), F.greatest(x, F.col("own")))
        rows = rows.withColumn("own", own).select("digest", "root", F.explode(F.transform(meets, pair)).alias("shard"))
        edges = edges.union(decided(rows, sets))
    return edges if edges is not None else members.sparkSession.createDataFrame([], "a long, b long")


def spread(big: DataFrame, small: DataFrame, key: str, by: str, how: str = "left", salts: int = 16) -> DataFrame:
    """big joined with small by key; rows of big that share a key go to salts tasks, by another column, as small is repeated for each.
    Its repeated rows are more than Spark expects, so they aren't broadcast."""
    lots = small.withColumn("__lot", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return big.withColumn("__lot", F.pmod(F.hash(by), F.lit(salts))).join(lots, [key, "__lot"], how).drop("__lot")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, shard_limit: int = SHARD_LIMIT, crowded: int = CROWDED) -> DataFrame:
    """One row of each component of docs over links of alike texts: that of the smallest doc_id (nulls first), and of rows that are
    equal in every column one. Null and wordless texts are alike to each other only. Columns may have any names; no rows give none."""
    spark = docs.sparkSession
    safe = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own, body = (f"c{docs.columns.index(c)}" for c in (doc_id, text))
    safe = safe.withColumn("__row", row_hash(safe))
    made = written(sketches(safe.withColumnRenamed(own, "__id"), ["__row", "__id"], body, k).withColumn("node", F.xxhash64(*PRINT)))
    each = written(made.groupBy("digest").agg(F.min("__row").alias("row"), F.first("n").alias("n"), F.first("node").alias("node"), *[F.first(w).alias(w) for w in PRINT]).where("n > 0"))
    near = components(candidates(each.select("node", *PRINT).distinct(), crowded))
    grouped = each.join(near, "node", "left").select("digest", "row", "n", F.coalesce("root", "node").alias("group"))
    several = grouped.groupBy("group").agg(F.count("*").alias("m")).where("m > 1").select("group")
    members = written(spread(grouped, several, "group", "digest", "inner"))
    wanted = members.select("digest", "row")
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_ROWS else wanted
    texts = safe.join(wanted, safe["__row"] == F.col("row")).select("digest", F.col(body).alias("__body"))
    found = map_texts(texts, ["digest"], "__body", "found binary", lambda: lambda texts: ([shingles(t, k).tobytes() for t in texts],))
    sets = written(found.dropDuplicates(["digest"]))
    roots = components(links(members.select("group", "digest", "n"), sets, shard_limit))
    placed = written(spread(made, roots.withColumnRenamed("node", "digest"), "digest", "__id").select("__id", "__row", F.coalesce("root", "digest").alias("__root")))
    for df in (made, each, members, sets):
        remove(spark, df)
    return one_of_each(safe, placed, own).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
