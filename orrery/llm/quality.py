"""Quality classifier: an interpolated modified Kneser-Ney model of character 5-grams, trained on trusted text.

Words of open vocabularies make count tables as large as the corpus; characters in classes of 12 bits fit five in an integer,
whose context and suffixes are bit operations. There is one path at every size. Documents are written once, in packs of
bounded size, as a table bucketed by pack; no text is shuffled afterwards. Trusted rows are found by a join of ids alone and
sent to their packs. Each pack gives its distinct 5-grams with their counts in trusted text; counts, continuation counts,
discounts and probabilities are sharded aggregates and joins by n-gram; each pack gets the probabilities of its own
5-grams back and is scored beside them. A 5-gram has at most one row in a pack, so the most frequent one is no larger a
share of the rows than one in the number of a pack's distinct 5-grams. The driver holds only counts of counts.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BYTES, chunks, remove, shared_folder, table, written
from .langid import held_out

ORDER, BITS = 5, 12
#: Code units below PLAIN are a class each, others are hashed into the rest; START stands before a text.
PLAIN, CLASSES, START = 1024, 1 << BITS, 2
PIECE = 1 << 19
#: Bytes of text in a pack; one longer text is a pack of its own.
PACK_BYTES = 48 << 20


def grams(texts: list[bytes | None]):
    """For runs of pieces of the texts: each piece's text, where its 5-grams start, and the 5-grams, one for each code unit."""
    run, size = [], 0
    for i, t in enumerate(texts):
        units = np.frombuffer(t.decode().lower().encode("utf-16-le", "surrogatepass"), "<u2").astype(np.int64) if t else np.zeros(0, np.int64)
        units = np.where(units < PLAIN, units, PLAIN + units * 40503 % (CLASSES - PLAIN))
        for at in range(0, len(units), PIECE):
            before = units[max(0, at - ORDER + 1) : at] if at else np.full(ORDER - 1, START, np.int64)
            run.append((i, np.concatenate([before, units[at : at + PIECE]])))
            size += len(run[-1][1])
            if size > PIECE:
                yield joined(run)
                run, size = [], 0
    if run:
        yield joined(run)


def joined(run: list[tuple[int, np.ndarray]]):
    codes = np.concatenate([p for _, p in run])
    g = codes.copy()
    for j in range(1, ORDER):
        g[j:] |= codes[:-j] << (BITS * j)
    lengths = np.array([len(p) for _, p in run])
    starts = np.cumsum(lengths) - lengths
    keep = np.ones(len(g), bool)
    for j in range(ORDER - 1):
        keep[starts + j] = False
    own = lengths - (ORDER - 1)
    return np.array([i for i, _ in run]), np.cumsum(own) - own, g[keep]


class Packs:
    """Rows dealt to packs as they come: a table (pack, at, columns, text), bucketed by pack, so that what is grouped by pack meets it in place."""

    def __init__(self, rows: DataFrame, pack_bytes: int = PACK_BYTES) -> None:
        """rows has the binary column text last."""
        spark = self.spark = rows.sparkSession
        last = len(rows.columns) - 1
        schema = T.StructType([T.StructField("pack", T.LongType()), T.StructField("at", T.LongType()), *rows.schema.fields])
        columns = schema.names

        def deal(batches):
            # The task's own id comes from Spark as the first column: retried tasks give the same packs.
            seq = at = held = 0
            for batch in batches:
                for part in chunks(batch, last + 1, min(CHUNK_BYTES, pack_bytes)):
                    size = part.column(last + 1).nbytes
                    if held and held + size > pack_bytes:
                        seq, at, held = seq + 1, 0, 0
                    task = part.column(0).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array((task << 24) + seq), pa.array(np.arange(at, at + len(part))), *part.columns[1:]], columns)
                    at, held = at + len(part), held + size

        name = f"orrery_packs_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(spark)}/{name}"
        dealt = rows.select(F.spark_partition_id().cast("long").alias("__task"), *rows.columns).mapInArrow(deal, schema)
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt.write.bucketBy(buckets, "pack").option("compression", "zstd").option("path", self.path).format("parquet").saveAsTable(name)
        self.name = name

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def pieces(rows: pa.Table):
    for batch in rows.select(["text"]).to_batches():
        yield from chunks(batch, 0, CHUNK_BYTES)


def count_grams(packs: Packs, marks: DataFrame) -> DataFrame:
    """(pack, gram, n): each pack's distinct 5-grams, and how often they occur in its rows that marks (pack, at) names."""

    def count(rows: pa.Table, marked: pa.Table) -> pa.Table:
        flags = np.isin(rows.column("at").to_numpy(), marked.column("marked_at").to_numpy())
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = 0
        for part in pieces(rows):
            for owner, starts, g in grams(part.column(0).to_pylist()):
                own, place = np.unique(g, return_inverse=True)
                n = np.bincount(place, np.repeat(flags[at + owner], np.diff(np.append(starts, len(g)))), len(own))
                both, place = np.unique(np.concatenate([keys, own]), return_inverse=True)
                keys, counts = both, np.bincount(place, np.concatenate([counts, n]), len(both)).astype(np.int64)
            at += len(part)
        pack = rows.column("pack")[0].as_py() if len(rows) else 0
        return pa.table([pa.array(np.full(len(keys), pack, np.int64)), pa.array(keys), pa.array(counts)], names=["pack", "gram", "n"])

    marks = marks.toDF("marked_pack", "marked_at")
    return packs.rows().select("pack", "at", "text").groupBy("pack").cogroup(marks.groupBy("marked_pack")).applyInArrow(count, "pack long, gram long, n long")


def suffix(gram: str, order: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit((1 << BITS * order) - 1))


def train(counts: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """From (gram, n) of the highest order, for each order: (gram, p), interpolated with all lower orders, and (context, gamma), its weight of the next lower order."""
    of = {ORDER: written(counts)}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: in how many contexts an n-gram follows
        of[k] = written(of[k + 1].groupBy(suffix("gram", k).alias("gram")).agg(F.count("*").alias("n")))
    counted = reduce(DataFrame.unionByName, [of[k].agg(F.lit(k).alias("k"), *[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]) for k in of])
    model, lower = {}, None
    spark = counts.sparkSession
    for k, n1, n2, n3, n4 in sorted(map(tuple, counted.collect())):
        c = of[k]
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        # Discounts of Chen and Goodman; a corpus too small to have them gets 0.5, 1 and 1.5.
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3] if n1 and n2 and n3 else [0.5, 1.0, 1.5]
        d = [min(max(x, 0.1), i - 0.05) for i, x in enumerate(d, 1)]
        context = c.groupBy(F.shiftright("gram", BITS).alias("context")).agg(F.sum("n").alias("total"), *[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2)], F.count_if(F.col("n") > 2).alias("n3"))
        context = context.withColumn("gamma", sum(F.lit(d[i]) * F.col(f"n{i + 1}") for i in range(3)) / F.col("total"))
        context = written(context.select("context", "total", "gamma"))
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        p = c.withColumn("context", F.shiftright("gram", BITS)).join(context, "context").withColumn("alpha", (F.col("n") - discount) / F.col("total"))
        if k == 1:
            p = p.select("gram", (F.col("alpha") + F.col("gamma") / CLASSES).alias("p"))
        else:
            p = p.withColumn("suffix", suffix("gram", k - 1)).join(lower.withColumnsRenamed({"gram": "suffix", "p": "q"}), "suffix")
            p = p.select("gram", (F.col("alpha") + F.col("gamma") * F.col("q")).alias("p"))
        lower = written(p)
        remove(spark, c)
        model[k] = lower, context
    return model


def probabilities(model: dict[int, tuple[DataFrame, DataFrame]], asked: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, p) of each distinct gram of the given order in asked: its own probability, else that of its suffix times its context's weight."""
    p, context = model[order]
    if order == 1:
        rest = context.agg(F.max("gamma").alias("gamma"))
        return asked.join(p, "gram", "left").join(F.broadcast(rest)).select("gram", F.coalesce("p", F.coalesce("gamma", F.lit(1.0)) / CLASSES).alias("p"))
    keyed = asked.select("gram", F.shiftright("gram", BITS).alias("context"), suffix("gram", order - 1).alias("suffix"))
    lower = probabilities(model, keyed.select(F.col("suffix").alias("gram")).distinct(), order - 1)
    found = keyed.join(p, "gram", "left").join(context.drop("total"), "context", "left").join(lower.withColumnsRenamed({"gram": "suffix", "p": "q"}), "suffix")
    return found.select("gram", F.coalesce("p", F.coalesce("gamma", F.lit(1.0)) * F.col("q")).alias("p"))


class Scores:
    """Log-probabilities by gram, in an open-addressed table."""

    def __init__(self, gram: np.ndarray, p: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(2 * len(gram) + 2))))
        slot = self.slots(gram)
        order = np.argsort(slot, kind="stable")
        at = np.arange(len(gram))
        place = np.maximum.accumulate(slot[order] - at) + at if len(gram) else at
        size = max((1 << self.bits), int(place[-1]) + 1 if len(place) else 0) + 1
        self.keys, self.logs = np.full(size, -1, np.int64), np.zeros(size)
        self.keys[place], self.logs[place] = gram[order], np.log(p[order])

    def slots(self, gram: np.ndarray) -> np.ndarray:
        return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, gram: np.ndarray) -> np.ndarray:
        """Every gram is in the table."""
        at = self.slots(gram)
        left = np.flatnonzero(self.keys[at] != gram)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] != gram[left]]
        return self.logs[at]

    def total(self, texts: list[bytes | None]) -> tuple[list[int], list[float | None]]:
        """Code units of each text, and its perplexity; None without any."""
        sums, units = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for owner, starts, g in grams(texts):
            np.add.at(sums, owner, np.add.reduceat(self.find(g), starts))
            np.add.at(units, owner, np.diff(np.append(starts, len(g))))
        return units.tolist(), [float(np.exp(-s / n)) if n else None for s, n in zip(sums, units.tolist())]


def scored(packs: Packs, counted: DataFrame, keep: list[T.StructField]) -> DataFrame:
    """The columns keep, n_units and perplexity of each row, written; counted is count_grams() of the packs, written."""
    model = train(counted.where("n > 0").groupBy("gram").agg(F.sum("n").alias("n")))
    asked = written(probabilities(model, counted.select("gram").distinct()))
    needed = counted.select("pack", "gram").join(asked, "gram")
    names = [f.name for f in keep]

    def score(rows: pa.Table, own: pa.Table) -> pa.Table:
        known = Scores(own.column("gram").to_numpy(), own.column("p").to_numpy())
        units, found = [], []
        for part in pieces(rows):
            a, b = known.total(part.column(0).to_pylist())
            units += a
            found += b
        return pa.table([*[rows.column(n) for n in names], pa.array(units, pa.int64()), pa.array(found, pa.float64())], names=[*names, "n_units", "perplexity"])

    schema = T.StructType([*keep, T.StructField("n_units", T.LongType()), T.StructField("perplexity", T.DoubleType())])
    found = packs.rows().select("pack", *names, "text").groupBy("pack").cogroup(needed.groupBy("pack")).applyInArrow(score, schema)
    result = written(found)
    for df in (asked, *[x for pair in model.values() for x in pair]):
        remove(packs.spark, df)
    return result


def perplexity(docs: DataFrame, trusted: DataFrame, keep: list[str], text: str = "text", pack_bytes: int = PACK_BYTES) -> DataFrame:
    """The columns keep, n_units and perplexity (null for null and empty texts) of each row of docs, by the model of trusted's texts.

    Without any trusted text all 5-grams are equally likely. Equal texts have equal values; other columns, whatever their
    names, don't matter.
    """
    names = [f"c{i}" for i in range(len(keep))]
    body = F.col(f"`{text}`").cast("binary").alias("text")
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.lit(False).alias("learn"), body)
    learn = trusted.select(*[F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in names], F.lit(True).alias("learn"), body)
    packs = Packs(rows.union(learn), pack_bytes)
    counted = written(count_grams(packs, packs.rows().where("learn").select("pack", "at")))
    found = scored(packs, counted, [*[rows.schema[n] for n in names], T.StructField("learn", T.BooleanType())])
    packs.drop()
    remove(docs.sparkSession, counted)
    return found.where("not learn").select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "n_units", "perplexity")


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quality: str = "quality", quantile: float = 0.99, slack: float = 0.1, least: int = 20, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(doc_id, lang, n_units, perplexity, threshold, keep) for each row of docs.

    Trusted are rows whose doc_id is labelled quality 1 (of several labels the largest). The model learns from four fifths of them (by
    crc32 of the id); a language's threshold is the quantile of the others' perplexity, times 1 + slack. Languages with fewer
    than least such documents, and null, take that of all languages. Null and empty texts have no perplexity and aren't
    kept; where no threshold can be had everything else is. Equal texts of one language have equal values, and each repeated
    row stays; no documents, or no labels, give no rows, or no thresholds.
    """
    good = labels.groupBy(F.col(f"`{doc_id}`").alias("__id")).agg(F.max(F.col(f"`{quality}`")).alias("q")).where("q = 1").select("__id")
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("binary").alias("text"))
    packs = Packs(rows, pack_bytes)
    ids = packs.rows().select("pack", "at", "id")
    counted = written(count_grams(packs, ids.join(good.where(~held_out("__id")), F.col("id") == F.col("__id")).select("pack", "at")))
    found = scored(packs, counted, rows.schema.fields[:2])
    packs.drop()
    remove(docs.sparkSession, counted)
    of = found.join(good.where(held_out("__id")), F.col("id") == F.col("__id"), "left_semi").where(F.col("perplexity").isNotNull())
    cut = (F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000)) * (1 + slack)).alias("own")
    by_language = of.where(F.col("lang").isNotNull()).groupBy(F.col("lang").alias("__lang")).agg(cut, F.count("*").alias("n")).where(F.col("n") >= least)
    limits = found.join(by_language, F.col("lang") == F.col("__lang"), "left").join(F.broadcast(of.agg(cut.alias("common"))))
    threshold = F.coalesce("own", "common")
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return limits.select(F.col("id").alias("doc_id"), "lang", "n_units", "perplexity", threshold.alias("threshold"), keep.alias("keep"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
