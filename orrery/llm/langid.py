"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from all training texts; the matrix of log-probabilities (languages x buckets) is broadcast in blocks of
languages, and batches are scored by gathering its columns at the buckets of each text's n-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, map_texts, remove, table, written

#: Lengths of n-grams, buckets for each length, and languages of a block: it is collected and broadcast at once, 0.4 MB a language.
LENGTHS, BUCKETS, BLOCK = (1, 2, 3), 1 << 15, 64
PIECE = 1 << 19
LETTER = regex.compile(r"\p{L}")
MIX = np.uint32(2654435761)
UNKNOWN = "und"


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text is a multiple of 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def buckets(texts: list[str]):
    """For each run of pieces of texts: the index of each piece's text, where the pieces start, and the buckets of their n-grams.

    A bucket is -1 where no n-gram of the piece's text starts. Texts are split into pieces that overlap, so memory is bounded.
    """
    run, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), PIECE):
            piece = t[at : at + PIECE + max(LENGTHS) - 1]
            run.append((i, piece, min(PIECE, len(t) - at)))
            size += len(piece)
            if size > PIECE:
                yield coded(run)
                run, size = [], 0
    if run:
        yield coded(run)


def coded(run: list[tuple[int, str, int]]):
    points = np.frombuffer("".join(p for _, p, _ in run).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(p) for _, p, _ in run])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    extra = [np.arange(s + own, e) for s, e, (_, _, own) in zip(starts, ends, run) if s + own < e]
    found = []
    for n in LENGTHS:
        h = points.copy()
        for j in range(1, n):
            h *= MIX
            h[:-j] += points[j:]
        h = ((h * MIX) >> np.uint32(17)).astype(np.int64) + LENGTHS.index(n) * BUCKETS
        for j in range(1, n):
            h[ends - j] = -1
        for x in extra:
            h[x] = -1
        found.append(h)
    return np.array([i for i, _, _ in run]), starts, found


def counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all rows with a text and a language; bucket -1 counts the rows. Each task sums up before it sends."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch, 0, CHUNK_BYTES):
                langs = part.column(1).to_pylist()
                texts = [t.decode().lower() for t in part.column(0).to_pylist()]
                for name in langs:
                    sums.setdefault(name, np.zeros(len(LENGTHS) * BUCKETS + 1, np.int64))[-1] += 1
                for owner, starts, found in buckets(texts):
                    stops = np.append(starts[1:], len(found[0]))
                    for name in {langs[i] for i in owner.tolist()}:
                        own = [slice(a, b) for i, a, b in zip(owner.tolist(), starts.tolist(), stops.tolist()) if langs[i] == name]
                        h = np.concatenate([x[s] for x in found for s in own])
                        sums[name] += np.bincount(h[h >= 0], minlength=len(LENGTHS) * BUCKETS + 1)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(np.where(at == len(n) - 1, -1, at), pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull())
    rows = rows.select(F.col(f"`{text}`").cast("binary").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """A block of languages, in order, and scores: a row of log-probabilities for each, with the log prior beside."""

    def __init__(self, rows: pa.Table, total: int, smoothing: float = 0.5) -> None:
        """rows: (lang, bucket, n) of the block's languages; total: training texts of all languages."""
        names, at, n = (rows.column(c) for c in ("lang", "bucket", "n"))
        self.languages = sorted(set(names.to_pylist()))
        index = {x: i for i, x in enumerate(self.languages)}
        which, at, n = np.array([index[x] for x in names.to_pylist()], np.int64), at.to_numpy(), n.to_numpy()
        grid = np.zeros((len(self.languages), len(LENGTHS) * BUCKETS + 1))
        grid[which, at] = n  # -1 is the last column
        sums = np.maximum(grid[:, :-1].reshape(len(self.languages), len(LENGTHS), BUCKETS).sum(2, keepdims=True), 1)
        logs = np.log((grid[:, :-1].reshape(len(self.languages), len(LENGTHS), BUCKETS) + smoothing) / (sums + smoothing * BUCKETS))
        self.scores = np.append(logs.reshape(len(self.languages), len(LENGTHS) * BUCKETS), np.zeros((len(self.languages), 1)), 1).astype(np.float32)
        self.prior = np.log(grid[:, -1] / max(total, 1)) if len(grid) else np.zeros(0)

    def sums(self, lowered: list[str]) -> np.ndarray:
        """Log-probabilities of each text with each language."""
        out = np.tile(self.prior, (len(lowered), 1))
        for owner, starts, found in buckets(lowered):
            for l in range(len(self.languages)):
                row = self.scores[l]
                np.add.at(out[:, l], owner, sum(np.add.reduceat(row[h], starts, dtype=np.float64) for h in found))
        return out


def predict(models: list[Model], texts: list[str | None]) -> tuple[list[str], list[float]]:
    lowered = [t.lower() if t else "" for t in texts]
    languages = [x for m in models for x in m.languages]
    sums = np.concatenate([m.sums(lowered) for m in models], 1) if models else np.zeros((len(texts), 0))
    names, scores = [], []
    for t, s in zip(lowered, sums):
        if not len(s) or not LETTER.search(t):
            names.append(UNKNOWN)
            scores.append(0.0)
        else:
            best = int(np.argmax(s))
            names.append(languages[best])
            scores.append(float(1 / np.exp(s - s[best]).sum()))
    return names, scores


def train(docs: DataFrame, text: str = "text", lang: str = "lang", block: int = BLOCK) -> list[Model]:
    """The model of all languages in blocks, in the order of their names. The driver holds the counts of one block at a time."""
    counted = written(counts(docs, text, lang))
    sizes = {r.lang: r.n for r in counted.where("bucket = -1").select("lang", "n").collect()}
    names, total = sorted(sizes), sum(sizes.values())
    models = [Model(counted.where(F.col("lang").isin(names[i : i + block])).toArrow(), total) for i in range(0, len(names), block)]
    remove(docs.sparkSession, counted)
    return models


def identify(docs: DataFrame, models: list[Model], keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep, lang_pred and score (the posterior of lang_pred). Null texts, texts without a letter, and all texts
    if there was nothing to learn from: `und` with score 0. Ties go to the language that sorts first; equal texts score alike,
    repeated rows stay."""
    shared = [docs.sparkSession.sparkContext.broadcast(m) for m in models]
    return map_texts(docs, keep, text, "lang_pred string, score double", lambda: lambda texts: predict([b.value for b in shared], [t.decode() if t is not None else None for t in texts]))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    found = identify(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")
