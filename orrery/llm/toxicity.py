"""Toxicity: a convolutional text classifier, trained in numpy.

Words are hashed to 32 bits, and hashes to rows of embeddings: those of fewer than LEAST fitted texts have none and say nothing, as
a maximum over a long text would meet every collision in a small table. Filters of several widths run over the whole text, the
maximum of each goes into a logistic output. It is fitted on a sample of the labelled rows and calibrated on all others: each language has the threshold of
the fewest errors. The language of a text is estimated from its words, so that nothing but the text enters a score.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table
from .decontaminate import words
from .langid import held_out

#: Bounds of the labelled sample that is fitted: rows of each label, and characters of its texts together.
POSITIVE, NEGATIVE, CHARACTERS = 3000, 5000, 48_000_000
WIDTHS, FILTERS, DIM, LEAST = (1, 2, 3), 8, 8, 3
PAD = max(WIDTHS)
BLOCK = 1 << 16
#: Steps of a score in which errors are counted for calibration.
STEP, LIMIT = 0.02, 30


def hashes(text: bytes | None) -> np.ndarray:
    """The hash of each word."""
    found = words(text)
    return np.fromiter(map(zlib.crc32, found), np.uint32, len(found))


class Model:
    """Scores texts; fit() trains it. Before that, or without both labels, every score is 0."""

    def __init__(self, seed: int = 11) -> None:
        self.random = np.random.default_rng(seed)
        self.hashes = np.zeros(0, np.uint32)
        self.languages: list[str] = []
        self.fitted = False

    def ids(self, hashed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the words of all texts, PAD zeros after each; where texts start and how many words they have."""
        n = np.array([len(t) for t in hashed], np.int64)
        starts = np.cumsum(n + PAD) - n - PAD
        flat = np.zeros(int((n + PAD).sum()) + PAD, np.int64)
        for t, s in zip(hashed, starts.tolist()):
            flat[s : s + len(t)] = self.rows(t)
        return flat, starts, n

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, 0 for those that have none."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0)

    def convolve(self, x: np.ndarray) -> list[np.ndarray]:
        m = len(x) - PAD
        return [sum(x[j : j + m] @ w[j] for j in range(len(w))) for w in self.filters]

    def features(self, flat: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The maximum of each filter over each text, 0 at least; block by block."""
        out = np.zeros((len(starts), len(WIDTHS) * FILTERS), np.float32)
        ends = starts + n + 1  # a text's last window is all padding
        for a in range(0, len(flat) - PAD, BLOCK):
            b = min(a + BLOCK, len(flat) - PAD)
            y = np.concatenate(self.convolve(self.embedding[flat[a : b + PAD]]), 1)
            own = np.flatnonzero((starts < b) & (ends > a))
            if not len(own):
                continue
            lo, hi = np.maximum(starts[own], a) - a, np.minimum(ends[own], b) - a
            bounds = np.stack([lo, hi], 1).ravel()
            y = np.append(y, np.zeros((1, y.shape[1]), y.dtype), 0)
            out[own] = np.maximum(out[own], np.maximum.reduceat(y, bounds, axis=0)[::2])
        return out

    def language(self, flat: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The index of each text's language, by its words."""
        sums = [np.add.reduceat(column[flat], starts, dtype=np.float64) for column in self.language_logs]
        return np.argmax(np.stack(sums, 1), 1)

    def logits(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        flat, starts, n = self.ids([hashes(t) for t in texts])
        return self.features(flat, starts, n) @ self.out + self.bias, self.language(flat, starts, n)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if not self.fitted or not texts:
            return np.zeros(len(texts))
        z, language = self.logits(texts)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64) - self.threshold[language], -30, 30)))

    def fit(self, texts: list[bytes], toxic: list[int], langs: list[str | None], epochs: int = 4, least_rows: int = 12_000, batch: int = 32, rate: float = 0.05) -> Model:
        """A small sample is passed over more often, until least_rows rows have been seen. Thresholds stay at 0 until calibrate()."""
        return self.fit_hashed([hashes(t) for t in texts], toxic, langs, epochs, least_rows, batch, rate)

    def fit_hashed(self, hashed: list[np.ndarray], toxic: list[int], langs: list[str | None], epochs: int = 4, least_rows: int = 12_000, batch: int = 32, rate: float = 0.05) -> Model:
        """As fit(), of the texts' hashes()."""
        y = np.array(toxic)
        if not 0 < y.sum() < len(y):
            return self
        found, times = np.unique(np.concatenate([np.unique(t) for t in hashed]), return_counts=True)
        self.hashes = found[times >= LEAST]
        size = 1 + len(self.hashes)
        self.embedding = (self.random.standard_normal((size, DIM)) * 0.1).astype(np.float32)
        self.embedding[0] = 0
        self.filters = [(self.random.standard_normal((w, DIM, FILTERS)) * 0.2).astype(np.float32) for w in WIDTHS]
        self.out, self.bias = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), np.float32(-1)

        tokens = [(flat.astype(np.int32), starts, n) for flat, starts, n in (self.ids([t]) for t in hashed)]
        self.languages = sorted({x for x in langs if x is not None}) or [""]
        logs, seen = np.full((len(self.languages), size), 0.5), np.zeros((2, size))
        for (flat, _, (n,)), x, label in zip(tokens, langs, toxic):
            own = np.unique(flat[:n])
            seen[label, own] += 1
            if x is not None:
                logs[self.languages.index(x), own] += 1
        logs[:, 0] = 0
        logs /= np.maximum(logs.sum(1, keepdims=True), 1)
        logs[:, 0] = 1  # padding and words without a row say nothing
        self.language_logs = np.log(logs).astype(np.float32)
        self.threshold = np.zeros(len(self.languages))
        # Training starts where hashes' texts differ by label: their first dimension at the log-odds, shrunk where texts are few, and the
        # filters' first tap on it. From noise alone maxima show each text few words to learn from (README has the figures).
        odds = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / (len(y) - y.sum() + 1))
        self.embedding[1:, 0] = (odds * seen.sum(0) / (seen.sum(0) + 20))[1:]
        for w in self.filters:
            w[0, 0] = np.abs(w[0, 0]) + 0.3

        learn = np.arange(len(y))
        speed = [np.full(a.shape, 1e-3, np.float32) for a in (self.embedding, *self.filters, self.out)]
        balance = max(1.0, (len(y) - y.sum()) / y.sum())

        def step(which: int, array: np.ndarray, slope: np.ndarray, at=slice(None)) -> None:
            speed[which][at] += slope * slope
            array[at] -= rate * slope / np.sqrt(speed[which][at])

        for _ in range(max(epochs, least_rows // len(y))):
            for part in np.array_split(self.random.permutation(learn), max(1, len(learn) // batch)):
                slopes = [np.zeros_like(w) for w in self.filters]
                d_out, d_bias, rows, d_rows = np.zeros_like(self.out), 0.0, [], []
                for i in part:
                    flat, _, (n,) = tokens[i]
                    x = self.embedding[flat]
                    tops, best = [], []
                    for conv in self.convolve(x):
                        best.append(np.argmax(conv[: n + 1], 0))
                        tops.append(conv[best[-1], np.arange(FILTERS)])
                    f = np.maximum(np.concatenate(tops), 0)
                    p = 1 / (1 + np.exp(-np.clip(f @ self.out + self.bias, -30, 30)))
                    d = (p - y[i]) * (balance if y[i] else 1.0) / len(part)
                    df_ = np.where(f > 0, d * self.out, 0).reshape(len(WIDTHS), FILTERS)
                    d_out += d * f
                    d_bias += d
                    for k, w in enumerate(WIDTHS):
                        for j in range(w):
                            at = best[k] + j
                            slopes[k][j] += (x[at] * df_[k][:, None]).T
                            rows.append(flat[at])
                            d_rows.append(self.filters[k][j].T * df_[k][:, None])
                for k, w in enumerate(self.filters):
                    step(1 + k, w, slopes[k] + 1e-4 * w)
                step(len(speed) - 1, self.out, d_out + 1e-4 * self.out)
                self.bias -= np.float32(rate * d_bias)
                which, place = np.unique(np.concatenate(rows), return_inverse=True)
                total = np.zeros((len(which), DIM), np.float32)
                np.add.at(total, place, np.concatenate(d_rows))
                step(0, self.embedding, total + 1e-4 * self.embedding[which], which)
                self.embedding[0] = 0
        self.fitted = True
        return self

    def calibrate(self, judged: list[tuple[int, int, int, float]], least: int = 20) -> None:
        """judged: (language, step, label, weight) summed over rows that training didn't see. For each language the threshold of the
        fewest errors; that of all rows together where fewer than least toxic ones are judged."""
        if not judged:
            return
        language, step, label, weight = (np.array(c) for c in zip(*judged))

        def cut(own: np.ndarray) -> float | None:
            steps = np.arange(step.min(), step.max() + 2)
            toxic, fine = (np.bincount(step[own & (label == k)] - steps[0], weight[own & (label == k)], len(steps)) for k in (1, 0))
            if not toxic.any() or not fine.any():
                return None
            errors = np.cumsum(toxic) - toxic + np.cumsum(fine[::-1])[::-1]  # of a threshold below each step
            at = np.flatnonzero(errors <= errors.min() * (1 + 1e-9))
            # Of the first run of best places the middle: as far from either label as can be.
            run = at[: int(np.flatnonzero(np.append(np.diff(at) > 1, True))[0]) + 1]
            return float(steps[run[len(run) // 2]] * STEP)

        common = cut(np.ones(len(step), bool))
        for l in range(len(self.languages)):
            own = language == l
            found = cut(own) if weight[own & (label == 1)].sum() >= least else None
            self.threshold[l] = found if found is not None else common if common is not None else 0.0


def known_labels(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """(__id, toxic): of a document's several labels the largest; nulls are left out."""
    return labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("__id")).agg(F.max(F.col(f"`{label}`")).cast("int").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", positive: int = POSITIVE, negative: int = NEGATIVE, characters: int = CHARACTERS) -> Model:
    """A model fitted on at most about positive and negative rows of each label, and about so many characters of text, chosen by a
    hash of the id and whatever their length; calibrated on all other labelled rows, or on a fifth where the sample could take all.

    Rows whose text is null don't teach. A doc_id that is repeated with the same text counts once.
    """
    known = known_labels(labels, doc_id, label).withColumn("lot", F.pmod(F.xxhash64("__id", F.lit("sample")), F.lit(1 << 30)) / (1 << 30))
    rows = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").cast("binary").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where("text IS NOT NULL")
    # Ids, lengths, labels and scores are joined; texts never move but for the sample's, whose ids are bounded by its parameters.
    sizes = {r.toxic: (r.n, r.size) for r in rows.select("__id", F.length("text").alias("size")).join(known, "__id").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    share = {k: min(0.8, most / max(sizes.get(k, (0, 0))[0], 1)) for k, most in ((1, positive), (0, negative))}
    asked = sum(share[k] * sizes[k][1] for k in (0, 1) if k in sizes)
    share = {k: x * min(1.0, characters / max(asked, 1)) for k, x in share.items()}
    chosen = F.col("lot") < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    # One row for each id and text, so that repeated rows can't fill the sample.
    got = rows.join(F.broadcast(known.where(chosen)), "__id").groupBy("__id", F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"), F.min("lang").alias("lang"))
    # Words are hashed where the texts are: the driver gets 4 bytes for each.
    got = map_texts(got, ["__id", "key", "toxic", "lang"], "text", "hashed binary", lambda: lambda texts: ([hashes(t).tobytes() for t in texts],))
    got = got.toArrow().sort_by([("__id", "ascending"), ("key", "ascending")])
    hashed = [np.frombuffer(x.as_buffer(), np.uint32) for x in got.column("hashed")]
    model = Model().fit_hashed(hashed, got.column("toxic").to_pylist(), got.column("lang").to_pylist())
    del got, hashed
    pa.default_memory_pool().release_unused()
    if model.fitted:
        judged = judge(rows, model).join(known.where(~chosen), "__id")
        weight = F.when(F.col("toxic") == 1, 1 / (1 - share[1])).otherwise(1 / (1 - share[0]))
        counts = judged.groupBy("language", "step", "toxic").agg(F.sum(weight).alias("weight"))
        model.calibrate([tuple(r) for r in counts.collect()])
    return model


def judge(rows: DataFrame, model: Model) -> DataFrame:
    """__id, and the estimated language and the step of the score of each row, by the model as it is before calibration."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts):
            z, language = shared.value.logits(texts) if texts else (np.zeros(0), np.zeros(0, int))
            return language, np.floor(np.clip(z, -LIMIT, LIMIT) / STEP).astype(int)

        return work

    return map_texts(rows, ["__id"], "text", "language int, step int", make)


def classify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep and score (0 to 1) of the whole text; null and empty texts are scored as texts without words. Equal texts score
    alike, repeated rows stay; without labelled rows of both kinds every score is 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, keep, text, "score double", lambda: lambda texts: (shared.value.score(texts),))


def remove_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without those that score threshold or more; columns, whatever their names, and other rows stay as they are."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    scored = classify(docs.toDF(*names), model, names, names[docs.columns.index(text)])
    return scored.where(F.col("score") < threshold).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    found = classify(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
