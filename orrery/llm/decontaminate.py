"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over the token windows of the training texts.

The benchmark is read in blocks of at most block_words words, so that what is broadcast and what a worker holds at once
are bounded; a benchmark of any size becomes more blocks, all of which every document is held against in one scan.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

#: Upper-case A-Z become lower case; bytes that are no word characters become spaces. Bytes from 0x80 belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20


def words(text: bytes | None) -> list[bytes]:
    """Null has no words."""
    return text.translate(FOLD).split() if text else []


class Index:
    """Windows of a block of benchmark items: for each length, a filter and the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], n: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, tuple]] = {}
        for item, tokens in items:
            if not tokens:
                continue
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens], np.int32)
            k = min(n, len(ids))
            found = self.windows.setdefault(k, {})
            for i in range(len(ids) - k + 1):
                key = ids[i : i + k].tobytes()
                if item not in found.get(key, ()):
                    found[key] = (*found.get(key, ()), item)
        self.code = np.random.default_rng(7).integers(1, 1 << 63, len(self.vocabulary) + 1, dtype=np.uint64)
        self.maybe = {}
        for k, found in self.windows.items():
            bits = np.zeros(1 << FILTER_BITS, bool)
            for key in found:
                bits[int(self.hashes(np.frombuffer(key, np.int32), k)[0]) >> (64 - FILTER_BITS)] = True
            self.maybe[k] = bits

    def hashes(self, ids: np.ndarray, k: int) -> np.ndarray:
        code = self.code[ids]
        out = code[: len(ids) - k + 1].copy()
        for j in range(1, k):
            out *= MULTIPLIER
            out += code[j : len(ids) - k + 1 + j]
        return out * MULTIPLIER

    def occurrences(self, ids: np.ndarray):
        """(start, length, items) of each window that occurs in ids, verified word for word."""
        for k, found in self.windows.items():
            if len(ids) < k:
                continue
            for i in np.flatnonzero(self.maybe[k][(self.hashes(ids, k) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]).tolist():
                if (items := found.get(ids[i : i + k].tobytes())) is not None:
                    yield i, k, items


def index_blocks(spark: SparkSession, benchmark: DataFrame, n: int, item_id: str, text: str, block_words: int) -> list:
    """Broadcast blocks of the benchmark; the driver holds one of them at a time."""
    blocks, held, count = [], [], 0
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{text}`").cast("binary"))
    for item, body in rows.toLocalIterator():
        tokens = words(bytes(body) if body is not None else None)
        if held and count + len(tokens) > block_words:
            blocks.append(spark.sparkContext.broadcast(Index(held, n)))
            held, count = [], 0
        held.append((item, tokens))
        count += len(tokens)
    if held or not blocks:
        blocks.append(spark.sparkContext.broadcast(Index(held, n)))
    return blocks


def cut_spans(text: bytes, hit: np.ndarray) -> str:
    """text without its hit words and what stands between two hit words that follow each other."""
    out, last, before = [], 0, False
    for m, h in zip(WORD.finditer(text), hit.tolist()):
        if h:
            if not before:
                out.append(text[last : m.start()])
            last = m.end()
        before = h
    return b"".join([*out, text[last:]]).decode()


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], n: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text", share: int = 20, block_words: int = 200_000, clean: bool = False) -> DataFrame:
    """The columns keep, and for each document: n_words, n_hit (words inside an occurrence of a benchmark window of n words;
    a shorter item is one window), items (sorted ids of items with occurring windows), contaminated (n_hit > 0 and
    share * n_hit >= n_words), spans ("start-end" of hit words, end exclusive) and, with clean, clean_text (the hit spans cut out).

    Null or wordless texts have no words and are clean; wordless items have no windows; an item whose id is null still hits
    but isn't listed; repeated items count once; an empty benchmark leaves every document clean.
    """
    blocks = index_blocks(docs.sparkSession, benchmark, n, item_id, item_text, block_words)
    several = len(blocks) > 1

    def make():
        def work(texts):
            tokens = [words(t) for t in texts]
            counts = np.array([len(t) for t in tokens], np.int64)
            starts = np.concatenate([[0], np.cumsum(counts + 1)])
            hit = np.zeros(starts[-1] + 1, np.int32)  # +1 where a hit begins, -1 where it ends
            items: list[set] = [set() for _ in texts]
            for b in blocks:
                index = b.value
                get = index.vocabulary.get
                ids = np.zeros(starts[-1], np.int32)  # a 0 after each document keeps windows inside it
                for t, s in zip(tokens, starts.tolist()):
                    ids[s : s + len(t)] = np.fromiter(map(get, t, repeat(0)), np.int32, len(t))
                for i, k, found in index.occurrences(ids):
                    hit[i] += 1
                    hit[i + k] -= 1
                    items[int(np.searchsorted(starts, i, "right")) - 1].update(found)
                if several:
                    b.__dict__.pop("_value", None)  # one block in memory at a time
            covered = np.cumsum(hit) > 0
            n_hit, listed, spans, kept = [], [], [], []
            for j, (s, c) in enumerate(zip(starts.tolist(), counts.tolist())):
                own = covered[s : s + c]
                n_hit.append(int(own.sum()))
                listed.append(sorted(x for x in items[j] if x is not None))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).tolist() if n_hit[-1] else []
                spans.append([f"{a}-{b}" for a, b in zip(edges[::2], edges[1::2])])
                if clean:
                    kept.append(None if texts[j] is None else cut_spans(texts[j], own) if n_hit[-1] else texts[j].decode())
            flags = [h > 0 and share * h >= c for h, c in zip(n_hit, counts.tolist())]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]
            return (counts, n_hit, listed, digests, flags, spans, *([kept] if clean else []))

        return work

    return map_texts(docs, keep, text, "n_words long, n_hit long, items array<string>, items_sha256 string, contaminated boolean, spans array<string>" + ", clean_text string" * clean, make)


def decontaminate(docs: DataFrame, benchmark: DataFrame, spans: bool = False, **options) -> DataFrame:
    """docs without its contaminated documents; with spans, all documents, the hit spans cut out of contaminated ones.

    Options are those of scan(). Columns and other rows stay as they are.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(options.pop("text", "text"))]
    found = scan(docs.toDF(*names), benchmark, names, clean=spans, text=text, **options)
    if not spans:
        found = found.where(~F.col("contaminated"))
    else:
        found = found.withColumn(text, F.when(F.col("contaminated"), F.col("clean_text")).otherwise(F.col(text)))
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", "contaminated")


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = "regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS_SQL.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL.format("text")} AS w FROM benchmark),
win AS (SELECT item_id, least(13, len(w)) AS k, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT dw.doc_id, dw.i, dw.k, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.s = win.s),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN its USING (doc_id)
"""
