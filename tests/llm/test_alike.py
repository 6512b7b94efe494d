"""Near-duplicate removal against brute-force Jaccard similarity."""

import random

import corpus_pipeline
import pytest
from orrery.llm import alike

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def kept(rows):
    """The smallest doc_id of each component over pairs of 4/5 or more, by comparing all of them."""
    sets = {}
    for i, text in rows:
        sets.setdefault(shingles(text), []).append(i)
    low, left, out = {s: min(ids) for s, ids in sets.items()}, set(sets), []
    while left:
        todo, seen = [left.pop()], []
        while todo:
            a = todo.pop()
            seen.append(low[a])
            near = {b for b in left if a and b and 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)}
            left -= near
            todo += near
        out.append(min(seen))
    return sorted(out)


def edited(words, share, rng):
    """A copy of words with changed words so that its similarity lies about share."""
    n, out = len(words), list(words)
    for at in rng.sample(range(n), max(1, round(n * (1 - share) / (1 + share) / 5))):
        out[at] = f"x{rng.random()}"
    return out


def corpus(n=150, seed=4):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 60, 120, 400]))]
        rows += [" ".join(words)] + [" ".join(edited(words, s, rng)) for s in (0.72, 0.8, 0.83, 0.9)]
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows += [" ".join(edited(base, 0.88, rng)) for _ in range(120)]  # one dense group on both sides of the bound
    return list(enumerate([*rows, None, "", " \n", "a b", "A  b"]))


@pytest.mark.parametrize("shard_limit, crowded", [(alike.SHARD_LIMIT, alike.CROWDED), (3000, 20)])
def test_stays_what_brute_force_keeps(spark, shard_limit, crowded):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = sorted(r.doc_id for r in alike.deduplicate(docs, shard_limit=shard_limit, crowded=crowded).collect())
    assert got == kept(rows)


def test_stage_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.one_of_near_duplicates_stays(spark, docs, "").select("doc_id").collect())
    assert got == kept([(r.doc_id, r.text) for r in docs.collect()])
