"""The pipeline's stages on a small table, each held against a plain version on its own input."""

import hashlib

import corpus_pipeline
import pytest
from orrery.llm import bpe, toxicity
from pyspark.sql import functions as F

from test_alike import kept
from test_llm import contaminated

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    more = docs.limit(5).withColumn("doc_id", F.col("doc_id") + 10_000).unionByName(docs.limit(3))
    docs = docs.unionByName(more).unionByName(spark.createDataFrame([(None, None, None, None, None), (20_000, "", "en", "s", 0)], docs.schema))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        result = stage(spark, docs, SF)
        if i < 4:
            assert result.columns == docs.columns
        result.write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_toxic_documents_go(spark, stages):
    before, after = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    from orrery.llm.langid import held_out

    model = toxicity.train(before.where(~held_out()), labels.where(~held_out()))
    kept = [r for r in before.collect() if model.score([r.text.encode() if r.text is not None else None])[0] < 0.5]
    assert sorted(map(str, kept)) == sorted(map(str, after.collect()))


def test_one_of_each_group_stays(stages):
    """Against all pairs of whole texts: the smallest id of each component over 5-word shingles alike to 0.8 or more; of equal rows one."""
    before, after = (x.collect() for x in stages[1])
    ids = kept([(-1 if r.doc_id is None else r.doc_id, r.text) for r in before])
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in after) == ids and set(map(str, after)) <= set(map(str, before))


def test_contaminated_documents_go(spark, stages):
    before, after = (x.collect() for x in stages[2])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = [r[-1] for r in contaminated([(r.doc_id, r.text) for r in before], items)]
    assert sorted(map(str, after)) == sorted(str(r) for r, b in zip(before, bad) if not b)


def test_secrets_are_masked(spark, stages):
    from orrery.llm import secrets

    before, after = ({r.doc_id: r for r in x.collect()} for x in stages[3])
    found = {r.doc_id: r.found for r in secrets.scan(stages[3][0]).collect()}
    assert before.keys() == after.keys()
    for i, r in before.items():
        text, out, at = r.text, "", 0
        for x in found[i]:
            if x.start >= at:
                out += text[at : x.start] + "[SECRET]"
            at = max(at, x.end)
        assert after[i].text == (None if text is None else out + text[at:])


def test_texts_are_encoded(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    texts = {r.doc_id: r.text or "" for r in stages[4][0].collect()}
    rows = stages[4][1].collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
