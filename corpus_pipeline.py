"""A corpus pipeline of five stages: documents in, token digests of clean documents out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each result as Parquet into
the shared checkpoint folder and reads it again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import alike, bpe, decontaminate, secrets, toxicity
from orrery.llm.common import shared_folder, table
from orrery.llm.langid import held_out


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled documents that aren't held out, and drops every document that scores 0.5 or more.

    Null and empty texts score as texts without words, equal texts alike; repeated rows stay or go together. Without labelled rows of both
    kinds, or without rows, nothing goes.
    """
    model = toxicity.train(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.remove_toxic(docs, model)


def one_of_near_duplicates_stays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row of the smallest doc_id stays. Texts whose sets of 5-word shingles have a Jaccard similarity of
    0.8 or more are linked, each link decided by the two whole texts. Null and wordless texts are alike to each other only; a null doc_id
    is the smallest; of rows equal in every column one stays, of other ties that of the smaller row hash. No rows give none."""
    return alike.deduplicate(docs, k=5)


def contaminated_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth of the words or more stands in 13-word windows of the benchmark. Null and wordless texts, and
    repeated rows of clean texts, stay; without benchmark items, or without rows, nothing goes."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_are_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces what the secret scan finds; no document goes, repeated rows stay. n_chars follows the text; null and empty texts stay as they are."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def texts_are_encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of the text's ids, and the digest of what they decode to. Null is encoded as the empty text; each row, repeated
    ones too, gives one. Other columns, whatever their names, don't matter."""
    return bpe.digests(bpe.encode(docs, ["doc_id"], bpe.default_path()))


STAGES = [
    ("toxicity", toxic_documents_go),
    ("simhash_near_dedup", one_of_near_duplicates_stays),
    ("decontamination", contaminated_documents_go),
    ("secret_scan", secrets_are_masked),
    ("bpe", texts_are_encoded),
]

#: A trained classifier and byte-level BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
