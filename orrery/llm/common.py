"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text bytes that a Python worker handles at once; one longer text is handled alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only where none is set and all runs on one machine (tests), a temporary one becomes it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="orrery-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: for tables of many narrow rows, a tenth of a checkpoint's size."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.folder = path  # for remove()
    return out


def remove(spark: SparkSession, what: DataFrame | str) -> None:
    """Deletes a folder of the shared checkpoint folder, or what written() put there. Nothing may read it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(what if isinstance(what, str) else what.folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def chunks(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of batch with about limit bytes of the given binary column each."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n + 64
    if start < len(lengths):
        yield batch.slice(start)


def kept_names(keep: list[str], results: list[str]) -> list[str]:
    """Names of the kept columns beside results: one that a result has too (in capitals or not) gets `_source` appended."""
    out: list[str] = []
    for c in keep:
        taken = {x.lower() for x in [*results, *out]}
        while c.lower() in taken:
            c += "_source"
        out.append(c)
    return out


def map_texts(df: DataFrame, keep: list[str], text: str, fields: str, make: Callable[[], Callable[[list], tuple]], limit: int = CHUNK_BYTES) -> DataFrame:
    """The columns keep (as kept_names() calls them) and those of fields (DDL), computed from the whole text of each row.

    make() is called once in each task and returns a function from a list of texts (UTF-8 bytes, None for null) to one
    sequence per field. Memory is bounded by limit and by the longest text, whatever the partition holds.
    """
    new = T._parse_datatype_string(fields)
    schema = T.StructType([T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)] + [T.StructField(f"r{i}", f.dataType) for i, f in enumerate(new.fields)])
    made, names = to_arrow_schema(new), schema.names
    n = len(keep)

    def run(batches):
        work = make()
        for batch in batches:
            for part in chunks(batch, n, limit):
                columns = work(part.column(n).to_pylist())
                arrays = [part.column(i) for i in range(n)] + [x if isinstance(x, pa.Array) else pa.array(x, made.field(i).type) for i, x in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    found = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(run, schema)
    return found.toDF(*kept_names(keep, new.names), *new.names)
