"""Shared plumbing of the training-data operators: column-pruned reads, Arrow maps, durable cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship

TOKENIZER_DIR = "/opt/tokenizers"


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named table, only the named columns (the scan reads no others)."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for Python work on small inputs.

    Only a scan of fewer partitions than cores is dealt out anew, so what moves is below cores x maxPartitionBytes
    whatever the table's size; larger scans pass untouched."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= want else df.repartition(want)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, Iterable]], schema: str) -> DataFrame:
    """mapInArrow with a function from one batch to columns named as in schema (a DDL string)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = fn(b)
            yield pa.RecordBatch.from_arrays([v if isinstance(v := got[f.name], pa.Array) else pa.array(v, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def durable(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint in the folder the cluster names in spark.checkpoint.dir.

    Where none is named, a single machine (tests) gets a folder of its own; a cluster gets an error."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"foliospark-checkpoint-{uuid.uuid4().hex}"))
    return df.checkpoint(eager=True)


def hashed_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, spread over all rows by the hash of the key and the same whatever the layout."""
    return df.orderBy(F.xxhash64(key), key).limit(most)


def not_blank(col: str):
    """True where the text holds a character that isn't white space (Unicode white space, as Python's str.strip)."""
    return F.col(col).rlike(r"[^\s\u0085   -     　\u001c-\u001f]")
