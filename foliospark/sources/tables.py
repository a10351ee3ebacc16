"""Column-pruned reads of the extracted-document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Distinct rows of the named columns (all columns if none is named; maps can't be compared, so those stay as they are)."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols).distinct() if cols else df


def latest(spark: SparkSession, sf_dir: str, name: str, key: str, *cols: str) -> DataFrame:
    """The last ingested record of each non-null key; of equal times the greatest row counts."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").where(F.col(key).isNotNull())
    rest = [c for c in cols if c != key]
    pick = F.max_by(F.struct(*rest), F.struct("ingested_at", *rest)).alias("r")
    return df.groupBy(key).agg(pick).select(key, "r.*")
