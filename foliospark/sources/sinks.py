"""Writers: partitioned tables, JSON lines and versioned contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Contracts and their versions.
CONTRACTS = {"structure": "1.1", "chunk": "1.1", "semantic": "1.0", "provenance": "1.0"}


def tagged(df: DataFrame, contract: str) -> DataFrame:
    """df with the contract's name and version in each row."""
    return df.withColumns({"contract": F.lit(contract), "contract_version": F.lit(CONTRACTS[contract])})


def conform(df: DataFrame, schema: StructType, contract: str | None = None) -> DataFrame:
    """df in the columns of schema: unknown columns are dropped, absent ones null. A major version that isn't ours is an error."""
    if contract:
        major = CONTRACTS[contract].split(".")[0]
        ok = (F.col("contract") == contract) & (F.substring_index("contract_version", ".", 1) == major)
        df = df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a contract of ours: "), F.coalesce("contract", F.lit("null")), F.lit(" "), F.coalesce("contract_version", F.lit("null")))).cast("boolean")))
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def write_table(df: DataFrame, path: str, *by: str, mode: str = "error") -> None:
    """Parquet, in folders by the given columns; with mode `overwrite` only the folders that get rows are replaced."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_jsonl(df: DataFrame, path: str, *by: str, mode: str = "error") -> None:
    """JSON lines with keys in sorted order, fields that are null left out."""
    w = df.select(*by, *sorted(c for c in df.columns if c not in by)).write.mode(mode).option("ignoreNullFields", "true")
    (w.partitionBy(*by) if by else w).json(path)
