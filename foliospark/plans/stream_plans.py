"""Event-time windows as a batch query: the same plan that streaming.ingest runs on a stream."""

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from ..streaming import ingest

SQL = {"str5_windows": "SELECT date_trunc('day', ingested_at) AS start, route, count(*) AS pages, sum(coalesce(length(markdown), 0)) AS chars FROM (SELECT DISTINCT out_id, ingested_at, route, markdown FROM page_outcomes) GROUP BY 1, 2"}


def str5_windows(spark: SparkSession, d: str) -> DataFrame:
    """Pages and text by day and route."""
    return ingest.windows(table(spark, d, "page_outcomes", "out_id", "ingested_at", "route", "markdown"), "1 day", "route")


QUERIES = {"str5_windows": str5_windows}
