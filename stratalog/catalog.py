"""All queries of the library, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.sources.lines import chunk_id, lines_of

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its function's name."""

    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))


def chunked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with chunk_id, by which all windows over them are partitioned, and ts in microseconds."""
    df = table(spark, sf_dir, "events")
    return df.withColumn("chunk_id", chunk_id(F.col("event_id"))).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


#: SQL of the same, to put before a query.
LINES = """WITH lines AS (
  SELECT doc_id::VARCHAR AS stream_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no, unnest(string_split(text, chr(10))) AS line
  FROM documents)
"""
EVENTS = """WITH e AS (SELECT *, CASE WHEN event_id < 1000 THEN 0 ELSE 1 + (event_id - 1000) // 10000 END AS chunk_id, epoch_us(ts) AS us FROM events)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from stratalog.plans import column_queries, encoding_queries, line_queries, report_queries, template_queries, value_queries  # noqa: F401
