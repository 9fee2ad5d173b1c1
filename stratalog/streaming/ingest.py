"""Incremental ingestion with Structured Streaming.

Files of lines come in micro-batches; each batch is encoded with the batch operators and appended to
Parquet, and templates seen before are recognised by an anti-join with the template table. Chunk
sizes and raw fallback follow the ratios of the chunks before in keyed state, one key a stream, so
parallelism is the number of streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators import parse, templates

LINES = "stream_id string, line_no long, line string"


def read_lines(spark: SparkSession, path: str, schema: str = LINES, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_templates(lines: DataFrame, path: str, checkpoint: str):
    """Starts a query that encodes each batch (mined by stream and batch) under path: rows and
    templates, the latter only if their text is new. availableNow: it stops when all is read."""
    spark = lines.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        chunk = df.withColumn("chunk_id", F.lit(number).cast("long"))
        rows, found = templates.encode_text(chunk, ["stream_id", "chunk_id"])
        found = found.withColumn("template_id", F.md5(F.encode("template", "UTF-8")))  # 128 bits, as batches look templates up by it
        out = f"{path}/rows/batch={number}"
        rows.join(found.select("stream_id", "chunk_id", "cluster", "template_id"), ["stream_id", "chunk_id", "cluster"], "left").write.mode("overwrite").parquet(out)
        new = found.select("template_id", "template", "n_variables").distinct()
        try:
            seen = spark.read.parquet(f"{path}/templates/*").select("template_id")
            new = new.join(seen, "template_id", "left_anti")
        except Exception as error:  # noqa: BLE001  no batch has written templates yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
        new.write.mode("overwrite").parquet(f"{path}/templates/batch={number}")

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The lines that write_templates has written."""
    rows = spark.read.parquet(f"{path}/rows/*")
    known = spark.read.parquet(f"{path}/templates/*").select("template_id", "template").distinct()
    joined = rows.join(known, "template_id", "left")
    return joined.select("stream_id", "line_no", templates.restore_line(F.col("template"), F.col("variables"), F.col("gaps"), F.col("raw")).alias("line"))


def format_counts(lines: DataFrame) -> DataFrame:
    """Running counts of JSON and text lines a stream."""
    return lines.groupBy("stream_id", parse.line_format(F.col("line")).alias("format")).agg(F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"))


def chunk_sizes(ratios: DataFrame, initial: int = 1000, usual: int = 10_000, poor: float = 1.1, retry: int = 10) -> DataFrame:
    """Next chunk sizes and raw fallback from a stream of (stream_id, chunk_id, ratio): the mean of the
    last three ratios moves the size, three poor ones in a row call for raw chunks, and after `retry`
    of those encoding is tried again."""
    out = "stream_id string, chunk_id long, next_size long, use_raw boolean"
    state = "size double, seen array<double>, raw_left int"

    def step(key, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        size, seen, raw_left = (float(initial), [], 0) if not held.exists else (held.get[0], list(held.get[1]), held.get[2])
        rows = pd.concat(list(batches)).sort_values("chunk_id")
        result = []
        for chunk, ratio in zip(rows["chunk_id"], rows["ratio"]):
            seen = [*seen, float(ratio)][-3:]
            mean = sum(seen) / len(seen)
            if len(seen) >= 2:
                if mean < 0.10:
                    size = min(50_000.0, float(int(size * 1.5)))
                elif mean > 0.30:
                    size = max(500.0, float(int(size * 0.75)))
                else:
                    size = float(int(0.9 * size + 0.1 * usual))
            raw_left = raw_left - 1 if raw_left else retry if len(seen) == 3 and min(seen) > poor else 0
            result.append((key[0], int(chunk), int(size), raw_left > 0))
        held.update((size, seen, raw_left))
        yield pd.DataFrame(result, columns=["stream_id", "chunk_id", "next_size", "use_raw"])

    return ratios.groupBy("stream_id").applyInPandasWithState(step, out, state, "append", "NoTimeout")


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """An extension: counts a window of event time, with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
