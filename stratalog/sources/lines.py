"""Lines: reading text as an ordered line table, chunks of lines, and writing them back.

A line table has stream_id, line_no (0-based within its stream) and line. Everything that depends on
order partitions by stream_id and chunk_id, so no window ever spans a whole table."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.functions.bits import let

FIRST_CHUNK, CHUNK = 1000, 10_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every byte of every file under path as lines (Latin-1 view, one character a byte), with stream_id
    (the file) and line_no. Files of any size, by Spark's splittable text reader. line_no comes from the
    offsets of the splits: one pass counts lines per split, a second numbers them, with the counts (one
    row a split) in between. Empty files have no lines; read_streams has them."""
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("stream_id"), F.col("_metadata.file_block_start").alias("_block"), F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line")
    )
    return _numbered(rows)


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    """stream_id, n_bytes, n_lines and final_newline of every file under path, empty ones too. The text
    reader takes line ends off, so the file's length tells whether the last line had one."""
    found = spark.read.format("binaryFile").load(path)
    # Scans skip empty files, so the names come from the listing, which the driver has; it prints file:/x as file:///x.
    names = spark.createDataFrame([(re.sub("^(\\w+):///", r"\1:/", f),) for f in found.inputFiles()], "stream_id string")
    files = names.join(found.select(F.col("_metadata.file_path").alias("stream_id"), F.col("length").alias("n_bytes")), "stream_id", "left").na.fill(0, ["n_bytes"])
    held = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("stream_id"), F.octet_length("value").alias("n"))
    held = held.groupBy("stream_id").agg(F.count("*").alias("n_lines"), F.sum(F.col("n") + 1).alias("_ended"))
    out = files.join(held, "stream_id", "left")
    return out.select("stream_id", "n_bytes", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), (F.coalesce("_ended", F.lit(-1)) == F.col("n_bytes")).alias("final_newline"))


def read_large_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of UTF-8 text with \\n ends, numbered like read_lines'."""
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("stream_id"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("line")
    )
    return _numbered(rows)


def _numbered(rows: DataFrame) -> DataFrame:
    """stream_id, _block, line with line_no from the lines' places in their splits."""
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    firsts = rows.groupBy("stream_id", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("stream_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = firsts.select("stream_id", "_block", "_first", before.alias("_before"))
    return rows.join(starts, ["stream_id", "_block"]).select("stream_id", (F.col("_before") + F.col("_at") - F.col("_first")).alias("line_no"), "line")


def lines_of(df: DataFrame, stream_id: Column, text: Column) -> DataFrame:
    """A line table from a text column; one stream a row."""
    return df.select(stream_id.cast("string").alias("stream_id"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("long")
    )


def lines_from(spark: SparkSession, lines: Iterable[str], stream_id: str = "memory", batch: int = 100_000, path: str | None = None) -> DataFrame:
    """A line table of any iterable of texts. Up to batch lines come from the driver's memory; more are
    written in batches under path, so that the driver holds one batch at a time."""
    schema, lines, at = "stream_id string, line_no long, line string", iter(lines), 0
    while True:
        own = [(stream_id, at + k, x) for k, x in enumerate(islice(lines, batch))]
        if path is None or (at == 0 and len(own) < batch):
            rest = next(lines, None)
            if rest is not None:
                raise ValueError("more lines than a batch need a path to be written to")
            return spark.createDataFrame(own, schema)
        if own:
            spark.createDataFrame(own, schema).coalesce(1).write.mode("overwrite" if at == 0 else "append").parquet(path)
        at += len(own)
        if len(own) < batch:
            return spark.read.schema(schema).parquet(path)


def chunk_id(line_no: Column, first: int = FIRST_CHUNK, size: int = CHUNK) -> Column:
    """A small first chunk, then chunks of one size."""
    return F.when(line_no < first, F.lit(0)).otherwise(1 + F.floor((line_no - first) / size)).cast("long")


def fixed_chunk_id(line_no: Column, size: int = CHUNK) -> Column:
    return F.floor(line_no / size).cast("long")


def with_chunks(lines: DataFrame, first: int = FIRST_CHUNK, size: int = CHUNK) -> DataFrame:
    return lines.withColumn("chunk_id", chunk_id(F.col("line_no"), first, size))


def adaptive_sizes(ratios: Column, initial: int = FIRST_CHUNK, usual: int = CHUNK, block: int = 256) -> Column:
    """The sizes of chunks 0, 1, 2 ... given the compression ratios of the chunks before, as the
    array after each: the mean of the last three ratios (two at least) below 0.10 grows the size by
    half up to 50000, above 0.30 shrinks it by a quarter down to 500, else it drifts to the usual.
    Ratios go by in blocks, so that arrays that grow stay small."""
    none = F.expr("cast(array() as array<double>)")

    def step(s: Column, ratio: Column) -> Column:
        seen = F.slice(F.concat(s["seen"], F.array(ratio.cast("double"))), -3, 3)
        seen = F.when(F.size(s["seen"]) >= 2, seen).otherwise(F.concat(s["seen"], F.array(ratio.cast("double"))))
        mean = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.size(seen)
        new = (
            F.when(F.size(seen) < 2, s["size"])
            .when(mean < 0.10, F.least(F.lit(50_000.0), F.floor(s["size"] * 1.5).cast("double")))
            .when(mean > 0.30, F.greatest(F.lit(500.0), F.floor(s["size"] * 0.75).cast("double")))
            .otherwise(F.floor(0.9 * s["size"] + 0.1 * usual).cast("double"))
        )
        return F.struct(new.alias("size"), seen.alias("seen"), F.concat(s["sizes"], F.array(new.cast("long"))).alias("sizes"))

    def over_block(s: Column, own: Column) -> Column:
        start = F.struct(s["size"].alias("size"), s["seen"].alias("seen"), F.expr("cast(array() as array<bigint>)").alias("sizes"))
        joined = lambda e: F.struct(e["size"].alias("size"), e["seen"].alias("seen"), F.concat(s["blocks"], F.array(e["sizes"])).alias("blocks"))
        return let(F.aggregate(own, start, step), joined)

    start = F.struct(F.lit(initial).cast("double").alias("size"), none.alias("seen"), F.array(F.array(F.lit(initial).cast("long"))).alias("blocks"))
    cut = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.size(r), F.lit(1)), F.lit(block)), lambda k: F.slice(r, k, block))
    return let(ratios, lambda r: F.aggregate(cut(r), start, over_block, lambda s: F.flatten(s["blocks"])))


def write_lines(lines: DataFrame, path: str, final_newline: bool = True) -> None:
    """One file a stream, in line order, under path/stream=...; text of Latin-1 views as its bytes."""
    rows = lines.repartition("stream_id").sortWithinPartitions("stream_id", "line_no")
    rows.select(F.encode("line", "ISO-8859-1").cast("string").alias("value"), "stream_id").write.partitionBy("stream_id").option("lineSep", "\n").text(path)


def write_fields(rows: DataFrame, path: str) -> None:
    """Each column as text files of its own, one value a line, in one pass over the rows."""
    long = rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns)).unpivot([], rows.columns, "field", "value")
    long.write.partitionBy("field").text(path)


def made_json_lines(spark: SparkSession, n: int = 100_000, partitions: int | None = None) -> DataFrame:
    """Synthetic service logs, one JSON object a line, the same for the same n."""
    draw = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k))
    pick = lambda salt, words: F.element_at(F.array(*map(F.lit, words)), (draw(salt, len(words)) + 1).cast("int"))
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    time = F.format_string(
        "2024-01-%02dT%02d:%02d:%02d.%03dZ", draw("d", 28) + 1, draw("h", 24), draw("m", 60), draw("s", 60), draw("ms", 1000)
    )
    service = pick("service", ["auth", "billing", "catalog", "gateway", "search"])
    action = pick("action", ["create", "read", "update", "delete", "list", "login", "logout"])
    line = F.format_string(
        '{"timestamp": "%s", "level": "%s", "service": "%s", "action": "%s", "request_id": "req-%08d", "user_id": "user-%04d", "duration_ms": %d, '
        '"message": "Processing request for endpoint /api/v1/%s/%d"}',
        time, pick("level", ["INFO", "WARN", "ERROR", "DEBUG"]), service, action, draw("r", 100_000_000), draw("u", 10_000), draw("t", 5000) + 1,
        pick("word", ["users", "orders", "items", "carts"]), draw("e", 10_000) + 1,
    )
    return rows.select(F.lit("json").alias("stream_id"), F.col("id").alias("line_no"), line.alias("line"))


def made_block_lines(spark: SparkSession, n: int = 100_000) -> DataFrame:
    """Synthetic storage logs with block numbers, some beyond 64 bits."""
    draw = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k))
    pick = lambda salt, words: F.element_at(F.array(*map(F.lit, words)), (draw(salt, len(words)) + 1).cast("int"))
    line = F.format_string(
        "%08d %06d %d %s dfs.%s: %s block blk_%s%d%09d from 10.%d.%d.%d:50010",
        F.lit(20081100) + draw("d", 28) + 1, draw("h", 235_959), draw("p", 30_000), pick("l", ["INFO", "WARN", "ERROR"]),
        pick("c", ["DataNode", "FSNamesystem", "DataXceiver"]), pick("a", ["Receiving", "Deleting", "Served"]), pick("s", ["", "-"]),
        draw("b1", 10_000_000_000), draw("b2", 1_000_000_000), draw("o1", 256), draw("o2", 256), draw("o3", 256),
    )
    return spark.range(n).select(F.lit("blocks").alias("stream_id"), F.col("id").alias("line_no"), line.alias("line"))
