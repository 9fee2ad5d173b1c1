from pyspark.sql import functions as F

from stratalog.streaming import ingest


def test_templates_over_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("s", 0, "Error at line 123"), ("s", 1, "Error at line 456")], ingest.LINES).coalesce(1).write.parquet(source)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    ingest.write_templates(ingest.read_lines(spark, source), out, check).awaitTermination()
    spark.createDataFrame([("s", 2, "Error at line 789"), ("s", 3, "  new\t5")], ingest.LINES).coalesce(1).write.mode("append").parquet(source)
    ingest.write_templates(ingest.read_lines(spark, source), out, check).awaitTermination()
    lines = [r["line"] for r in ingest.restore(spark, out).orderBy("line_no").collect()]
    assert lines == ["Error at line 123", "Error at line 456", "Error at line 789", "  new\t5"]
    texts = [r["template"] for r in spark.read.parquet(f"{out}/templates/*").collect()]
    assert texts.count("Error at line <*>") == 1


def test_chunk_sizes(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("a", k, 0.05) for k in range(4)] + [("b", k, 1.2) for k in range(5)]
    schema = "stream_id string, chunk_id long, ratio double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    sizes = ingest.chunk_sizes(spark.readStream.schema(schema).parquet(source))
    q = sizes.writeStream.format("memory").queryName("sizes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["stream_id"], r["chunk_id"]): (r["next_size"], r["use_raw"]) for r in spark.table("sizes").collect()}
    assert [got["a", k][0] for k in range(4)] == [1000, 1500, 2250, 3375]
    assert [got["b", k] for k in range(5)] == [(1000, False), (750, False), (562, True), (500, True), (500, True)]


def test_running_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("s", 0, '{"a": 1}'), ("s", 1, "text"), ("s", 2, "text")], ingest.LINES).write.parquet(source)
    q = ingest.format_counts(ingest.read_lines(spark, source)).writeStream.format("memory").queryName("formats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["format"]: r["n"] for r in spark.table("formats").collect()} == {"JSON": 1, "TEXT": 2}
    assert spark.table("formats").select(F.sum("bytes")).first()[0] == 19
