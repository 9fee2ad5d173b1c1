"""Queries that choose between encodings, verify, and report."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.catalog import EVENTS, LINES, chunked_events, document_lines, query, table
from stratalog.functions.packing import zstd_decompress
from stratalog.operators import encoders, select
from stratalog.plans import codec
from stratalog.sources import lines as source


def made_sizes(spark, sf_dir):
    """Sizes of ten files by three methods, made from events."""
    rows = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("f"), (F.col("event_id") % 10).cast("string")).alias("file"))
    return rows.agg(
        F.sum(F.octet_length("props") + 1).alias("original"), F.count_distinct("props").alias("ours"), F.sum(F.col("user_id") % 7).alias("plain"),
        F.max("user_id").cast("long").alias("other"),
    )


SIZES = """WITH w AS (SELECT 'f' || event_id % 10 AS file, sum(strlen(props) + 1)::BIGINT AS original, count(DISTINCT props) AS ours, sum(user_id % 7)::BIGINT AS plain, max(user_id) AS other FROM events GROUP BY 1),
s AS (SELECT file, original, unnest(['ours', 'plain', 'other']) AS method, unnest([ours, plain, other]) AS bytes FROM w)
"""


@query(SIZES + "SELECT file, method, bytes FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY bytes, method) AS r FROM s) WHERE r = 1")
def benchmark_winner(spark, sf_dir):
    return select.smallest(select.long_sizes(made_sizes(spark, sf_dir), ["file", "original"], ["ours", "plain", "other"]), ["file"], lossless=None)


@query(SIZES + "SELECT method, sum(bytes) / sum(original) AS weighted_ratio, avg(bytes / original) AS mean_ratio, count(*) AS files FROM s GROUP BY 1")
def weighted_ratio(spark, sf_dir):
    return select.weighted_ratio(select.long_sizes(made_sizes(spark, sf_dir), ["file", "original"], ["ours", "plain", "other"]))


@query(SIZES + "SELECT method, file, sum(bytes)::BIGINT AS bytes, sum(original)::BIGINT AS original, sum(bytes) / sum(original) AS ratio FROM s GROUP BY GROUPING SETS ((method, file), (method))")
def sizes_with_total(spark, sf_dir):
    return select.with_total(select.long_sizes(made_sizes(spark, sf_dir), ["file", "original"], ["ours", "plain", "other"]))


@query(
    SIZES
    + """SELECT method, count(*) FILTER (WHERE d <= -0.0001) AS wins, count(*) FILTER (WHERE abs(d) < 0.0001) AS ties, count(*) FILTER (WHERE d >= 0.0001) AS losses
FROM (SELECT s.method, w.ours / w.original - s.bytes / w.original AS d FROM s JOIN w USING (file) WHERE s.method <> 'ours') GROUP BY 1"""
)
def win_tie_loss(spark, sf_dir):
    return select.win_tie_loss(made_sizes(spark, sf_dir), "ours", ["plain", "other"], "original")


CHUNKS = """WITH c AS (SELECT event_id // 2500 AS stream_id, event_id // 100 AS chunk_id, sum(strlen(event_type))::BIGINT AS encoded_bytes, sum(strlen(props))::BIGINT AS raw_bytes, count(*) AS n_lines FROM events GROUP BY ALL),
r AS (SELECT *, encoded_bytes / raw_bytes AS ratio FROM c)
"""


def chunk_facts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 2500).alias("stream_id"), F.floor(F.col("event_id") / 100).alias("chunk_id"))
    rows = rows.agg(F.sum(F.octet_length("event_type")).alias("encoded_bytes"), F.sum(F.octet_length("props")).alias("raw_bytes"), F.count("*").alias("n_lines"))
    return rows.withColumn("ratio", F.col("encoded_bytes") / F.col("raw_bytes"))


@query(
    CHUNKS
    + """SELECT stream_id, chunk_id, avg(ratio) OVER w AS mean_ratio, count(*) OVER w = 3 AND min(ratio) OVER w > 0.7 AS use_raw FROM r
WINDOW w AS (PARTITION BY stream_id ORDER BY chunk_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""
)
def ratio_windows(spark, sf_dir):
    return select.ratio_windows(chunk_facts(spark, sf_dir), ["stream_id"], "chunk_id", "ratio", poor=0.7).select("stream_id", "chunk_id", "mean_ratio", "use_raw")


@query(CHUNKS + "SELECT stream_id, sum(n_lines)::BIGINT AS n_lines, count(*) AS n_chunks, sum(raw_bytes)::BIGINT AS raw_bytes, sum(encoded_bytes)::BIGINT AS encoded_bytes, sum(encoded_bytes) / sum(raw_bytes) AS ratio FROM r GROUP BY 1")
def codec_statistics(spark, sf_dir):
    return select.statistics(chunk_facts(spark, sf_dir), ["stream_id"])


@query(
    """WITH RECURSIVE c AS (SELECT event_id // 2500 AS stream_id, row_number() OVER (PARTITION BY event_id // 2500 ORDER BY event_id // 100) AS k, sum(event_id % 100 * 7 % 100) / 10000.0 * (1 + event_id // 100 % 5) AS ratio
  FROM events GROUP BY event_id // 2500, event_id // 100),
t AS (SELECT stream_id, 0 AS k, 1000.0::DOUBLE AS size, NULL::DOUBLE AS a, NULL::DOUBLE AS b FROM (SELECT DISTINCT stream_id FROM c)
  UNION ALL SELECT t.stream_id, c.k, CASE WHEN t.b IS NULL THEN t.size WHEN m < 0.1 THEN least(50000.0, floor(t.size * 1.5)) WHEN m > 0.3 THEN greatest(500.0, floor(t.size * 0.75)) ELSE floor(0.9 * t.size + 1000) END, t.b, c.ratio
  FROM t JOIN (SELECT stream_id, k::INT AS k, ratio::DOUBLE AS ratio FROM c) c ON c.stream_id = t.stream_id AND c.k = t.k + 1,
  LATERAL (SELECT CASE WHEN t.a IS NULL THEN (t.b + c.ratio) / 2 ELSE (t.a + t.b + c.ratio) / 3 END AS m))
SELECT stream_id, k, size::BIGINT AS size FROM t"""
)
def adaptive_chunk_sizes(spark, sf_dir):
    at = F.floor(F.col("event_id") / 100)
    rows = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 2500).alias("stream_id"), at.alias("chunk_id"))
    rows = rows.agg(F.sum(F.col("event_id") % 100 * 7 % 100).alias("s"))
    rows = rows.withColumn("ratio", F.col("s") / 10000.0 * (1 + F.col("chunk_id") % 5))
    lists = rows.groupBy("stream_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "ratio"))), lambda x: x["ratio"]).alias("ratios"))
    return lists.select("stream_id", F.posexplode(source.adaptive_sizes(F.col("ratios"))).alias("k", "size"))


@query(LINES + "SELECT 's' || stream_id::BIGINT % 10 AS stream_id, count(*) AS n, 0 AS n_different, true AS lossless FROM lines GROUP BY 1")
def verify_roundtrip(spark, sf_dir):
    rows = document_streams(spark, sf_dir)
    return codec.verify(rows, codec.encode(rows, 0, 5_000_000)).select("stream_id", "n", "n_different", "lossless")


@query(EVENTS + "SELECT event_id, true AS same, CASE WHEN event_id % 10 = 0 THEN '[[\"k\"], ' || (props->>'$.k') || ']' END AS difference FROM e")
def json_semantic_verify(spark, sf_dir):
    props = F.col("props")
    spelled = F.concat(F.lit('{ "z":1, "k":'), F.get_json_object(props, "$.k"), F.lit("}"))
    swapped = F.concat(F.lit('{"k":  '), F.get_json_object(props, "$.k"), F.lit(', "z": 1}'))
    other = F.when(F.col("event_id") % 10 == 0, "{}").otherwise(props)
    rows = table(spark, sf_dir, "events")
    both = F.when(F.col("event_id") % 10 == 0, F.get(F.array_sort(F.filter(F.concat(F.array_except(select.json_leaves(props), select.json_leaves(other))), lambda x: x != "[[], {}]")), F.lit(0)))
    return rows.select("event_id", select.same_json(spelled, swapped).alias("same"), both.alias("difference"))


def document_streams(spark, sf_dir):
    """All documents' lines as ten streams, in the order of documents and lines."""
    rows = document_lines(spark, sf_dir).withColumn("doc", F.col("stream_id").cast("long"))
    return rows.select(F.concat(F.lit("s"), (F.col("doc") % 10).cast("string")).alias("stream_id"), (F.col("doc") * 100_000 + F.col("line_no")).alias("line_no"), "line")


STREAMS = LINES + """, d AS (SELECT 's' || stream_id::BIGINT % 10 AS stream_id, stream_id::BIGINT * 100000 + line_no AS line_no, line FROM lines)
"""


@query(STREAMS + "SELECT stream_id, unnest(['raw', 'zstd', 'columns']) AS method, unnest([sum(strlen(line) + 1)::BIGINT, NULL, NULL]) AS bytes, true AS lossless FROM d GROUP BY 1")
def method_sizes(spark, sf_dir):
    """Raw lines, zstd frames and typed columns of ten streams: each method decodes exactly. The bytes of
    the last two are in method_choice."""
    sizes = codec.candidate_sizes(document_streams(spark, sf_dir), encoders.kept_in(spark, scratch(spark, "methods")))
    return sizes.select("stream_id", "method", F.when(F.col("method") == "raw", F.col("bytes")).alias("bytes"), "lossless")


@query()
def method_choice(spark, sf_dir):
    """The smallest lossless method of ten streams, and its bytes against the raw ones'."""
    sizes = codec.candidate_sizes(document_streams(spark, sf_dir), encoders.kept_in(spark, scratch(spark, "methods")))
    raw = sizes.filter("method = 'raw'").select("stream_id", F.col("bytes").alias("raw_bytes"))
    return select.smallest(sizes, ["stream_id"]).join(raw, "stream_id").withColumn("ratio", F.col("bytes") / F.col("raw_bytes"))


@query(
    STREAMS
    + """, c AS (SELECT *, CASE WHEN line_no < 1000 THEN 0 ELSE 1 + (line_no - 1000) // 10000 END AS chunk_id FROM d)
SELECT stream_id, chunk_id, count(*) AS n_lines, min(line_no) AS first_line, CASE WHEN bool_and(json_valid(line) AND line LIKE '{%}') THEN 'JSON' WHEN NOT bool_or(json_valid(line) AND line LIKE '{%}') THEN 'TEXT' ELSE 'MIXED' END AS chunk_type,
  sum(strlen(line) + 1)::BIGINT - 1 AS raw_bytes, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS restored_sha256 FROM c GROUP BY ALL"""
)
def zstd_sizes(spark, sf_dir):
    """Chunks as zstd frames, and a digest of what the frames give back."""
    frames = codec.chunk_frames(document_streams(spark, sf_dir))
    return frames.select("stream_id", "chunk_id", "n_lines", "first_line", "chunk_type", F.col("raw_bytes").cast("long").alias("raw_bytes"), F.sha2(zstd_decompress(F.col("frame")), 256).alias("restored_sha256"))


@query(
    """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, session::BIGINT AS session, count(*) AS n, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended FROM n GROUP BY ALL"""
)
def sessionize(spark, sf_dir):
    """An extension: sessions of a user's events with gaps of 30 minutes at most."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("us", "event_id")
    rows = chunked_events(spark, sf_dir)
    rows = rows.withColumn("s", F.when(F.col("us") - F.lag("us").over(w) <= 1_800_000_000, 0).otherwise(1))
    rows = rows.withColumn("session", F.sum("s").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("us").alias("started"), F.max("us").alias("ended"))


def scratch(spark, name):
    """A new folder where driver and executors both write."""
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lines-')}"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(LINES + "SELECT count(*) AS n, count(DISTINCT line) AS n_distinct, sum(strlen(line))::BIGINT AS bytes FROM lines")
def file_roundtrip(spark, sf_dir):
    """All lines of all documents written as text files and read back by the splittable reader."""
    path = scratch(spark, "file-roundtrip")
    document_lines(spark, sf_dir).select(F.col("line").alias("value")).write.text(path)
    back = source.read_large_lines(spark, path)
    return back.agg(F.count("*").alias("n"), F.count_distinct("line").alias("n_distinct"), F.sum(F.octet_length("line")).alias("bytes"))


@query("SELECT event_type AS stream_id, count(*) AS n_lines, sum(strlen(props) + 1)::BIGINT AS n_bytes, true AS final_newline FROM events GROUP BY 1")
def stream_files(spark, sf_dir):
    """One folder of files a stream, with its lines, bytes and last line ends as they are on disk."""
    path = scratch(spark, "stream-files")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("stream_id"), F.col("event_id").alias("line_no"), F.col("props").alias("line"))
    source.write_lines(rows, path)
    files = source.read_streams(spark, f"{path}/*").withColumn("stream_id", F.regexp_extract("stream_id", "stream_id=([^/]*)/", 1))
    return files.filter("n_bytes > 0").groupBy("stream_id").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_bytes").alias("n_bytes"), F.min("final_newline").alias("final_newline"))


@query("SELECT unnest(['event_id', 'event_type', 'user_id']) AS field, count(*) AS n, unnest([count(DISTINCT event_id), count(DISTINCT event_type), count(DISTINCT user_id)]) AS n_distinct FROM events")
def field_files(spark, sf_dir):
    """Each column as text files of its own, read back by column."""
    path = scratch(spark, "field-files")
    source.write_fields(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), path)
    return spark.read.text(path).groupBy("field").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_distinct"))


@query("SELECT event_type AS name, count(*) AS n_lines, sum(strlen(props) + 1)::BIGINT AS n_bytes, CASE WHEN count(*) > 1000 THEN 1 + (count(*) + 8999) // 10000 ELSE 1 END AS n_chunks, true AS lossless FROM events GROUP BY 1")
def compressed_files(spark, sf_dir):
    """Files compressed to a folder and restored by chunk: their lines, bytes and chunks, and whether
    every line came back."""
    from stratalog.functions.bits import to_latin1

    path = scratch(spark, "compressed-files")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("stream_id"), F.col("event_id").alias("line_no"), F.col("props").alias("line"))
    source.write_lines(rows, f"{path}/in")
    codec.compress(spark, f"{path}/in/*", f"{path}/out")
    name = F.regexp_extract("stream_id", "stream_id=([^/]*)/", 1).alias("name")
    back = codec.decompress(spark, f"{path}/out").select(name, "chunk_id", "content")
    sizes = back.groupBy("name").agg(F.sum(F.octet_length("content")).alias("n_bytes"), F.count("*").alias("n_chunks"), F.sum(F.regexp_count(to_latin1(F.col("content")), F.lit("\n"))).alias("n_lines"))
    checked = codec.verify(source.read_lines(spark, f"{path}/in/*"), codec.load(spark, f"{path}/out")).select(name, "lossless")
    return sizes.join(checked, "name").select("name", "n_lines", "n_bytes", "n_chunks", "lossless")


@query("SELECT stream_id, count(*) AS n, count(DISTINCT line_no) AS n_distinct FROM (SELECT 'json' AS stream_id, unnest(generate_series(0, 99999)) AS line_no UNION ALL SELECT 'blocks', unnest(generate_series(0, 99999))) GROUP BY 1")
def generators(spark, sf_dir):
    """Synthetic logs at the generators' own size, and that all of them parse as what they are."""
    from stratalog.operators import parse

    made = source.made_json_lines(spark).filter(parse.is_json(F.col("line")))
    blocks = source.made_block_lines(spark).filter(parse.parse_block_log(F.col("line")).isNotNull())
    return made.unionByName(blocks).groupBy("stream_id").agg(F.count("*").alias("n"), F.count_distinct("line_no").alias("n_distinct"))
