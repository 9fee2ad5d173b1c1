"""Queries over whole columns encoded by type, packed codes, and bit-level forms."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.catalog import EVENTS, LINES, chunked_events, document_lines, query, table
from stratalog.functions import bits, packing
from stratalog.operators import encoders, parse, select
from stratalog.operators import json_lines as j
from stratalog.plans import codec
from stratalog.plans.column_queries import CELLS, event_cells
from stratalog.plans.line_queries import MIXED, NESTED, known_lines, mixed_lines, nested_lines
from stratalog.plans.report_queries import scratch

KEYS = ["chunk_id", "column_id"]


def kept(spark):
    return encoders.kept_in(spark, scratch(spark, "columns"))


#: Types, encodings and costs of event_cells' columns, and every value's number.
ENCODED = (
    CELLS
    + """, typed AS (SELECT chunk_id, column_id, n_present, CASE WHEN n_present = 0 THEN 'RAW' WHEN n_prefix_id >= 0.9 * n_present AND p0 = p1 THEN 'PREFIX_ID' WHEN n_iso >= 0.9 * n_present THEN 'ISO'
  WHEN n_ipv4 >= 0.9 * n_present THEN 'IPV4' WHEN n_number >= 0.9 * n_present THEN 'NUMBER' WHEN n_path = n THEN 'PATH' WHEN n_distinct <= 256 THEN 'DICTIONARY' ELSE 'RAW' END AS column_type FROM prof),
num AS (SELECT c.*, column_type, CASE column_type WHEN 'PREFIX_ID' THEN regexp_extract(value, '-([0-9]+)$', 1)::BIGINT WHEN 'ISO' THEN epoch(try_strptime(value, '%Y-%m-%dT%H:%M:%SZ'))::BIGINT * 1000000000
  WHEN 'IPV4' THEN split_part(value, '.', 1)::BIGINT * 16777216 + split_part(value, '.', 2)::BIGINT * 65536 + split_part(value, '.', 3)::BIGINT * 256 + split_part(value, '.', 4)::BIGINT WHEN 'NUMBER' THEN value::BIGINT END AS v
  FROM cells c JOIN typed USING (chunk_id, column_id) WHERE value IS NOT NULL),
steps AS (SELECT *, lag(v) OVER (PARTITION BY chunk_id, column_id ORDER BY event_id) AS b FROM num),
cost AS (SELECT chunk_id, column_id, count(v) AS n, count(DISTINCT v) AS d, min(v) AS least, max(v)::HUGEINT - min(v) AS span, coalesce(avg(CASE WHEN v >= b THEN 1.0 WHEN b IS NOT NULL THEN 0.0 END), 1.0) AS up FROM steps WHERE v IS NOT NULL GROUP BY ALL),
bytes AS (SELECT *, CASE WHEN span < 256 THEN 1 WHEN span < 65536 THEN 2 WHEN span < 4294967296 THEN 4 ELSE 8 END AS w, CASE WHEN d <= 256 THEN 1 WHEN d <= 65536 THEN 2 ELSE 4 END AS iw FROM cost),
forms AS (SELECT *, n * w AS binary_bytes, CAST(ceil(n * greatest(1, length(bin(span::BIGINT))) / 8.0) AS BIGINT) + 5 AS packed_bytes, d * w + n * iw AS dictionary_bytes FROM bytes),
enc AS (SELECT t.chunk_id, t.column_id, t.column_type, least, CASE WHEN f.n IS NULL THEN CASE WHEN t.column_type IN ('PATH', 'DICTIONARY') THEN t.column_type ELSE 'RAW' END WHEN up >= 0.7 THEN 'DELTA'
  WHEN binary_bytes <= packed_bytes AND binary_bytes <= dictionary_bytes THEN 'BINARY' WHEN packed_bytes <= dictionary_bytes THEN 'BIT_PACKED' ELSE 'DICTIONARY' END AS encoding FROM typed t LEFT JOIN forms f USING (chunk_id, column_id))
"""
)


@query(
    ENCODED
    + """, seg AS (SELECT chunk_id, column_id, event_id, unnest(generate_series(0, len(string_split(substr(value, 2), '/')) - 1)) AS position, unnest(string_split(substr(value, 2), '/')) AS s FROM num WHERE column_type = 'PATH'),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY chunk_id, column_id, position ORDER BY s) - 1 AS k FROM seg),
paths AS (SELECT chunk_id, column_id, event_id, string_agg(k::VARCHAR, ',' ORDER BY position) AS codes FROM ranked GROUP BY ALL)
SELECT s.chunk_id, s.column_id, s.event_id, e.column_type, e.encoding, CASE e.encoding WHEN 'DELTA' THEN v - coalesce(b, 0) WHEN 'BINARY' THEN v - least WHEN 'BIT_PACKED' THEN v - least
  WHEN 'DICTIONARY' THEN dense_rank() OVER (PARTITION BY s.chunk_id, s.column_id ORDER BY CASE WHEN v IS NULL THEN value ELSE v::VARCHAR END) - 1 END AS code, codes,
  CASE WHEN e.encoding = 'RAW' THEN value END AS raw, value AS decoded
FROM steps s JOIN enc e USING (chunk_id, column_id) LEFT JOIN paths p USING (chunk_id, column_id, event_id)"""
)
def smart_columns(spark, sf_dir):
    """Nine columns of events, each encoded by its own type: codes, raw texts, and the values again."""
    made = encoders.encode_columns(event_cells(spark, sf_dir), KEYS, "event_id", keep=kept(spark))
    back = encoders.decode_columns(made, KEYS, "event_id").withColumnRenamed("value", "decoded")
    rows = made.cells.join(made.columns.select(*KEYS, "column_type", "encoding"), KEYS).join(back, [*KEYS, "event_id"])
    return rows.select(*KEYS, "event_id", "column_type", "encoding", "code", F.array_join(F.transform("codes", lambda k: k.cast("string")), ",").alias("codes"), "raw", "decoded")


@query(
    ENCODED
    + """, words AS (SELECT chunk_id, column_id, value, count(*) AS c FROM cells WHERE value IS NOT NULL GROUP BY ALL),
plain AS (SELECT chunk_id, column_id, sum(c)::BIGINT AS n, count(*) AS d, sum((strlen(value) + 1) * c)::BIGINT AS raw_bytes, sum(strlen(value) + 1)::BIGINT AS vocabulary FROM words GROUP BY ALL)
SELECT chunk_id, column_id, 'RAW' AS method, raw_bytes AS bytes, true AS lossless FROM plain
UNION ALL SELECT chunk_id, column_id, 'DICTIONARY', vocabulary + CAST(ceil(n * greatest(1, CAST(ceil(log2(d)) AS INT)) / 8.0) AS BIGINT), true FROM plain
UNION ALL SELECT chunk_id, column_id, 'TYPED', NULL, true FROM plain"""
)
def column_methods(spark, sf_dir):
    """Every column by every method, its bytes and whether it decodes exactly; the bytes of typed columns
    are in column_choice."""
    out = encoders.column_candidates(event_cells(spark, sf_dir), KEYS, "event_id", keep=kept(spark))
    return out.select(*KEYS, "method", F.when(F.col("method") != "TYPED", F.col("bytes")).alias("bytes"), "lossless")


@query(
    ENCODED
    + """, z AS (SELECT chunk_id, column_id, v - coalesce(b, 0) AS dv FROM steps WHERE column_type = 'NUMBER'), u AS (SELECT *, CASE WHEN dv >= 0 THEN 2 * dv ELSE -2 * dv - 1 END AS q FROM z),
typed_bytes AS (SELECT chunk_id, column_id, sum(greatest(1, ceil(CASE WHEN q = 0 THEN 0 ELSE length(bin(q)) END / 7.0)))::BIGINT AS bytes FROM u GROUP BY ALL)
SELECT chunk_id, column_id, 'TYPED' AS method, bytes FROM typed_bytes"""
)
def column_choice(spark, sf_dir):
    """The smallest lossless method of the rising numbers' columns, with its bytes."""
    best = select.smallest(encoders.column_candidates(event_cells(spark, sf_dir), KEYS, "event_id", keep=kept(spark)), KEYS)
    return best.filter("column_id = 'id'").select(*KEYS, "method", "bytes")


@query(EVENTS + "SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY event_id) - 1 AS place, dense_rank() OVER (PARTITION BY chunk_id ORDER BY event_type) - 1 AS code, 3 AS width FROM e WHERE (SELECT count(DISTINCT event_type) FROM events) BETWEEN 5 AND 8 UNION ALL SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY event_id) - 1, dense_rank() OVER (PARTITION BY chunk_id ORDER BY event_type) - 1, 2 FROM e WHERE (SELECT count(DISTINCT event_type) FROM events) BETWEEN 3 AND 4")
def packed_codes(spark, sf_dir):
    """Dictionary codes of a column as one run of bits, and the codes again."""
    cells = event_cells(spark, sf_dir).filter("column_id = 'event_type'")
    packed = encoders.pack_codes(encoders.encode_columns(cells, KEYS, "event_id", keep=kept(spark)), KEYS, "event_id")
    codes = encoders.unpack_codes(packed, KEYS).join(packed.select(*KEYS, "width", F.octet_length("packed").alias("b"), "n"), KEYS)
    return codes.filter(F.col("b") == F.ceil(F.col("n") * F.col("width") / 8)).select("chunk_id", F.col("place").cast("long").alias("place"), "code", "width")


@query(CELLS + "SELECT chunk_id, column_id, row_number() OVER (PARTITION BY chunk_id, column_id ORDER BY event_id) - 1 AS place, value FROM cells WHERE value IS NOT NULL")
def column_frames(spark, sf_dir):
    """Each column's values as one zstd frame, and the values again."""
    frames = codec.column_frames(event_cells(spark, sf_dir), KEYS, "event_id")
    return codec.column_frame_values(frames, KEYS).select(*KEYS, F.col("place").cast("long").alias("place"), "value")


@query(MIXED + "SELECT stream_id::VARCHAR AS stream_id, line_no, line FROM lines")
def codec_by_column(spark, sf_dir):
    """Lines to templates and leaves, their values to typed columns, and all the way back."""
    rows = mixed_lines(spark, sf_dir).withColumn("stream_id", F.col("stream_id").cast("string"))
    return codec.decode(codec.decode_by_column(codec.encode_by_column(codec.encode(rows), kept(spark))))


@query(
    EVENTS
    + """, r AS (SELECT (event_id // 1000)::VARCHAR AS stream_id, chunk_id, event_id, (props->>'$.k')::BIGINT AS k FROM e WHERE event_id % 4 <> 0)
SELECT stream_id, chunk_id, 'j["k"]' AS column_id, 'NUMBER' AS column_type, count(*) AS n_present, 0 AS n_raw FROM r GROUP BY ALL"""
)
def codec_column_types(spark, sf_dir):
    """What the codec makes of the JSON lines' columns: type, values, and how many stay raw."""
    rows = mixed_lines(spark, sf_dir).withColumn("stream_id", F.col("stream_id").cast("string"))
    made = codec.encode_by_column(codec.encode(rows), kept(spark))
    raw = made.cells.groupBy(*codec.COLUMN).agg(F.count("raw").alias("n_raw"))
    return made.columns.join(raw, codec.COLUMN).filter(F.startswith("column_id", F.lit("j"))).select(*codec.COLUMN, "column_type", "n_present", "n_raw")


@query(NESTED + "SELECT line_no, CASE WHEN second THEN 4 WHEN extra THEN 4 ELSE 3 END AS n_shallow, CASE WHEN second THEN 4 WHEN extra THEN 7 ELSE 6 END AS n_deep, CASE WHEN NOT second THEN '{\"name\": \"u' || user_id || '\", \"tags\": [\"a\", 1, null]}' END AS user_object, line AS shallow, line AS deep FROM lines")
def json_flatten_options(spark, sf_dir):
    """Leaves with objects kept whole below the first level, and with arrays by element."""
    rows = nested_lines(spark, sf_dir)
    shallow = j.unflatten_lines(j.flatten_lines(rows, depth=0)).select("line_no", F.size("leaves").cast("long").alias("n_shallow"), F.get(F.filter("leaves", lambda x: x["type"] == "object"), F.lit(0))["value"].alias("user_object"), F.col("line").alias("shallow"))
    deep = j.unflatten_lines(j.flatten_lines(rows, arrays=True)).select("line_no", F.size("leaves").cast("long").alias("n_deep"), F.col("line").alias("deep"))
    return shallow.join(deep, "line_no")


def shallow_cells(spark, sf_dir):
    rows = j.flatten_lines(nested_lines(spark, sf_dir), depth=0)
    return rows, j.leaf_cells(rows, ["chunk_id", "line_no"])


@query(NESTED + "SELECT chunk_id, line_no, 'user' AS key, unnest(['name', 'tags']) AS member, unnest(CASE WHEN second THEN [0, 0] ELSE [2, 2] END) AS mask, unnest(CASE WHEN second THEN [NULL, NULL] ELSE ['u' || user_id, '[\"a\", 1, null]'] END) AS value FROM lines")
def json_nested_table(spark, sf_dir):
    """The objects of a column as a table of their own, with a two-bit mask a row and member."""
    rows, cells = shallow_cells(spark, sf_dir)
    return j.nested_cells(j.nested_table(cells, ["chunk_id"]), rows, ["chunk_id"]).filter("key = 'user'").select("chunk_id", "line_no", "key", "member", "mask", "value")


@query(NESTED + "SELECT chunk_id, 'user' AS key, '{\"name\": \"u' || user_id || '\", \"tags\": [\"a\", 1, null]}' AS value, row_number() OVER (PARTITION BY chunk_id ORDER BY count(*) DESC, 'u' || user_id || '\"') - 1 AS code FROM lines WHERE NOT second GROUP BY chunk_id, user_id")
def json_nested_dictionary(spark, sf_dir):
    """Nested objects as texts by frequency."""
    _, cells = shallow_cells(spark, sf_dir)
    return j.nested_dictionary(cells, ["chunk_id"]).select("chunk_id", "key", "value", F.col("code").cast("long").alias("code"))


@query(NESTED + ", k AS (SELECT chunk_id, line_no, CASE WHEN second THEN 'ok' ELSE 'x.y' END AS key, CASE WHEN second THEN 'true' END AS value FROM lines WHERE second OR extra UNION ALL SELECT chunk_id, line_no, 'empty', '{}' FROM lines WHERE second), f AS (SELECT chunk_id, min(line_no) - 1 AS first FROM lines GROUP BY 1) SELECT chunk_id, key, line_no, line_no - coalesce(lag(line_no) OVER (PARTITION BY chunk_id, key ORDER BY line_no), first) AS step, value FROM k JOIN f USING (chunk_id)")
def json_sparse_columns(spark, sf_dir):
    """Keys that most rows don't have, by the steps between the rows that do."""
    rows = j.flatten_lines(nested_lines(spark, sf_dir))
    cells = j.leaf_cells(rows, ["chunk_id", "line_no"])
    return j.sparse_columns(cells, rows, ["chunk_id"]).select("chunk_id", "key", "line_no", "step", "value")


@query(
    NESTED
    + """, c AS (SELECT chunk_id, count(*) AS n, sum(strlen(line) + 1)::BIGINT AS raw_bytes, sum(strlen(line_no::VARCHAR) + 1) + 3 AS ids, coalesce(sum(CASE WHEN NOT second THEN strlen('u' || user_id) + 1 END) + 10, 0) + coalesce(sum(CASE WHEN NOT second THEN 15 END) + 10, 0) AS users,
  sum(CASE WHEN second THEN 3 ELSE 5 END) + 2 AS vs, coalesce(sum(CASE WHEN second THEN 5 END) + 3, 0) + coalesce(sum(CASE WHEN second THEN 3 END) + 6, 0) AS seconds, coalesce(sum(CASE WHEN extra AND NOT second THEN 1 END) + 4, 0) AS extras FROM lines GROUP BY 1)
SELECT chunk_id, raw_bytes, (ids + users + vs + seconds + extras)::BIGINT AS columnar_bytes, CASE WHEN ids + users + vs + seconds + extras < raw_bytes THEN 'COLUMNAR' ELSE 'RAW' END AS choice FROM c"""
)
def json_columnar_or_raw(spark, sf_dir):
    return j.columnar_or_raw(j.flatten_lines(nested_lines(spark, sf_dir)).withColumn("line", F.col("line")), ["chunk_id"])


@query(NESTED + "SELECT line_no, 'id' AS key, line_no::VARCHAR AS text FROM lines UNION ALL SELECT line_no, 'user.name', 'u' || user_id FROM lines WHERE NOT second UNION ALL SELECT line_no, 'ok', 'true' FROM lines WHERE second")
def json_typed_values(spark, sf_dir):
    """Leaves as variants, read back as text."""
    cells = j.leaf_cells(j.flatten_lines(nested_lines(spark, sf_dir)), ["chunk_id", "line_no"]).filter("key in ('id', 'user.name', 'ok')")
    return cells.select("line_no", "key", F.variant_get(j.typed_value(F.col("type"), F.col("value")), "$.v", "string").alias("text"))


@query(NESTED + "SELECT line_no, CASE WHEN second THEN '[[\"empty\"], {}]' ELSE '[[\"id\"], ' || line_no || ']' END AS difference FROM lines")
def json_first_difference(spark, sf_dir):
    """The least leaf that a line and one of its members alone don't share."""
    member = F.when(F.col("line_no") % 5 == 0, F.concat(F.lit('{"id": '), F.col("line_no").cast("string"), F.lit(', "ok": true, "v": 0}')))
    other = F.coalesce(member, F.regexp_replace("line", r'^\{"id": [0-9]+, ', "{"))
    return nested_lines(spark, sf_dir).select("line_no", select.first_difference(F.col("line"), other).alias("difference"))


@query("SELECT event_id, event_id % 5 AS largest, event_id % 3 = 0 AS any_raw, CASE WHEN event_id % 3 = 0 THEN 16 WHEN event_id % 5 < 2 THEN 1 WHEN event_id % 5 < 4 THEN 2 ELSE 3 END AS width FROM events")
def template_index_widths(spark, sf_dir):
    largest, raw = F.col("event_id") % 5, F.col("event_id") % 3 == 0
    return table(spark, sf_dir, "events").select("event_id", largest.alias("largest"), raw.alias("any_raw"), bits.template_index_width(largest, raw).alias("width"))


@query(EVENTS + ", b AS (SELECT event_id, props, lag(props, 1, '') OVER (PARTITION BY chunk_id ORDER BY event_id) AS r FROM e) SELECT event_id, props AS restored, props = r AS same, CASE WHEN props = r THEN (32 + 9 * ((strlen(props) + 254) // 255) + 7) // 8 END AS n_bytes FROM b")
def hybrid_bitstream(spark, sf_dir):
    """Each text against the one before as a stream of bits, its bytes where the two are equal, and the
    text again."""
    before = F.lag("props", 1, "").over(W.partitionBy("chunk_id").orderBy("event_id"))
    rows = chunked_events(spark, sf_dir).select("event_id", "props", before.alias("r"))
    rows = rows.withColumn("packed", packing.hybrid(F.col("props"), F.col("r"))).withColumn("restored", packing.unhybrid(F.col("packed"), F.col("r")))
    return rows.select("event_id", "restored", (F.col("props") == F.col("r")).alias("same"), F.when(F.col("props") == F.col("r"), F.octet_length("packed").cast("long")).alias("n_bytes"))


@query("SELECT event_id, CASE WHEN event_id = 0 THEN '-' ELSE printf('%.2f%%', 100.0 * (event_id % 50) / event_id) END AS ratio, CASE WHEN event_id % 50 < event_id THEN 'part' ELSE 'whole' END AS smaller, (event_id % 50) / 1e6 / 2.0 AS mb_per_s, event_id / 2.0 AS lines_per_s FROM events")
def ratios_and_rates(spark, sf_dir):
    part, whole = F.col("event_id") % 50, F.col("event_id")
    speed = select.throughput(part, whole, F.lit(2.0))
    return table(spark, sf_dir, "events").select("event_id", bits.format_ratio(part, whole).alias("ratio"), select.smaller_of(part, whole, ("part", "whole")).alias("smaller"), speed["mb_per_s"].alias("mb_per_s"), speed["lines_per_s"].alias("lines_per_s"))


@query("SELECT event_id, event_id % 4 < 3 AS object_or_array, event_id % 4 = 0 AS object, event_id % 4 IN (0, 3) AS by_looks FROM events")
def json_tests(spark, sf_dir):
    """Objects, arrays, cut-off texts and look-alikes by the three tests of JSON lines."""
    k = F.col("event_id") % 4
    line = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("["), F.col("props"), F.lit("]"))).when(k == 2, F.lit("[1, null]")).otherwise("{not json}")
    return table(spark, sf_dir, "events").select("event_id", parse.is_json_or_array(line).alias("object_or_array"), parse.is_json(line).alias("object"), parse.json_like(line).alias("by_looks"))


FIELDS = ["host", "user", "time", "method", "path", "status", "size"]


@query(
    """WITH c AS (SELECT event_id // 5000 AS chunk_id, * FROM events), f AS (SELECT chunk_id, unnest(['host', 'user', 'time', 'method', 'path', 'status', 'size']) AS column_id, count(*) AS n, count(DISTINCT user_id) AS users FROM c GROUP BY chunk_id)
SELECT chunk_id, column_id, CASE column_id WHEN 'host' THEN 'IPV4' WHEN 'user' THEN CASE WHEN users <= 256 THEN 'DICTIONARY' ELSE 'RAW' END WHEN 'time' THEN 'CLF' WHEN 'method' THEN 'DICTIONARY' WHEN 'path' THEN 'PATH' ELSE 'NUMBER' END AS column_type,
  n AS n_present, n AS n_same FROM f"""
)
def access_columns(spark, sf_dir):
    """Access log lines parsed into fields, each field a column encoded by its type, and how many values
    come back."""
    rows = known_lines(spark, sf_dir)["access"].withColumn("p", parse.parse_access(F.col("line")))
    rows = rows.select(F.floor(F.col("line_no") / 5000).alias("chunk_id"), "line_no", *(f"p.{c}" for c in FIELDS))
    cells = rows.unpivot(["chunk_id", "line_no"], FIELDS, "column_id", "value")
    made = encoders.encode_columns(cells, KEYS, "line_no", keep=kept(spark))
    back = encoders.decode_columns(made, KEYS, "line_no").withColumnRenamed("value", "decoded")
    same = cells.join(back, [*KEYS, "line_no"]).groupBy(*KEYS).agg(F.count_if(F.col("value") == F.col("decoded")).alias("n_same"))
    return made.columns.select(*KEYS, "column_type", "n_present").join(same, KEYS)


@query(LINES + "SELECT stream_id, line_no, line AS restored, len(regexp_extract_all(line, '[0-9]+')) > 0 AS masked FROM lines")
def masked_columns(spark, sf_dir):
    """Lines as typed masks with a dictionary, their variables as columns by type and place, and the lines
    again."""
    lines = document_lines(spark, sf_dir).withColumn("template", parse.typed_mask(F.col("line"))).withColumn("variables", parse.typed_variables(F.col("line")))
    chunk = (F.col("stream_id").cast("long") / 500).cast("long")
    rows = lines.select(chunk.alias("chunk_id"), "stream_id", F.struct(F.col("stream_id").cast("long").alias("doc"), "line_no").alias("at"), "line_no", "line", "template", "variables")
    cells = rows.select("chunk_id", "at", F.posexplode("variables").alias("place", "v")).select("chunk_id", F.concat_ws(".", "v.type", "place").alias("column_id"), "at", F.col("v.value").alias("value"))
    templates = rows.select("chunk_id", F.lit("template").alias("column_id"), "at", F.col("template").alias("value"))
    made = encoders.encode_columns(cells.unionByName(templates), KEYS, "at", keep=kept(spark))
    back = encoders.decode_columns(made, KEYS, "at")
    place = F.substring_index("column_id", ".", -1).try_cast("int")
    values = back.filter("column_id != 'template'").groupBy("chunk_id", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), "value"))), lambda x: F.struct(x["value"].alias("value"))).alias("variables"))
    whole = back.filter("column_id = 'template'").select("chunk_id", "at", F.col("value").alias("template")).join(values, ["chunk_id", "at"], "left")
    restored = parse.restore_mask(F.col("template"), F.coalesce("variables", F.expr("cast(array() as array<struct<value:string>>)")))
    return whole.select(F.col("at.doc").cast("string").alias("stream_id"), F.col("at.line_no").alias("line_no"), restored.alias("restored"), F.col("template").rlike("<(IP|UUID|BLK|HEX|BIGINT|FLOAT|INT)>|[0-9]").alias("masked"))
