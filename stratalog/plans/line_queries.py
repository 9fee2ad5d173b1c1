"""Queries over lines: sources, chunks, formats, templates, JSON and similar lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.catalog import EVENTS, LINES, chunked_events, document_lines, query, table
from stratalog.operators import json_lines as j
from stratalog.operators import parse, similar, templates
from stratalog.plans import codec
from stratalog.sources import lines as source


@query(LINES + "SELECT * FROM lines")
def explode_lines(spark, sf_dir):
    return document_lines(spark, sf_dir)


@query("SELECT event_id, CASE WHEN event_id < 1000 THEN 0 ELSE 1 + (event_id - 1000) // 10000 END AS chunk_id, event_id // 10000 AS fixed_chunk_id FROM events")
def chunk_assign(spark, sf_dir):
    at = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", source.chunk_id(at).alias("chunk_id"), source.fixed_chunk_id(at).alias("fixed_chunk_id"))


@query(
    """WITH e AS (SELECT *, event_id // 500 AS k FROM events), b AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY k ORDER BY event_id) THEN 1 ELSE 0 END AS s FROM e),
r AS (SELECT *, sum(s) OVER (PARTITION BY k ORDER BY event_id) - 1 AS run FROM b)
SELECT k, run::BIGINT AS run, event_type, min(event_id) AS "first", count(*) AS length FROM r GROUP BY ALL"""
)
def format_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("k", F.floor(F.col("event_id") / 500))
    return parse.format_runs(rows, ["k"], "event_id", "event_type")


@query("SELECT event_id // 500 AS k, event_id AS at, event_type FROM events")
def format_runs_expanded(spark, sf_dir):
    return parse.expand_runs(format_runs(spark, sf_dir), ["k"], "event_type")


MIXED = """WITH lines AS (SELECT event_id // 1000 AS stream_id, event_id AS line_no, CASE WHEN event_id % 4 = 0 THEN 'plain ' || event_type ELSE props END AS line FROM events)
"""


def mixed_lines(spark, sf_dir):
    line = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("plain "), F.col("event_type"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 1000).alias("stream_id"), F.col("event_id").alias("line_no"), line.alias("line"))


@query(MIXED + "SELECT stream_id, line_no, CASE WHEN json_valid(line) AND line LIKE '{%}' THEN 'JSON' ELSE 'TEXT' END AS format FROM lines")
def line_formats(spark, sf_dir):
    return mixed_lines(spark, sf_dir).select("stream_id", "line_no", parse.line_format(F.col("line")).alias("format"))


@query(
    MIXED
    + """SELECT stream_id, count(*) FILTER (WHERE line LIKE '{%}') AS n_json, count(*) AS n_lines, count(*) FILTER (WHERE line NOT LIKE '{%}') AS n_text, 'MIXED' AS chunk_type FROM lines GROUP BY 1"""
)
def chunk_strategy(spark, sf_dir):
    return parse.chunk_type(mixed_lines(spark, sf_dir), ["stream_id"])


@query(
    """SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS stream_id, (CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END)::DOUBLE AS json_share, CASE WHEN event_id % 2 = 0 THEN 'TEXT' ELSE 'JSON' END AS format FROM events WHERE event_id < 2"""
)
def format_vote(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    rows = table(spark, sf_dir, "events").select(F.when(even, "a").otherwise("b").alias("stream_id"), F.floor(F.col("event_id") / 2).alias("line_no"), F.when(even, F.col("event_type")).otherwise(F.col("props")).alias("line"))
    return parse.format_vote(rows)


@query(
    """SELECT stream_id, access_share::DOUBLE AS access_share, block_share::DOUBLE AS block_share, syslog_share::DOUBLE AS syslog_share, kind FROM (VALUES ('access', 1.0, 0.0, 0.0, 'access'), ('blocks', 0.0, 1.0, 0.0, 'blocks'), ('json', 0.0, 0.0, 0.0, 'json_flat'), ('syslog', 0.0, 0.0, 1.0, 'syslog')) t(stream_id, access_share, block_share, syslog_share, kind)"""
)
def stream_kinds(spark, sf_dir):
    rows = known_lines(spark, sf_dir)
    rows = rows["access"].withColumn("stream_id", F.lit("access")).unionByName(rows["blocks"].withColumn("stream_id", F.lit("blocks"))).unionByName(rows["syslog"].withColumn("stream_id", F.lit("syslog")))
    rows = rows.unionByName(table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.col("props").alias("line"), F.lit("json").alias("stream_id")))
    return parse.stream_kind(rows).select("stream_id", "access_share", "block_share", "syslog_share", "kind")


def known_lines(spark, sf_dir):
    """Lines of known formats made from events."""
    rows = table(spark, sf_dir, "events")
    ip = F.concat_ws(".", F.lit("10"), F.lit("0"), (F.col("user_id") % 256).cast("string"), (F.col("event_id") % 256).cast("string"))
    access = F.concat(ip, F.lit(" - u"), F.col("user_id").cast("string"), F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), F.col("event_type"), F.lit(' HTTP/1.1" 200 '), (F.col("event_id") % 1000).cast("string"))
    blocks = F.concat(F.date_format("ts", "yyMMdd HHmmss"), F.lit(" "), F.col("user_id").cast("string"), F.lit(" INFO dfs.DataNode: Receiving block blk_-"), F.col("event_id").cast("string"), F.lit(" src: /"), ip, F.lit(":50010"))
    syslog = F.concat(F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" host"), (F.col("user_id") % 10).cast("string"), F.lit(" sshd["), F.col("event_id").cast("string"), F.lit("]: session "), F.col("event_type"))
    return {n: rows.select(F.col("event_id").alias("line_no"), x.alias("line")) for n, x in (("access", access), ("blocks", blocks), ("syslog", syslog))}


@query(
    """SELECT event_id AS line_no, '10.0.' || user_id % 256 || '.' || event_id % 256 AS host, 'u' || user_id AS "user", strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000' AS time, 'GET' AS method, '/' || event_type AS path, '200' AS status, (event_id % 1000)::VARCHAR AS size FROM events"""
)
def parse_access_log(spark, sf_dir):
    rows = known_lines(spark, sf_dir)["access"].withColumn("p", parse.parse_access(F.col("line")))
    return rows.select("line_no", *(f"p.{c}" for c in ("host", "user", "time", "method", "path", "status", "size")))


@query(
    """SELECT event_id AS line_no, strftime(ts, '%b %d %H:%M:%S') AS time, 'host' || user_id % 10 AS host, 'sshd' AS program, event_id::VARCHAR AS pid, 'session ' || event_type AS message FROM events"""
)
def parse_syslog(spark, sf_dir):
    return known_lines(spark, sf_dir)["syslog"].withColumn("p", parse.parse_syslog(F.col("line"))).select("line_no", "p.*")


@query(
    """SELECT event_id AS line_no, user_id::VARCHAR AS pid, 'INFO' AS level, 'dfs.DataNode' AS component, 'blk_-' || event_id AS block, '10.0.' || user_id % 256 || '.' || event_id % 256 || ':50010' AS address,
  'Receiving block <BLK> src: /<IP>' AS template FROM events"""
)
def parse_block_log(spark, sf_dir):
    rows = known_lines(spark, sf_dir)["blocks"].withColumn("p", parse.parse_block_log(F.col("line")))
    return rows.select("line_no", "p.pid", "p.level", "p.component", F.get("p.blocks", F.lit(0)).alias("block"), F.get("p.addresses", F.lit(0)).alias("address"), "p.template")


@query("SELECT 'access' AS stream_id, 1.0::DOUBLE AS share, true AS structured")
def structured_gate(spark, sf_dir):
    rows = known_lines(spark, sf_dir)["access"].withColumn("stream_id", F.lit("access"))
    return parse.structured_share(rows, parse.parse_access(F.col("line")))


@query(LINES + "SELECT stream_id, round(var_pop(length(line)), 3) AS variance, round(avg(length(line)), 3) AS mean, var_pop(length(line)) < 2 * avg(length(line)) AS repetitive FROM lines WHERE line_no < 500 GROUP BY 1")
def length_variance_test(spark, sf_dir):
    out = parse.length_spread(document_lines(spark, sf_dir))
    return out.select("stream_id", F.round("variance", 3).alias("variance"), F.round("mean", 3).alias("mean"), "repetitive")


@query(
    LINES
    + """, c AS (SELECT stream_id, substr(line, 1, 20) AS b, count(*) AS n FROM lines GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY n DESC, b) AS k, sum(n) OVER (PARTITION BY stream_id) AS total FROM c)
SELECT stream_id, sum(n) / any_value(total) AS share, sum(n) / any_value(total) > 0.5 AS templated FROM r WHERE k <= 10 GROUP BY 1"""
)
def prefix_vote(spark, sf_dir):
    return parse.prefix_vote(document_lines(spark, sf_dir))


@query(LINES + "SELECT stream_id, line_no, regexp_replace(line, '[0-9]+', '<N>', 'g') AS template FROM lines")
def digit_mask_templates(spark, sf_dir):
    return document_lines(spark, sf_dir).select("stream_id", "line_no", F.regexp_replace("line", "[0-9]+", "<N>").alias("template"))


@query(LINES + "SELECT stream_id, line_no, regexp_replace(regexp_replace(regexp_replace(line, '[0-9]{1,3}(\\.[0-9]{1,3}){3}(:[0-9]+)?', chr(1), 'g'), '[0-9]{6,}', chr(4), 'g'), '[0-9]+', chr(5), 'g') AS masked FROM lines")
def control_mask(spark, sf_dir):
    return document_lines(spark, sf_dir).select("stream_id", "line_no", parse.control_mask(F.col("line")).alias("masked"))


@query(LINES + "SELECT stream_id, line_no, line AS restored FROM lines")
def typed_mask_roundtrip(spark, sf_dir):
    rows = document_lines(spark, sf_dir)
    return rows.select("stream_id", "line_no", parse.restore_mask(parse.typed_mask(F.col("line")), parse.typed_variables(F.col("line"))).alias("restored"))


TOKENS = (
    LINES
    + """, t AS (SELECT stream_id, line_no, line, array_to_string(list_transform(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+'), lambda w: CASE WHEN regexp_matches(w, '^/?[0-9]{1,3}(\\.[0-9]{1,3}){3}(:.*)?$')
  OR (length(w) > 4 AND regexp_matches(w, '^[A-Za-z0-9_-]+(\\.[A-Za-z0-9_-]+)+$')) OR regexp_matches(w, '^/[A-Za-z0-9/._~%-]{3,}$') OR regexp_matches(w, '^[0-9.-]*[0-9][0-9.-]*$')
  OR (contains(w, ':') AND regexp_matches(w, '^[0-9:]*[0-9][0-9:]*$')) OR regexp_matches(w, '^[0-9a-fA-F]{7,}$') OR (regexp_matches(w, '[0-9]') AND regexp_matches(w, '^blk[_-].*$'))
  OR (length(w) > 4 AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[_-]')) OR regexp_matches(w, '^[A-Za-z][A-Za-z0-9]{0,18}[0-9]$')
  OR regexp_matches(w, '^[A-Za-z0-9_-]+@[A-Za-z0-9_-]+$') OR regexp_matches(w, '^#[A-Za-z0-9]+#$') OR regexp_matches(w, '^[^\\[\\]]*\\[[0-9]+\\].*$') THEN '<*>' ELSE w END), ' ') AS template FROM lines)
"""
)


@query(
    TOKENS
    + """SELECT stream_id, line_no, nullif(template, '') AS template, dense_rank() OVER (PARTITION BY stream_id ORDER BY f) - 1 AS template_id FROM (
  SELECT stream_id, line_no, template, min(line_no) OVER (PARTITION BY stream_id, template) AS f FROM t WHERE template <> '')
UNION ALL SELECT stream_id, line_no, NULL, NULL FROM t WHERE template = ''"""
)
def exact_match_miner(spark, sf_dir):
    return templates.exact_match_mine(document_lines(spark, sf_dir), ["stream_id"]).select("stream_id", "line_no", "template", F.col("template_id").cast("long").alias("template_id"))


@query(LINES + "SELECT stream_id, line_no, line AS restored FROM lines")
def exact_match_roundtrip(spark, sf_dir):
    rows = templates.exact_match_mine(document_lines(spark, sf_dir), ["stream_id"])
    return rows.select("stream_id", "line_no", templates.restore_line(F.col("template"), F.col("variables"), F.col("gaps"), F.col("raw")).alias("restored"))


@query(
    TOKENS
    + """, c AS (SELECT template, count(*) AS n FROM t GROUP BY 1) SELECT template, n AS "count", n / (SELECT sum(n) FROM c) AS share FROM c ORDER BY n DESC, template LIMIT 20"""
)
def template_report(spark, sf_dir):
    counts = document_lines(spark, sf_dir).groupBy(templates.token_template(F.col("line")).alias("template")).count()
    return parse.template_report(counts)


@query(
    TOKENS
    + """, m AS (SELECT stream_id, template, min(line_no) AS first_line, count(*) AS n FROM t GROUP BY ALL)
SELECT stream_id, template, first_line, n AS "count", row_number() OVER (PARTITION BY stream_id ORDER BY first_line, template) - 1 AS template_id FROM m"""
)
def template_dictionary(spark, sf_dir):
    rows = document_lines(spark, sf_dir).withColumn("template", templates.token_template(F.col("line")))
    return parse.template_ids(rows, ["stream_id"]).withColumn("template_id", F.col("template_id").cast("long"))


@query(LINES + "SELECT stream_id, line_no, line AS restored FROM lines")
def whitespace_roundtrip(spark, sf_dir):
    """Lines with their single spaces widened by place, marked, restored, and narrowed again."""
    wide = F.array_join(F.transform(F.split("line", " ", -1), lambda w, i: F.concat(w, F.repeat(F.lit(" "), i % 12))), " ")
    rows = document_lines(spark, sf_dir).withColumn("wide", F.concat(F.lit("\t\t"), wide, F.lit("  \r")))
    same = templates.restore_spaces(templates.mark_spaces(F.col("wide"))) == F.col("wide")
    parts = templates.split_spaces(F.col("wide"))
    same = same & (templates.join_spaces(parts["tokens"], parts["gaps"]) == F.col("wide"))
    return rows.select("stream_id", "line_no", F.when(same, F.col("line")).alias("restored"))


@query(LINES + "SELECT stream_id, line_no, line AS restored, least(50, len(regexp_extract_all(line, '\\s+|[,;:=\\[\\]{}()\"<>]|[^\\s,;:=\\[\\]{}()\"<>]+'))) AS n_tokens FROM lines")
def delimited_tokens(spark, sf_dir):
    parts = parse.delimited_tokens(F.col("line"))
    rows = document_lines(spark, sf_dir).withColumn("t", parts)
    return rows.select("stream_id", "line_no", F.array_join("t", "").alias("restored"), F.size("t").cast("long").alias("n_tokens"))


@query(EVENTS + "SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN props LIKE '%\": %' THEN 'spaced' ELSE 'tight' END AS style, 1 AS depth FROM e")
def json_field(spark, sf_dir):
    text = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", j.json_field(text, "$.k").cast("long").alias("k"), j.separators(text).alias("style"), parse.json_depth(text).alias("depth"))


def nested_lines(spark, sf_dir):
    """JSON lines of optional and nested members, keys in two orders, made from events."""
    rows = table(spark, sf_dir, "events")
    first = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "user": {"name": "u'), F.col("user_id").cast("string"), F.lit('", "tags": ["a", 1, null]}, "v": 1.50'))
    extra = F.when(F.col("event_id") % 3 == 0, ', "x.y": null').otherwise("")
    second = F.concat(F.lit('{"v": -0, "ok": true, "empty": {}, "id": '), F.col("event_id").cast("string"), F.lit("}"))
    line = F.when(F.col("event_id") % 5 == 0, second).otherwise(F.concat(first, extra, F.lit("}")))
    return rows.select(F.lit("s").alias("stream_id"), F.floor(F.col("event_id") / 500).alias("chunk_id"), F.col("event_id").alias("line_no"), line.alias("line"))


NESTED = """WITH lines AS (SELECT 's' AS stream_id, event_id // 500 AS chunk_id, event_id AS line_no, event_id % 5 = 0 AS second, event_id % 3 = 0 AS extra,
  CASE WHEN event_id % 5 = 0 THEN '{"v": -0, "ok": true, "empty": {}, "id": ' || event_id || '}'
  ELSE '{"id": ' || event_id || ', "user": {"name": "u' || user_id || '", "tags": ["a", 1, null]}, "v": 1.50' || CASE WHEN event_id % 3 = 0 THEN ', "x.y": null' ELSE '' END || '}' END AS line, user_id FROM events)
"""


@query(NESTED + "SELECT line_no, line AS restored, CASE WHEN second THEN 4 WHEN extra THEN 5 ELSE 4 END AS n_leaves FROM lines")
def json_flatten_roundtrip(spark, sf_dir):
    rows = j.flatten_lines(nested_lines(spark, sf_dir))
    return j.unflatten_lines(rows).select("line_no", F.col("line").alias("restored"), F.size("leaves").cast("long").alias("n_leaves"))


@query(
    NESTED
    + """, c AS (SELECT chunk_id, line_no, unnest(CASE WHEN second THEN ['v', 'ok', 'empty', 'id'] WHEN extra THEN ['id', 'user.name', 'user.tags', 'v', 'x.y'] ELSE ['id', 'user.name', 'user.tags', 'v'] END) AS key,
  unnest(CASE WHEN second THEN [0, 1, 2, 3] WHEN extra THEN [0, 1, 2, 3, 4] ELSE [0, 1, 2, 3] END) AS position FROM lines), f AS (SELECT chunk_id, key, min(line_no * 100 + position) AS p FROM c GROUP BY ALL)
SELECT chunk_id, key, row_number() OVER (PARTITION BY chunk_id ORDER BY p) - 1 AS key_id FROM f"""
)
def json_key_table(spark, sf_dir):
    cells = j.leaf_cells(j.flatten_lines(nested_lines(spark, sf_dir)), ["chunk_id", "line_no"])
    return j.key_table(cells, ["chunk_id"]).withColumn("key_id", F.col("key_id").cast("long"))


@query(
    NESTED
    + """, o AS (SELECT chunk_id, line_no, CASE WHEN second THEN 'b' WHEN extra THEN 'c' ELSE 'a' END AS shape FROM lines)
SELECT chunk_id, line_no, dense_rank() OVER (PARTITION BY chunk_id ORDER BY f) - 1 AS order_id FROM (SELECT *, min(line_no) OVER (PARTITION BY chunk_id, shape) AS f FROM o)"""
)
def json_key_orders(spark, sf_dir):
    cells = j.leaf_cells(j.flatten_lines(nested_lines(spark, sf_dir)), ["chunk_id", "line_no"])
    return j.key_orders(cells, j.key_table(cells, ["chunk_id"]), ["chunk_id"]).select("chunk_id", "line_no", F.col("order_id").cast("long").alias("order_id"))


@query(
    NESTED
    + """, k AS (SELECT unnest(['id', 'user.name', 'user.tags', 'v', 'x.y', 'ok', 'empty']) AS key)
SELECT line_no, key, CASE WHEN key IN ('id', 'v') THEN 2 WHEN key IN ('user.name', 'user.tags') THEN CASE WHEN second THEN 0 ELSE 2 END WHEN key = 'x.y' THEN CASE WHEN extra AND NOT second THEN 1 ELSE 0 END ELSE CASE WHEN second THEN 2 ELSE 0 END END AS presence FROM lines, k"""
)
def json_presence(spark, sf_dir):
    rows = j.flatten_lines(nested_lines(spark, sf_dir))
    cells = j.leaf_cells(rows, ["chunk_id", "line_no"])
    return j.with_absent(cells, rows, j.key_table(cells, ["chunk_id"]), ["chunk_id"]).select("line_no", "key", "presence")


@query(
    NESTED
    + """, n AS (SELECT chunk_id, count(*) AS n, count(*) FILTER (WHERE second) AS s, count(*) FILTER (WHERE extra AND NOT second) AS x, count(DISTINCT CASE WHEN NOT second THEN user_id END) AS u FROM lines GROUP BY 1)
SELECT chunk_id, 'id' AS key, n, n AS n_integer, 0 AS n_float, 0 AS n_string, 0 AS n_null, 0 AS n_distinct, 'DELTA' AS hint FROM n
UNION ALL SELECT chunk_id, 'user.name', n - s, 0, 0, n - s, 0, u, 'DICTIONARY' FROM n UNION ALL SELECT chunk_id, 'user.tags', n - s, 0, 0, 0, 0, 0, 'RAW' FROM n
UNION ALL SELECT chunk_id, 'v', n, s, n - s, 0, 0, 0, 'RAW' FROM n UNION ALL SELECT chunk_id, 'x.y', x, 0, 0, 0, x, 0, 'RAW' FROM n
UNION ALL SELECT chunk_id, 'ok', s, 0, 0, 0, 0, 0, 'RAW' FROM n UNION ALL SELECT chunk_id, 'empty', s, 0, 0, 0, 0, 0, 'RAW' FROM n"""
)
def json_key_statistics(spark, sf_dir):
    cells = j.leaf_cells(j.flatten_lines(nested_lines(spark, sf_dir)), ["chunk_id", "line_no"])
    return j.key_statistics(cells, ["chunk_id"]).select("chunk_id", "key", "n", "n_integer", "n_float", "n_string", "n_null", "n_distinct", "hint")


@query(
    NESTED
    + """, c AS (SELECT chunk_id, 'u' || user_id AS value, count(*) AS n FROM lines WHERE NOT second GROUP BY ALL)
SELECT chunk_id, value, row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, value) - 1 AS code FROM c"""
)
def json_value_dictionary(spark, sf_dir):
    cells = j.leaf_cells(j.flatten_lines(nested_lines(spark, sf_dir)), ["chunk_id", "line_no"])
    return j.value_dictionary(cells, ["chunk_id"]).select("chunk_id", "value", F.col("code").cast("long").alias("code"))


def document_chunks(spark, sf_dir):
    """All documents' lines as ten streams in chunks, in the order of documents and lines."""
    rows = document_lines(spark, sf_dir).withColumn("doc", F.col("stream_id").cast("long"))
    return rows.select(F.concat(F.lit("s"), (F.col("doc") % 10).cast("string")).alias("stream_id"), F.floor(F.col("doc") / 500).alias("chunk_id"), (F.col("doc") * 100_000 + F.col("line_no")).alias("line_no"), "line")


@query("WITH l AS (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS n, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT 's' || doc_id % 10 AS stream_id, doc_id * 100000 + n AS line_no, line FROM l")
def drain_roundtrip(spark, sf_dir):
    rows, found = templates.encode_text(document_chunks(spark, sf_dir))
    return templates.decode_text(rows, found).select("stream_id", "line_no", "line")


@query(MIXED + "SELECT stream_id::VARCHAR AS stream_id, line_no, line FROM lines")
def codec_roundtrip(spark, sf_dir):
    rows = mixed_lines(spark, sf_dir).withColumn("stream_id", F.col("stream_id").cast("string"))
    return codec.decode(codec.encode(rows))


@query(MIXED + "SELECT stream_id::VARCHAR AS stream_id, line_no, line FROM lines")
def zstd_frames(spark, sf_dir):
    rows = mixed_lines(spark, sf_dir).select(F.col("stream_id").cast("string").alias("stream_id"), "line_no", "line")
    frames = codec.chunk_frames(rows.withColumn("stream_id", F.lit("all")))
    return codec.frame_lines(frames).select(F.floor(F.col("line_no") / 1000).cast("string").alias("stream_id"), "line_no", "line")


@query("SELECT k::VARCHAR AS stream_id, 0 AS chunk_id, event_id - k * 1000 AS at, event_type AS line FROM (SELECT *, event_id // 1000 AS k FROM events)")
def legacy_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("k", F.floor(F.col("event_id") / 1000))
    whole = rows.groupBy("k").agg(F.array_sort(F.collect_set("event_type")).alias("words"), F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("l"))
    frames = whole.select(F.col("k").cast("string").alias("stream_id"), F.lit(0).alias("chunk_id"), "words", F.expr("transform(l, x -> cast(array_position(words, x) as int) - 1)").alias("indexes"))
    return codec.legacy_lines(frames).withColumn("at", F.col("at").cast("long"))


def spread_events(spark, sf_dir):
    line = F.concat_ws(" ", F.lit("user"), F.lpad(F.col("user_id").cast("string"), 5, "0"), F.lit("did"), F.col("event_type"), F.col("event_id").cast("string"))
    return chunked_events(spark, sf_dir).select(F.floor(F.col("event_id") / 500).alias("chunk_id"), F.col("event_id").alias("line_no"), line.alias("line"))


@query(EVENTS + "SELECT event_id, event_type AS restored FROM e")
def consecutive_xor(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = similar.consecutive_xor(chunked_events(spark, sf_dir), ["chunk_id"], "event_id", "event_type")
    before = F.coalesce(F.lag("event_type").over(W.partitionBy("chunk_id").orderBy("event_id")), F.lit(""))
    return rows.withColumn("_b", before).select("event_id", similar.unxor(F.col("xor"), F.col("_b"), F.length("event_type")).alias("restored"))
