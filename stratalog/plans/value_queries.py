"""Queries over single values: bits, bytes, recognisers, parsers and printers."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.catalog import EVENTS, chunked_events, document_lines, query, table
from stratalog.functions import bits, values

IPS = """WITH lines AS (SELECT doc_id, text FROM documents),
ips AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')) AS ip FROM lines)
"""


def addresses(spark, sf_dir):
    found = F.regexp_extract_all(F.col("text"), F.lit(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("at", "ip"))


@query(
    """SELECT event_id, v, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS zigzag, v AS restored
FROM (SELECT event_id, user_id - 75 AS v FROM events)"""
)
def zigzag(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") - 75).alias("v"))
    return rows.withColumn("zigzag", bits.zigzag(F.col("v"))).withColumn("restored", bits.unzigzag(F.col("zigzag")))


@query(
    """SELECT o_orderkey, greatest(1, CAST(ceil(length(bin(o_orderkey)) / 7.0) AS INT)) AS size, o_orderkey AS restored,
  greatest(1, CAST(ceil(length(bin(CASE WHEN o_orderkey >= 2 THEN 2 * (o_orderkey - 2) ELSE -2 * (o_orderkey - 2) - 1 END)) / 7.0) AS INT)) AS signed_size
FROM orders"""
)
def varint_bytes(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.octet_length(bits.varint(key)).alias("size"),
        bits.unvarint(bits.varint(key)).alias("restored"),
        bits.varint_size(bits.zigzag(key - 2)).alias("signed_size"),
    )


@query(
    """SELECT l_orderkey, count(*) AS n, sum(greatest(1, CAST(ceil(length(bin(l_partkey)) / 7.0) AS INT))) AS bytes, list(l_partkey ORDER BY l_linenumber, l_partkey)::VARCHAR AS restored
FROM lineitem GROUP BY l_orderkey"""
)
def varint_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    rows = rows.withColumn("keys", F.transform("l", lambda x: x["l_partkey"])).withColumn("b", bits.varints(F.col("keys")))
    back = F.concat(F.lit("["), F.array_join(bits.unvarints(F.col("b")).cast("array<string>"), ", "), F.lit("]"))
    return rows.select("l_orderkey", F.size("keys").cast("long").alias("n"), F.octet_length("b").cast("long").alias("bytes"), back.alias("restored"))


@query(
    """SELECT l_orderkey, CAST(ceil(count(*) * 3 / 8.0) AS BIGINT) AS bytes, list(l_linenumber::BIGINT ORDER BY l_linenumber)::VARCHAR AS restored FROM lineitem GROUP BY l_orderkey"""
)
def bit_packing(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("long"))).alias("v"))
    rows = rows.withColumn("b", bits.pack(F.col("v"), 3))
    back = F.concat(F.lit("["), F.array_join(bits.unpack(F.col("b"), 3, F.size("v")).cast("array<string>"), ", "), F.lit("]"))
    return rows.select("l_orderkey", F.octet_length("b").cast("long").alias("bytes"), back.alias("restored"))


@query(
    """SELECT count(DISTINCT props) AS n_distinct, greatest(1, CAST(ceil(log2(count(DISTINCT props))) AS INT)) AS bits,
  CASE WHEN count(DISTINCT props) <= 256 THEN 1 WHEN count(DISTINCT props) <= 65536 THEN 2 ELSE 4 END AS bytes,
  CAST(ceil(count(*) * greatest(1, CAST(ceil(log2(count(DISTINCT props))) AS INT)) / 8.0) AS BIGINT) AS packed_bytes FROM events"""
)
def dict_bit_width(spark, sf_dir):
    rows = table(spark, sf_dir, "events").agg(F.count_distinct("props").alias("n_distinct"), F.count("*").alias("n"))
    width = bits.index_width(F.col("n_distinct"))
    return rows.select("n_distinct", width.alias("bits"), bits.index_bytes(F.col("n_distinct")).alias("bytes"), bits.packed_size(F.col("n"), width).alias("packed_bytes"))


@query(
    """SELECT doc_id, length(text) + (length(text) - length(replace(text, chr(10), ''))) + (length(text) - length(replace(text, chr(92), ''))) AS escaped_chars, text AS restored FROM documents"""
)
def escape_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("e", bits.escape(F.col("text")))
    return rows.select("doc_id", F.length("e").cast("long").alias("escaped_chars"), bits.unescape(F.col("e")).alias("restored"))


@query("""SELECT doc_id, strlen(text) AS bytes, md5(text) AS digest FROM documents""")
def latin1_view(spark, sf_dir):
    view = bits.to_latin1(F.encode("text", "UTF-8"))
    rows = table(spark, sf_dir, "documents").select("doc_id", view.alias("v"))
    return rows.select("doc_id", F.length("v").cast("long").alias("bytes"), F.md5(bits.from_latin1(F.col("v"))).alias("digest"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey - 100 BETWEEN -128 AND 127 THEN 1 WHEN l_partkey - 100 BETWEEN -32768 AND 32767 THEN 2 ELSE 4 END AS signed_width,
  CASE WHEN l_suppkey * 1000 < 256 THEN 1 WHEN l_suppkey * 1000 < 65536 THEN 2 ELSE 4 END AS unsigned_width FROM lineitem"""
)
def integer_widths(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", bits.signed_width(F.col("l_partkey") - 100).alias("signed_width"), bits.unsigned_width(F.col("l_suppkey") * 1000).alias("unsigned_width")
    )


@query(
    """SELECT o_orderkey, t AS text, t LIKE '-%' AS negative, CAST(replace(replace(t, '.', ''), '-', '') AS BIGINT) AS digits, length(t) - strpos(t, '.') AS decimals, t AS restored
FROM (SELECT o_orderkey, printf('%.2f', o_totalprice - 100000) AS t FROM orders)"""
)
def decimal_packing(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%.2f", F.col("o_totalprice") - 100000).alias("text"))
    rows = rows.withColumn("d", bits.split_decimal(F.col("text")))
    return rows.select("o_orderkey", "text", "d.negative", "d.digits", F.col("d.decimals").cast("long").alias("decimals"), bits.join_decimal(F.col("d")).alias("restored"))


@query(
    IPS
    + """SELECT doc_id, ip, CASE WHEN ok THEN a * 16777216 + b * 65536 + c * 256 + d END AS packed, CASE WHEN ok THEN ip END AS restored FROM (
  SELECT *, greatest(a, b, c, d) < 256 AND NOT regexp_matches(ip, '(^|\\.)0[0-9]') AS ok FROM (
    SELECT doc_id, ip, split_part(ip, '.', 1)::BIGINT AS a, split_part(ip, '.', 2)::BIGINT AS b, split_part(ip, '.', 3)::BIGINT AS c, split_part(ip, '.', 4)::BIGINT AS d FROM ips))"""
)
def ipv4_pack(spark, sf_dir):
    rows = addresses(spark, sf_dir).withColumn("packed", bits.ipv4_to_long(F.col("ip")))
    return rows.select("doc_id", "ip", "packed", F.when(F.col("packed").isNotNull(), bits.long_to_ipv4(F.col("packed"))).alias("restored"))


@query("""SELECT s_suppkey, 100 + s_suppkey % 300 AS status, CASE WHEN 100 + s_suppkey % 300 BETWEEN 100 AND 355 THEN s_suppkey % 300 END AS packed FROM supplier""")
def status_bytes(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (100 + F.col("s_suppkey") % 300).alias("status"))
    return rows.withColumn("packed", bits.status_byte(F.col("status")))


@query(
    """SELECT doc_id, h AS hex, u AS uuid, 32 AS hex_chars, 16 AS uuid_bytes, h AS hex_restored, u AS uuid_restored FROM (
  SELECT doc_id, h, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS u
  FROM (SELECT doc_id, md5(text) AS h FROM documents))"""
)
def uuid_hex_bytes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("hex"))
    rows = rows.withColumn("uuid", F.regexp_replace("hex", "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    return rows.select(
        "doc_id", "hex", "uuid", F.length("hex").alias("hex_chars"), F.octet_length(bits.uuid_bytes(F.col("uuid"))).alias("uuid_bytes"),
        F.lower(F.hex(bits.hex_bytes(F.col("hex")))).alias("hex_restored"), bits.bytes_uuid(bits.uuid_bytes(F.col("uuid"))).alias("uuid_restored"),
    )


@query(
    """SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE printf('%.1f', floor(n_chars * 10 / 1024.0 + 0.5) / 10) || ' KB' END AS size FROM documents"""
)
def size_format(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", bits.format_bytes(F.col("n_chars")).alias("size"))


@query(
    """SELECT o_orderkey, x AS text, epoch(o_orderdate)::BIGINT AS seconds, ' +0200' AS zone, x AS restored
FROM (SELECT *, '[' || strftime(o_orderdate, '%d/%b/%Y:%H:%M:%S') || ' +0200]' AS x FROM orders)"""
)
def clf_parse(spark, sf_dir):
    text = F.concat(F.lit("["), F.date_format(F.col("o_orderdate"), "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0200]"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).withColumn("p", values.parse_clf(F.col("text")))
    return rows.select("o_orderkey", "text", "p.seconds", "p.zone", values.print_clf(F.col("p")).alias("restored"))


@query(
    EVENTS
    + """SELECT event_id, x AS text, us * 1000 AS nanos, 6 AS decimals, 'Z' AS zone, x AS restored
FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS x FROM e)"""
)
def iso_parse(spark, sf_dir):
    rows = chunked_events(spark, sf_dir).select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("text"))
    rows = rows.withColumn("p", values.parse_iso(F.col("text")))
    return rows.select("event_id", "text", "p.nanos", "p.decimals", "p.zone", values.print_iso(F.col("p")).alias("restored"))


@query(
    """SELECT event_id, x AS text, 'req' AS prefix, event_id AS number, 8 AS width, x AS restored FROM (SELECT event_id, printf('req-%08d', event_id) AS x FROM events)"""
)
def prefix_id_split(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.format_string("req-%08d", "event_id").alias("text")).withColumn("p", values.parse_prefix_id(F.col("text")))
    return rows.select("event_id", "text", "p.prefix", "p.number", "p.width", values.print_prefix_id(F.col("p")).alias("restored"))


PATHS = """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages)
"""


def paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("path"))


@query(
    PATHS
    + """SELECT page_id, path, len(s) AS n_segments, s[1] AS first_segment, path AS restored FROM (
  SELECT *, string_split(regexp_replace(path, '^/|/$', '', 'g'), '/') AS s FROM p) WHERE path <> '' AND path <> '/'"""
)
def path_segments(spark, sf_dir):
    rows = paths(spark, sf_dir).filter("path <> '' and path <> '/'").withColumn("s", values.path_segments(F.col("path")))
    back = values.print_path(F.col("s"), F.endswith("path", F.lit("/")))
    return rows.select("page_id", "path", F.size("s").cast("long").alias("n_segments"), F.get("s", F.lit(0)).alias("first_segment"), back.alias("restored"))


@query(
    """SELECT doc_id, w, CASE WHEN w IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(w, '^[a-zA-Z][a-zA-Z0-9]*[-_]-?[0-9]+,?$') THEN 'prefix_id'
  WHEN regexp_matches(w, '^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$') THEN 'ipv4' WHEN regexp_matches(w, '^(0|-?[1-9][0-9]*)$') THEN 'number'
  WHEN regexp_matches(w, '^-?[0-9]+\\.[0-9]+$') THEN 'float' WHEN regexp_matches(w, '^[0-9a-fA-F]{7,}$') THEN 'hex' WHEN regexp_matches(w, '^/[A-Za-z0-9_./-]*$') AND NOT contains(w, '//') THEN 'path'
  WHEN regexp_matches(w, '^[A-Za-z][A-Za-z0-9-]*(\\.[A-Za-z0-9-]+)+$') THEN 'hostname' ELSE 'text' END AS kind
FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9A-Za-z][^ \\n]*')) AS w FROM documents) WHERE regexp_matches(w, '[0-9./]')"""
)
def value_kinds(spark, sf_dir):
    found = F.regexp_extract_all(F.col("text"), F.lit(r"[0-9A-Za-z][^ \n]*"), F.lit(0))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("w")).distinct().filter(F.col("w").rlike("[0-9./]"))
    return rows.select("doc_id", "w", values.kind(F.col("w")).alias("kind"))


@query(
    """SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE regexp_matches(w, '^/?[0-9]{1,3}(\\.[0-9]{1,3}){3}(:.*)?$')
  OR (length(w) > 4 AND regexp_matches(w, '^[A-Za-z0-9_-]+(\\.[A-Za-z0-9_-]+)+$')) OR regexp_matches(w, '^/[A-Za-z0-9/._~%-]{3,}$') OR regexp_matches(w, '^[0-9.-]*[0-9][0-9.-]*$')
  OR (contains(w, ':') AND regexp_matches(w, '^[0-9:]*[0-9][0-9:]*$')) OR regexp_matches(w, '^[0-9a-fA-F]{7,}$') OR (regexp_matches(w, '[0-9]') AND regexp_matches(w, '^blk[_-].*$'))
  OR (length(w) > 4 AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[_-]')) OR regexp_matches(w, '^[A-Za-z][A-Za-z0-9]{0,18}[0-9]$')
  OR regexp_matches(w, '^[A-Za-z0-9_-]+@[A-Za-z0-9_-]+$') OR regexp_matches(w, '^#[A-Za-z0-9]+#$') OR regexp_matches(w, '^[^\\[\\]]*\\[[0-9]+\\].*$')) AS n_variable
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS w FROM documents) GROUP BY doc_id"""
)
def token_variable_flags(spark, sf_dir):
    from stratalog.operators.parse import tokens

    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("w"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_if(values.is_variable_token(F.col("w"))).alias("n_variable"))


@query(
    """SELECT stream_id, line_no, line AS restored, strlen(line) AS n_bytes FROM (
  SELECT doc_id::VARCHAR AS stream_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"""
)
def zero_run_roundtrip(spark, sf_dir):
    """XOR of every line with itself but for its first letter, folded and unfolded."""
    view = F.decode(F.encode("line", "UTF-8"), "ISO-8859-1")
    rows = document_lines(spark, sf_dir).withColumn("a", bits.to_codes(view))
    rows = rows.withColumn("b", F.transform("a", lambda c, i: F.when(i == 0, 0).otherwise(c)))
    rows = rows.withColumn("x", bits.unzero_runs(bits.zero_runs(bits.xor_codes(F.col("a"), F.col("b")))))
    back = F.unhex(F.array_join(F.transform(bits.xor_codes(F.col("x"), F.col("b")), lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return rows.select("stream_id", "line_no", F.decode(back, "UTF-8").alias("restored"), F.size("a").cast("long").alias("n_bytes"))
