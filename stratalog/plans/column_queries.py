"""Queries that profile columns and encode them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.catalog import EVENTS, chunked_events, query, table
from stratalog.functions import values
from stratalog.operators import columns as c


@query(EVENTS + "SELECT event_id, us - lag(us, 1, 0) OVER (PARTITION BY chunk_id ORDER BY event_id) AS delta, us AS decoded FROM e")
def delta_encode(spark, sf_dir):
    rows = c.delta_encode(chunked_events(spark, sf_dir), ["chunk_id"], "event_id", "us")
    return c.delta_decode(rows, ["chunk_id"], "event_id").select("event_id", "delta", "decoded")


@query(
    EVENTS
    + """SELECT event_id, us - min(us) OVER (PARTITION BY chunk_id) AS "offset", us AS decoded,
  CASE WHEN max(us) OVER (PARTITION BY chunk_id) - min(us) OVER (PARTITION BY chunk_id) < 4294967296 THEN 4 ELSE 8 END AS width FROM e"""
)
def frame_of_reference(spark, sf_dir):
    rows = c.frame_decode(c.frame_encode(chunked_events(spark, sf_dir), ["chunk_id"], "us"))
    return rows.select("event_id", "offset", "decoded", "width")


@query(EVENTS + "SELECT event_id, dense_rank() OVER (PARTITION BY chunk_id ORDER BY event_type) - 1 AS code, event_type AS decoded FROM e")
def dict_codes_sorted(spark, sf_dir):
    rows = chunked_events(spark, sf_dir).select("chunk_id", "event_id", "event_type")
    codes = c.dictionary(rows, ["chunk_id"], "event_type")
    coded = c.dictionary_encode(rows, ["chunk_id"], "event_type").drop("event_type")
    return c.dictionary_decode(coded, codes, ["chunk_id"], "event_type").select("event_id", "code", "decoded")


@query(
    EVENTS
    + """SELECT chunk_id, event_type, n AS "count", row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, event_type) - 1 AS code
FROM (SELECT chunk_id, event_type, count(*) AS n FROM e GROUP BY ALL)"""
)
def dict_codes_freq(spark, sf_dir):
    return c.dictionary(chunked_events(spark, sf_dir), ["chunk_id"], "event_type", "frequency").select("chunk_id", "event_type", "count", "code")


@query(
    EVENTS
    + """SELECT chunk_id, props, n AS "count", row_number() OVER (PARTITION BY chunk_id ORDER BY f) - 1 AS code
FROM (SELECT chunk_id, props, count(*) AS n, min(event_id) AS f FROM e GROUP BY ALL)"""
)
def dict_codes_first_seen(spark, sf_dir):
    return c.dictionary(chunked_events(spark, sf_dir), ["chunk_id"], "props", "first", "event_id").select("chunk_id", "props", "count", "code")


@query(
    EVENTS
    + """SELECT event_id, CASE WHEN ok THEN v - coalesce(lag(CASE WHEN ok THEN v END IGNORE NULLS) OVER (PARTITION BY chunk_id ORDER BY event_id), 0) END AS delta, CASE WHEN NOT ok THEN x END AS raw, x AS decoded
FROM (SELECT *, user_id AS v, event_id % 7 <> 0 AS ok, CASE WHEN event_id % 7 = 0 THEN 'u' || user_id ELSE user_id::VARCHAR END AS x FROM e)"""
)
def text_delta_fallback(spark, sf_dir):
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string"))
    rows = chunked_events(spark, sf_dir).select("chunk_id", "event_id", text.alias("text"))
    rows = c.text_delta(rows, ["chunk_id"], "event_id", values.number(F.col("text")), "text")
    return c.text_delta_decode(rows, ["chunk_id"], "event_id").select("event_id", "delta", "raw", "decoded")


@query(
    EVENTS
    + """SELECT event_id, us * 1000 - coalesce(lag(us * 1000) OVER (PARTITION BY chunk_id ORDER BY event_id), 0) AS delta, x AS decoded
FROM (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || CASE WHEN event_id % 3 = 0 THEN '+02:00' ELSE 'Z' END AS x FROM e)"""
)
def iso_column(spark, sf_dir):
    zone = F.when(F.col("event_id") % 3 == 0, "+02:00").otherwise("Z")
    rows = chunked_events(spark, sf_dir).select("chunk_id", "event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), zone).alias("text"))
    return c.time_decode(c.time_encode(rows, ["chunk_id"], "event_id", "text"), ["chunk_id"], "event_id").select("event_id", "delta", "decoded")


@query(
    """SELECT o_orderkey, s - coalesce(lag(s) OVER (PARTITION BY k ORDER BY o_orderkey), 0) AS delta, x AS decoded, dense_rank() OVER (PARTITION BY k ORDER BY z) - 1 AS format_id
FROM (SELECT o_orderkey, o_orderkey // 1000 AS k, epoch(o_orderdate)::BIGINT AS s, CASE WHEN o_orderkey % 2 = 0 THEN ' +0000' ELSE ' -0700' END AS z,
  strftime(o_orderdate, '%d/%b/%Y:%H:%M:%S') || CASE WHEN o_orderkey % 2 = 0 THEN ' +0000' ELSE ' -0700' END AS x FROM orders)"""
)
def clf_column(spark, sf_dir):
    zone = F.when(F.col("o_orderkey") % 2 == 0, " +0000").otherwise(" -0700")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.floor(F.col("o_orderkey") / 1000).alias("k"), F.concat(F.date_format("o_orderdate", "dd/MMM/yyyy:HH:mm:ss"), zone).alias("text")
    )
    rows = c.time_encode(rows, ["k"], "o_orderkey", "text", "clf")
    rows = c.format_dictionary(rows, ["k"], F.col("format.zone"), "zone")
    return c.time_decode(rows, ["k"], "o_orderkey", "clf").select("o_orderkey", "delta", "decoded", "format_id")


@query(
    EVENTS
    + """SELECT event_id, user_id - coalesce(lag(user_id) OVER (PARTITION BY chunk_id ORDER BY event_id), 0) AS delta, printf('"user_%06d",', user_id) AS decoded FROM e"""
)
def prefix_id_column(spark, sf_dir):
    rows = chunked_events(spark, sf_dir).select("chunk_id", "event_id", F.format_string('"user_%06d",', "user_id").alias("text"))
    return c.prefix_id_decode(c.prefix_id_encode(rows, ["chunk_id"], "event_id", "text"), ["chunk_id"], "event_id").select("event_id", "delta", "decoded")


def event_addresses(spark, sf_dir):
    octet = lambda m: (F.col("event_id") * m % 256).cast("string")
    text = F.concat_ws(".", F.lit("10"), (F.col("user_id") % 256).cast("string"), octet(7), octet(13))
    return chunked_events(spark, sf_dir).select("chunk_id", "event_id", text.alias("ip"))


@query(
    EVENTS
    + """, a AS (SELECT chunk_id, event_id, '10.' || user_id % 256 || '.' || event_id * 7 % 256 || '.' || event_id * 13 % 256 AS ip,
  10 * 16777216 + user_id % 256 * 65536 + event_id * 7 % 256 * 256 + event_id * 13 % 256 AS v FROM e),
w AS (SELECT *, v - min(v) OVER (PARTITION BY chunk_id) AS "offset", lag(v) OVER (PARTITION BY chunk_id ORDER BY event_id) AS before FROM a)
SELECT event_id, "offset", xor(v, coalesce(before, 0)) AS xor, CASE WHEN before IS NULL THEN 5 WHEN xor(v, before) < 256 THEN 2 WHEN xor(v, before) < 65536 THEN 3 ELSE 5 END AS xor_bytes, ip AS decoded FROM w"""
)
def ipv4_xor_delta(spark, sf_dir):
    rows = c.ipv4_encode(event_addresses(spark, sf_dir), ["chunk_id"], "event_id", "ip")
    return c.ipv4_decode(rows).select("event_id", "offset", "xor", "xor_bytes", "decoded")


URLS = """WITH p AS (SELECT page_id, page_id // 1000 AS k, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages),
s AS (SELECT page_id, k, unnest(generate_series(0, len(string_split(regexp_replace(path, '^/|/$', '', 'g'), '/')) - 1)) AS position,
  unnest(string_split(regexp_replace(path, '^/|/$', '', 'g'), '/')) AS segment FROM p WHERE path <> '' AND path <> '/')
"""


def url_paths(spark, sf_dir):
    """Paths of pages; vocabularies are those of a chunk of pages, so no window is over a whole table."""
    rows = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 1000).alias("k"), "page_id", F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("path"))
    return rows.filter("path <> '' and path <> '/'")


@query(URLS + "SELECT page_id, position, segment, dense_rank() OVER (PARTITION BY k, position ORDER BY segment) - 1 AS code FROM s")
def path_columns(spark, sf_dir):
    return c.path_encode(url_paths(spark, sf_dir), ["k"], "page_id", "path").select("page_id", F.col("position").cast("long").alias("position"), "segment", "code")


@query(URLS + "SELECT page_id, position, segment, dense_rank() OVER (PARTITION BY k ORDER BY segment) - 1 AS code FROM s")
def path_shared_dictionary(spark, sf_dir):
    return c.path_encode(url_paths(spark, sf_dir), ["k"], "page_id", "path", shared=True).select("page_id", F.col("position").cast("long").alias("position"), "segment", "code")


@query("SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS decoded FROM pages WHERE regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) NOT IN ('', '/')")
def path_decode(spark, sf_dir):
    long = c.path_encode(url_paths(spark, sf_dir), ["k"], "page_id", "path")
    return c.path_decode(long, ["k"], "page_id").select("page_id", "decoded")


def event_cells(spark, sf_dir):
    """Text columns of events in long form: chunk_id, column_id, event_id, value; absent values null."""
    rows = chunked_events(spark, sf_dir)
    octet = lambda m: (F.col("event_id") * m % 256).cast("string")
    made = {
        "event_type": F.col("event_type"), "user": F.concat(F.lit("user-"), F.col("user_id").cast("string")), "id": F.col("event_id").cast("string"),
        "ip": F.concat_ws(".", F.lit("10"), F.lit("1"), octet(7), octet(13)), "time": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "path": F.concat(F.lit("/a/"), F.col("event_type"), F.lit("/"), (F.col("user_id") % 10).cast("string")), "flag": F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"),
        "rare": F.when(F.col("event_id") % 40 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))), "props": F.col("props"),
    }
    wide = rows.select("chunk_id", "event_id", *(x.alias(n) for n, x in made.items()))
    return wide.unpivot(["chunk_id", "event_id"], list(made), "column_id", "value")


CELLS = (
    EVENTS
    + """, cells AS (SELECT chunk_id, event_id, unnest(['event_type', 'user', 'id', 'ip', 'time', 'path', 'flag', 'rare', 'props']) AS column_id,
  unnest([event_type, 'user-' || user_id, event_id::VARCHAR, '10.1.' || event_id * 7 % 256 || '.' || event_id * 13 % 256, strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '/a/' || event_type || '/' || user_id % 10,
  CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, CASE WHEN event_id % 40 = 0 THEN 'x' || event_id END, props]) AS value FROM e),
prof AS (SELECT chunk_id, column_id, count(*) AS n, count(value) AS n_present, count(*) FILTER (WHERE value = '') AS n_empty, count(DISTINCT value) AS n_distinct,
  count(*) FILTER (WHERE regexp_matches(value, '^"?[a-zA-Z][a-zA-Z0-9]*[-_]-?[0-9]+"?,?$')) AS n_prefix_id, min(CASE WHEN regexp_matches(value, '^"?[a-zA-Z][a-zA-Z0-9]*[-_]-?[0-9]+"?,?$') THEN regexp_extract(value, '([a-zA-Z][a-zA-Z0-9]*)[-_]', 1) END) AS p0,
  max(CASE WHEN regexp_matches(value, '^"?[a-zA-Z][a-zA-Z0-9]*[-_]-?[0-9]+"?,?$') THEN regexp_extract(value, '([a-zA-Z][a-zA-Z0-9]*)[-_]', 1) END) AS p1,
  count(*) FILTER (WHERE try_strptime(value, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL) AS n_iso, count(*) FILTER (WHERE regexp_matches(value, '^[0-9]{1,3}(\\.[0-9]{1,3}){3}$')) AS n_ipv4,
  count(*) FILTER (WHERE regexp_matches(value, '^(0|-?[1-9][0-9]*)$')) AS n_number, count(*) FILTER (WHERE regexp_matches(value, '^/[A-Za-z0-9_./-]*$') AND NOT contains(value, '//')) AS n_path,
  count(*) FILTER (WHERE value IN ('true', 'false')) AS n_boolean, min(CASE WHEN regexp_matches(value, '^(0|-?[1-9][0-9]*)$') THEN value::BIGINT END) AS least,
  max(CASE WHEN regexp_matches(value, '^(0|-?[1-9][0-9]*)$') THEN value::BIGINT END) AS most, coalesce(sum(strlen(value)), 0)::BIGINT AS bytes FROM cells GROUP BY ALL)
"""
)


@query(CELLS + "SELECT chunk_id, column_id, n, n_present, n_empty, n_distinct, n_prefix_id, n_iso, n_ipv4, n_number, n_path, n_boolean, least, most, bytes FROM prof")
def column_profile(spark, sf_dir):
    return c.profile(event_cells(spark, sf_dir), ["chunk_id", "column_id"]).select(
        "chunk_id", "column_id", "n", "n_present", "n_empty", "n_distinct", "n_prefix_id", "n_iso", "n_ipv4", "n_number", "n_path", "n_boolean", "least", "most", "bytes"
    )


@query(
    CELLS
    + """SELECT chunk_id, column_id, CASE WHEN n_present = 0 THEN 'RAW' WHEN n_prefix_id >= 0.9 * n_present AND p0 = p1 THEN 'PREFIX_ID' WHEN n_iso >= 0.9 * n_present THEN 'ISO'
  WHEN n_ipv4 >= 0.9 * n_present THEN 'IPV4' WHEN n_number >= 0.9 * n_present THEN 'NUMBER' WHEN n_path = n THEN 'PATH' WHEN n_distinct <= 256 THEN 'DICTIONARY' ELSE 'RAW' END AS column_type FROM prof"""
)
def column_type_choice(spark, sf_dir):
    return c.choose_type(c.profile(event_cells(spark, sf_dir), ["chunk_id", "column_id"])).select("chunk_id", "column_id", "column_type")


@query(
    EVENTS
    + """, v AS (SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY event_id) AS r, CASE WHEN regexp_matches(event_type, '^[a-zA-Z][a-zA-Z0-9]*[-_][0-9]+$') THEN 'prefix_id' ELSE 'text' END AS kind FROM e)
SELECT chunk_id, max(kind) AS kind, 1.0::DOUBLE AS share FROM v WHERE r <= 1000 GROUP BY chunk_id"""
)
def type_vote(spark, sf_dir):
    rows = chunked_events(spark, sf_dir).select("chunk_id", "event_id", F.col("event_type").alias("value"))
    return c.vote_type(rows, ["chunk_id"], "event_id")


@query(
    EVENTS
    + """SELECT chunk_id, avg(CASE WHEN value >= b THEN 1 WHEN b IS NOT NULL THEN 0 END) AS sorted_share, count(*) AS n
FROM (SELECT chunk_id, value, lag(value) OVER (PARTITION BY chunk_id ORDER BY event_id) AS b FROM e) GROUP BY chunk_id"""
)
def sortedness(spark, sf_dir):
    return c.sortedness(chunked_events(spark, sf_dir), ["chunk_id"], "event_id", "value")


def labelled_documents(spark, sf_dir):
    """quality of every document, null where no label is; the order is doc_id."""
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 1000).alias("chunk_id"), "doc_id")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("value")), "doc_id", "left")


LABELLED = """WITH d AS (SELECT doc_id // 1000 AS chunk_id, doc_id, quality AS value FROM documents LEFT JOIN labels USING (doc_id))
"""


@query(LABELLED + "SELECT doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY chunk_id ORDER BY doc_id), -1) AS step, value FROM d WHERE value IS NOT NULL")
def sparse_encode(spark, sf_dir):
    return c.sparse_encode(labelled_documents(spark, sf_dir), ["chunk_id"], "doc_id").select("doc_id", "step", "value")


@query(LABELLED + "SELECT doc_id, value FROM d")
def sparse_decode(spark, sf_dir):
    rows = labelled_documents(spark, sf_dir)
    return c.sparse_decode(c.sparse_encode(rows, ["chunk_id"], "doc_id"), rows, ["chunk_id"], "doc_id").select("doc_id", "value")


@query(LABELLED + "SELECT chunk_id, avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS absent_share, count(*) AS n, avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) > 0.5 AND count(*) > 10 AS sparse FROM d GROUP BY chunk_id")
def sparsity(spark, sf_dir):
    return c.sparsity(labelled_documents(spark, sf_dir), ["chunk_id"])


@query(
    """WITH r AS (SELECT l_returnflag, l_partkey AS v, lag(l_partkey) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 100 + l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem),
s AS (SELECT l_returnflag, count(*) AS n, count(DISTINCT v) AS n_distinct, min(v) AS least, max(v) AS most FROM r GROUP BY 1),
w AS (SELECT *, CASE WHEN most - least < 256 THEN 1 WHEN most - least < 65536 THEN 2 ELSE 4 END AS width FROM s)
SELECT l_returnflag, n, n_distinct, least, most, n * width AS binary_bytes, CAST(ceil(n * length(bin(most - least)) / 8.0) AS BIGINT) + 5 AS packed_bytes,
  n_distinct * width + n * CASE WHEN n_distinct <= 256 THEN 1 WHEN n_distinct <= 65536 THEN 2 ELSE 4 END AS dictionary_bytes FROM w"""
)
def cost_model_int(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", F.struct(F.col("l_orderkey") * 100 + F.col("l_linenumber"), "l_partkey", "l_suppkey").alias("o"))
    out = c.integer_costs(rows, ["l_returnflag"], "o", "l_partkey")
    return out.select("l_returnflag", "n", "n_distinct", "least", "most", "binary_bytes", "packed_bytes", "dictionary_bytes")


@query(
    EVENTS
    + """, p AS (SELECT chunk_id, event_type AS v, count(*) AS n FROM e GROUP BY ALL), s AS (SELECT chunk_id, sum(n)::BIGINT AS n, count(*) AS n_distinct, sum((strlen(v) + 1) * n)::BIGINT AS raw_bytes, sum(strlen(v) + 1)::BIGINT AS vocabulary_bytes FROM p GROUP BY 1)
SELECT chunk_id, n, n_distinct, raw_bytes, vocabulary_bytes + CAST(ceil(n * greatest(1, CAST(ceil(log2(n_distinct)) AS INT)) / 8.0) AS BIGINT) AS dictionary_bytes,
  CASE WHEN vocabulary_bytes + CAST(ceil(n * greatest(1, CAST(ceil(log2(n_distinct)) AS INT)) / 8.0) AS BIGINT) < 0.9 * raw_bytes THEN 'DICTIONARY' ELSE 'RAW' END AS by_cost, CASE WHEN n_distinct / n < 0.3 THEN 'DICTIONARY' ELSE 'RAW' END AS by_share FROM s"""
)
def cost_model_text(spark, sf_dir):
    out = c.string_costs(chunked_events(spark, sf_dir), ["chunk_id"], "event_type")
    return out.select("chunk_id", "n", "n_distinct", "raw_bytes", "dictionary_bytes", "by_cost", "by_share")


@query(EVENTS + "SELECT chunk_id, count(*) AS n, count(DISTINCT user_id) AS n_distinct, min(user_id) AS least, max(user_id) AS most, 1 AS n_widths FROM e GROUP BY chunk_id")
def cost_model_prefix(spark, sf_dir):
    rows = chunked_events(spark, sf_dir).select("chunk_id", "event_id", F.format_string("req-%08d", "user_id").alias("v"))
    return c.prefix_costs(rows, ["chunk_id"], "event_id", "v").select("chunk_id", "n", "n_distinct", "least", "most", F.col("n_widths").cast("int").alias("n_widths"))


@query(EVENTS + "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 5 = 1 THEN 1 ELSE 2 END AS presence, CASE WHEN event_id % 5 > 1 THEN event_id % 2 = 0 END AS bit, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'null' WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS decoded FROM e")
def boolean_column(spark, sf_dir):
    flag = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 5 == 1, "null").when(F.col("event_id") % 2 == 0, "true").otherwise("false")
    rows = c.boolean_encode(chunked_events(spark, sf_dir).select("event_id", flag.alias("v")), "v")
    return c.boolean_decode(rows).select("event_id", "presence", "bit", "decoded")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'UUID' WHEN doc_id % 3 = 1 THEN 'HEX' ELSE 'RAW' END AS shape, x AS decoded FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0
  THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) WHEN doc_id % 3 = 1 THEN h ELSE upper(h) || 'Z' END AS x FROM (SELECT doc_id, md5(text) AS h FROM documents))"""
)
def binary_column(spark, sf_dir):
    h = F.md5(F.encode("text", "UTF-8"))
    uuid = F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    text = F.when(F.col("doc_id") % 3 == 0, uuid).when(F.col("doc_id") % 3 == 1, h).otherwise(F.concat(F.upper(h), F.lit("Z")))
    rows = c.binary_encode(table(spark, sf_dir, "documents").select("doc_id", text.alias("v")), "v")
    return c.binary_decode(rows).select("doc_id", "shape", "decoded")


def optional_cells(spark, sf_dir):
    """Present cells of four optional columns of events."""
    rows = chunked_events(spark, sf_dir)
    cells = rows.select("chunk_id", "event_id", F.explode(F.array(
        F.lit("a"), F.when(F.col("event_id") % 2 == 0, "b"), F.when(F.col("event_id") % 2 == 0, "c"), F.when(F.col("event_id") % 30 == 0, "d"),
    )).alias("column_id"))
    return rows, cells.filter("column_id is not null")


OPTIONAL = (
    EVENTS
    + """, cells AS (SELECT chunk_id, event_id, unnest(CASE WHEN event_id % 30 = 0 THEN ['a', 'b', 'c', 'd'] WHEN event_id % 2 = 0 THEN ['a', 'b', 'c'] ELSE ['a'] END) AS column_id FROM e)
"""
)


@query(
    OPTIONAL
    + """, p AS (SELECT chunk_id, column_id, list(event_id ORDER BY event_id) AS places FROM cells GROUP BY ALL)
SELECT chunk_id, len(places) AS n_rows, string_agg(column_id, ',' ORDER BY column_id) AS columns FROM p GROUP BY chunk_id, places"""
)
def presence_groups(spark, sf_dir):
    out = c.presence_groups(optional_cells(spark, sf_dir)[1], ["chunk_id"], "column_id", "event_id")
    return out.select("chunk_id", "n_rows", F.array_join("columns", ",").alias("columns"))


@query(
    OPTIONAL
    + """, p AS (SELECT chunk_id, event_id, string_agg(column_id, ',' ORDER BY column_id) AS columns FROM cells GROUP BY ALL), t AS (SELECT chunk_id, columns, count(*) AS n_rows, min(event_id) AS first_row FROM p GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY n_rows DESC, first_row) - 1 AS template_id FROM t"""
)
def row_key_templates(spark, sf_dir):
    out = c.row_templates(optional_cells(spark, sf_dir)[1], ["chunk_id"], "column_id", "event_id")
    return out.select("chunk_id", F.array_join("columns", ",").alias("columns"), "n_rows", "first_row", F.col("template_id").cast("long").alias("template_id"))


@query(OPTIONAL + "SELECT chunk_id, column_id, count(*) / n AS present_share, count(*) / n < 0.05 AS rare FROM cells JOIN (SELECT chunk_id, count(*) AS n FROM e GROUP BY 1) USING (chunk_id) GROUP BY chunk_id, column_id, n")
def rare_columns(spark, sf_dir):
    rows, cells = optional_cells(spark, sf_dir)
    return c.rare_columns(cells, rows, ["chunk_id"], "column_id")
