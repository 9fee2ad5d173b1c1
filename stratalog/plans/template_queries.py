"""Queries over templates and their variables, and the similarity miners against recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.catalog import LINES, document_lines, query, table
from stratalog.operators import parse, similar, templates
from stratalog.plans.line_queries import TOKENS, document_chunks, spread_events

#: The test of a variable word, out of the SQL of templates.
VARIABLE = TOKENS[TOKENS.index("CASE WHEN ") + 10 : TOKENS.index(" THEN '<*>'")]
VALUES = TOKENS + f""", v AS (SELECT stream_id, line_no, line, template, list_filter(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+'), lambda w: ({VARIABLE}) OR w = '<*>') AS vars FROM t)
"""


def mined(spark, sf_dir):
    """Documents' lines with templates, in chunks of five lines."""
    rows = templates.exact_match_mine(document_lines(spark, sf_dir), ["stream_id"])
    return rows.withColumn("chunk_id", F.floor(F.col("line_no") / 5))


#: The same, ids by first appearance in a stream.
MINED = VALUES + """, f AS (SELECT *, line_no // 5 AS chunk_id, min(line_no) OVER (PARTITION BY stream_id, template) AS f FROM v WHERE template <> ''),
m AS (SELECT stream_id, line_no, chunk_id, template, vars, dense_rank() OVER (PARTITION BY stream_id ORDER BY f) - 1 AS template_id FROM f
  UNION ALL SELECT stream_id, line_no, line_no // 5, NULL, vars, NULL FROM v WHERE template = '')
"""


@query(VALUES + "SELECT stream_id, line_no, 'v' || i AS column_id, vars[i + 1] AS value FROM (SELECT stream_id, line_no, vars, unnest(generate_series(0, len(vars) - 1)) AS i FROM v WHERE len(vars) > 0)")
def variable_positions(spark, sf_dir):
    """Lines' variables as columns by position."""
    return templates.positions_as_columns(mined(spark, sf_dir), ["stream_id", "line_no"]).select("stream_id", "line_no", "column_id", "value")


@query(VALUES + ", l AS (SELECT template, i AS position, vars[i + 1] AS value FROM (SELECT template, vars, unnest(generate_series(0, len(vars) - 1)) AS i FROM v WHERE len(vars) > 0 AND template <> '')) SELECT template, position, count(*) AS n, count(DISTINCT value) AS n_distinct, bool_and(regexp_matches(value, '^(0|-?[1-9][0-9]*)$')) AS numbers FROM l GROUP BY ALL")
def variable_kinds(spark, sf_dir):
    """By template and position: values, distinct ones, and whether all are numbers."""
    rows = mined(spark, sf_dir).filter("template is not null")
    out = templates.variable_report(rows, ["template"])
    return out.select("template", F.col("position").cast("long").alias("position"), "n", "n_distinct", (F.col("kinds") == F.array(F.lit("number"))).alias("numbers"))


@query(MINED + "SELECT stream_id, line_no, dense_rank() OVER (PARTITION BY stream_id, chunk_id ORDER BY template_id) - 1 AS local_id FROM m WHERE template_id IS NOT NULL UNION ALL SELECT stream_id, line_no, NULL FROM m WHERE template_id IS NULL")
def local_template_ids(spark, sf_dir):
    """Template ids numbered anew in every chunk."""
    return templates.local_ids(mined(spark, sf_dir), ["stream_id", "chunk_id"]).select("stream_id", "line_no", F.col("local_id").cast("long").alias("local_id"))


@query(MINED + "SELECT stream_id, template, min(chunk_id) AS chunk_id FROM m WHERE template IS NOT NULL GROUP BY ALL")
def first_written(spark, sf_dir):
    """The chunk in which each template of a stream is written, once."""
    return templates.new_templates(mined(spark, sf_dir))


@query(MINED + "SELECT stream_id, line_no, row_number() OVER (PARTITION BY stream_id ORDER BY template_id NULLS FIRST, vars[1] NULLS FIRST, line_no) - 1 AS sorted_no FROM m")
def sorted_by_template(spark, sf_dir):
    """Each line's place when a stream is sorted by template and first variable."""
    return templates.sort_by_template(mined(spark, sf_dir), ["stream_id"]).select("stream_id", "line_no", F.col("sorted_no").cast("long").alias("sorted_no"))


@query(
    """WITH h AS (SELECT page_id % 10 AS k, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages), d AS (SELECT k, regexp_replace(path, '[0-9]+', '<N>', 'g') AS p FROM h),
s AS (SELECT k, list_transform(string_split(p, '/'), lambda x, i: CASE WHEN i > 1 AND regexp_matches(x, '^[A-Za-z_-]+$') THEN '<S>' ELSE x END) AS l FROM d), t AS (SELECT k, array_to_string(l, '/') AS template FROM s),
c AS (SELECT k, template, count(*) AS n FROM t GROUP BY ALL), b AS (SELECT *, n / sum(n) OVER (PARTITION BY k) AS share FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY share DESC, template DESC) AS o FROM b)
SELECT k, CASE WHEN share >= 0.8 THEN template END AS template, share FROM r WHERE o = 1"""
)
def endpoint_template(spark, sf_dir):
    """The template that most paths of a group of pages have, over all pages."""
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("k"), F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("path"))
    return templates.endpoint_template(rows, ["k"], "path")


#: A typed value, and the word character after it that makes it none.
TYPED = "'(?:^|[^A-Za-z0-9_<])((?:" + "|".join(p for _, p in parse.MASKS) + "))([A-Za-z0-9_>]?)'"


@query(
    LINES
    + "SELECT type, count(*) AS n_values, count(DISTINCT v) AS n_distinct, sum(strlen(v))::BIGINT AS bytes FROM (SELECT v, CASE "
    + " ".join(f"WHEN regexp_matches(v, '^(?:{p})$') THEN '{n}'" for n, p in parse.MASKS)
    + f" END AS type FROM (SELECT unnest(regexp_extract_all(line, {TYPED}, 1)) AS v, unnest(regexp_extract_all(line, {TYPED}, 2)) AS after FROM lines) WHERE after = '') GROUP BY 1"
)
def variable_streams(spark, sf_dir):
    """All typed values of documents' lines as one stream a type."""
    rows = document_lines(spark, sf_dir).select(F.lit(0).alias("k"), parse.typed_variables(F.col("line")).alias("variables"))
    return parse.variables_by_type(rows, ["k"]).drop("k")


VARIES = f"(({VARIABLE}) OR w = '<*>')"


def mining_sql(rows: str, state: str) -> str:
    """The miner's rule as a recursion over the lines of all scopes at once. rows: a table of scope, k (1, 2,
    ...) and words. A scope's state: its clusters (first: the first word unless it varies; words: null
    where they vary) and the cluster that each line joined."""
    return f"""{state}(scope, k, clusters, joined) USING KEY (scope) AS (
  SELECT DISTINCT scope, 0::BIGINT, []::STRUCT(first VARCHAR, words VARCHAR[])[], []::BIGINT[] FROM {rows}
  UNION SELECT scope, k, CASE WHEN len(words) = 0 THEN clusters
    WHEN hit IS NOT NULL THEN list_transform(clusters, lambda x, i: CASE WHEN i = hit THEN {{'first': x.first, 'words': list_transform(x.words, lambda y, j: CASE WHEN y = words[j] THEN y END)}} ELSE x END)
    WHEN len(clusters) >= 500 THEN clusters ELSE list_append(clusters, {{'first': literal[1], 'words': literal}}) END,
    list_append(joined, CASE WHEN len(words) = 0 THEN NULL WHEN hit IS NOT NULL THEN hit WHEN len(clusters) < 500 THEN len(clusters) + 1 END)
  FROM (SELECT m.scope, p.k, m.clusters, m.joined, p.words, p.literal, list_min(list_filter(list_transform(m.clusters, lambda x, i:
      CASE WHEN x.first IS NOT DISTINCT FROM p.literal[1] AND len(x.words) = len(p.words) AND len(list_filter(list_transform(x.words, lambda y, j: y = p.words[j]), lambda z: z)) >= 0.4 * len(p.words) THEN i END), lambda i: i IS NOT NULL)) AS hit
    FROM {state} m JOIN (SELECT *, list_transform(words, lambda w: CASE WHEN {VARIES} THEN NULL ELSE w END) AS literal FROM {rows}) p ON p.scope = m.scope AND p.k = m.k + 1))"""


DRAIN = (
    LINES.replace("WITH lines", "WITH RECURSIVE lines", 1)
    + """, w AS (SELECT 's' || stream_id::BIGINT % 10 || ' ' || stream_id::BIGINT // 500 AS scope, stream_id::BIGINT * 100000 + line_no AS line_no, regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+') AS words FROM lines),
p AS (SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY line_no) AS k, words FROM w),
"""
    + mining_sql("p", "m")
    + """,
found AS (SELECT split_part(scope, ' ', 1) AS stream_id, split_part(scope, ' ', 2)::BIGINT AS chunk_id, i - 1 AS cluster, array_to_string(list_transform(x.words, lambda y: coalesce(y, '<*>')), ' ') AS template, len(list_filter(x.words, lambda y: y IS NULL)) AS n_variables
  FROM (SELECT scope, unnest(clusters) AS x, unnest(generate_series(1, len(clusters))) AS i FROM m WHERE len(clusters) > 0))
"""
)


@query(DRAIN + "SELECT * FROM found")
def drain_templates(spark, sf_dir):
    found = templates.templates_of(templates.mine(document_chunks(spark, sf_dir)), ["stream_id", "chunk_id"])
    return found.select("stream_id", "chunk_id", "cluster", "template", F.col("n_variables").cast("long").alias("n_variables"))


@query(
    DRAIN
    + """, t AS (SELECT DISTINCT template, string_split(template, ' ') AS words FROM found), q AS (SELECT template, words, len(words) || chr(9) || words[1] AS scope, row_number() OVER (PARTITION BY len(words), words[1] ORDER BY template) AS k FROM t),
"""
    + mining_sql("q", "n")
    + """
SELECT q.template, coalesce(array_to_string(list_transform(n.clusters[n.joined[q.k]].words, lambda y: coalesce(y, '<*>')), ' '), q.template) AS merged FROM q JOIN n ON n.scope = q.scope"""
)
def merged_templates(spark, sf_dir):
    """Templates of all chunks, mined once more."""
    found = templates.templates_of(templates.mine(document_chunks(spark, sf_dir)), ["stream_id", "chunk_id"])
    return templates.merge_templates(found)


SPREAD = """WITH l AS (SELECT event_id // 500 AS chunk_id, event_id AS line_no, 'user ' || lpad(user_id::VARCHAR, 5, '0') || ' did ' || event_type || ' ' || event_id AS line FROM events),
"""
SIMILAR = "list_sum(list_transform(generate_series(1, greatest(length(line), length(x.line))), lambda i: CASE WHEN i <= least(length(line), length(x.line)) AND substr(line, i, 1) = substr(x.line, i, 1) THEN 1 ELSE 0 END)) / greatest(length(line), length(x.line))"


@query(
    SPREAD
    + f"""w AS (SELECT *, list({{'line_no': line_no, 'line': line}}) OVER (PARTITION BY chunk_id, length(line) ORDER BY line_no ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS recent FROM l),
s AS (SELECT line_no, line, list_transform(list_reverse(coalesce(recent, [])), lambda x: {{'line_no': x.line_no, 'line': x.line, 's': {SIMILAR}}}) AS found FROM w),
b AS (SELECT line_no, line, list_filter(found, lambda x: x.s >= 0.85)[1] AS best FROM s)
SELECT line_no, best.line_no AS reference, best.s AS similarity, line AS restored FROM b"""
)
def xor_window(spark, sf_dir):
    """Lines against the most recent similar line of their length, and the lines again."""
    rows = similar.xor_lines(similar.reference_lines(spread_events(spark, sf_dir), ["chunk_id"]))
    back = similar.unxor(F.col("xor"), F.col("reference_line"), F.length("line"))
    return rows.select("line_no", "reference", "similarity", F.when(F.col("reference").isNotNull(), back).otherwise(F.col("line")).alias("restored"))


@query(
    SPREAD
    + f"""e AS (SELECT chunk_id, line_no, line, length(line) // 32 AS own, unnest([length(line) // 32 - 1, length(line) // 32, length(line) // 32 + 1]) AS bucket FROM l),
w AS (SELECT *, list({{'line_no': line_no, 'line': line}}) OVER (PARTITION BY chunk_id, bucket ORDER BY line_no ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING) AS recent FROM e),
s AS (SELECT line_no, unnest(list_transform(coalesce(recent, []), lambda x: {{'line_no': x.line_no, 's': {SIMILAR}}})) AS x FROM w WHERE bucket = own),
b AS (SELECT line_no, x.line_no AS reference, x.s AS similarity, row_number() OVER (PARTITION BY line_no ORDER BY x.s DESC, x.line_no DESC) AS r FROM s)
SELECT l.line_no, CASE WHEN similarity >= 0.5 THEN reference END AS reference, CASE WHEN similarity >= 0.5 THEN similarity END AS similarity FROM l LEFT JOIN (SELECT * FROM b WHERE r = 1) USING (line_no)"""
)
def xor_bucket_window(spark, sf_dir):
    rows = similar.bucketed_reference_lines(spread_events(spark, sf_dir), ["chunk_id"])
    return rows.select("line_no", "reference", "similarity")
