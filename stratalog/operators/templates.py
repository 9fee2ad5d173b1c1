"""Message templates: whitespace-exact tokenising, an exact-match miner in SQL, and a similarity miner.

White space is kept beside the tokens as gaps, so any line comes back as it was; `mark_spaces` is the
single-text form of the same. The similarity miner walks the lines of a scope in order and keeps, per
first token and token count, the clusters found so far: a line joins the first cluster with enough
equal literal tokens, whose differing tokens turn into variables, or opens a new one. It streams over
sorted partitions and holds clusters only, never a group of lines; scopes (stream and chunk by
default) are mined in parallel and their templates merged afterwards."""

from __future__ import annotations

import re
from operator import eq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.functions.values import VARIABLE_TOKENS, is_variable_token
from stratalog.operators.parse import tokens

WILDCARD = "<*>"
MARK = "\x1e"
SIMILARITY, MAX_CLUSTERS = 0.4, 500
WORD = r"[^ \t\n\x0B\f\r]+"


def split_spaces(line: Column) -> Column:
    """struct(tokens, gaps): the words of a line and the white space before, between and after them."""
    return F.struct(tokens(line).alias("tokens"), F.split(line, WORD, -1).alias("gaps"))


def join_spaces(words: Column, gaps: Column) -> Column:
    return F.array_join(F.zip_with(gaps, words, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def canonical_gaps(n_tokens: Column) -> Column:
    """The gaps of a line with single spaces between its words."""
    inner = F.transform(F.sequence(F.lit(0), n_tokens), lambda i: F.when((i == 0) | (i == n_tokens), "").otherwise(" "))
    return inner


def mark_spaces(line: Column) -> Column:
    """The line with runs of spaces, leading tabs, trailing spaces and a carriage return as marks: the
    mark character and a digit for up to nine spaces, T and R for tabs and returns. A mark character
    of the line itself becomes mark and 0, so that restoring is exact for every line."""
    m = F.lit(MARK)
    pieces = F.regexp_extract_all(line, F.lit(r"(?s)^\t+| {2,}| +$|\r$|\x1E|[^ \x1E\r]+|."), F.lit(0))

    def spaces(n: Column) -> Column:
        return F.concat(F.repeat(F.lit(f"{MARK}9"), F.floor(n / 9).cast("int")), F.when(n % 9 > 0, F.concat(m, (n % 9).cast("string"))).otherwise(""))

    def piece(p: Column, i: Column) -> Column:
        size = F.length(p)
        last = i == F.size(pieces) - 1
        tabs = (i == 0) & p.rlike(r"^\t+$")
        return (
            F.when(p == MARK, F.lit(f"{MARK}0"))
            .when(tabs, F.concat(m, F.lit("T"), size.cast("string"), m))
            .when(p.rlike("^ {2,}$") | ((p == " ") & last), spaces(size))
            .when((p == "\r") & last, F.lit(f"{MARK}R"))
            .otherwise(p)
        )

    return F.array_join(F.transform(pieces, piece), "")


def restore_spaces(marked: Column) -> Column:
    pieces = F.regexp_extract_all(marked, F.lit(r"(?s)^\x1ET[0-9]+\x1E|\x1E[0-9R]|[^\x1E]+|\x1E"), F.lit(0))

    def piece(p: Column) -> Column:
        tabs = F.regexp_extract(p, r"^\x1ET([0-9]+)\x1E$", 1)
        return (
            F.when(p == f"{MARK}0", MARK)
            .when(p == f"{MARK}R", "\r")
            .when(F.length(tabs) > 0, F.repeat(F.lit("\t"), tabs.try_cast("int")))
            .when(p.rlike(r"^\x1E[1-9]$"), F.repeat(F.lit(" "), F.substring(p, 2, 1).try_cast("int")))
            .otherwise(p)
        )

    return F.array_join(F.transform(pieces, piece), "")


def _hole(token: Column) -> Column:
    """A word that a template leaves open; one that reads like a wildcard is a value, too."""
    return is_variable_token(token) | (token == WILDCARD)


def token_template(line: Column) -> Column:
    """The line's words with every variable one as a wildcard, joined by single spaces."""
    return F.array_join(F.transform(tokens(line), lambda t: F.when(_hole(t), WILDCARD).otherwise(t)), " ")


def token_variables(line: Column) -> Column:
    return F.filter(tokens(line), _hole)


def fill(template: Column, variables: Column) -> Column:
    """A template's wildcards, words of their own, filled with the variables in order."""
    parts = F.split(template, r"(?<![^ ])<\*>(?![^ ])", -1)
    return F.array_join(F.zip_with(parts, F.coalesce(variables, F.expr("cast(array() as array<string>)")), lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")


def exact_match_mine(lines: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """lines with template, template_id (by first appearance; null over the cap or for blank lines),
    variables, gaps (null where single spaces) and raw (lines without a template). Pure SQL: lines
    with equal words outside of their variables share a template."""
    words = split_spaces(F.col("line"))
    rows = lines.withColumn("_w", words)
    n = F.size("_w.tokens")
    rows = rows.withColumn("template", F.when(n > 0, token_template(F.col("line")))).withColumn("variables", token_variables(F.col("line")))
    rows = rows.withColumn("gaps", F.when(F.col("_w.gaps") != canonical_gaps(n), F.col("_w.gaps"))).drop("_w")
    found = rows.filter("template is not null").groupBy(*keys, "template").agg(F.min("line_no").alias("_first"))
    ids = found.withColumn("template_id", F.row_number().over(W.partitionBy(*keys).orderBy("_first", "template")) - 1).filter(F.col("template_id") < most).drop("_first")
    out = rows.join(ids, [*keys, "template"], "left")
    return out.withColumn("raw", F.when(F.col("template_id").isNull(), F.col("line")))


def restore_line(template: Column, variables: Column, gaps: Column, raw: Column) -> Column:
    """The line again, from exact_match_mine's columns."""
    filled = fill(template, variables)  # variables hold no white space, so the words can be cut again
    return F.coalesce(raw, F.when(gaps.isNull(), filled).otherwise(join_spaces(F.split(filled, " ", -1), gaps)))


_WORDS = re.compile(WORD)


def words_of(line: str | None) -> list[str]:
    """tokens() of one line."""
    return _WORDS.findall(line) if line else []


class Miner:
    """The clusters of one scope. add(words) gives (cluster, is_new), or None over the cap."""

    def __init__(self, similarity: float = SIMILARITY, most: int = MAX_CLUSTERS):
        self.similarity, self.most = similarity, most
        self.tests = [re.compile(p) for p in VARIABLE_TOKENS.values()]
        self.known: dict[str, bool] = {}
        self.clusters: list[list] = []  # words, None for variables
        self.literal: list[int] = []  # how many words aren't None
        self.groups: dict[tuple, list[int]] = {}

    def variable(self, word: str) -> bool:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[word] = word == WILDCARD or any(t.match(word) for t in self.tests)
        return found

    def add(self, words: list[str]):
        if not words:
            return None
        key = (None if self.variable(words[0]) else words[0], len(words))
        own, least = self.groups.setdefault(key, []), self.similarity * len(words)
        for k in own:
            cluster = self.clusters[k]
            same = sum(map(eq, cluster, words))
            if same >= least:
                if same < self.literal[k]:
                    self.clusters[k] = [a if a == b else None for a, b in zip(cluster, words)]
                    self.literal[k] = same
                return k
        if len(self.clusters) >= self.most:
            return None
        self.clusters.append([None if self.variable(w) else w for w in words])
        self.literal.append(len(words) - self.clusters[-1].count(None))
        own.append(len(self.clusters) - 1)
        return len(self.clusters) - 1


def mine(lines: DataFrame, scope: list[str] | None = None, similarity: float = SIMILARITY, most: int = MAX_CLUSTERS, line: bool = False) -> DataFrame:
    """scope, line_no and cluster (null for blank lines and over the cap) and, on one row a cluster,
    its final words in `pattern` (null otherwise); with line, the lines as well."""
    from pyspark.sql import types as T

    scope = ["stream_id", "chunk_id"] if scope is None else scope
    fields = [lines.schema[c] for c in scope]
    text = [T.StructField("line", T.StringType())] if line else []
    schema = T.StructType([*fields, T.StructField("line_no", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("pattern", T.ArrayType(T.StringType())), *text])
    rows = lines.select(*scope, "line_no", "line")
    rows = rows.repartition(*scope).sortWithinPartitions(*scope, "line_no")

    def run(batches):
        import pyarrow as pa

        kinds = [pa.field(f.name, batch_type(f.dataType)) for f in fields]
        out_schema = pa.schema([*kinds, ("line_no", pa.int64()), ("cluster", pa.int32()), ("pattern", pa.list_(pa.string())), *([("line", pa.string())] if line else [])])
        now, miner = None, None

        def patterns():
            return [(*now, None, k, ["<*>" if w is None else w for w in c], *([None] if line else [])) for k, c in enumerate(miner.clusters)] if miner else []

        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*scope, "line_no", "line"))):
                key = row[:-2]
                if key != now or miner is None:
                    out += patterns()
                    now, miner = key, Miner(similarity, most)
                out.append((*key, row[-2], miner.add(words_of(row[-1])), None, *([row[-1]] if line else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), out_schema)], schema=out_schema)
        last = patterns()
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*last), out_schema)], schema=out_schema)

    def batch_type(kind):
        import pyarrow as pa

        return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind.simpleString()]

    return rows.mapInArrow(run, schema)


def templates_of(mined: DataFrame, scope: list[str]) -> DataFrame:
    """scope, cluster, template, n_variables, template_id: the id is a hash of the template's text, so
    equal templates of all scopes and batches have equal ids without being collected or ranked."""
    found = mined.filter("pattern is not null").select(*scope, "cluster", F.array_join("pattern", " ").alias("template"), F.size(F.filter("pattern", lambda w: w == WILDCARD)).alias("n_variables"))
    return found.withColumn("template_id", F.xxhash64("template"))


def encode_text(lines: DataFrame, scope: list[str] | None = None, similarity: float = SIMILARITY, most: int = MAX_CLUSTERS) -> tuple[DataFrame, DataFrame]:
    """(rows, templates): rows are scope, line_no, cluster, variables, gaps and raw. Variables come
    from the final template of a line's cluster; a line that the template doesn't give back is raw."""
    scope = ["stream_id", "chunk_id"] if scope is None else scope
    mined = mine(lines, scope, similarity, most, line=True)
    templates = templates_of(mined, scope)
    rows = mined.filter("line_no is not null").select(*scope, "line_no", "line", "cluster").join(templates.select(*scope, "cluster", "template", "template_id"), [*scope, "cluster"], "left")
    parts = split_spaces(F.col("line"))
    rows = rows.withColumn("_w", parts).withColumn("_t", F.split("template", " ", -1))
    fits = F.col("template").isNotNull() & (F.size("_t") == F.size("_w.tokens"))
    holes = F.filter(F.zip_with("_t", "_w.tokens", lambda t, w: F.when(t == WILDCARD, F.coalesce(w, F.lit("")))), lambda v: v.isNotNull())
    rows = rows.withColumn("variables", F.when(fits, holes))
    rows = rows.withColumn("gaps", F.when(fits & (F.col("_w.gaps") != canonical_gaps(F.size("_w.tokens"))), F.col("_w.gaps")))
    back = restore_line(F.col("template"), F.col("variables"), F.col("gaps"), F.lit(None).cast("string"))
    rows = rows.withColumn("raw", F.when(fits & back.eqNullSafe(F.col("line")), F.lit(None).cast("string")).otherwise(F.col("line")))
    kept = F.col("raw").isNull()
    rows = rows.select(*scope, "line_no", F.when(kept, F.col("cluster")).alias("cluster"), F.when(kept, F.col("variables")).alias("variables"), F.when(kept, F.col("gaps")).alias("gaps"), "raw")
    return rows, templates


def decode_text(rows: DataFrame, templates: DataFrame, scope: list[str] | None = None) -> DataFrame:
    scope = ["stream_id", "chunk_id"] if scope is None else scope
    joined = rows.join(templates.select(*scope, "cluster", "template"), [*scope, "cluster"], "left")
    return joined.select(*scope, "line_no", restore_line(F.col("template"), F.col("variables"), F.col("gaps"), F.col("raw")).alias("line"))


def merge_templates(templates: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Templates of many scopes mined once more as lines of one: template and merged. Their number is
    bounded by the cap times the scopes; groups of equal first word and length are mined in parallel."""
    words = F.split("template", " ", -1)
    rows = templates.select("template").distinct()
    rows = rows.withColumn("stream_id", F.concat_ws("\t", F.size(words).cast("string"), F.get(words, F.lit(0))))
    rows = rows.withColumn("line_no", F.row_number().over(W.partitionBy("stream_id").orderBy("template")).cast("long")).withColumn("line", F.col("template"))
    mined = mine(rows.select("stream_id", "line_no", "line"), ["stream_id"], similarity)
    merged = mined.filter("pattern is not null").select("stream_id", "cluster", F.array_join("pattern", " ").alias("merged"))
    places = mined.filter("line_no is not null").select("stream_id", "line_no", "cluster")
    return rows.join(places, ["stream_id", "line_no"]).join(merged, ["stream_id", "cluster"], "left").select("template", F.coalesce("merged", "template").alias("merged"))


def local_ids(rows: DataFrame, scope: list[str], template_id: str = "template_id") -> DataFrame:
    """Template ids of a scope numbered from 0 in their order."""
    return rows.withColumn("local_id", F.when(F.col(template_id).isNotNull(), F.dense_rank().over(W.partitionBy(*scope).orderBy(F.col(template_id).asc_nulls_last())) - 1))


def new_templates(rows: DataFrame, stream: str = "stream_id", template: str = "template") -> DataFrame:
    """stream, template, chunk_id: the chunk in which each template is first written."""
    return rows.filter(F.col(template).isNotNull()).groupBy(stream, template).agg(F.min("chunk_id").alias("chunk_id"))


def variable_report(rows: DataFrame, keys: list[str], variables: str = "variables") -> DataFrame:
    """One row a template and position: count, distinct values and the kinds of the values."""
    from stratalog.functions.values import kind

    long = rows.select(*keys, F.posexplode(variables).alias("position", "value"))
    return long.groupBy(*keys, "position").agg(
        F.count("*").alias("n"), F.count_distinct("value").alias("n_distinct"), F.array_sort(F.collect_set(kind(F.col("value")))).alias("kinds")
    )


def field_template(value: Column) -> Column:
    """Words and numbers of a path or id as <S> and <N>."""
    return F.regexp_replace(F.regexp_replace(value, "[0-9]+", "<N>"), r"(?<=/)[A-Za-z_-]+(?=/|$)", "<S>")


def endpoint_template(values_: DataFrame, keys: list[str], value: str, share: float = 0.8) -> DataFrame:
    """keys with the template that share of a column's values have, null if none."""
    counts = values_.groupBy(*keys, field_template(F.col(value)).alias("template")).count()
    total = F.sum("count").over(W.partitionBy(*keys))
    best = counts.withColumn("share", F.col("count") / total).groupBy(*keys).agg(F.max(F.struct("share", "template")).alias("b"))
    return best.select(*keys, F.when(F.col("b.share") >= share, F.col("b.template")).alias("template"), F.col("b.share").alias("share"))


def sort_by_template(rows: DataFrame, scope: list[str]) -> DataFrame:
    """rows with sorted_no, their place when a scope is sorted by template and first variable."""
    w = W.partitionBy(*scope).orderBy("template_id", F.get("variables", F.lit(0)), "line_no")
    return rows.withColumn("sorted_no", F.row_number().over(w) - 1)


def positions_as_columns(rows: DataFrame, keys: list[str], variables: str = "variables") -> DataFrame:
    """Cells in long form: keys, column_id (the position), value."""
    return rows.select(*keys, F.posexplode(variables).alias("position", "value")).withColumn("column_id", F.concat(F.lit("v"), F.col("position").cast("string"))).drop("position")
