"""Classifying lines and files, and parsing known line formats, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The formats of known log lines, and the masks of typed templates in their order.
ACCESS = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "(?:(\S+) (\S+) (\S+)|([^"]*))" ([0-9]{3}) ([0-9]+|-)(?: "([^"]*)" "([^"]*)")?$'
BLOCK_LOG = r"^([0-9]{6,8}) ([0-9]{6}) ([0-9]+) ([A-Z]+) ([^:\s]+): (.*)$"
SYSLOG = r"^([A-Z][a-z]{2} [ 0-9][0-9] [0-9]{2}:[0-9]{2}:[0-9]{2}) (\S+) ([^\[:\s]+(?:\([^)]*\))?)(?:\[([0-9]+)\])?: (.*)$"
MASKS = [
    ("IP", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?"),
    ("UUID", r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    ("BLK", r"blk_-?[0-9]+"),
    ("HEX", r"0x[0-9a-fA-F]+"),
    ("BIGINT", r"[0-9]{6,}"),
    ("FLOAT", r"[0-9]+\.[0-9]+"),
    ("INT", r"[0-9]+"),
]


def json_like(line: Column) -> Column:
    """An object by its looks: braces around it, and no escapes by number (they wouldn't print back)."""
    t = F.trim(line)
    return F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}")) & ~F.contains(line, F.lit("\\u"))


def is_json(line: Column) -> Column:
    """An object that parses; anything else, arrays included, is text."""
    return F.coalesce(json_like(line) & F.try_parse_json(F.trim(line)).isNotNull(), F.lit(False))


def is_json_or_array(line: Column) -> Column:
    t = F.trim(line)
    shape = (F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}"))) | (t.rlike(r'^\[\s*(\]|[{\["0-9tfn-])') & F.endswith(t, F.lit("]")))
    return F.coalesce(shape & F.try_parse_json(t).isNotNull(), F.lit(False))


def line_format(line: Column) -> Column:
    return F.when(is_json(line), "JSON").otherwise("TEXT")


def chunk_type(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """keys with the numbers of JSON and text lines and what the chunk is: JSON, TEXT or MIXED."""
    out = lines.groupBy(*keys).agg(F.count_if(is_json(F.col(line))).alias("n_json"), F.count("*").alias("n_lines"))
    return out.withColumn("n_text", F.col("n_lines") - F.col("n_json")).withColumn(
        "chunk_type", F.when(F.col("n_text") == 0, "JSON").when(F.col("n_json") == 0, "TEXT").otherwise("MIXED")
    )


def format_vote(lines: DataFrame, sample: int = 100, share: float = 0.5, line: str = "line") -> DataFrame:
    """stream_id with the format of its first lines: JSON if more than share of them are."""
    first = lines.filter(F.col("line_no") < sample).groupBy("stream_id").agg(F.avg(is_json(F.col(line)).cast("double")).alias("json_share"))
    return first.withColumn("format", F.when(F.col("json_share") > share, "JSON").otherwise("TEXT"))


def json_depth(text: Column) -> Column:
    """The deepest nesting of a JSON text: brackets outside of strings."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "")
    marks = F.regexp_extract_all(bare, F.lit(r"[\[{}\]]"), F.lit(0))
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, m: Column) -> Column:
        now = s["now"] + F.when(m.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(marks, state, step, lambda s: s["most"])


def stream_kind(lines: DataFrame, sample: int = 100, line: str = "line") -> DataFrame:
    """stream_id with the shares of known formats among its first lines, and the kind they make:
    json_nested, json_flat, access, blocks, syslog or generic."""
    x = F.col(line)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    found = lines.filter(F.col("line_no") < sample).groupBy("stream_id").agg(
        share(is_json(x)).alias("json_share"), F.max(F.when(is_json(x), json_depth(x)).otherwise(0)).alias("depth"),
        share(x.rlike(ACCESS)).alias("access_share"), share(x.rlike(BLOCK_LOG)).alias("block_share"), share(x.rlike(SYSLOG)).alias("syslog_share"),
    )
    kind = (
        F.when((F.col("json_share") > 0.9) & (F.col("depth") > 3), "json_nested").when(F.col("json_share") > 0.9, "json_flat")
        .when(F.col("access_share") > 0.8, "access").when(F.col("block_share") > 0.8, "blocks").when(F.col("syslog_share") > 0.8, "syslog").otherwise("generic")
    )
    return found.withColumn("kind", kind)


def _fields(line: Column, pattern: str, names: dict[str, int], nullable: set[str] = frozenset()) -> Column:
    parts = []
    for name, group in names.items():
        value = F.regexp_extract(line, pattern, group)
        parts.append((F.when(F.length(value) > 0, value) if name in nullable else value).alias(name))
    return F.when(line.rlike(pattern), F.struct(*parts))


def parse_access(line: Column) -> Column:
    """struct of an access log line, common or combined; null if it is none. request is what stands
    between the quotes where it isn't three words."""
    names = {"host": 1, "ident": 2, "user": 3, "time": 4, "method": 5, "path": 6, "protocol": 7, "request": 8, "status": 9, "size": 10, "referer": 11, "agent": 12}
    return _fields(line, ACCESS, names, {"method", "path", "protocol", "request", "referer", "agent"})


def parse_syslog(line: Column) -> Column:
    return _fields(line, SYSLOG, {"time": 1, "host": 2, "program": 3, "pid": 4, "message": 5}, {"pid"})


def parse_block_log(line: Column) -> Column:
    """struct of a storage log line, with its block ids, addresses and the message's typed template."""
    names = {"date": 1, "time": 2, "pid": 3, "level": 4, "component": 5, "message": 6}
    base = _fields(line, BLOCK_LOG, names)
    message = F.regexp_extract(line, BLOCK_LOG, 6)
    return F.when(
        base.isNotNull(),
        F.struct(
            *(base[n].alias(n) for n in names),
            F.regexp_extract_all(message, F.lit(r"blk_-?[0-9]+"), F.lit(0)).alias("blocks"),
            F.regexp_extract_all(message, F.lit(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?"), F.lit(0)).alias("addresses"),
            typed_mask(message).alias("template"),
        ),
    )


def structured_share(lines: DataFrame, parsed: Column, least: float = 0.8) -> DataFrame:
    """stream_id with the share of lines that parse, and whether a structured encoding pays."""
    out = lines.groupBy("stream_id").agg(F.avg(parsed.isNotNull().cast("double")).alias("share"))
    return out.withColumn("structured", F.col("share") >= least)


def length_spread(lines: DataFrame, sample: int = 500) -> DataFrame:
    """stream_id with whether its first lines are alike in length: variance below twice the mean."""
    size = F.length("line")
    out = lines.filter(F.col("line_no") < sample).groupBy("stream_id").agg(F.var_pop(size).alias("variance"), F.avg(size).alias("mean"))
    return out.withColumn("repetitive", F.col("variance") < 2 * F.col("mean"))


def prefix_vote(lines: DataFrame, width: int = 20, top: int = 10) -> DataFrame:
    """stream_id with the share of lines that start with its most frequent beginnings, and whether
    that makes a template log (over half)."""
    counts = lines.groupBy("stream_id", F.substring("line", 1, width).alias("beginning")).count()
    rank = F.row_number().over(W.partitionBy("stream_id").orderBy(F.desc("count"), "beginning"))
    total = lines.groupBy("stream_id").agg(F.count("*").alias("n"))
    held = counts.withColumn("rank", rank).filter(F.col("rank") <= top).groupBy("stream_id").agg(F.sum("count").alias("held"))
    out = held.join(total, "stream_id")
    return out.select("stream_id", (F.col("held") / F.col("n")).alias("share"), (F.col("held") / F.col("n") > 0.5).alias("templated"))


def format_runs(lines: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values in order: keys, run, value, first, length."""
    w = W.partitionBy(*keys).orderBy(order)
    starts = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    runs = lines.select(*keys, order, value, starts.alias("_s")).withColumn("run", F.sum("_s").over(w) - 1)
    return runs.groupBy(*keys, "run", value).agg(F.min(order).alias("first"), F.count("*").alias("length"))


def expand_runs(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every place of every run again: keys, at, value."""
    at = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("length") - 1))
    return runs.select(*keys, at.alias("at"), value)


def interleave(parts: list[DataFrame]) -> DataFrame:
    """Tables of lines of different formats as one; line_no keeps the order."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def tokens(line: Column) -> Column:
    """The runs of characters that aren't white space."""
    return F.regexp_extract_all(line, F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))


def delimited_tokens(line: Column, most: int = 50) -> Column:
    """Words, runs of white space and single delimiters, all kept; what is over most is one token."""
    parts = F.regexp_extract_all(line, F.lit(r"""\s+|[,;:=\[\]{}()"<>]|[^\s,;:=\[\]{}()"<>]+"""), F.lit(0))
    rest = F.array_join(F.slice(parts, most, 1 << 30), "")
    return F.when(F.size(parts) <= most, parts).otherwise(F.concat(F.slice(parts, 1, most - 1), F.array(rest)))


def typed_mask(line: Column) -> Column:
    """The line with every typed value as <TYPE>, the types in their fixed order."""
    return reduce(lambda c, m: F.regexp_replace(c, rf"(?<![A-Za-z0-9_<]){m[1]}(?![A-Za-z0-9_>])", f"<{m[0]}>"), MASKS, line)


def typed_variables(line: Column) -> Column:
    """array<struct<type, value>> of the values that typed_mask takes out, in line order."""
    whole = "|".join(f"({p})" for _, p in MASKS)
    found = F.regexp_extract_all(line, F.lit(rf"(?<![A-Za-z0-9_<])(?:{whole})(?![A-Za-z0-9_>])"), F.lit(0))

    def kind(v: Column) -> Column:
        return reduce(lambda rest, m: F.when(v.rlike(f"^(?:{m[1]})$"), m[0]).otherwise(rest), reversed(MASKS), F.lit("INT"))

    return F.transform(found, lambda v: F.struct(kind(v).alias("type"), v.alias("value")))


def restore_mask(template: Column, variables: Column) -> Column:
    """The inverse of typed_mask: the marks filled with the values in order."""
    parts = F.split(template, "<(?:" + "|".join(n for n, _ in MASKS) + ")>", -1)
    return F.array_join(
        F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(variables, i)["value"], F.lit("")))), ""
    )


def control_mask(line: Column) -> Column:
    """Addresses, UUIDs, hex numbers and long and short numbers as one control character each."""
    steps = [(MASKS[0][1], "\x01"), (MASKS[1][1], "\x02"), (MASKS[3][1], "\x03"), (r"[0-9]{6,}", "\x04"), (r"[0-9]+", "\x05")]
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, line)


def template_ids(rows: DataFrame, keys: list[str], template: str = "template", order: str = "line_no") -> DataFrame:
    """keys, template, template_id (0-based by first appearance), first_line, count."""
    found = rows.groupBy(*keys, template).agg(F.min(order).alias("first_line"), F.count("*").alias("count"))
    return found.withColumn("template_id", F.row_number().over(W.partitionBy(*keys).orderBy("first_line", template)) - 1)


def variables_by_type(rows: DataFrame, keys: list[str], variables: str = "variables") -> DataFrame:
    """One stream of values a type: keys, type, n_values, n_distinct, bytes."""
    long = rows.select(*keys, F.explode(variables).alias("v")).select(*keys, "v.type", "v.value")
    return long.groupBy(*keys, "type").agg(
        F.count("*").alias("n_values"), F.count_distinct("value").alias("n_distinct"), F.sum(F.octet_length("value")).alias("bytes")
    )


def template_report(counts: DataFrame, top: int = 20, template: str = "template") -> DataFrame:
    """The most frequent templates with their share of all lines."""
    one = F.lit(0).alias("_one")
    total = counts.groupBy(one).agg(F.sum("count").alias("total"))
    best = counts.orderBy(F.desc("count"), template).limit(top).select("*", one)
    return best.join(total, "_one").select(template, "count", (F.col("count") / F.col("total")).alias("share"))
