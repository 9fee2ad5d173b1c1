"""Profiling columns and encoding them as queryable columns.

A column is the rows of one set of keys (such as stream, chunk and column name) in the order of one
column; every window is partitioned by the keys. Encoders add columns, decoders give the values back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.functions import bits, values

THRESHOLD = 0.9
DICTIONARY_LIMIT = 256


def profile(cells: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """One row a column: counts, distinct values, matches of every kind, ranges and sizes. One
    aggregation; null values are absent ones, which are not empty ones."""
    v = F.col(value)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    prefix = values.parse_prefix_id(v)
    n = values.number(v)
    return cells.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count(v).alias("n_present"),
        count(F.length(v) == 0).alias("n_empty"),
        F.count_distinct(v).alias("n_distinct"),
        count(F.startswith(v, F.lit("[")) & ~F.endswith(v, F.lit("]")) & values.parse_clf(F.concat(v, F.lit("]"))).isNotNull()).alias("n_clf_fragment"),
        count(values.parse_clf(v).isNotNull()).alias("n_clf"),
        count(prefix.isNotNull()).alias("n_prefix_id"),
        F.min(prefix["prefix"]).alias("first_prefix"),
        F.max(prefix["prefix"]).alias("last_prefix"),
        count(values.parse_iso(v).isNotNull()).alias("n_iso"),
        count(values.is_ipv4(v)).alias("n_ipv4"),
        count(n.isNotNull()).alias("n_number"),
        count(values.is_path(v)).alias("n_path"),
        count(v.isin("true", "false")).alias("n_boolean"),
        count(v.rlike(values.UUID)).alias("n_uuid"),
        F.min(n).alias("least"),
        F.max(n).alias("most"),
        F.coalesce(F.sum(F.octet_length(v)), F.lit(0)).alias("bytes"),
    )


def choose_type(profiled: DataFrame) -> DataFrame:
    """profile's rows with column_type and match_ratio: the first kind that 90 % of the values have;
    none but dictionary and raw for columns with empty values. A path column needs all values."""
    present = F.col("n_present")
    ratio = lambda c: F.when(present > 0, F.col(c) / present).otherwise(0.0)
    full = (F.col("n_empty") == 0) & (present > 0)
    kinds = [
        ("CLF_FRAGMENT", ratio("n_clf_fragment") >= THRESHOLD, ratio("n_clf_fragment")),
        ("CLF", ratio("n_clf") >= THRESHOLD, ratio("n_clf")),
        ("PREFIX_ID", (ratio("n_prefix_id") >= THRESHOLD) & (F.col("first_prefix") == F.col("last_prefix")), ratio("n_prefix_id")),
        ("ISO", ratio("n_iso") >= THRESHOLD, ratio("n_iso")),
        ("IPV4", ratio("n_ipv4") >= THRESHOLD, ratio("n_ipv4")),
        ("NUMBER", ratio("n_number") >= THRESHOLD, ratio("n_number")),
        ("PATH", (F.col("n_path") == present) & (present == F.col("n")), F.lit(1.0)),
    ]
    small = F.when(F.col("n_distinct") <= DICTIONARY_LIMIT, "DICTIONARY").otherwise("RAW")
    column_type = reduce(lambda rest, k: F.when(full & k[1], k[0]).otherwise(rest), reversed(kinds), F.when(present == 0, "RAW").otherwise(small))
    match = reduce(lambda rest, k: F.when(full & k[1], k[2]).otherwise(rest), reversed(kinds), F.lit(1.0))
    return profiled.withColumn("column_type", column_type).withColumn("match_ratio", match)


def sampled(cells: DataFrame, keys: list[str], order: str, first: int = 100, value: str = "value") -> DataFrame:
    """The first present, nonempty values of every column, for the detectors that vote on a sample."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return cells.filter(F.length(value) > 0).withColumn("_rank", rank).filter(F.col("_rank") <= first).drop("_rank")


def vote_type(cells: DataFrame, keys: list[str], order: str, first: int = 1000, share: float = 0.9, value: str = "value") -> DataFrame:
    """keys with the kind that share of the first values have, or text."""
    rows = sampled(cells, keys, order, first, value).select(*keys, values.kind(F.col(value)).alias("kind"))
    counts = rows.groupBy(*keys, "kind").count()
    total = F.sum("count").over(W.partitionBy(*keys))
    best = counts.withColumn("share", F.col("count") / total).groupBy(*keys).agg(F.max(F.struct("share", "kind")).alias("best"))
    return best.select(*keys, F.when(F.col("best.share") >= share, F.col("best.kind")).otherwise("text").alias("kind"), F.col("best.share").alias("share"))


def sortedness(cells: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys with the share of values that are not below the one before; 1 for a single value."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    rows = cells.select(*keys, F.when(before.isNotNull(), (F.col(value) >= before).cast("double")).alias("_up"))
    return rows.groupBy(*keys).agg(F.coalesce(F.avg("_up"), F.lit(1.0)).alias("sorted_share"), F.count("*").alias("n"))


def sparsity(cells: DataFrame, keys: list[str], value: str = "value", over: float = 0.5, least: int = 10) -> DataFrame:
    absent = F.avg(F.col(value).isNull().cast("double"))
    return cells.groupBy(*keys).agg(absent.alias("absent_share"), F.count("*").alias("n")).withColumn(
        "sparse", (F.col("absent_share") > over) & (F.col("n") > least)
    )


def sparse_encode(cells: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """The present values with the step from the present place before (from -1 for the first)."""
    before = F.lag(order).over(W.partitionBy(*keys).orderBy(order))
    kept = cells.filter(F.col(value).isNotNull())
    return kept.select(*keys, order, (F.col(order) - F.coalesce(before, F.lit(-1))).alias("step"), value)


def sparse_decode(encoded: DataFrame, spine: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """All places of the spine (keys, order) with their values, null where absent."""
    at = F.sum("step").over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - 1
    return spine.select(*keys, order).join(encoded.select(*keys, at.alias(order), value), [*keys, order], "left")


def delta_encode(rows: DataFrame, keys: list[str], order: str, value: str, out: str = "delta") -> DataFrame:
    return rows.withColumn(out, F.col(value) - F.lag(value, 1, 0).over(W.partitionBy(*keys).orderBy(order)))


def delta_decode(rows: DataFrame, keys: list[str], order: str, delta: str = "delta", out: str = "decoded") -> DataFrame:
    return rows.withColumn(out, F.sum(delta).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def frame_encode(rows: DataFrame, keys: list[str], value: str, out: str = "offset") -> DataFrame:
    """Offsets from the least value, with that value (base) and the bytes that the widest offset takes."""
    w = W.partitionBy(*keys)
    base = F.min(value).over(w)
    return rows.withColumn("base", base).withColumn(out, F.col(value) - F.col("base")).withColumn("width", bits.unsigned_width(F.max(value).over(w) - F.col("base")))


def frame_decode(rows: DataFrame, offset: str = "offset", out: str = "decoded") -> DataFrame:
    return rows.withColumn(out, F.col("base") + F.col(offset))


def dictionary(rows: DataFrame, keys: list[str], value: str, by: str = "value", order: str | None = None) -> DataFrame:
    """keys, value, code, count: codes by value order, by falling frequency, or by first appearance.
    Values are counted before they are ranked, so a window only holds distinct values."""
    found = rows.groupBy(*keys, value).agg(F.count("*").alias("count"), *([F.min(order).alias("first")] if order else []))
    rank = {"value": [F.col(value)], "frequency": [F.desc("count"), F.col(value)], "first": [F.col("first") if order else F.col(value)]}[by]
    return found.withColumn("code", (F.row_number().over(W.partitionBy(*keys).orderBy(*rank)) - 1).cast("long"))


def dictionary_encode(rows: DataFrame, keys: list[str], value: str, by: str = "value", order: str | None = None) -> DataFrame:
    codes = dictionary(rows, keys, value, by, order)
    codes = codes.select(*(F.col(c).alias(f"_{c}") for c in [*keys, value]), "code")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*keys, value]])
    return rows.join(codes, on).select(*rows.columns, "code")


def dictionary_decode(encoded: DataFrame, codes: DataFrame, keys: list[str], value: str) -> DataFrame:
    return encoded.join(codes.select(*keys, F.col("code"), F.col(value).alias("decoded")), [*keys, "code"])


def text_delta(rows: DataFrame, keys: list[str], order: str, number: Column, text: str, out: str = "delta") -> DataFrame:
    """Deltas from the last row whose text parses (number is null where it doesn't); the others keep
    their text in raw, with no escapes in the way."""
    before = F.last("_n", ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_n", number)
    return rows.withColumn(out, F.col("_n") - F.coalesce(before, F.lit(0))).withColumn("raw", F.when(F.col("_n").isNull(), F.col(text))).drop("_n")


def text_delta_decode(rows: DataFrame, keys: list[str], order: str, delta: str = "delta", out: str = "decoded") -> DataFrame:
    """The numbers again, as text, and the raw texts."""
    total = F.sum(F.coalesce(F.col(delta), F.lit(0))).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(out, F.coalesce(F.col("raw"), total.cast("string")))


def format_dictionary(rows: DataFrame, keys: list[str], format_: Column, name: str = "format") -> DataFrame:
    """rows with format_id: the code of their format (such as zone and brackets) among the column's."""
    rows = rows.withColumn(name, format_)
    return rows.withColumn("format_id", F.dense_rank().over(W.partitionBy(*keys).orderBy(name)) - 1)


def prefix_id_encode(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Numbers of prefixed ids as deltas, with their affixes as a format; other texts raw."""
    parsed = values.parse_prefix_id(F.col(value))
    affixes = F.struct(parsed["opening"].alias("opening"), parsed["prefix"].alias("prefix"), parsed["separator"].alias("separator"), parsed["width"].alias("width"), parsed["closing"].alias("closing"))
    return text_delta(rows.withColumn("format", F.when(parsed.isNotNull(), affixes)), keys, order, parsed["number"], value)


def prefix_id_decode(rows: DataFrame, keys: list[str], order: str, out: str = "decoded") -> DataFrame:
    total = F.sum(F.coalesce(F.col("delta"), F.lit(0))).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    whole = F.struct(*(F.col(f"format.{c}").alias(c) for c in ("opening", "prefix", "separator", "width", "closing")), total.alias("number"))
    return rows.withColumn("_p", whole).withColumn(out, F.coalesce(F.col("raw"), values.print_prefix_id(F.col("_p")))).drop("_p")


def time_encode(rows: DataFrame, keys: list[str], order: str, value: str, shape: str = "iso") -> DataFrame:
    """Times (iso: nanoseconds, clf: seconds) as deltas, the format of every row kept; others raw."""
    parsed = values.parse_iso(F.col(value)) if shape == "iso" else values.parse_clf(F.col(value))
    number, parts = ("nanos", ["separator", "decimals", "zone"]) if shape == "iso" else ("seconds", ["opening", "zone", "closing"])
    format_ = F.when(parsed.isNotNull(), F.struct(*(parsed[p].alias(p) for p in parts)))
    return text_delta(rows.withColumn("format", format_), keys, order, parsed[number], value)


def time_decode(rows: DataFrame, keys: list[str], order: str, shape: str = "iso", out: str = "decoded") -> DataFrame:
    total = F.sum(F.coalesce(F.col("delta"), F.lit(0))).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)).cast("long")
    rows = rows.withColumn("_t", total)
    if shape == "iso":
        whole = F.struct(F.col("_t").alias("nanos"), F.col("format.separator"), F.col("format.decimals"), F.col("format.zone"))
        printed = values.print_iso(whole)
    else:
        whole = F.struct(F.col("_t").alias("seconds"), F.col("format.opening"), F.col("format.zone"), F.col("format.closing"))
        printed = values.print_clf(whole)
    return rows.withColumn(out, F.coalesce(F.col("raw"), printed)).drop("_t")


def ipv4_encode(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Addresses as offsets from the least and as XOR with the one before; others raw."""
    w = W.partitionBy(*keys)
    number = bits.ipv4_to_long(F.col(value))
    rows = rows.withColumn("address", number).withColumn("raw", F.when(number.isNull(), F.col(value)))
    before = F.last("address", ignorenulls=True).over(w.orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return (
        rows.withColumn("base", F.min("address").over(w))
        .withColumn("offset", F.col("address") - F.col("base"))
        .withColumn("xor", F.col("address").bitwiseXOR(F.coalesce(before, F.lit(0).cast("long"))))
        .withColumn("xor_bytes", F.when(F.col("address").isNotNull(), bits.ipv4_delta_size(F.col("address"), before)))
    )


def ipv4_decode(rows: DataFrame, out: str = "decoded") -> DataFrame:
    return rows.withColumn(out, F.coalesce(F.col("raw"), bits.long_to_ipv4(F.col("base") + F.col("offset"))))


def path_encode(rows: DataFrame, keys: list[str], order: str, value: str, shared: bool = False) -> DataFrame:
    """Long form of path columns: keys, order, position, segment, trailing, code; codes by segment
    position, or one vocabulary for all positions if shared. Paths without segments have position -1."""
    trailing = F.endswith(F.col(value), F.lit("/")) & (F.length(value) > 1)
    segments = values.path_segments(F.col(value))
    long = rows.select(*keys, order, trailing.alias("trailing"), F.posexplode_outer(segments).alias("position", "segment"))
    long = long.withColumn("position", F.coalesce("position", F.lit(-1)))
    by = keys if shared else [*keys, "position"]
    return dictionary_encode(long, by, "segment")


def path_decode(long: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, order and the path again."""
    parts = F.array_sort(F.collect_list(F.when(F.col("position") >= 0, F.struct("position", "segment"))))
    whole = long.groupBy(*keys, order).agg(parts.alias("_parts"), F.max("trailing").alias("_trailing"))
    return whole.select(*keys, order, values.print_path(F.transform("_parts", lambda p: p["segment"]), F.col("_trailing")).alias("decoded"))


def integer_costs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys with the bytes of every encoding of an integer column, and the one to choose: deltas if
    70 % of the neighbours rise, else the cheapest of binary, bit-packed and dictionary."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    rows = rows.select(*keys, F.col(value).alias("v"), F.when(before.isNotNull(), (F.col(value) >= before).cast("double")).alias("up"), (F.col(value) - F.coalesce(before, F.lit(0))).alias("d"))
    found = rows.groupBy(*keys).agg(
        F.count("v").alias("n"), F.count_distinct("v").alias("n_distinct"), F.min("v").alias("least"), F.max("v").alias("most"),
        F.coalesce(F.avg("up"), F.lit(1.0)).alias("sorted_share"), F.sum(bits.varint_size(bits.zigzag(F.col("d")))).alias("delta_bytes"),
    )
    span = F.col("most") - F.col("least")
    width = bits.unsigned_width(span)
    found = (
        found.withColumn("binary_bytes", F.col("n") * width)
        .withColumn("packed_bytes", bits.packed_size(F.col("n"), F.greatest(F.lit(1), bits.bit_length(span))) + 5)
        .withColumn("dictionary_bytes", F.col("n_distinct") * width + F.col("n") * bits.index_bytes(F.col("n_distinct")))
    )
    least = F.least("binary_bytes", "packed_bytes", "dictionary_bytes")
    return found.withColumn(
        "encoding",
        F.when(F.col("sorted_share") >= 0.7, "DELTA").when(F.col("binary_bytes") == least, "BINARY").when(F.col("packed_bytes") == least, "BIT_PACKED").otherwise("DICTIONARY"),
    )


def string_costs(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys with the bytes of raw and dictionary forms of a text column, the share of distinct values
    and the choices by cost (below 90 % of raw), by share (below 30 %) and by number (256)."""
    per = rows.groupBy(*keys, value).agg(F.count("*").alias("c"))
    size = F.coalesce(F.octet_length(value), F.lit(0)) + 1
    found = per.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"), F.sum(size * F.col("c")).alias("raw_bytes"), F.sum(size).alias("vocabulary_bytes"))
    found = found.withColumn("dictionary_bytes", F.col("vocabulary_bytes") + bits.packed_size(F.col("n"), bits.index_width(F.col("n_distinct"))))
    choice = lambda c: F.when(c, "DICTIONARY").otherwise("RAW")
    return (
        found.withColumn("by_cost", choice(F.col("dictionary_bytes") < 0.9 * F.col("raw_bytes")))
        .withColumn("by_share", choice(F.col("n_distinct") / F.col("n") < 0.3))
        .withColumn("by_number", choice((F.col("n_distinct") < 256) | (F.col("n_distinct") / F.col("n") < 0.3)))
    )


def prefix_costs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys with the costs of the numbers of prefixed ids, after integer_costs, and their widths."""
    parsed = rows.withColumn("_p", values.parse_prefix_id(F.col(value))).filter("_p is not null")
    numbers = parsed.select(*keys, order, F.col("_p.number").alias("number"), F.col("_p.width").alias("width"))
    widths = numbers.groupBy(*keys).agg(F.count_distinct("width").alias("n_widths"))
    return integer_costs(numbers, keys, order, "number").join(widths, keys)


def boolean_encode(rows: DataFrame, value: str) -> DataFrame:
    """presence (0 absent, 1 null text, 2 value) and the value as a boolean."""
    v = F.col(value)
    return rows.withColumn("presence", F.when(v.isNull(), 0).when(v == "null", 1).otherwise(2)).withColumn("bit", F.when(v == "true", True).when(v == "false", False))


def boolean_decode(rows: DataFrame, out: str = "decoded") -> DataFrame:
    return rows.withColumn(out, F.when(F.col("presence") == 0, F.lit(None)).when(F.col("presence") == 1, "null").otherwise(F.col("bit").cast("string")))


def binary_encode(rows: DataFrame, value: str) -> DataFrame:
    """UUIDs and hex texts as bytes where they print back, with what they are; others raw."""
    v = F.col(value)
    uuid, hexed = bits.uuid_bytes(v), bits.hex_bytes(v)
    return (
        rows.withColumn("shape", F.when(uuid.isNotNull(), "UUID").when(hexed.isNotNull(), "HEX").otherwise("RAW"))
        .withColumn("packed", F.coalesce(uuid, hexed))
        .withColumn("raw", F.when(F.col("shape") == "RAW", v))
        .withColumn("dashes", F.when(v.rlike("^[0-9a-f]+(-[0-9a-f]+)+$"), values.dash_pattern(v)))
    )


def binary_decode(rows: DataFrame, out: str = "decoded") -> DataFrame:
    return rows.withColumn(out, F.when(F.col("shape") == "UUID", bits.bytes_uuid(F.col("packed"))).when(F.col("shape") == "HEX", F.lower(F.hex("packed"))).otherwise(F.col("raw")))


def presence_groups(cells: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    """Columns that are present in the same rows: keys, pattern, columns, n_rows. The pattern is an
    order-free hash of the places (sums of two hashes), so no list of places is ever built."""
    h = lambda salt: F.sum(F.xxhash64(order, F.lit(salt)).cast("decimal(38,0)"))
    per = cells.groupBy(*keys, column).agg(F.count("*").alias("n_rows"), h(1).alias("_a"), h(2).alias("_b"))
    return per.groupBy(*keys, "n_rows", "_a", "_b").agg(F.array_sort(F.collect_list(column)).alias("columns")).drop("_a", "_b")


def row_templates(cells: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    """Sets of columns present in a row: keys, columns, n_rows, first_row, template_id by frequency."""
    per = cells.groupBy(*keys, order).agg(F.array_sort(F.collect_set(column)).alias("columns"))
    found = per.groupBy(*keys, "columns").agg(F.count("*").alias("n_rows"), F.min(order).alias("first_row"))
    return found.withColumn("template_id", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n_rows"), "first_row")) - 1)


def rare_columns(cells: DataFrame, rows: DataFrame, keys: list[str], column: str, share: float = 0.05) -> DataFrame:
    """keys, column, present_share and whether it is rare among the rows."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    per = cells.groupBy(*keys, column).agg(F.count("*").alias("_held")).join(n, keys)
    return per.select(*keys, column, (F.col("_held") / F.col("_n")).alias("present_share"), (F.col("_held") / F.col("_n") < share).alias("rare"))
