"""JSON lines as typed leaves, exactly.

A line is flattened into leaves in document order: path (an array of keys, so dots in keys are no
trouble), type and the literal text of the value. Rebuilding prints the leaves with the line's own
separators; a line that doesn't come back byte by byte is kept raw. Arrays of objects can be flattened
by element, empty objects and arrays are leaves of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = T.ArrayType(
    T.StructType([T.StructField("path", T.ArrayType(T.StringType())), T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])
)
SPACED, TIGHT = (", ", ": "), (",", ":")


def separators(line: Column) -> Column:
    """spaced or tight, by what follows the first key."""
    return F.when(line.rlike(r'^\s*\{\s*"(?:[^"\\]|\\.)*": '), "spaced").otherwise("tight")


class _Number(str):
    """A number's literal text."""


def _parse(line: str):
    import json

    class Pairs(list):
        pass

    def pairs(items):
        return Pairs(items)

    decoder = json.JSONDecoder(object_pairs_hook=pairs, parse_int=_Number, parse_float=_Number, parse_constant=_Number)
    return decoder.decode(line), Pairs


def flatten(line: str, depth: int | None = None, arrays: bool = False):
    """(leaves, style) of an object's line, or None if printing them doesn't give the line back.
    Objects deeper than depth, and arrays unless asked for, are leaves with their JSON text."""
    import json

    try:
        value, pairs_kind = _parse(line)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, pairs_kind):
        return None
    for style in ("spaced", "tight"):
        if _print(value, pairs_kind, *(SPACED if style == "spaced" else TIGHT)) == line:
            break
    else:
        return None
    comma, colon = SPACED if style == "spaced" else TIGHT
    leaves: list[dict] = []

    def walk(x, path: list[str]) -> None:
        if isinstance(x, pairs_kind):
            if not x:
                leaves.append({"path": path, "type": "empty_object", "value": "{}"})
            elif depth is not None and len(path) > depth:
                leaves.append({"path": path, "type": "object", "value": _print(x, pairs_kind, comma, colon)})
            else:
                for k, v in x:
                    walk(v, [*path, k])
        elif isinstance(x, list):
            if arrays and x:
                for k, v in enumerate(x):
                    walk(v, [*path, f"[{k}]"])
            else:
                leaves.append({"path": path, "type": "array" if x else "empty_array", "value": _print(x, pairs_kind, comma, colon)})
        elif isinstance(x, _Number):
            leaves.append({"path": path, "type": "number", "value": str(x)})
        elif isinstance(x, str):
            leaves.append({"path": path, "type": "string", "value": x})
        elif x is None:
            leaves.append({"path": path, "type": "null", "value": None})
        else:
            leaves.append({"path": path, "type": "boolean", "value": json.dumps(x)})

    walk(value, [])
    if unflatten(leaves, style) != line:
        return None
    return leaves, style


def _print(x, pairs_kind, comma: str, colon: str) -> str:
    import json

    if isinstance(x, pairs_kind):
        return "{" + comma.join(json.dumps(k, ensure_ascii=False) + colon + _print(v, pairs_kind, comma, colon) for k, v in x) + "}"
    if isinstance(x, list):
        return "[" + comma.join(_print(v, pairs_kind, comma, colon) for v in x) + "]"
    if isinstance(x, _Number):
        return str(x)
    return json.dumps(x, ensure_ascii=False)


def unflatten(leaves: list[dict], style: str) -> str:
    """The line of leaves in document order. Keys of the form [n] that count up from 0 in their
    place are array elements."""
    import json

    comma, colon = SPACED if style == "spaced" else TIGHT
    root: list = []
    for leaf in leaves:
        at = root
        path = list(leaf["path"])
        for k, key in enumerate(path):
            last = k == len(path) - 1
            if last:
                at.append((key, leaf))
            elif at and at[-1][0] == key and isinstance(at[-1][1], list):
                at = at[-1][1]
            else:
                at.append((key, []))
                at = at[-1][1]

    def text(x) -> str:
        if isinstance(x, dict):
            if x["type"] == "string":
                return json.dumps(x["value"], ensure_ascii=False)
            return "null" if x["type"] == "null" else x["value"]
        if x and all(key == f"[{k}]" for k, (key, _) in enumerate(x)):
            return "[" + comma.join(text(v) for _, v in x) + "]"
        return "{" + comma.join(json.dumps(key, ensure_ascii=False) + colon + text(v) for key, v in x) + "}"

    if leaves and not leaves[0]["path"]:
        return "{}"
    return text(root)


def flatten_lines(lines: DataFrame, line: str = "line", depth: int | None = None, arrays: bool = False) -> DataFrame:
    """lines with leaves (null for raw lines), style and raw."""
    schema = T.StructType([*lines.schema.fields, T.StructField("leaves", LEAF), T.StructField("style", T.StringType()), T.StructField("raw", T.StringType())])

    def run(batches):
        import pyarrow as pa

        leaf = pa.list_(pa.struct([("path", pa.list_(pa.string())), ("type", pa.string()), ("value", pa.string())]))
        for batch in batches:
            texts = batch.column(line).to_pylist()
            found = [flatten(t, depth, arrays) if t is not None else None for t in texts]
            extra = [
                pa.array([f[0] if f else None for f in found], leaf),
                pa.array([f[1] if f else None for f in found], pa.string()),
                pa.array([None if f else t for f, t in zip(found, texts)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[f.name for f in schema.fields])

    return lines.mapInArrow(run, schema)


def unflatten_lines(rows: DataFrame, out: str = "line") -> DataFrame:
    """flatten_lines' rows with the lines again."""
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != out), T.StructField(out, T.StringType())])
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lines = [
                raw if leaves is None else unflatten(leaves, style)
                for leaves, style, raw in zip(*(batch.column(c).to_pylist() for c in ("leaves", "style", "raw")))
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lines, pa.string())], names=[*keep, out])

    return rows.mapInArrow(run, schema)


def leaf_cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: keys, position, path, key (the path with dots), type, value."""
    long = rows.select(*keys, F.posexplode("leaves").alias("position", "leaf"))
    return long.select(*keys, "position", F.col("leaf.path").alias("path"), F.array_join("leaf.path", ".").alias("key"), F.col("leaf.type").alias("type"), F.col("leaf.value").alias("value"))


def key_table(cells: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """keys, key, key_id: keys numbered by first appearance (line, then position)."""
    first = cells.groupBy(*keys, "key").agg(F.min(F.struct(order, "position")).alias("_first"))
    return first.withColumn("key_id", F.row_number().over(W.partitionBy(*keys).orderBy("_first", "key")) - 1).drop("_first")


def key_orders(cells: DataFrame, ids: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """keys, line, key_order (ids in the line's order) and order_id (orders numbered by first line)."""
    per = cells.join(ids, [*keys, "key"]).groupBy(*keys, order).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "key_id"))), lambda x: x["key_id"]).alias("key_order"))
    firsts = per.groupBy(*keys, "key_order").agg(F.min(order).alias("_first"))
    firsts = firsts.withColumn("order_id", F.row_number().over(W.partitionBy(*keys).orderBy("_first")) - 1).drop("_first")
    return per.join(firsts, [*keys, "key_order"])


def with_absent(cells: DataFrame, rows: DataFrame, ids: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """Every row with every key of its scope: presence 0 absent, 1 null, 2 value."""
    spine = rows.select(*keys, order).join(ids.select(*keys, "key"), keys)
    out = spine.join(cells.select(*keys, order, "key", "type", "value"), [*keys, order, "key"], "left")
    return out.withColumn("presence", F.when(F.col("type").isNull(), 0).when(F.col("type") == "null", 1).otherwise(2))


def key_statistics(cells: DataFrame, keys: list[str], longest: int = 200) -> DataFrame:
    """keys, key with counts of every type, distinct short texts, and a hint: raw below ten values,
    delta for over 80 % integers, dictionary for over half texts with few distinct ones."""
    count = lambda c: F.count_if(c)
    integer = (F.col("type") == "number") & F.col("value").rlike("^-?[0-9]+$")
    found = cells.groupBy(*keys, "key").agg(
        F.count("*").alias("n"), count(integer).alias("n_integer"), count((F.col("type") == "number") & ~integer).alias("n_float"),
        count(F.col("type") == "string").alias("n_string"), count(F.col("type") == "boolean").alias("n_boolean"), count(F.col("type") == "null").alias("n_null"),
        count(F.col("type").isin("object", "empty_object")).alias("n_object"), count(F.col("type").isin("array", "empty_array")).alias("n_array"),
        F.count_distinct(F.when((F.col("type") == "string") & (F.length("value") < longest), F.col("value"))).alias("n_distinct"),
    )
    hint = (
        F.when(F.col("n") < 10, "RAW").when(F.col("n_integer") / F.col("n") > 0.8, "DELTA")
        .when((F.col("n_string") / F.col("n") > 0.5) & (F.col("n_distinct") < 1000), "DICTIONARY").otherwise("RAW")
    )
    return found.withColumn("hint", hint)


def value_dictionary(cells: DataFrame, keys: list[str], longest: int = 200, most: int = 50_000) -> DataFrame:
    """keys, key, value, code of short texts, the most frequent first; codes beyond most are left out
    (their values stay literal)."""
    counts = cells.filter((F.col("type") == "string") & (F.length("value") < longest)).groupBy(*keys, "key", "value").count()
    code = F.row_number().over(W.partitionBy(*keys, "key").orderBy(F.desc("count"), "value")) - 1
    return counts.withColumn("code", code).filter(F.col("code") < most).drop("count")


def typed_value(type_: Column, value: Column) -> Column:
    """A leaf as a JSON variant."""
    return F.try_parse_json(F.when(type_ == "string", F.to_json(F.struct(value.alias("v")))).otherwise(F.concat(F.lit('{"v":'), F.coalesce(value, F.lit("null")), F.lit("}"))))


def nested_table(cells: DataFrame, keys: list[str], order: str = "line_no", line: str = "value") -> DataFrame:
    """The objects among cells (leaves that a depth limit kept whole) as tables of their own: keys, key,
    order and leaves of their members, to any depth, and mask: 3 for an empty object, else 2."""
    inner = flatten_lines(cells.filter(F.col("type").isin("object", "empty_object")).select(*keys, "key", order, line), line)
    return inner.withColumn("mask", F.when(F.col(line) == "{}", 3).otherwise(2)).drop(line)


def nested_cells(nested: DataFrame, outer: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """Long form of nested_table over all rows of outer (keys, order): member, value and its two-bit mask:
    0 the object or the member is absent, 1 null, 2 a value, 3 an empty object or array."""
    long = nested.select(*keys, "key", order, F.posexplode("leaves").alias("position", "leaf"))
    long = long.select(*keys, "key", order, F.array_join("leaf.path", ".").alias("member"), F.col("leaf.type").alias("type"), F.col("leaf.value").alias("value"))
    spine = outer.select(*keys, order).join(long.select(*keys, "key", "member").distinct(), keys)
    out = spine.join(long, [*keys, "key", order, "member"], "left")
    mask = F.when(F.col("type").isNull(), 0).when(F.col("type") == "null", 1).when(F.col("type").isin("empty_object", "empty_array"), 3).otherwise(2)
    return out.withColumn("mask", mask).drop("type")


def sparse_columns(cells: DataFrame, rows: DataFrame, keys: list[str], order: str = "line_no", over: float = 0.5) -> DataFrame:
    """keys, key, order, step, type and value of the keys that over half of a chunk's rows don't have; the
    step is the distance from the row with the key before, as in columns.sparse_encode."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    held = cells.groupBy(*keys, "key").agg(F.count_distinct(order).alias("_held")).join(n, keys).filter(F.col("_held") < (1 - over) * F.col("_n"))
    before = F.lag(order).over(W.partitionBy(*keys, "key").orderBy(order))
    out = cells.join(held.select(*keys, "key", "_first"), [*keys, "key"])
    return out.select(*keys, "key", order, (F.col(order) - F.coalesce(before, F.col("_first") - 1)).alias("step"), "type", "value")


def json_field(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


def nested_dictionary(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, key, value, code for arrays and deep objects: their JSON texts by frequency."""
    counts = cells.filter(F.col("type").isin("array", "object")).groupBy(*keys, "key", "value").count()
    return counts.withColumn("code", F.row_number().over(W.partitionBy(*keys, "key").orderBy(F.desc("count"), "value")) - 1).drop("count")


def columnar_or_raw(rows: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """keys with the bytes of lines and of their leaves' values with one key table, and the choice."""
    per = rows.groupBy(*keys).agg(F.sum(F.octet_length(line) + 1).alias("raw_bytes"))
    cells = leaf_cells(rows, keys)
    size = cells.groupBy(*keys, "key").agg(F.sum(F.coalesce(F.octet_length("value"), F.lit(0)) + 1).alias("b")).withColumn("b", F.col("b") + F.octet_length("key") + 1)
    size = size.groupBy(*keys).agg(F.sum("b").alias("columnar_bytes"))
    return per.join(size, keys, "left").withColumn("choice", F.when(F.coalesce("columnar_bytes", "raw_bytes") < F.col("raw_bytes"), "COLUMNAR").otherwise("RAW"))
