"""Similar earlier lines: a window of recent lines of like length, and XOR against the most similar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.functions.bits import to_codes, xor_codes, zero_runs


def similarity(a: Column, b: Column) -> Column:
    """The share of places of the longer text at which two texts have the same character."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y).cast("int")), F.lit(0), lambda n, x: n + x)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.when((F.length(a) > 0) & (F.length(b) > 0), same / longest).otherwise(0.0)).otherwise(1.0)


def _best(rows: DataFrame, candidates: str, least: float, enough: float) -> DataFrame:
    """The first candidate (newest first) with enough similarity, else the most similar with least."""
    scored = F.transform(candidates, lambda c: F.struct(similarity(F.col("line"), c["line"]).alias("similarity"), c["line_no"].alias("line_no"), c["line"].alias("line")))
    rows = rows.withColumn("_scored", scored)
    state = F.expr("cast(null as struct<similarity:double,line_no:bigint,line:string>)")
    best = F.aggregate(
        "_scored", state, lambda s, c: F.when(s.isNull() | ((s["similarity"] < enough) & (c["similarity"] > s["similarity"])), c).otherwise(s)
    )
    rows = rows.withColumn("_best", best)
    taken = F.col("_best.similarity") >= least
    return rows.withColumn("reference", F.when(taken, F.col("_best.line_no"))).withColumn("reference_line", F.when(taken, F.col("_best.line"))).withColumn(
        "similarity", F.when(taken, F.col("_best.similarity"))
    ).drop("_scored", "_best", candidates)


def reference_lines(lines: DataFrame, keys: list[str], size: int = 8, least: float = 0.85, enough: float = 0.85) -> DataFrame:
    """lines with reference (line_no of the similar line among the last `size` of the same length),
    its text and the similarity; null if none reaches least."""
    w = W.partitionBy(*keys, "_size").orderBy(F.col("line_no")).rowsBetween(-size, -1)
    rows = lines.withColumn("_size", F.length("line")).withColumn("_recent", F.reverse(F.collect_list(F.struct("line_no", "line")).over(w)))
    return _best(rows, "_recent", least, enough).drop("_size")


def bucketed_reference_lines(lines: DataFrame, keys: list[str], size: int = 16, width: int = 32, least: float = 0.5) -> DataFrame:
    """The same among the last `size` lines of the same or a neighbouring length bucket: every line is
    entered in its bucket and both neighbours, and asks in its own."""
    bucket = F.floor(F.length("line") / width)
    entered = lines.select(*keys, "line_no", "line", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket"), bucket.alias("_own"))
    w = W.partitionBy(*keys, "_bucket").orderBy("line_no").rowsBetween(-size, -1)
    rows = entered.withColumn("_recent", F.reverse(F.collect_list(F.struct("line_no", "line")).over(w))).filter(F.col("_bucket") == F.col("_own")).drop("_bucket", "_own")
    return _best(rows, "_recent", least, 1.0)


def xor_lines(rows: DataFrame) -> DataFrame:
    """rows with xor (codes of the line against its reference, zero where equal) and xor_runs (the
    same with runs of zeros folded); null without a reference."""
    codes = xor_codes(to_codes(F.col("line")), to_codes(F.col("reference_line")))
    return rows.withColumn("xor", F.when(F.col("reference").isNotNull(), codes)).withColumn("xor_runs", zero_runs(F.col("xor")))


def unxor(xor: Column, reference_line: Column, length: Column) -> Column:
    """The line again, from its XOR, its reference and its length (Latin-1 characters)."""
    codes = F.slice(xor_codes(xor, to_codes(reference_line)), F.lit(1), length)
    return F.array_join(F.transform(codes, lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 2, "0")), "ISO-8859-1")), "")


def consecutive_xor(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Each value's codes against the value before in its column."""
    before = F.coalesce(F.lag(value).over(W.partitionBy(*keys).orderBy(order)), F.lit(""))
    return rows.withColumn("xor", xor_codes(to_codes(F.col(value)), to_codes(before)))
