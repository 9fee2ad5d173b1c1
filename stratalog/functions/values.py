"""Recognisers, parsers and printers of the value kinds found in logs, as column expressions.

A parser returns null unless printing its result gives the text back, so what parses is lossless."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.functions.bits import ipv4_to_long

# The shapes of the value kinds.
CLF = r"^(\[?)([0-9]{2})/(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)/([0-9]{4}):([0-9]{2}):([0-9]{2}):([0-9]{2})( [+-][0-9]{4})?(\]?)$"
ISO = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})([T ])([0-9]{2}):([0-9]{2}):([0-9]{2})(\.[0-9]{1,9})?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
NUMBER = r"^-?[0-9]+$"
FLOAT = r"^-?[0-9]+\.[0-9]+$"
IPV4 = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"
PREFIX_ID = r'^("?)([a-zA-Z][a-zA-Z0-9]*)([-_])(-?[0-9]+)("?,?)$'
PATH = r"^/[A-Za-z0-9_./-]*$"
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
HEX = r"^[0-9a-fA-F]+$"
HOSTNAME = r"^[A-Za-z][A-Za-z0-9-]*(\.[A-Za-z0-9-]+)+$"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def is_number(v: Column) -> Column:
    """An integer that prints as it stands: no leading zeros, no minus zero."""
    return v.rlike(r"^(0|-?[1-9][0-9]*)$")


def number(v: Column) -> Column:
    return F.when(is_number(v), v.try_cast("long"))


def is_ipv4(v: Column) -> Column:
    return ipv4_to_long(v).isNotNull()


def _seconds(shaped: Column, y: Column, m: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """Seconds of a wall clock reading since 1970, on the proleptic Gregorian calendar; null for no such
    day or time, and unless shaped. Counted by arithmetic, from matching texts only: a cast that fails
    costs an exception a row."""
    y, m, d, h, mi, s = (F.when(shaped, x).try_cast("long") for x in (y, m, d, h, mi, s))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    valid = m.between(1, 12) & (d >= 1) & (d <= length) & (h < 24) & (mi < 60) & (s < 60)
    # years that start in March, so that the leap day comes last
    year = F.when(m <= 2, y - 1).otherwise(y)
    day_of_year = F.floor((153 * ((m + 9) % 12) + 2) / 5) + d - 1
    days = 365 * year + F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400) + day_of_year - 719468
    return F.when(valid, days * 86400 + h * 3600 + mi * 60 + s)


def parse_clf(v: Column) -> Column:
    """struct(seconds, opening, zone, closing) of an access log time; the zone is kept, not applied."""
    g = lambda k: F.regexp_extract(v, CLF, k)
    month = F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), g(3)).cast("string"), 2, "0")
    seconds = _seconds(v.rlike(CLF), g(4), month, g(2), g(5), g(6), g(7))
    return F.when(v.rlike(CLF) & seconds.isNotNull(), F.struct(seconds.alias("seconds"), g(1).alias("opening"), g(8).alias("zone"), g(9).alias("closing")))


def _clock(seconds: Column) -> tuple[Column, Column]:
    days = F.floor(seconds / 86400).cast("int")
    rest = F.pmod(seconds, F.lit(86400))
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.date_from_unix_date(days), F.concat_ws(":", two(F.floor(rest / 3600)), two(F.floor(rest / 60) % 60), two(rest % 60))


def print_clf(p: Column) -> Column:
    day, clock = _clock(p["seconds"])
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))
    date = F.concat_ws("/", F.date_format(day, "dd"), month, F.lpad(F.year(day).cast("string"), 4, "0"))
    return F.concat(p["opening"], date, F.lit(":"), clock, p["zone"], p["closing"])


def parse_iso(v: Column) -> Column:
    """struct(nanos, separator, decimals, zone) of an ISO 8601 time: nanoseconds of the wall clock.
    Null outside the years whose nanoseconds fit 64 bits."""
    g = lambda at, n: F.substring(v, at, n)  # noqa: E731  all parts before the fraction have fixed places
    seconds = _seconds(v.rlike(ISO), g(1, 4), g(6, 2), g(9, 2), g(12, 2), g(15, 2), g(18, 2))
    fraction = F.regexp_extract(v, r"^.{19}\.([0-9]{1,9})", 1)
    nanos = seconds * 1_000_000_000 + F.rpad(fraction, 9, "0").try_cast("long")
    fits = v.rlike(ISO) & seconds.between(-9_223_372_036, 9_223_372_035)
    zone = F.regexp_extract(v, r"^.{19}(?:\.[0-9]*)?(.*)$", 1)
    return F.when(fits, F.struct(nanos.alias("nanos"), g(11, 1).alias("separator"), F.length(fraction).alias("decimals"), zone.alias("zone")))


def print_iso(p: Column) -> Column:
    seconds = F.floor(p["nanos"] / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("long")
    rest = p["nanos"] - seconds * 1_000_000_000
    day, clock = _clock(seconds)
    fraction = F.substring(F.lpad(rest.cast("string"), 9, "0"), F.lit(1), p["decimals"])
    dotted = F.when(p["decimals"] > 0, F.concat(F.lit("."), fraction)).otherwise("")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), p["separator"], clock, dotted, p["zone"])


def parse_prefix_id(v: Column) -> Column:
    """struct(opening, prefix, separator, number, width, closing); the width keeps leading zeros."""
    g = lambda k: F.regexp_extract(v, PREFIX_ID, k)
    n = g(4).try_cast("long")
    fits = v.rlike(PREFIX_ID) & n.isNotNull() & ~g(4).rlike("^-0")
    return F.when(
        fits,
        F.struct(
            g(1).alias("opening"), g(2).alias("prefix"), g(3).alias("separator"), n.alias("number"),
            F.length(F.regexp_replace(g(4), "^-", "")).alias("width"), g(5).alias("closing"),
        ),
    )


def print_prefix_id(p: Column) -> Column:
    digits = F.lpad(F.regexp_replace(p["number"].cast("string"), "^-", ""), p["width"], F.lit("0"))
    return F.concat(p["opening"], p["prefix"], p["separator"], F.when(p["number"] < 0, "-").otherwise(""), digits, p["closing"])


def is_path(v: Column) -> Column:
    return v.rlike(PATH) & ~F.contains(v, F.lit("//"))


def path_segments(v: Column) -> Column:
    """The segments of a path between its slashes; none for "/"."""
    inner = F.regexp_replace(v, "^/|/$", "")
    return F.when(F.length(inner) > 0, F.split(inner, "/")).otherwise(F.expr("cast(array() as array<string>)"))


def print_path(segments: Column, trailing: Column) -> Column:
    joined = F.concat(F.lit("/"), F.array_join(segments, "/"))
    return F.when(F.size(segments) == 0, F.lit("/")).otherwise(F.concat(joined, F.when(trailing, "/").otherwise("")))


def dash_pattern(v: Column) -> Column:
    """Lengths of the runs of hex digits between dashes."""
    return F.transform(F.split(v, "-"), F.length)


def kind(v: Column) -> Column:
    """The kind of one value, by the first recogniser that takes it."""
    tests = [
        ("empty", F.length(v) == 0),
        ("boolean", v.isin("true", "false")),
        ("clf_fragment", F.startswith(v, F.lit("[")) & ~F.endswith(v, F.lit("]")) & parse_clf(F.concat(v, F.lit("]"))).isNotNull()),
        ("clf", parse_clf(v).isNotNull()),
        ("prefix_id", parse_prefix_id(v).isNotNull()),
        ("iso", parse_iso(v).isNotNull()),
        ("ipv4", is_ipv4(v)),
        ("number", is_number(v)),
        ("float", v.rlike(FLOAT)),
        ("uuid", v.rlike(UUID)),
        ("hex", v.rlike(HEX) & (F.length(v) > 6)),
        ("path", is_path(v)),
        ("hostname", v.rlike(HOSTNAME)),
    ]
    return reduce(lambda rest, t: F.when(t[1], t[0]).otherwise(rest), reversed(tests), F.lit("text"))


#: Tests of a token that varies between lines of one template, in their order.
VARIABLE_TOKENS = {
    "address": r"^/?[0-9]{1,3}(\.[0-9]{1,3}){3}(:.*)?$",
    "hostname": r"^(?=.{5,}$)[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+$",
    "path": r"^/[A-Za-z0-9/._~%-]{3,}$",
    "number": r"^[0-9.-]*[0-9][0-9.-]*$",
    "clock": r"^(?=[^:]*:)[0-9:]*[0-9][0-9:]*$",
    "hex": r"^[0-9a-fA-F]{7,}$",
    "block": r"^(?=.*[0-9])blk[_-].*$",
    "joined": r"^(?=.*[0-9])(?=.*[A-Za-z])(?=.*[_-]).{5,}$",
    "numbered": r"^[A-Za-z][A-Za-z0-9]{0,18}[0-9]$",
    "user_at_host": r"^[A-Za-z0-9_-]+@[A-Za-z0-9_-]+$",
    "hashed": r"^#[A-Za-z0-9]+#$",
    "process": r"^[^\[\]]*\[[0-9]+\].*$",
}


def is_variable_token(token: Column) -> Column:
    return reduce(lambda a, b: a | b, (token.rlike(p) for p in VARIABLE_TOKENS.values()))
