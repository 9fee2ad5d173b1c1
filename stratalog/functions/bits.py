"""Byte- and bit-level encodings as column expressions: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(v: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 ... become 0, 1, 2, 3 ..."""
    v = v.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(z: Column) -> Column:
    z = z.cast("long")
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("long")))


def bit_length(v: Column) -> Column:
    """Bits of the unsigned value; 0 for 0, 64 for what reads as negative."""
    return F.when(v < 0, 64).when(v == 0, 0).otherwise(F.length(F.bin(v.cast("long"))))


def varint_size(v: Column) -> Column:
    """Bytes that the value takes with seven bits a byte."""
    return F.greatest(F.lit(1), F.ceil(bit_length(v) / 7)).cast("int")


def varint_hex(v: Column) -> Column:
    """The value with seven bits a byte, low ones first, the high bit set in all but the last; as hex."""
    v = v.cast("long")
    last = varint_size(v) - 1

    def byte(i: Column) -> Column:
        low = F.call_function("shiftrightunsigned", v, 7 * i).bitwiseAND(F.lit(127).cast("long"))
        return F.lpad(F.hex(F.when(i < last, low + 128).otherwise(low)), 2, "0")

    return F.array_join(F.transform(F.sequence(F.lit(0), last), byte), "")


def varint(v: Column) -> Column:
    return F.unhex(varint_hex(v))


def varints(values: Column) -> Column:
    """A list of values as varints one after another."""
    return F.unhex(F.array_join(F.transform(values, varint_hex), ""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body's lambdas use it: an expression that a
    lambda refers to is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


NO_LONGS = "cast(array() as array<bigint>)"


def _hex_pairs(b: Column) -> Column:
    """The bytes of a binary column as two hex digits each. Cut by one pass of a pattern: taking the
    parts of a text by their places is a walk from its start for each."""
    return F.regexp_extract_all(F.hex(b), F.lit(".."), F.lit(0))


def _bytes(b: Column) -> Column:
    """The bytes of a binary column as array<long>."""
    return F.transform(_hex_pairs(b), lambda p: F.conv(p, 16, 10).cast("long"))


def unvarints(b: Column) -> Column:
    """All values of a run of varints: the bytes in groups that end with one below 128."""
    groups = F.regexp_extract_all(F.hex(b), F.lit("(?:[89A-F].)*[0-7]."), F.lit(0))

    def value(g: Column) -> Column:
        digits = F.regexp_extract_all(g, F.lit(".."), F.lit(0))
        seven = lambda p, i: F.call_function("shiftleft", F.conv(p, 16, 10).cast("long").bitwiseAND(F.lit(127).cast("long")), 7 * i)
        return F.aggregate(F.transform(digits, seven), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    return F.transform(groups, value)


def unvarint(b: Column) -> Column:
    return F.element_at(unvarints(b), 1)


def index_width(n_distinct: Column) -> Column:
    """Bits of a dictionary index."""
    return F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(n_distinct, F.lit(1)).cast("double")))).cast("int")


def template_index_width(largest: Column, any_raw: Column) -> Column:
    """Bits of a template index: 16 as soon as a line has none, else what the largest one needs."""
    return F.when(any_raw, 16).otherwise(F.greatest(F.lit(1), bit_length(largest))).cast("int")


def index_bytes(n_distinct: Column) -> Column:
    """Whole bytes of a dictionary index: 1, 2 or 4."""
    return F.when(n_distinct <= 256, 1).when(n_distinct <= 65536, 2).otherwise(4)


def packed_size(n: Column, bits: Column) -> Column:
    return F.ceil(n * bits / 8).cast("long")


def pack(values: Column, bits: Column | int) -> Column:
    """A list of values of `bits` bits each, low bits first, as binary. Built as text of binary digits,
    the first value last, so that each value is printed once."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    digits = lambda v: F.right(F.lpad(F.bin(F.coalesce(v, F.lit(0)).cast("long")), 64, "0"), bits)
    whole = F.array_join(F.reverse(F.transform(values, digits)), "")
    padded = lambda w: F.concat(F.repeat(F.lit("0"), F.pmod(-F.length(w), F.lit(8))), w)
    octets = lambda w: F.reverse(F.regexp_extract_all(padded(w), F.lit(".{8}"), F.lit(0)))
    return F.coalesce(F.unhex(F.array_join(F.transform(let(whole, octets), lambda o: F.lpad(F.conv(o, 2, 16), 2, "0")), "")), F.lit(b""))


def unpack(b: Column, bits: Column | int, n: Column) -> Column:
    """n values of `bits` bits each from binary. The bits are cut by a pattern, two binary digits of
    text a step, so the work is linear in them."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    whole = F.array_join(F.reverse(F.transform(_hex_pairs(b), lambda p: F.lpad(F.conv(p, 16, 2), 8, "0"))), "")
    used = lambda w: F.right(w, (n * bits).cast("int"))
    cut = lambda w: F.regexp_extract_all(used(w), F.concat(F.lit(".{"), bits.cast("string"), F.lit("}")), F.lit(0))
    # 64 binary digits in two halves: conv of a negative number would be unsigned
    signed = lambda d: F.call_function("shiftleft", F.conv(F.left(F.lpad(d, 64, "0"), F.lit(32)), 2, 10).cast("long"), F.lit(32)).bitwiseOR(F.conv(F.right(F.lpad(d, 64, "0"), F.lit(32)), 2, 10).cast("long"))
    return F.when(n > 0, F.reverse(F.transform(let(whole, cut), signed))).otherwise(F.expr(NO_LONGS))


def to_codes(text: Column) -> Column:
    """The Latin-1 codes of a text's characters."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    return F.when(F.length(text) > 0, codes).otherwise(F.expr("cast(array() as array<int>)"))


def xor_codes(a: Column, b: Column) -> Column:
    """Elementwise XOR of two code lists; the shorter one counts as padded with zeros."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).bitwiseXOR(F.coalesce(y, F.lit(0))))


def zero_runs(codes: Column) -> Column:
    """Runs of zeros as (0, length up to 255), other codes as they are. The places where runs of zeros
    start are found first; each run is then cut by its length."""
    none = F.expr("cast(array() as array<int>)")
    starts = lambda c: F.filter(F.transform(c, lambda x, i: F.when((i == 0) | (x != 0) | (F.get(c, i - 1) != 0), i)), lambda i: i.isNotNull())

    def run(c: Column, at: Column, end: Column) -> Column:
        size = end - at
        full = F.floor((size - 1) / 255).cast("int")
        pairs = F.concat(F.flatten(F.array_repeat(F.array(F.lit(0), F.lit(255)), full)), F.array(F.lit(0), size - 255 * full))
        return F.when(F.get(c, at) == 0, pairs).otherwise(F.array(F.get(c, at)))

    def folded(c: Column) -> Column:
        return let(starts(c), lambda s: F.flatten(F.transform(s, lambda at, k: run(c, at, F.coalesce(F.get(s, k + 1), F.size(c))))))

    return F.when(codes.isNotNull(), F.when(F.size(codes) > 0, let(codes, folded)).otherwise(none))


def unzero_runs(runs: Column) -> Column:
    """The inverse: a run's length is what follows a zero, since lengths are over 0."""
    none = F.expr("cast(array() as array<int>)")

    def opened(r: Column) -> Column:
        return F.flatten(F.transform(r, lambda x, i: F.when((i > 0) & (F.get(r, i - 1) == 0), F.array_repeat(F.lit(0), x)).when(x == 0, none).otherwise(F.array(x))))

    return F.when(runs.isNotNull(), F.when(F.size(runs) > 0, let(runs, opened)).otherwise(none))


def escape(text: Column) -> Column:
    """Backslash and line end as two characters each."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """The inverse, reading from left to right, so that an escaped backslash before an n stays one."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\\.|[^\\]+|\\"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p == "\\n", "\n").when(p == "\\\\", "\\").otherwise(p)), "")


def to_latin1(b: Column) -> Column:
    """Bytes as a text whose characters are the bytes' codes."""
    return F.decode(b, "ISO-8859-1")


def from_latin1(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def signed_width(v: Column) -> Column:
    """Bytes (1, 2, 4, 8) of a signed value."""
    return F.when(v.between(-128, 127), 1).when(v.between(-32768, 32767), 2).when(v.between(-2147483648, 2147483647), 4).otherwise(8)


def unsigned_width(span: Column) -> Column:
    """Bytes (1, 2, 4, 8) of a value from 0 to span."""
    return F.when(span < 256, 1).when(span < 65536, 2).when(span < 4294967296, 4).otherwise(8)


def split_decimal(text: Column) -> Column:
    """A decimal's sign, digits and number of decimals; null where printing them differs."""
    parts = F.split(F.regexp_replace(text, "^-", ""), r"\.")
    digits = F.concat(F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    fits = text.rlike(r"^-?[0-9]+\.[0-9]+$") & (F.length(digits) <= 16)
    return F.when(
        fits,
        F.struct(
            F.startswith(text, F.lit("-")).alias("negative"),
            F.try_to_number(digits, F.lit("9" * 16)).cast("long").alias("digits"),
            F.length(digits).alias("n_digits"),
            F.length(F.get(parts, F.lit(1))).alias("decimals"),
        ),
    )


def join_decimal(d: Column) -> Column:
    digits = F.lpad(d["digits"].cast("string"), d["n_digits"], F.lit("0"))
    whole = F.substring(digits, F.lit(1), d["n_digits"] - d["decimals"])
    return F.concat(F.when(d["negative"], "-").otherwise(""), whole, F.lit("."), F.substring(digits, d["n_digits"] - d["decimals"] + 1, d["decimals"]))


def ipv4_to_long(ip: Column) -> Column:
    """The address as a number; null unless printing it gives the same text."""
    p = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("long"))
    value = F.get(p, F.lit(0)) * 16777216 + F.get(p, F.lit(1)) * 65536 + F.get(p, F.lit(2)) * 256 + F.get(p, F.lit(3))
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return F.when(ip.rlike(rf"^{octet}(\.{octet}){{3}}$"), value)


def long_to_ipv4(v: Column) -> Column:
    each = (F.shiftright(v, s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0))
    return F.concat_ws(".", *each)


def ipv4_delta_size(now: Column, before: Column) -> Column:
    """Bytes of an address after another: 2 or 3 where three or two octets are the same, else 5."""
    x = now.bitwiseXOR(before)
    return F.when(before.isNull(), 5).when(x < 256, 2).when(x < 65536, 3).otherwise(5)


def status_byte(code: Column) -> Column:
    """An HTTP status as one byte; null beyond 100 to 355."""
    return F.when(code.between(100, 355), code - 100)


def uuid_bytes(text: Column) -> Column:
    """A canonical UUID as 16 bytes; null for any other spelling."""
    return F.when(text.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.unhex(F.replace(text, F.lit("-"), F.lit(""))))


def bytes_uuid(b: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(b)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def hex_bytes(text: Column) -> Column:
    """Lower-case hex of even length as bytes; null for any other spelling."""
    return F.when(text.rlike("^([0-9a-f]{2})+$"), F.unhex(text))


def format_bytes(n: Column) -> Column:
    """A size for people: B, KB, MB or GB."""
    scaled = lambda d, unit: F.concat(F.format_string("%.1f", F.floor(n * 10 / float(d) + 0.5) / 10.0), F.lit(f" {unit}"))
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, scaled(1 << 10, "KB"))
        .when(n < 1 << 30, scaled(1 << 20, "MB"))
        .otherwise(scaled(1 << 30, "GB"))
    )


def format_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.format_string("%.2f%%", F.lit(100.0) * part / whole)).otherwise("-")
