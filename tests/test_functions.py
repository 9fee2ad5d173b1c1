import pytest
from pyspark.sql import functions as F

from stratalog.functions import bits, packing, values


def column(spark, cells, kind="string"):
    return spark.createDataFrame([(k, c) for k, c in enumerate(cells)], f"k int, v {kind}")


def result(df, c):
    return [r[0] for r in df.orderBy("k").select(c.alias("x")).collect()]


BIG = [0, 1, 127, 128, 255, 256, 16383, 16384, 2**63 - 1, -1]


def test_varint(spark):
    df = column(spark, BIG, "long")
    v = F.col("v")
    assert result(df, bits.unvarint(bits.varint(v))) == BIG
    assert result(df, F.octet_length(bits.varint(v))) == result(df, bits.varint_size(v)) == [1, 1, 1, 2, 2, 2, 2, 3, 9, 10]
    assert result(df.filter("k = 3"), F.hex(bits.varint(v))) == ["8001"]


def test_zigzag(spark):
    cells = [0, -1, 1, -2, 2**63 - 1, -(2**63)]
    df = column(spark, cells, "long")
    assert result(df, bits.zigzag(F.col("v")))[:4] == [0, 1, 2, 3]
    assert result(df, bits.unzigzag(bits.zigzag(F.col("v")))) == cells


@pytest.mark.parametrize("cells,width,size", [([0, 1, 2, 3, 0, 1, 2, 3], 2, 2), ([0, 0xFFFF, 1, 0xFFFF], 16, 8), ([], 3, 0), ([5], 3, 1)])
def test_packing(spark, cells, width, size):
    df = column(spark, [cells], "array<long>")
    packed = bits.pack(F.col("v"), width)
    assert result(df, F.octet_length(packed)) == [size]
    assert result(df, bits.unpack(packed, width, F.size("v"))) == [cells]


def test_widths(spark):
    df = column(spark, [1, 2, 3, 4, 5, 256, 257], "long")
    assert result(df, bits.index_width(F.col("v"))) == [1, 1, 2, 2, 3, 8, 9]
    assert result(df, bits.template_index_width(F.col("v"), F.lit(False))) == [1, 2, 2, 3, 3, 9, 9]
    assert result(df, bits.template_index_width(F.col("v"), F.lit(True))) == [16] * 7


HOSTILE = ["a\nb", "a\\nb", "\\", "\\\\n", "trailing\\", "nul\x00", ""]


def test_escape(spark):
    df = column(spark, HOSTILE)
    assert result(df, bits.unescape(bits.escape(F.col("v")))) == HOSTILE
    assert not any("\n" in x for x in result(df, bits.escape(F.col("v"))))


def test_latin1(spark):
    whole = bytes(range(256))
    df = column(spark, [bytearray(whole)], "binary")
    assert result(df, bits.from_latin1(bits.to_latin1(F.col("v")))) == [whole]


def test_ipv4(spark):
    cells = ["10.1.2.3", "010.1.1.1", "256.1.1.1", "1.2.3", "1.2.3.4:80", "255.255.255.255", "0.0.0.0"]
    df = column(spark, cells)
    assert result(df, bits.ipv4_to_long(F.col("v"))) == [167838211, None, None, None, None, 4294967295, 0]
    assert result(df.filter("k in (0, 5, 6)"), bits.long_to_ipv4(bits.ipv4_to_long(F.col("v")))) == ["10.1.2.3", "255.255.255.255", "0.0.0.0"]


def test_decimals(spark):
    cells = ["-0.50", "12.300", "1e5", "7", "000.10"]
    df = column(spark, cells)
    assert result(df, bits.join_decimal(bits.split_decimal(F.col("v")))) == ["-0.50", "12.300", None, None, "000.10"]


def test_binary(spark):
    cells = ["123e4567-e89b-12d3-a456-426614174000", "123E4567-e89b-12d3-a456-426614174000", "abc", "abcd", "ABCD"]
    df = column(spark, cells)
    assert result(df, bits.bytes_uuid(bits.uuid_bytes(F.col("v")))) == [cells[0], None, None, None, None]
    assert result(df, F.lower(F.hex(bits.hex_bytes(F.col("v"))))) == [None, None, None, "abcd", None]


def test_zero_runs(spark):
    cells = [[0] * 300, [1, 0, 0, 2], [], [0], [5]]
    df = column(spark, cells, "array<int>")
    assert result(df, bits.zero_runs(F.col("v"))) == [[0, 255, 0, 45], [1, 0, 2, 2], [], [0, 1], [5]]
    assert result(df, bits.unzero_runs(bits.zero_runs(F.col("v")))) == cells


ISO = ["2024-02-29T00:00:00Z", "1999-12-31 23:59:59.999999999+02:00", "1969-12-31T23:59:59.5", "2024-01-01T10:00:00.123+0200"]
NOT_ISO = ["2023-02-29T00:00:00Z", "9999-12-31T00:00:00Z", "2024-01-01", "2024-01-01T24:00:00", "", "2024-01-01T00:00:60Z"]


def test_iso(spark):
    df = column(spark, ISO + NOT_ISO)
    assert result(df, values.print_iso(values.parse_iso(F.col("v")))) == ISO + [None] * len(NOT_ISO)
    assert result(df.filter("k = 2"), values.parse_iso(F.col("v"))["nanos"]) == [-500_000_000]


CLF = ["[09/Jun/2005:06:06:01 +0000]", "29/Feb/2024:23:59:59", "[31/Dec/1969:23:59:59 -0700"]


def test_clf(spark):
    bad = ["[30/Feb/2024:00:00:00 +0000]", "01/Foo/2024:00:00:00", "x"]
    df = column(spark, CLF + bad)
    assert result(df, values.print_clf(values.parse_clf(F.col("v")))) == CLF + [None] * 3


def test_prefix_ids(spark):
    good = ["req-1", "req-0001", "blk_-5", '"req-1",', "a9_0", "x-9223372036854775807"]
    bad = ["req1", "-5", "x-9223372036854775808", "req-", "blk_-0"]
    df = column(spark, good + bad)
    assert result(df, values.print_prefix_id(values.parse_prefix_id(F.col("v")))) == good + [None] * len(bad)


def test_kinds(spark):
    cells = ["", "true", "007", "-0", "9223372036854775808", "1.5", "/a/b", "/a//b", "host.example.com", "deadbeef", "[09/Jun/2005:06:06:01", "x y"]
    df = column(spark, cells)
    assert result(df, values.kind(F.col("v"))) == ["empty", "boolean", "text", "text", "number", "float", "path", "text", "hostname", "hex", "clf_fragment", "text"]


def test_paths(spark):
    cells = ["/", "/a", "/a/", "/a/b.c/d"]
    df = column(spark, cells)
    v = F.col("v")
    assert result(df, values.print_path(values.path_segments(v), F.endswith(v, F.lit("/")))) == cells


VARIABLE = ["10.1.1.1", "/10.1.1.1:80", "a.example", "/var/log", "-12.5", "20:36:15", "deadbeef1", "blk_1", "node-55", "cn450", "src@host", "#1#", "sshd[12]:"]
LITERAL = ["Error", "at", "/", "-", "a.b", ":", "abc", "@x", "##", "word", ".", "[x]"]


def test_variable_tokens(spark):
    df = column(spark, VARIABLE + LITERAL)
    assert result(df, values.is_variable_token(F.col("v"))) == [True] * len(VARIABLE) + [False] * len(LITERAL)


def test_hybrid_and_zstd(spark):
    rows = [("abcdef", "abcxef"), ("", "x"), ("aaaa" * 200, "aaaa" * 200), ("short", "a longer reference"), ("x" * 40_000, "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    packed = packing.hybrid(F.col("a"), F.col("b"))
    back = [r[0] for r in df.select(packing.unhybrid(packed, F.col("b"))).collect()]
    assert back == [a for a, _ in rows]
    frames = df.select("a", packing.zstd_compress(F.encode("a", "UTF-8")).alias("z"))
    assert [r[0].decode() for r in frames.select(packing.zstd_decompress(F.col("z"))).collect()] == [a for a, _ in rows]
