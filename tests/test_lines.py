import json

import pytest
from pyspark.sql import functions as F

from stratalog.functions import bits
from stratalog.operators import columns, encoders, json_lines, parse, select, similar, templates
from stratalog.plans import codec
from stratalog.sources import lines as source

SPACES = ["Jun  9 test", "test line\r", "\t" * 12 + "x", " " * 25, "a" + " " * 25, "only", "", "\x1e2", "a\x1eR", " x ", "tab\tin", "10" + " " * 10 + "x", "\r", "  \r", "\t \t"]


def frame(spark, lines):
    return source.lines_from(spark, lines)


def in_order(df, c="x"):
    return [r[c] for r in df.orderBy("line_no").collect()]


def test_spaces(spark):
    df = frame(spark, SPACES)
    marked = templates.mark_spaces(F.col("line"))
    assert in_order(df.withColumn("x", templates.restore_spaces(marked))) == SPACES
    assert "\x1e2" in in_order(df.withColumn("x", marked))[0]
    parts = templates.split_spaces(F.col("line"))
    assert in_order(df.withColumn("x", templates.join_spaces(parts["tokens"], parts["gaps"]))) == SPACES


LINES = [
    "Error at line 123", "Error at line 456", "Jun  9 06:06:01 combo sshd(pam_unix)[19939]: session opened", "", "   ", "a <*> b", "<*>", "x" * 40_000,
    "hub 1-0:1.0: 6 ports detected", "hub 1-0:1.0: USB hub found", "hub 1-3:1.0: 2 ports detected", *SPACES, "\x1ET3\x1Ex", "é ü 中", "10 20 30", "<*> 5 <*>",
]


def test_exact_match(spark):
    rows = templates.exact_match_mine(frame(spark, LINES), ["stream_id"])
    back = rows.withColumn("x", templates.restore_line(F.col("template"), F.col("variables"), F.col("gaps"), F.col("raw")))
    assert in_order(back) == LINES
    ids = in_order(rows, "template_id")
    assert ids[0] == ids[1] == 0 and in_order(rows, "variables")[1] == ["456"]


def test_similarity_miner(spark):
    df = source.with_chunks(frame(spark, LINES))
    rows, found = templates.encode_text(df)
    assert in_order(templates.decode_text(rows, found), "line") == LINES
    assert in_order(rows, "cluster")[0] == in_order(rows, "cluster")[1]
    texts = {r["template"] for r in found.collect()}
    assert "Error at line <*>" in texts


def test_miner_in_order():
    m = templates.Miner()
    assert [m.add(x.split()) for x in ("a b c d", "a b x y", "a q r s", "z b c d", "")] == [0, 0, 1, 2, None]
    assert m.clusters[0] == ["a", "b", None, None]
    small = templates.Miner(most=1)
    assert [small.add(x.split()) for x in ("a b", "c d", "a b")] == [0, None, 0]


def test_parsers(spark):
    access = '10.0.0.1 - bob [09/Jun/2005:06:06:01 +0000] "GET /x HTTP/1.1" 200 - "http://r" "agent"'
    df = frame(spark, [access, access.replace("GET /x HTTP/1.1", "-"), "Jun  9 06:06:01 combo sshd(pam_unix)[19939]: session opened", "081109 203615 148 INFO dfs.DataNode: Served block blk_-38 to /10.1.1.1", "none"])
    a = in_order(df.withColumn("x", parse.parse_access(F.col("line"))))
    assert (a[0]["path"], a[0]["size"], a[0]["agent"], a[1]["request"], a[1]["path"], a[2]) == ("/x", "-", "agent", "-", None, None)
    s = in_order(df.withColumn("x", parse.parse_syslog(F.col("line"))))
    assert (s[2]["program"], s[2]["pid"], s[4]) == ("sshd(pam_unix)", "19939", None)
    b = in_order(df.withColumn("x", parse.parse_block_log(F.col("line"))))
    assert (b[3]["blocks"], b[3]["template"]) == (["blk_-38"], "Served block <BLK> to /<IP>")


def test_line_formats(spark):
    cells = ['{"key": "value"}', "Error at line 123", "  { partial json", '  {"a":1} ', "[1, 2]", "{not json}", "", '{"a": "\\u00e9"}']
    df = frame(spark, cells)
    assert in_order(df.withColumn("x", parse.line_format(F.col("line")))) == ["JSON", "TEXT", "TEXT", "JSON", "TEXT", "TEXT", "TEXT", "TEXT"]
    assert in_order(df.withColumn("x", parse.is_json_or_array(F.col("line"))))[4] is True
    assert in_order(df.withColumn("x", parse.json_depth(F.lit('{"a": [{"b": "}"}]}'))))[0] == 3


JSON = [
    '{"a":1,"b":2,"c":3}', '{"c":3,"b":2,"a":1}', '{"a": 1, "b": 2}', '{"a.b":1,"a":{"b":1}}', '{"a":1e5,"b":1.0,"c":18446744073709551615,"d":-0,"e":0.1000}', '{"a":1,"a":2}',
    ' {"a":1}', '{"a": 1,"b":2}', '{"k":"\\u00e9"}', "[1]", "{}", '{"a":{},"b":[],"c":null,"d":""}', '{"x":[{"p":1},{"q":null},{}]}', '{"a":{"[0]":1}}', "not json", '{"a":"_ABSENT_"}',
]


@pytest.mark.parametrize("depth,arrays", [(None, False), (1, False), (None, True)])
def test_json_lines(spark, depth, arrays):
    rows = json_lines.flatten_lines(frame(spark, JSON), depth=depth, arrays=arrays)
    assert in_order(json_lines.unflatten_lines(rows), "line") == JSON
    raw = in_order(rows, "raw")
    assert raw[0] is None and raw[4] is None and raw[-2] == "not json"


def test_json_meaning(spark):
    df = spark.createDataFrame([('{"a":1,"b":[1,2]}', '{ "b":[1, 2], "a": 1}'), ('{"a":1}', '{"a":2}')], "p string, q string")
    assert [r[0] for r in df.select(select.same_json(F.col("p"), F.col("q"))).collect()] == [True, False]
    assert df.select(select.first_difference(F.col("p"), F.col("q"))).collect()[1][0] == '[["a"], 1]'


def test_files(spark, tmp_path):
    contents = {"a.log": b"Line 1\nLine 2", "b.log": b"x\n\n\xff\xfe\x00\r\ny\n", "c.log": b"\n", "d.log": bytes(range(256)) * 3, "e.log": b'{"a": 1}\nplain 5\n{"a": 2}\n', "f.log": b""}
    contents["g.log"] = b"".join(b"line %d of many\n" % k for k in range(12_345)) + b"the last"
    (tmp_path / "in").mkdir()
    for name, data in contents.items():
        (tmp_path / "in" / name).write_bytes(data)
    codec.compress(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    rows = codec.decompress(spark, str(tmp_path / "out")).orderBy("stream_id", "chunk_id").collect()
    found = {}
    for r in rows:
        name = r["stream_id"].rsplit("/", 1)[1]
        found[name] = found.get(name, b"") + bytes(r["content"])
    assert found == contents and len(rows) == len(contents) + 2
    stream = next(r["stream_id"] for r in rows if r["stream_id"].endswith("a.log"))
    assert list(codec.iterate(codec.load(spark, str(tmp_path / "out")), stream)) == ["Line 1", "Line 2"]
    (tmp_path / "half").mkdir()
    with pytest.raises(ValueError, match="manifest"):
        codec.load(spark, str(tmp_path / "half"))


def broadcast_parts(df):
    """The parts of df's plan below its broadcasts, as text."""
    lines, parts = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = lines[k + 1 :]
            end = next((i for i, x in enumerate(below) if depth(x) <= depth(line)), len(below))
            parts.append("\n".join(below[:end]))
    return parts


def test_lines_of_small_files_are_not_broadcast(spark, tmp_path):
    """Files of repeated lines take few bytes, however many rows they hold: no plan may broadcast those."""
    content = b"".join(b'{"k": %d}\n' % (k % 100) for k in range(11_000)) + b"".join(b"user %d in\n" % (k % 7) for k in range(1_000))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_bytes(content)
    (tmp_path / "in" / "empty.log").write_bytes(b"")
    codec.compress(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    restored, lines = codec.decompress(spark, str(tmp_path / "out")), source.read_lines(spark, str(tmp_path / "in"))
    checked = codec.verify(lines, codec.load(spark, str(tmp_path / "out")))
    for df in (restored, checked):
        for part in broadcast_parts(df):
            assert "line_no#" not in part and "template#" not in part
    rows = restored.orderBy("stream_id", "chunk_id").collect()
    assert b"".join(bytes(r["content"]) for r in rows) == content and [r["chunk_id"] for r in rows] == [0, 1, 2, 0]
    assert [(r["n"], r["lossless"]) for r in checked.collect()] == [(12_000, True)]


def test_any_iterable(spark, tmp_path):
    rows = source.lines_from(spark, (f"l{k}" for k in range(25)), batch=10, path=str(tmp_path / "lines")).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in rows] == [(k, f"l{k}") for k in range(25)]
    assert source.lines_from(spark, ["a", "b"]).count() == 2
    with pytest.raises(ValueError, match="path"):
        source.lines_from(spark, (str(k) for k in range(11)), batch=10)


def test_large_reader(spark, tmp_path):
    (tmp_path / "x.log").write_text("\n".join(f"line {k}" for k in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = source.read_large_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["line_no"], r["line"]) for r in rows] == [(k, f"line {k}") for k in range(5000)]


def test_codec_of_mixed_lines(spark, tmp_path):
    lines_ = [x for pair in zip(LINES, JSON) for x in pair]
    df = frame(spark, lines_)
    made = codec.encode(df, 5, 7)
    assert in_order(codec.decode(made), "line") == lines_
    assert codec.verify(df, made).collect()[0]["lossless"]
    for sizes in ((), (3, 4)):
        frames = codec.chunk_frames(df, *sizes)
        assert in_order(codec.frame_lines(frames), "line") == lines_
    again = codec.decode_by_column(codec.encode_by_column(made, encoders.kept_in(spark, str(tmp_path))))
    assert in_order(codec.decode(again), "line") == lines_


def test_verification_finds_differences(spark):
    a, b = frame(spark, ["x", "y", "z"]), frame(spark, ["x", "q"])
    r = select.verify(a, b, ["stream_id", "line_no"], "line").collect()[0]
    assert (r["n"], r["n_different"], r["lossless"], r["first_difference"]["line_no"]) == (3, 2, False, 1)


def test_similar_lines(spark):
    lines_ = ["user 001 in", "user 002 in", "other", "user 003 in", "nothing like it", "user 0039 in"]
    df = frame(spark, lines_)
    rows = similar.xor_lines(similar.reference_lines(df, ["stream_id"]))
    assert in_order(rows, "reference") == [None, 0, None, 1, None, None]
    back = F.when(F.col("reference").isNull(), F.col("line")).otherwise(similar.unxor(F.col("xor"), F.col("reference_line"), F.length("line")))
    assert in_order(rows.withColumn("x", back)) == lines_
    assert in_order(similar.bucketed_reference_lines(df, ["stream_id"]), "reference")[5] == 3


def test_single_value_columns(spark):
    df = spark.createDataFrame([("c", 0, "[09/Jun/2005:06:06:01"), ("d", 0, ""), ("e", 0, "x"), ("n", 0, "6"), ("n", 1, ""), ("n", 2, "2"), ("p", 0, "a-1"), ("p", 1, "b-2")], "k string, o int, value string")
    kinds = {r["k"]: r["column_type"] for r in columns.choose_type(columns.profile(df, ["k"])).collect()}
    assert kinds == {"c": "CLF_FRAGMENT", "d": "DICTIONARY", "e": "DICTIONARY", "n": "DICTIONARY", "p": "DICTIONARY"}


def test_encoded_columns(spark, tmp_path):
    """Every type of column, with values that don't fit it, empty texts and absent values."""
    cells = {
        "prefix": ["req-001", "req-0x", "req-12", "req--5", None, "req-003"] * 5 + [f"req-{k:03d}" for k in range(60)], "time": [f"2024-01-02T03:04:{k:02d}.5Z" for k in range(60)] + ["2024-01-02 03:04:05+01:00"],
        "clf": [f"[09/Jun/2005:06:{k:02d}:01 +0000]" for k in range(60)] + ["no time"], "fragment": [f"[09/Jun/2005:06:{k:02d}:01" for k in range(40)], "ip": [f"10.0.{k % 7}.{k}" for k in range(50)] + ["10.0.0.256"],
        "number": ["6", "", "2", ""], "up": [str(k * k) for k in range(400)] + ["007"], "few": [str(x) for x in (5, 900_000_000_000, 5, 7) * 60], "path": ["/a/b/", "/a/c", "/", "/a//", "/x"][:3] * 3 + ["/x"],
        "word": ["x", "y", "x", "é\n"], "text": [f"free text {k} é" for k in range(300)], "none": [None, None], "flag": ["true", "false", "true"],
    }
    df = spark.createDataFrame([(k, i, v) for k, vs in cells.items() for i, v in enumerate(vs)], "k string, o int, value string")
    made = encoders.encode_columns(df, ["k"], "o", keep=encoders.kept_in(spark, str(tmp_path / "a")))
    back = {(r["k"], r["o"]): r["value"] for r in encoders.decode_columns(made, ["k"], "o").collect()}
    assert back == {(k, i): v for k, vs in cells.items() for i, v in enumerate(vs) if v is not None}
    chosen = {r["k"]: (r["column_type"], r["encoding"]) for r in made.columns.collect()}
    assert chosen["up"] == ("NUMBER", "DELTA") and chosen["few"] == ("NUMBER", "DICTIONARY") and chosen["path"] == ("PATH", "PATH") and chosen["number"] == ("DICTIONARY", "DICTIONARY") and chosen["text"] == ("RAW", "RAW")
    assert chosen["prefix"][0] == "PREFIX_ID" and chosen["fragment"][0] == "CLF_FRAGMENT" and chosen["ip"][0] == "IPV4"
    sizes = {(r["k"], r["method"]): r for r in encoders.column_candidates(df, ["k"], "o", keep=encoders.kept_in(spark, str(tmp_path / "b"))).collect()}
    assert all(r["lossless"] for k, r in sizes.items() if k[0] != "none") and sizes["up", "TYPED"]["bytes"] < sizes["up", "RAW"]["bytes"]
    codes = {(r["k"], r["place"]): r["code"] for r in encoders.unpack_codes(encoders.pack_codes(made, ["k"], "o"), ["k"]).collect()}
    assert [codes["word", k] for k in range(4)] == [0, 1, 0, 2]


def test_long_inputs(spark):
    """What used to copy an array for every element stays linear."""
    n = 20_000
    df = spark.range(1).select(F.sequence(F.lit(0), F.lit(n - 1)).alias("v"))
    small = F.transform("v", lambda x: (x % 128).cast("long"))
    assert df.select(bits.unpack(bits.pack(small, 7), 7, F.lit(n)) == small).first()[0]
    assert df.select(bits.unvarints(bits.varints(small)) == small).first()[0]
    runs = F.transform("v", lambda x: F.when(x % 700 < 690, 0).otherwise(x % 250 + 1).cast("int"))
    assert df.select(bits.unzero_runs(bits.zero_runs(runs)) == runs).first()[0]
    ratios = F.transform("v", lambda x: (x % 7) / 10.0)
    assert df.select(F.size(source.adaptive_sizes(ratios))).first()[0] == n + 1
    line = F.array_join(F.transform("v", lambda x: F.when(x % 2 == 0, "word").otherwise(x.cast("string"))), "  ")
    rows = df.select(F.lit("s").alias("stream_id"), F.lit(0).cast("long").alias("chunk_id"), F.lit(0).cast("long").alias("line_no"), line.alias("line"))
    made, found = templates.encode_text(rows)
    assert templates.decode_text(made, found).first()["line"] == rows.first()["line"] and made.first()["raw"] is None


def test_synthetic_logs(spark):
    rows = source.made_json_lines(spark, 50).collect()
    assert all(json.loads(r["line"])["request_id"].startswith("req-") for r in rows)
    assert source.made_json_lines(spark, 50).collect() == rows
