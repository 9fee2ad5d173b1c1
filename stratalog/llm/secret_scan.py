r"""Secret scanning with a random forest that removes false positives.

Candidates are runs of 12 or more credential characters, whichever comes first, with a digit or a
change of case, found by splitting every whole text where one starts, each with the word before it and
what joins the two (which may be, or hold, a candidate itself). Marks of prose and markup at a run's
ends aren't part of it. A random forest judges them by length, character transitions, dictionary
coverage, the document's path and the neighbouring words. It is trained on labelled findings: the ones
given, or by default ones made by rule from the known shapes of credentials and of their look-alikes
(hashes of commits, identifiers, paths, addresses, long words, numbers). The dictionary is a list of
words that the caller gives; it becomes a bit set, one literal of 128 KB however many words it has.
The trees become nested CASE expressions, so scanning is built-in expressions only, with no shuffle:
candidates stay in an array of their document. Findings are spans, and texts are redacted by cutting
these out, so the same characters elsewhere stay.

Training reads `labelled`, whose size bound is its caller's (the default makes made_rows rows);
the corpus is scanned whole.

Defined results: null and empty texts have no findings; a candidate that occurs twice is found
twice, in text order; ties and repeated rows give equal findings; a null path counts as an ordinary
one; an empty table gives an empty table; other columns pass through and clashing names get
underscores.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import free_name, let, running_sums

#: where a candidate starts, and what it is; nothing before it is consumed
RUN = r"[A-Za-z0-9+/_.@!#$%^~-]"
START = rf"(?<!{RUN})(?={RUN}{{12}})"
CANDIDATE = rf"^{RUN}{{12,}}={{0,2}}"
#: what is no part of a candidate at its ends
LEAD, TRAIL = r"^[.!#$^~-]+", r"[.!@/_~-]+$"
#: the end of the text before a candidate; group 1: the word before, group 2: what joins it
BEFORE = r"""([^\s"'=:]{1,32})(["'`]?\s{0,2}(?:=>|[=:])\s{0,2}["'`]?|\s{1,2}["'`]?|["'`(<])?\z"""
#: characters that BEFORE can span, and the candidates that can lie in them
REACH, NEAR = 48, 4

# Words that stand before credentials, before look-alikes, and in paths of samples.
CREDENTIAL_WORDS = "token|secret|passw|passwd|pwd|api|apikey|key|auth|bearer|credential|private|access|aws|session|signature"
LOOKALIKE_WORDS = "commit|sha|sha1|sha256|md5|hash|checksum|digest|rev|revision|uuid|guid|id|etag|integrity|version|build|blob|tree|parent"
SAMPLE_PATHS = "test|tests|spec|example|examples|sample|samples|fixture|fixtures|mock|docs|vendor|node_modules|lock"
PLACEHOLDERS = "example|sample|dummy|changeme|placeholder|your|xxxx|test|fake|redacted|lorem|1234567|abcdef"
DICTIONARY_BITS = 20
#: the words of a candidate: runs of letters, cut where the case rises
PARTS = "[A-Z]?[a-z]+|[A-Z]+"

FEATURES = [
    "length", "digit_share", "upper_share", "hex_only", "changes", "distinct_share", "vowel_share", "coverage",
    "longest_word", "dots", "dashes", "slashes", "at_sign", "prefixed", "placeholder", "said_credential", "said_lookalike", "assigned", "sample_path",
]


def dictionary_bits(words: Iterable[str]) -> bytes:
    """A set of words as bits by hash; of 50 000 words, one in twenty others is taken for one of them."""
    import xxhash

    bits = bytearray((1 << DICTIONARY_BITS) // 8)
    for w in words:
        h = xxhash.xxh64_intdigest(w.lower().encode(), 42) & ((1 << DICTIONARY_BITS) - 1)
        bits[h >> 3] |= 1 << (h & 7)
    return bytes(bits)


@dataclass
class Forest:
    """Trees as nested tuples (feature, threshold, left, right), leaves as probabilities of label 1, and
    the dictionary that their features are of."""

    trees: list
    bits: bytes


def _in_dictionary(word: Column, bits: bytes) -> Column:
    h = F.xxhash64(word).bitwiseAND(F.lit((1 << DICTIONARY_BITS) - 1).cast("long"))
    byte = F.conv(F.hex(F.substring(F.lit(bits), F.shiftright(h, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, h.bitwiseAND(F.lit(7).cast("long")).cast("int")).bitwiseAND(F.lit(1)) == 1


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def describe(value: Column, before: Column, joint: Column, path: Column, bits: bytes) -> dict[str, Column]:
    """FEATURES of a candidate as doubles; bits: dictionary_bits."""
    size = F.length(value).cast("double")
    lower = F.lower(value)
    said = F.lower(F.concat_ws(" ", before, F.when(F.instr(joint, "=") > 0, F.lit("="))))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    runs = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"[0-9]+", "0"), r"[a-z]+", "a"), r"[A-Z]+", "A"), r"[^0aA]+", "-"))
    letters_in_words = F.aggregate(F.split(lower, r"[^a-z]+"), F.lit(0), lambda m, w: F.greatest(m, F.length(w)))
    words = F.transform(F.filter(F.regexp_extract_all(value, F.lit(PARTS), F.lit(0)), lambda w: F.length(w) >= 3), F.lower)
    covered = F.aggregate(words, F.lit(0), lambda n, w: n + F.when(_in_dictionary(w, bits), F.length(w)).otherwise(0))
    return {
        "length": size,
        "digit_share": _count(value, "[0-9]") / size,
        "upper_share": _count(value, "[A-Z]") / size,
        "hex_only": one(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "changes": runs / size,
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / size,
        "vowel_share": _count(lower, "[aeiou]") / size,
        "coverage": covered / size,
        "longest_word": letters_in_words.cast("double"),
        "dots": _count(value, r"[.]").cast("double"),
        "dashes": _count(value, "[-_]").cast("double"),
        "slashes": _count(value, "/").cast("double"),
        "at_sign": one(F.instr(value, "@") > 0),
        "prefixed": one(value.rlike(r"^(AKIA|ASIA|AIza|gh[pousr]_|sk[-_]|pk[-_]|rk_|xox[abprs]-|eyJ|glpat-|SG\.|npm_)")),
        "placeholder": one(lower.rlike(f"({PLACEHOLDERS})") | value.rlike(r"(.)\1{5}")),
        "said_credential": one(said.rlike(f"(^|[^a-z])[a-z]*({CREDENTIAL_WORDS})[a-z]*")),
        "said_lookalike": one(said.rlike(f"(^|[^a-z])({LOOKALIKE_WORDS})([^a-z]|$)")),
        "assigned": one(joint.rlike("[=:]")),
        "sample_path": one(F.lower(F.coalesce(path, F.lit(""))).rlike(f"(^|[^a-z])({SAMPLE_PATHS})([^a-z]|$)")),
    }


def made_findings(spark: SparkSession, made_rows: int = 6000, first: int = 0) -> DataFrame:
    """Labelled findings made by rule: value, before, joint, path, label. Rows from first on: others than
    those of another range."""
    rows = spark.range(first, first + made_rows, 1, 2).select("id")
    draw = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    pick = lambda salt, words: F.element_at(F.array(*map(F.lit, words)), (draw(salt, len(words)) + 1).cast("int"))
    hexes = F.sha2(F.concat(F.lit("h"), F.col("id").cast("string")), 512)
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 512))), "[+/=]", "")
    size = F.lit(16) + draw("size", 32)
    upper = F.upper(F.regexp_replace(mixed, "[^A-Za-z0-9]", ""))
    words = ["request", "handler", "service", "message", "table", "value", "index", "group", "theon", "eau", "ment", "schein", "keit", "lich", "ando", "cion", "thing"]
    joined = F.concat(*(pick(f"w{k}", words) for k in range(4)))
    camel = F.concat(pick("c0", words), *(F.initcap(pick(f"c{k}", words)) for k in range(1, 4)), draw("c9", 10).cast("string"))
    digits = F.concat(F.lit("4"), F.substring(F.regexp_replace(F.conv(F.substring(hexes, 1, 15), 16, 10), "^0", "1"), 1, 15))
    address = F.concat_ws(".", *(draw(f"ip{k}", 250).cast("string") for k in range(4)))
    uuid = F.regexp_replace(F.substring(hexes, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    mail = F.concat(pick("m0", words), F.lit("."), draw("m1", 99).cast("string"), F.lit("@mail"), draw("m2", 9).cast("string"), F.lit(".example.com"))
    path = F.concat_ws("/", pick("p0", words), pick("p1", words), F.concat(pick("p2", words), draw("p3", 99).cast("string"), pick("p4", [".py", ".js", ".html", ".json"])))
    host = F.concat(F.lit("www."), pick("u0", words), draw("u1", 9).cast("string"), F.lit(".example.com/"), pick("u2", words))
    version = F.concat(pick("v0", words), F.lit("-"), draw("v1", 9).cast("string"), F.lit("."), draw("v2", 30).cast("string"), F.lit(".0-release"))
    secret = ["token", "password", "secret", "api_key", "apikey", "auth_token", "access_key", "SECRET_KEY", "passwd", "private_key", "Bearer", "AWS_SECRET"]
    other = ["commit", "sha256", "md5", "checksum", "revision", "uuid", "id", "etag", "digest", "integrity"]
    plain = [*words, "the", "of", "is", "de", "la", "und"]
    kinds = [
        (1, F.expr("substr(h, 1, int(n))"), secret, "set"),
        (1, F.substring(hexes, 1, 40), secret, "set"),
        (1, F.expr("substr(m, 1, int(n))"), secret, "set"),
        (1, F.substring(hexes, 3, 18), ["password", "passwd", "pwd", "secret", "token"], "set"),
        (1, F.concat(pick("k", ["AKIA", "ASIA"]), F.substring(upper, 1, 16)), [*plain, *secret], "any"),
        (1, F.concat(pick("k2", ["ghp_", "gho_", "sk-", "xoxb-", "AIza", "glpat-", "npm_"]), F.substring(mixed, 1, 36)), [*plain, *secret], "any"),
        (1, F.concat(F.lit("eyJ"), F.substring(mixed, 1, 20), F.lit("."), F.substring(mixed, 21, 40)), [*plain, *secret], "any"),
        (0, F.substring(hexes, 1, 40), other, "any"),
        (0, F.substring(hexes, 5, 32), other, "any"),
        (0, hexes, other, "any"),
        (0, uuid, [*plain, *other], "any"),
        (0, joined, plain, "space"),
        (0, camel, plain, "any"),
        (0, digits, plain, "space"),
        (0, address, plain, "space"),
        (0, mail, plain, "space"),
        (0, path, plain, "any"),
        (0, host, plain, "any"),
        (0, version, plain, "any"),
        (0, F.concat(pick("x", ["your_api_key_here", "xxxxxxxxxxxx", "changeme", "example-token-", "dummy_secret_"]), draw("x2", 999).cast("string")), secret, "set"),
        (0, joined, secret, "set"),
        (0, camel, secret, "set"),
        (0, path, secret, "set"),
        (0, F.substring(hexes, 1, 40), plain, "space"),
    ]
    joints = {"set": [" = \"", "=", ": \"", ":", " = '", "=\""], "space": [" "], "any": [" ", "=", ": ", " = \""]}
    rows = rows.withColumn("h", hexes).withColumn("m", mixed).withColumn("n", size).withColumn("kind", F.pmod(F.col("id"), F.lit(len(kinds))))

    def of_kind(make) -> Column:
        return reduce(lambda old, k: F.when(F.col("kind") == k, make(kinds[k])).otherwise(old), range(1, len(kinds)), make(kinds[0]))

    paths = pick("path", ["src/app.py", "config/prod.env", "src0", "lib/util.js", "tests/test_app.py", "docs/example.md", "vendor/x.lock"])
    return rows.select(
        of_kind(lambda k: k[1]).alias("value"),
        of_kind(lambda k: pick("before", k[2])).alias("before"),
        of_kind(lambda k: pick("joint", joints[k[3]])).alias("joint"),
        paths.alias("path"),
        of_kind(lambda k: F.lit(k[0])).alias("label"),
    )


def train(labelled: DataFrame, words: Iterable[str], trees: int = 25, depth: int = 7, seed: int = 3) -> Forest:
    """A forest of labelled findings; words: the dictionary."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    bits = dictionary_bits(words)
    found = describe(F.col("value"), F.col("before"), F.col("joint"), F.col("path"), bits)
    rows = labelled.filter("value is not null and label in (0, 1)").select(F.col("label").cast("double").alias("label"), *(c.cast("double").alias(n) for n, c in found.items()))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", maxBins=64).fit(rows)

    def walk(node):
        if node.subtreeDepth() == 0:
            stats = node.impurityStats().stats()
            return float(stats[1] / max(stats[0] + stats[1], 1e-9))
        split = node.split()
        return split.featureIndex(), float(split.threshold()), walk(node.leftChild()), walk(node.rightChild())

    return Forest([walk(t._call_java("rootNode")) for t in forest.trees], bits)


def forest_score(forest: Forest, feature) -> Column:
    """The mean leaf over the trees, as one expression; feature(name) gives a feature's column."""

    def tree(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        index, threshold, left, right = node
        return F.when(feature(FEATURES[index]) <= threshold, tree(left)).otherwise(tree(right))

    return reduce(lambda a, b: a + b, map(tree, forest.trees)) / len(forest.trees)


def scan(docs: DataFrame, forest: Forest, text: str = "text", path: str | None = "source", least: float = 0.5, mark: str = "[REDACTED]") -> DataFrame:
    """docs with findings, an array of (value, before, score, start, length) of the candidates scoring least
    or more (start: 0-based, in characters), n_candidates, and redacted, the text with a mark in the
    place of every finding."""
    where = F.col(path) if path and path in docs.columns else F.lit(None).cast("string")
    found, count, redacted, held = (free_name(docs, n) for n in ("findings", "n_candidates", "redacted", "_candidates"))
    pieces, tails = free_name(docs, "_pieces"), free_name(docs, "_tails")
    if_any = lambda c, what: F.when(c.isNotNull(), what)

    def valued(piece: Column, k: Column) -> Column:
        run = F.regexp_extract(piece, CANDIDATE, 0)
        return F.struct(F.length(F.regexp_extract(run, LEAD, 0)).alias("lead"), F.regexp_replace(F.regexp_replace(run, LEAD, ""), TRAIL, "").alias("value"), k.alias("k"))

    def plausible(c: Column) -> Column:
        fits = (F.length(c["value"]) >= 12) & (c["value"].rlike("[0-9]") | c["value"].rlike("[a-z][A-Z]"))
        return F.when(fits, c)

    def placed(c: Column) -> Column:
        near = (F.coalesce(F.get(F.col(tails), c["k"] - n), F.lit("")) for n in range(NEAR, 0, -1))
        return if_any(c, F.struct(c["lead"].alias("lead"), c["value"].alias("value"), F.substring(F.concat(*near), -REACH, REACH).alias("to")))

    def joined(c: Column) -> Column:
        part = lambda k: F.regexp_extract(c["to"], BEFORE, k)
        return if_any(c, F.struct(c["lead"].alias("lead"), c["value"].alias("value"), part(1).alias("before"), part(2).alias("joint")))

    def described(c: Column) -> Column:
        features = describe(c["value"], c["before"], c["joint"], where, forest.bits)
        return if_any(c, F.struct(*(c[n].alias(n) for n in ("lead", "value", "before")), *(x.cast("double").alias(n) for n, x in features.items())))

    def scored(c: Column) -> Column:
        return if_any(c, F.struct(*(c[n].alias(n) for n in ("lead", "value", "before")), forest_score(forest, lambda n: c[n]).alias("score")))

    # One entry a piece of the text, null where the piece starts with no candidate.
    steps = F.transform(F.transform(F.transform(pieces, valued), plausible), placed)
    steps = F.transform(F.transform(F.transform(steps, joined), described), scored)
    # Most texts have no candidate at all; one cheap test spares them the rest.
    none = F.expr("cast(array() as array<struct<value:string,before:string,score:double,start:int,length:int>>)")
    likely = F.col(text).rlike(rf"{RUN}{{12}}") & F.col(text).rlike(r"[0-9]|[a-z][A-Z]")
    # The text before the first candidate (a line end is put there), then each candidate with what follows it.
    out = docs.withColumn(pieces, F.when(likely, F.split(F.concat(F.lit("\n"), F.col(text)), START, -1)))
    out = out.withColumn(tails, F.transform(pieces, lambda p: F.substring(p, -REACH, REACH)))
    out = out.withColumn(held, F.when(likely, steps))
    secret = lambda c: F.coalesce(c["score"] >= least, F.lit(False))
    starts = running_sums(F.transform(pieces, F.length))

    def span(c: Column, at: Column) -> Column:
        return F.when(secret(c), F.struct(c["value"].alias("value"), c["before"].alias("before"), c["score"].alias("score"), (at - 1 + c["lead"]).alias("start"), F.length(c["value"]).alias("length")))

    def cut(piece: Column, c: Column) -> Column:
        rest = F.substring(piece, c["lead"] + F.length(c["value"]) + 1, F.length(piece))
        return F.when(secret(c), F.concat(F.substring(piece, F.lit(1), c["lead"]), F.lit(mark), rest)).otherwise(piece)

    some = F.coalesce(F.exists(held, secret), F.lit(False))
    spans = F.filter(F.zip_with(held, starts, span), lambda x: x.isNotNull())
    whole = F.array_join(F.zip_with(pieces, held, cut), "")
    return out.withColumns(
        {
            found: F.when(some, spans).otherwise(none),
            count: F.coalesce(F.size(F.filter(held, lambda c: c.isNotNull())), F.lit(0)).cast("long"),
            redacted: F.when(some, F.substring(whole, F.lit(2), F.length(whole))).otherwise(F.col(text)),
        }
    ).drop(pieces, tails, held)


def redact(text: Column, findings: Column, mark: str = "[REDACTED]") -> Column:
    """text with every found span replaced: what scan's redacted has, for findings that come from a table."""
    ends = F.concat(F.array(F.lit(0)), F.transform(findings, lambda f: f["start"] + f["length"]))
    starts = F.concat(F.transform(findings, lambda f: f["start"]), F.array(F.length(text)))
    return F.when(text.isNotNull(), let(text, lambda t: F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(t, a + 1, b - a)), mark)))
