"""Quality scores from supervised subword embeddings.

Every word gives hashed features: itself, its character n-grams (3 to 5, with word ends) and the
pair with the word before it. A feature has a learned vector, a document's vector is the average
over its features, and a softmax over the labels reads it. Vectors and softmax are trained by
stochastic gradient descent in numpy on the driver, on at most per_class labelled rows of each
label (picked by a hash of the id), weighted back to the labels' shares. Their whole texts are hashed
in tasks; the driver gets at most 6 * BUCKETS bytes a row. For scoring, the two-label softmax of an average is linear in the features, so every feature
has one number, its share of the logit; all texts are hashed whole, vectorised, with no shuffle.

Defined results: null, empty and wordless texts have no features and score by the bias alone;
null labels and unknown ids are ignored, of repeated ids the smaller label counts; without labels
of both kinds the score is the share of label 1 (1 without labels); repeated rows score alike; an
empty table gives an empty table; clashing column names get underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm.common import added, bounded_sample, byte_batches, free_name, lean, small_batches, utf8, written

BUCKETS = 1 << 15


SAME_PAIR = 0
PIECE_WORDS = 100_000


def _hashed(h):
    import numpy as np

    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)


def features(text: bytes | None):
    """Buckets of a text's features, one entry an occurrence: the n-grams of code points of every word between its
    ends (which count as a character), the words, and the pairs of neighbours; pairs of a word with
    itself share a bucket. Long texts are hashed in pieces."""
    import numpy as np

    words, out, before = (text or b"").split(), [], None
    for k in range(0, len(words), PIECE_WORDS):
        piece = b" " + b" ".join(words[k : k + PIECE_WORDS]) + b" "
        code = np.frombuffer(piece.decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
        end = code == 32
        with np.errstate(over="ignore"):
            h, inner = code[:-1] * np.uint32(0x01000193) + code[1:], np.ones(len(code) - 1, dtype=bool)
            for n in (3, 4, 5):
                if len(code) < n:
                    break
                h = h[:-1] * np.uint32(0x01000193) + code[n - 1 :]
                inner = inner[:-1] & ~end[n - 2 : -1]
                out.append(_hashed(h[inner] + np.uint32(n)))
            starts = np.flatnonzero(end[:-1] & ~end[1:]) + 1
            sizes = np.flatnonzero(~end[:-1] & end[1:]) + 1 - starts
            place = np.arange(len(code)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(code)]))))
            power = np.cumprod(np.full(int(place.max()) + 1, 0x85EBCA6B, dtype=np.uint32), dtype=np.uint32)
            word = np.add.reduceat(np.where(end, np.uint32(0), code * power[place]), starts, dtype=np.uint32) + sizes.astype(np.uint32)
            out.append(_hashed(word * np.uint32(0xC2B2AE35)))
            row = word if before is None else np.concatenate((before, word))
            pair = _hashed(row[:-1] * np.uint32(0x27D4EB2F) + row[1:] * np.uint32(0x165667B1))
            out.append(np.where(row[:-1] == row[1:], np.uint32(SAME_PAIR), pair))
        before = word[-1:]
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


def counted(text: bytes | None):
    """(buckets, counts) of a text."""
    import numpy as np

    n = np.bincount(features(text), minlength=BUCKETS)
    keys = np.flatnonzero(n)
    return keys.astype(np.int16), n[keys].astype(np.float32)


class Model:
    """What scoring needs: each feature's share of the difference of the two logits, and the bias."""

    def __init__(self, shares, bias: float):
        self.shares, self.bias = shares, bias

    def score(self, text: bytes | None) -> float:
        import math

        found = features(text)
        z = self.bias + (float(self.shares[found].mean()) if len(found) else 0.0)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def train(documents, weights, dimension: int = 12, least_steps: int = 20_000, rate: float = 0.25, seed: int = 5) -> Model:
    """documents: (label, buckets, counts). Stochastic gradient descent, one document a step. A vector's
    step is the gradient divided by the squared norm of the document's feature shares: an average of
    hundreds of features moves little by the bare gradient, that of a few moves much."""
    import numpy as np

    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dimension, 1 / dimension, (BUCKETS, dimension))
    out, bias = np.zeros((2, dimension)), np.zeros(2)
    epochs = max(12, -(-least_steps // len(documents)))
    steps, at = epochs * len(documents), 0
    for _ in range(epochs):
        for k in random.permutation(len(documents)):
            label, buckets, counts = documents[k]
            now = rate * (1 - at / steps) * weights[label]
            at += 1
            own = counts / max(counts.sum(), 1)
            mean = own @ vectors[buckets] if len(buckets) else np.zeros(dimension)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= now * np.outer(p, mean)
            bias -= 0.1 * now * p
            if len(buckets):
                vectors[buckets] -= now * np.outer(own / max(float(own @ own), 1e-9) * 0.05, back)
    return Model((vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    rows: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    per_class: int = 1500,
) -> Model:
    import numpy as np

    spark = docs.sparkSession
    small_batches(spark)
    known = labels if rows is None else labels.filter(rows)
    known = known.select(F.col(doc_id).alias("_id"), F.col(label).alias("_y")).filter("_id is not null and _y in (0, 1)")
    known = known.groupBy("_id").agg(F.min("_y").cast("int").alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 1.0
    constant = Model(np.zeros(BUCKETS), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    if len(counts) < 2:
        return constant
    chosen = bounded_sample(known, "_id", per_class, "_y")  # 2 * per_class rows at most
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).filter("_text is not null")
    one = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))  # an id may come often
    sample = written(spark, one.select("_y", "_text"), "quality-sample", 0)

    def hashed(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, "_text", 4 << 20):
            found = [counted(t) for t in utf8(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_y"), pa.array([a for a, _ in found], pa.list_(pa.int16())), pa.array([b for _, b in found], pa.list_(pa.float32()))],
                names=["y", "f", "n"],
            )

    got = sample.mapInArrow(lean(hashed), "y int, f array<smallint>, n array<float>").toArrow()
    documents = [(y, f.values.to_numpy(), n.values.to_numpy()) for y, f, n in zip(got.column("y").to_pylist(), got.column("f"), got.column("n"))]
    documents.sort(key=lambda d: (d[0], d[1].tobytes(), d[2].tobytes()))
    drawn = [sum(1 for d in documents if d[0] == k) for k in (0, 1)]
    if not all(drawn):
        return constant
    weights = [counts[k] / drawn[k] * sum(drawn) / sum(counts.values()) for k in (0, 1)]
    return train(documents, weights)


def score(docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """columns of docs (all, by default) with quality_score, 0 to 1."""
    keep = docs.columns if columns is None else columns
    schema = added(docs.select(*[F.col(f"`{c}`") for c in keep]), (free_name(docs, "quality_score"), T.DoubleType()))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        own = shipped.value
        for batch in byte_batches(batches, text, 8 << 20):
            scores = pa.array([own.score(t) for t in utf8(batch.column(text))], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), scores], names=[f.name for f in schema.fields])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run), schema)
