"""Toxicity by multiple-instance learning: labels are of documents, scores are of sentences.

A sentence's probability is a logistic function of its distinct words; a document's is the noisy-or
of its sentences, 1 - (1 - leak) * prod(1 - p), where leak is what a document without any toxic
sentence still has (label noise ends up there, so long documents don't add it up). Word weights,
bias and leak are trained together from document labels by full-batch Adam in numpy, and the
sentences with a high probability are then the located offenders.

The model is fitted on at most per_class labelled rows of each label (picked by a hash of the id),
weighted back to the labels' shares, over their whole texts: which words are candidates is decided by
counts that tasks make, and the driver gets the candidates, their places in sentences, and numbers of
the sentences without any. Every document is scored over its whole text, without a shuffle.

Defined results: null and empty texts have no sentences and score leak; labels that are null or of
unknown ids are ignored, of repeated ids the larger counts; without labels of both kinds the score
is the share of toxic labels (0 without labels); repeated rows score alike; an empty table gives an
empty table; clashing column names get underscores.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm.common import added, bounded_sample, byte_batches, free_name, lean, small_batches, written

SENTENCE = re.compile(r"[^\n]+?(?:[.!?](?=\s)|(?=\n)|\Z)")
WORD = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCE.finditer(text)]


def words(sentence: str) -> set[str]:
    return set(WORD.findall(sentence.lower()))


class Model:
    def __init__(self, weights: dict[str, float], bias: float, leak: float):
        self.weights, self.bias, self.leak = weights, bias, leak

    def sentence_scores(self, text: str | None) -> list[tuple[int, int, float]]:
        import math

        out, get, known, cache = [], self.weights.__getitem__, self.weights.keys(), {}
        for a, b in sentences(text or ""):
            found = known & words(text[a:b])
            z = self.bias + sum(map(get, sorted(found)))
            if (p := cache.get(z)) is None:
                p = cache[z] = 1 / (1 + math.exp(-z)) if z > -30 else math.exp(z)
            out.append((a, b, p))
        return out

    def combine(self, scores: list[float]) -> float:
        import math

        return 1 - (1 - self.leak) * math.exp(sum(map(math.log1p, (-min(p, 1 - 1e-12) for p in scores))))


def train(y, weight, plain, of, word, lengths, size: int, steps: int = 300, l2: float = 0.01):
    """Word weights, bias and leak (logit), by document: label y, weight, and plain, its sentences
    without candidate words; by other sentence: its document (of) and its number of words (lengths);
    word: their candidates one after another. size: how many candidates there are."""
    import numpy as np

    at = np.repeat(np.arange(len(lengths)), lengths)
    theta = np.zeros(size + 2)
    theta[size], theta[size + 1] = -6.0, -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        bias = theta[size]
        z = bias + np.bincount(at, theta[word], minlength=len(of))
        total = np.bincount(of, np.logaddexp(0, z), minlength=len(y)) + plain * np.logaddexp(0, bias)
        leak = 1 / (1 + np.exp(-theta[size + 1]))
        miss = np.clip((1 - leak) * np.exp(-total), 1e-12, 1 - 1e-9)
        back = weight * np.where(y > 0, -miss / (1 - miss), 1.0)
        g = back[of] / (1 + np.exp(-z))
        of_bias = g.sum() + (back * plain).sum() / (1 + np.exp(-bias))
        grad = np.concatenate((np.bincount(word, g[at], minlength=size), [of_bias, (back * leak).sum()]))
        grad[:size] += 2 * l2 * theta[:size]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[:size] = np.maximum(theta[:size], 0)  # evidence adds up, none takes away
        theta[size + 1] = min(theta[size + 1], -1.0)
    return theta


def _own_weights(sample: DataFrame) -> dict:
    """By sampled document: the mean of 1 / (how many documents of its label have the sentence) over its
    distinct sentences, so that near copies share the weight of one and no copied passage looks like
    evidence; 1 without sentences. Sentences are counted by hash in tasks."""

    def hashed(batches):
        import pyarrow as pa
        import xxhash

        for batch in byte_batches(batches, "_text", 4 << 20):
            found = [{xxhash.xxh64_intdigest(" ".join(sorted(w))) >> 1 for a, b in sentences(t) if (w := words(t[a:b]))} for t in batch.column("_text").to_pylist()]
            sizes = [len(f) for f in found]
            which = pa.array([k for k, n in enumerate(sizes) for _ in range(n)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(which), batch.column("_y").take(which), pa.array([h for f in found for h in f], pa.int64())], names=["_id", "_y", "h"])

    said = sample.mapInArrow(lean(hashed), T.StructType([sample.schema["_id"], sample.schema["_y"], T.StructField("h", T.LongType())]))
    holders = said.groupBy("_y", "h").agg(F.count("*").alias("n"))
    own = said.join(holders, ["_y", "h"]).groupBy("_id").agg(F.avg(F.round(F.lit(1 << 30) / F.col("n")).cast("decimal(20,0)")).cast("double").alias("w"))
    return {r["_id"]: r["w"] / (1 << 30) for r in own.collect()}  # one row a sampled document at most


def _candidates(sample: DataFrame, own: dict, least_ratio: float) -> tuple[list[str], list[str]]:
    """The words that toxic documents hold more often than chance lets them: a log-likelihood ratio over
    least_ratio on the weighted counts, and three times the others' share; those that all toxic documents
    hold apart, as they can't tell which sentence offends. All other words have no weight."""
    shipped = sample.sparkSession.sparkContext.broadcast(own)

    def held(batches):
        import pyarrow as pa

        found: dict[tuple[str, int], int] = {}
        for batch in byte_batches(batches, "_text", 4 << 20):
            for i, y, t in zip(batch.column("_id").to_pylist(), batch.column("_y").to_pylist(), batch.column("_text").to_pylist()):
                w = round(shipped.value.get(i, 1.0) * (1 << 30))
                for word in words(t):
                    found[word, y] = found.get((word, y), 0) + w
            if len(found) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), pa.array(found.values(), pa.int64())], names=["word", "y", "w"])
                found = {}
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), pa.array(found.values(), pa.int64())], names=["word", "y", "w"])

    whole = {0: 0.0, 1: 0.0}
    for r in sample.select("_id", "_y").collect():
        whole[r["_y"]] += own.get(r["_id"], 1.0)
    per = lambda k: (F.sum(F.when(F.col("y") == k, F.col("w")).otherwise(0)) / float(1 << 30)).alias(f"h{k}")
    counts = sample.mapInArrow(lean(held), "word string, y int, w long").groupBy("word").agg(per(0), per(1))
    rate = (F.col("h0") + F.col("h1")) / (whole[0] + whole[1])
    part = lambda n, share, of: F.when((n > 0) & (share > 0), n * F.log(share / of)).otherwise(0.0)
    ratio = F.lit(0.0)
    for k in (0, 1):
        held_, rest = F.col(f"h{k}"), F.lit(whole[k]) - F.col(f"h{k}")
        ratio = ratio + 2 * part(held_, held_ / whole[k], rate) + 2 * part(rest, rest / whole[k], 1 - rate)
    kept = counts.filter((ratio > least_ratio) & (F.col("h1") / whole[1] > 3 * F.col("h0") / whole[0]))
    found = sorted(tuple(r) for r in kept.select("word", (F.col("h1") >= whole[1] * (1 - 1e-9)).alias("all")).collect())
    return [w for w, all_ in found if not all_], [w for w, all_ in found if all_]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    rows: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    per_class: int = 3000,
    least_ratio: float = 16.0,
) -> Model:
    """The model of the labelled rows for which `rows` holds (over labels' columns; all by default)."""
    import math

    import numpy as np

    spark = docs.sparkSession
    small_batches(spark)
    known = labels if rows is None else labels.filter(rows)
    known = known.select(F.col(doc_id).alias("_id"), F.col(label).alias("_y")).filter("_id is not null and _y in (0, 1)")
    known = known.groupBy("_id").agg(F.max("_y").cast("int").alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return Model({}, -30.0, share)
    chosen = bounded_sample(known, "_id", per_class, "_y")  # 2 * per_class rows at most
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).filter("_text is not null")
    one = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))  # an id may come often
    sample = written(spark, one, "toxic-sample", 0)
    drawn = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if len(drawn) < 2:
        return Model({}, -30.0, share)
    own = _own_weights(sample)
    names, common = _candidates(sample, own, least_ratio)
    got = _places(sample, names)
    if common and any(y and not s for y, s in zip(got.column("_y").to_pylist(), got.column("s").combine_chunks().value_lengths().to_pylist())):
        names = sorted(names + common)  # a toxic document has no other candidate
        got = _places(sample, names)
    y = got.column("_y").to_numpy()
    weight = np.array([own.get(i, 1.0) for i in got.column("_id").to_pylist()])
    weight = weight * np.array([counts[k] / drawn[k] * len(y) / sum(counts.values()) for k in (0, 1)])[y]
    said = got.column("s").combine_chunks()
    per = np.asarray(said.value_lengths())
    theta = train(
        y.astype(float), weight, got.column("plain").to_numpy().astype(float), np.repeat(np.arange(len(y)), per), np.asarray(said.flatten().flatten()), np.asarray(said.flatten().value_lengths()), len(names)
    )
    strong = {w: float(theta[k]) for k, w in enumerate(names) if abs(theta[k]) > 0.02}
    return Model(strong, float(theta[len(names)]), 1 / (1 + math.exp(-float(theta[len(names) + 1]))))


def _places(sample: DataFrame, names: list[str]):
    """By sampled document, in the order of ids: label, number of sentences without candidates (plain), and
    the candidates of the others as places in names (s)."""
    shipped = sample.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(names)})

    def placed(batches):
        import pyarrow as pa

        index = shipped.value
        for batch in byte_batches(batches, "_text", 4 << 20):
            plain, said = [], []
            for t in batch.column("_text").to_pylist():
                all_ = [sorted(index[w] for w in words(t[a:b]) & index.keys()) for a, b in sentences(t)]
                said.append([s for s in all_ if s])
                plain.append(len(all_) - len(said[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), pa.array(plain, pa.int64()), pa.array(said, pa.list_(pa.list_(pa.int32())))], names=["_id", "_y", "plain", "s"])

    found = T.StructType([sample.schema["_id"], sample.schema["_y"], T.StructField("plain", T.LongType()), T.StructField("s", T.ArrayType(T.ArrayType(T.IntegerType())))])
    return sample.mapInArrow(lean(placed), found).toArrow().sort_by("_id").combine_chunks()


def score(docs: DataFrame, model: Model, text: str = "text", offending: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """columns of docs (all, by default) with toxicity (0 to 1) and toxic_sentences, the character
    ranges whose sentences score offending or more, with their scores."""
    keep = docs.columns if columns is None else columns
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    names = [free_name(docs, "toxicity"), free_name(docs, "toxic_sentences")]
    schema = added(docs.select(*[F.col(f"`{c}`") for c in keep]), (names[0], T.DoubleType()), (names[1], span))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        own = shipped.value
        for batch in byte_batches(batches, text, 4 << 20):
            totals, spans = [], []
            for value in batch.column(text).to_pylist():
                found = own.sentence_scores(value)
                totals.append(own.combine([p for _, _, p in found]))
                spans.append([{"start": a, "end": b, "score": p} for a, b, p in found if p >= offending])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(totals, pa.float64()), pa.array(spans, kind)], names=[f.name for f in schema.fields]
            )

    small_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run), schema)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids are in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
