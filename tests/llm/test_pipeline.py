import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratalog.llm import secret_scan, toxicity
from stratalog.llm.queries import vocabulary_words
from tests.llm.test_operators import brute_components, brute_leaks

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        result = corpus_pipeline.written(spark, f(spark, docs, SF), "test")
        out.append((name, docs, result))
        docs = result
    return out


def test_columns(stages):
    assert len(stages) == 5
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]


def test_toxicity(spark, stages):
    _, before, after = stages[0]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    expected = {d for d, t in before.select("doc_id", "text").collect() if model.combine([p for _, _, p in model.sentence_scores(t)]) < 0.7}
    assert {r["doc_id"] for r in after.collect()} == expected


def test_near_copies(stages):
    _, before, after = stages[1]
    rows = [tuple(r) for r in before.select("doc_id", "text").orderBy("doc_id").limit(1000).collect()]
    expected = {i for i, _, c in brute_components(rows, 5, 80) if i == c}
    assert {r["doc_id"] for r in after.collect()} == expected


def test_leaks(stages):
    _, before, after = stages[2]
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    rows = before.select("doc_id", "text").collect()
    leaks = brute_leaks([r["text"] for r in rows], list(zip(items.item_id.astype(str), items.text)), 10)
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r, (_, hit, _) in zip(rows, leaks) if not hit}


def test_secrets(spark, stages):
    _, before, after = stages[3]
    old = {r["doc_id"]: r for r in before.collect()}
    new = {r["doc_id"]: r for r in after.collect()}
    assert old.keys() == new.keys()
    changed = [k for k in old if old[k]["text"] != new[k]["text"]]
    assert changed and all("[REDACTED]" in new[k]["text"] and new[k]["n_chars"] == len(new[k]["text"]) for k in changed)
    assert not after.filter(F.col("text").rlike(r'token = "[0-9a-f]{40}"')).count()
    # the stage's texts are its input with the spans of the findings cut out, by plain slicing
    found = secret_scan.scan(before, secret_scan.train(secret_scan.made_findings(spark), vocabulary_words())).collect()
    for r in found:
        text, at, out = r["text"], 0, []
        for f in r["findings"]:
            assert text[f["start"] : f["start"] + f["length"]] == f["value"] and f["start"] >= at
            out += [text[at : f["start"]], "[REDACTED]"]
            at = f["start"] + f["length"]
        assert new[r["doc_id"]]["text"] == ("".join(out) + text[at:] if out else text)


def test_encoding(stages):
    _, before, after = stages[4]
    assert after.count() == before.count() and after.filter("not round_trip").count() == 0


def test_run(spark, stages):
    def digest(df):
        return hashlib.sha256(repr(sorted((r["doc_id"], r["n_tokens"]) for r in df.collect())).encode()).hexdigest()

    assert digest(corpus_pipeline.run(spark, SF)) == digest(stages[-1][2])




def test_odd_rows(spark, documents, no_documents):
    odd = documents.withColumnRenamed("text_", "findings")
    for docs in (odd, odd.limit(0)):
        for name, f in corpus_pipeline.STAGES[:-1]:
            after = f(spark, docs, "/root/testdata/sf0.001")
            assert after.columns == docs.columns, name
            after.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
