"""A corpus pipeline of five operators: toxic documents go, one document of each group of near
copies stays, benchmark passages go with their documents, secrets are blacked out, and what is left
is encoded. Each stage's result is written as Parquet in the shared folder and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import few_files, size_of, table, written
from stratalog.llm.queries import tokenizer_path

#: SQL can't express the trained stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _compact(df: DataFrame, docs: DataFrame) -> DataFrame:
    """What a stage returns, in files of a sensible size."""
    return few_files(df, size_of(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose score is 0.7 or more; labels of all folds are learned from."""
    from stratalog.llm import toxicity as op

    scored = op.score(docs, op.fit(docs, table(spark, sf_dir, "labels")))
    return _compact(scored.filter(F.col(scored.columns[len(docs.columns)]) < 0.7).select(*(F.col(f"`{c}`") for c in docs.columns)), docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each component of five-word shingle similarities of 0.8 or more."""
    from stratalog.llm.jaccard_join import keep_one

    return _compact(keep_one(docs, n=5, percent=80), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    from stratalog.llm.decontaminate import remove_contaminated

    return _compact(remove_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; confirmed secrets in their texts are replaced and n_chars follows."""
    from stratalog.llm.queries import vocabulary_words
    from stratalog.llm.secret_scan import made_findings, scan, train

    found = scan(docs, train(made_findings(spark), vocabulary_words()))
    findings, redacted = F.col(found.columns[len(docs.columns)]), F.col(found.columns[len(docs.columns) + 2])
    n_chars = F.when(F.size(findings) > 0, F.length(redacted).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    new = {"text": redacted.alias("text"), "n_chars": n_chars.alias("n_chars")}
    return _compact(found.select(*(new.get(c, F.col(f"`{c}`")) for c in docs.columns)), docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in the vocabulary, and whether decoding them gives the text back."""
    from stratalog.llm.sentencepiece_codec import encode_decode, read_model

    out = encode_decode(docs.select("doc_id", "lang", "source", "text"), read_model(tokenizer_path("piece_bpe_32k.model")))
    same = (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    return _compact(out.select("doc_id", "lang", "source", "n_tokens", "token_ids", same), docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding and decoding", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{k}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
