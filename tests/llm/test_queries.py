import pytest

from stratalog.llm.queries import oracle_sql, queries
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    compare(queries()[name](spark, sf_dir), connect(sf_dir), oracle_sql()[name])


COLUMNS = {
    "op1": ["page_id", "url", "text", "n_chars"],
    "op2": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op3": ["doc_id", "held_out", "score", "predicted"],
    "op6": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7": ["doc_id", "held_out", "score", "predicted"],
    "op8": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op10": ["doc_id", "n_shingles", "component_id"],
}
TABLE = {"op1": "pages", "op2": "conversations"}


@pytest.mark.parametrize("name", sorted(queries()))
def test_whole_tables_and_columns(spark, sf_dir, name):
    op = name.split("_")[0]
    df = queries()[name](spark, sf_dir)
    assert df.columns[: len(COLUMNS.get(op, []))] == COLUMNS.get(op, [])
    if op != "op2":
        assert df.count() == spark.read.parquet(f"{sf_dir}/{TABLE.get(op, 'documents')}.parquet").count()
