import __spark_entry__ as entry

from tests.conftest import SF0001


def test_oracles_belong_to_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 35


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["query_index", "rank", "corpus_id", "matched_sentence", "similarity_score"]
    assert len(rows) == 5 * spark.read.parquet(f"{SF0001}/documents.parquet").count()  # every document is a note
