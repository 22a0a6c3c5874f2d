"""The models' rows carry no texts: five matched sentences a row were most of what a task read."""

from datetime import datetime, timedelta

from notewise.plans.fixtures import model_frame, modelling_table


def _tables(spark, path):
    words = ["fever", "cough", "pain", "sleep", "dose", "missed"]
    spark.createDataFrame([(i, f"{words[i % 6]} {words[(i + 1) % 6]} note {i}") for i in range(12)],
                          "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, f"{words[i % 6]} theme") for i in range(7)], "item_id long, text string") \
        .write.parquet(f"{path}/benchmark.parquet")
    start = datetime(2024, 1, 1)
    spark.createDataFrame([(i, start + timedelta(hours=7 * i), i % 8, ("purchase", "click", "view")[i % 3]) for i in range(120)],
                          "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_models_read_no_texts(spark, tmp_path):
    sf_dir = _tables(spark, tmp_path / "t")
    with_texts, without = modelling_table(spark, sf_dir), modelling_table(spark, sf_dir, texts=False)
    texts = [c for c in with_texts.columns if c.endswith("_matched_sentence")]
    assert len(texts) == 5 and not set(texts) & set(without.columns)
    assert sorted(map(str, with_texts.drop(*texts).collect())) == sorted(map(str, without.collect()))
    assert without.count() == 240
    frame, _ = model_frame(spark, sf_dir)
    assert not [c for c in frame.columns if c.endswith("_matched_sentence")]
    assert frame.count() == 240
