from pyspark.sql import functions as F

from notewise.functions.text import (clean_text, lemma_table, ngrams, note_tokens, preprocess_notes,
                                     word_tokens)


def _one(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return [r[0] for r in df.orderBy("id").select(expr).collect()]


def test_clean_text_edge_cases(spark):
    texts = [None, "", "12345 678", "Don't-STOP 3x pills", "Café naïve résumé",
             "left right  the patients"]
    out = _one(spark, texts, clean_text("text"))
    # null -> empty; digits only -> empty; apostrophe splits; accents split words
    assert out[0] == "" and out[1] == "" and out[2] == ""
    assert out[3] == "stop pills"  # don / t / x dropped (stop word or short)
    assert out[4] == "caf sum"  # accents split words; "na", "ve", "r" are too short
    assert out[5] == "left right patients"


def test_null_token_option(spark):
    out = _one(spark, [None], clean_text("text", null_token="nan"))
    assert out == ["nan"]


def test_stop_words_keep_order_and_repeats(spark):
    out = _one(spark, ["pain the pain and fever pain"], note_tokens("text"))
    assert out == [["pain", "pain", "fever", "pain"]]


def test_word_tokens_unicode_and_lengths(spark):
    out = _one(spark, ["Été a b_c thisisaverylongtokenxx the ab"], word_tokens("text"))
    assert out == [["été", "b_c", "ab"]]


def test_ngrams_within_document(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"])], "id long, tk array<string>")
    g = df.select(F.explode(ngrams("tk", 1, 10)).alias("g")).select("g.n", "g.gram").collect()
    assert sorted((r.n, r.gram) for r in g) == [(1, "a"), (1, "b"), (1, "c"), (2, "a b"), (2, "b c"), (3, "a b c")]


def test_lemmas_need_vocabulary(spark):
    toks = spark.createDataFrame([("pills",), ("pill",), ("glasses",), ("glass",), ("bus",), ("boxes",)], "token string")
    table = {r.token: r.lemma for r in lemma_table(toks).collect()}
    assert table == {"pills": "pill", "glasses": "glass"}  # 'bu' and 'box' are not words here


def test_preprocess_notes_lemmatises_in_order(spark):
    df = spark.createDataFrame([(1, "Pills and more pills"), (2, "a pill"), (3, None)], "id long, text string")
    out = {r.id: r.clean_text for r in preprocess_notes(df, "id", "text").collect()}
    assert out == {1: "pill pill", 2: "pill", 3: ""}
