"""Defined results at the edges: helper columns that clash, odd letters, extreme vectors, odd URLs."""

import math
import random

import corpus_pipeline
import zstandard
from notewise.llm import embedding_dedup, exact_dedup, language_id, mixing, ngram_join, packing, warc
from notewise.session import ship_package

SCHEMA = ("doc_id long, text string, lang string, source string, _sha string, sha string, _kept_id long, _gone_id long, "
          "_slot long, _position int, rank_ long, bucket int, slot long, stays boolean")


def _docs(spark):
    texts = ["one two three four five six seven", "one two three four five six seven", "", None, "²²²", "a b c", "long " * 5_000]
    rows = [(i, t, "en", "s" if i % 2 else None, f"x{i}", "y", -i, i, 7, i, 8, 9, 10, False) for i, t in enumerate(texts)]
    rows.append((None, "no id", None, None, "x", "y", 0, None, 7, 0, 8, 9, 10, False))
    return spark.createDataFrame([*rows, rows[5]], SCHEMA), rows


def test_stages_pass_columns_of_any_name(spark):
    ship_package(spark)
    docs, rows = _docs(spark)
    by_id = {r[0]: r for r in rows}
    stay = {exact_dedup.drop_copies: [None, 1, 3, 4, 5, 6], ngram_join.keep_one: [None, 0, 2, 3, 4, 5, 5, 6],
            mixing.mixed_documents: [None, 0, 1, 2, 3, 4, 5, 5, 6]}
    for stage, want in stay.items():
        out = stage(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert sorted((r["doc_id"] for r in got), key=lambda i: -1 if i is None else i) == want
        assert all(tuple(r) == by_id[r["doc_id"]] for r in got)
        none = stage(docs.limit(0))
        assert (none.columns, none.count()) == (docs.columns, 0)
    packed = corpus_pipeline.packing(spark, docs, "").collect()
    assert len(packed) == len(rows) + 1
    assert packing.pack(docs.limit(0), order=mixing.places(docs.limit(0))).count() == 0
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns
    assert not {2, 3, 4} & {r["doc_id"] for r in kept.collect()}
    assert language_id.keep_identified(docs.limit(0)).count() == 0


def test_letters_are_alphabetic_characters():
    for text in (None, "", "²²²", "½½", "12 _-", "Ⅷ"):
        assert language_id.letters(text) == b""
    assert language_id.letters("É 1 b") == "é b".encode()


def test_every_part_of_a_text_can_teach(spark):
    rnd = random.Random(3)
    head = "".join(rnd.choices("abcdefgh ", k=4 * language_id.SAMPLE_CHARS))
    docs = spark.createDataFrame([(0, head + "zyxwvu " * 300, "a"), (1, "only this", "b"), (2, "", "c"), (3, None, "d")],
                                 "doc_id long, text string, lang string")
    learned = language_id.learn_dictionaries(docs)
    assert set(learned) == {"a", "b"}
    assert b"zyxwvu" in learned["a"] and learned["b"] == b"only this "
    few = language_id.learn_dictionaries(docs, sample_rows=1)
    assert len(few["a"]) <= language_id.SAMPLE_CHARS + 1


def test_smallest_compressed_size_wins():
    """Against direct compression of every piece with every dictionary."""
    rnd = random.Random(4)
    words = {s: ["".join(rnd.choices(s, k=6)) for _ in range(80)] for s in ("abcdef", "defghi", "ghijkl")}
    learned = {s: (" ".join(rnd.choices(w, k=900)) + " ").encode() for s, w in words.items()}
    model = language_id.Classifier(learned)
    parameters = zstandard.ZstdCompressionParameters(**language_id.PARAMETERS)
    for s, w in words.items():
        for n in (1, 30, 2_000):
            text = " ".join(rnd.choices(w, k=n))
            sizes = []
            for name in sorted(learned):
                raw = zstandard.ZstdCompressionDict(learned[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                coder = zstandard.ZstdCompressor(dict_data=raw, compression_params=parameters)
                plain = text.encode()
                sizes.append((sum(len(coder.compress(plain[i:i + language_id.PIECE_BYTES]))
                                  for i in range(0, len(plain), language_id.PIECE_BYTES)), name))
            sizes.sort()
            lang, margin = model.predict(text)
            assert math.isclose(margin, (sizes[1][0] - sizes[0][0]) / sizes[1][0], abs_tol=.02)
            assert n == 1 or lang == sizes[0][1] == s


def test_vectors_of_extreme_length(spark):
    ship_package(spark)
    rnd = random.Random(9)
    base = [rnd.gauss(0, 1) for _ in range(16)]
    sizes = (1.0, 1e200, 1e-200, 1e-300, 1e300)
    rows = [(i, [x * s for x in base], 1) for i, s in enumerate(sizes)] + [(5, [-x * 1e200 for x in base], 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_embeddings(docs, block=2).collect()}
    assert got == {**{i: (4, 0) for i in range(5)}, 5: (0, 5)}


def test_page_with_the_url_of_a_version_block(spark):
    ship_package(spark)
    rows = [(1, "filedesc://x", "a"), (2, "filedesc://x y 3", "a"), (3, "http://h/", None)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["url"]) for r in warc.archive_pages(docs).collect()}
    assert got == {1: ("revisit", 2, "filedesc://x"), 2: ("response", None, "filedesc://x%20y%203"),
                   3: ("response", None, "http://h/")}
