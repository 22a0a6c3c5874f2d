"""Language identification by compression.

Each language has a raw-content zstandard dictionary of sample text.  A text is
reduced to lower-case letters and spaces, cut into pieces and compressed with
every dictionary; the language with the smallest total wins.  A margin between
the two smallest totals that is narrower than ``min_margin`` is a rejection.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bound of the training sample: rows of a language.
SAMPLE_ROWS = 256
#: Characters of a piece; a row of the sample is a piece of a text, drawn from all pieces of all texts by hash.
SAMPLE_CHARS = 2_048
#: Bytes of a dictionary.
DICT_BYTES = 48 << 10
PIECE_BYTES = 4_096
#: Short matches (from 4 bytes) and lazy parsing: faster levels miss the affixes that tell languages apart.
PARAMETERS = {"window_log": 18, "hash_log": 15, "chain_log": 15, "search_log": 2, "min_match": 4,
              "strategy": zstandard.STRATEGY_LAZY, "write_content_size": False, "write_dict_id": False}
#: Narrowest margin, as a share of the second smallest size, that is not rejected.
MIN_MARGIN = 0.002
UNKNOWN = "und"
_ASCII = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def letters(text: str | None) -> bytes:
    """UTF-8 of the lower-case text with runs of other ASCII than letters as single spaces; empty without letters."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return b" ".join(text.lower().encode().translate(_ASCII).split())


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id's text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_dictionaries(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                       sample_rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """Raw dictionary content of every language in ``train``.

    Whole texts are cut into pieces of ``SAMPLE_CHARS`` characters, and a language
    learns from at most ``sample_rows`` of its pieces: those with the smallest hash of
    id, place and piece, so every part of a text can teach.
    """
    text = F.col(text_col).cast("string")
    # one pass over a text; substrings at rising offsets would read its head for every piece
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SAMPLE_CHARS}}}"), F.lit(0))
    rows = train.filter(F.col(lang_col).isNotNull() & text.isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"),
        F.posexplode(pieces).alias("at", "text")) \
        .select("lang", "text", F.xxhash64("id", "at", "text").alias("order"))
    top = Window.partitionBy("lang").orderBy("order", "text")
    picked = rows.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= sample_rows) \
        .orderBy("lang", "n").collect()
    out: dict[str, bytes] = {}
    for r in picked:
        have = out.get(r["lang"], b"")
        if len(have) < DICT_BYTES and letters(r["text"]):
            out[r["lang"]] = have + letters(r["text"]) + b" "
    return {lang: raw[:DICT_BYTES] for lang, raw in out.items()}


class Classifier:
    """Compressed sizes of a text under every dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.coders = []
        parameters = zstandard.ZstdCompressionParameters(**PARAMETERS)
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=parameters)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=parameters))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, margin): the margin is 0 for one language or no letters, and at ties."""
        plain = letters(text)
        if not plain or not self.langs:
            return UNKNOWN, 0.0
        pieces = [plain[at:at + PIECE_BYTES] for at in range(0, len(plain), PIECE_BYTES)]
        sizes = sorted((sum(len(c.compress(p)) for p in pieces), i) for i, c in enumerate(self.coders))
        if len(sizes) == 1:
            return self.langs[0], 1.0
        return self.langs[sizes[0][1]], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs``' id, lang_pred, score and rejected, one row per input row.

    ``lang_pred`` is ``und`` for a null text or one without letters, and when no
    language was learned.  ``score`` is the margin between the two smallest
    sizes over the second (0 to 1).  ``rejected`` marks ``und`` and margins
    below ``min_margin``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # languages * DICT_BYTES

    def run(batches):
        model = Classifier(shared.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64()),
                 pa.array([x[0] == UNKNOWN or x[1] < min_margin for x in found], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                min_margin: float = MIN_MARGIN) -> DataFrame:
    """Learn from labelled rows that are not held out, then identify every row.

    Returns doc_id, held_out, lang_pred, score, rejected.  Only the text enters
    a prediction.  Rows with a null text or language teach nothing.
    """
    model = learn_dictionaries(docs.filter(~held_out(id_col)), text_col, lang_col, id_col)
    found = identify(docs, model, id_col, text_col, min_margin)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns."""
    model = learn_dictionaries(docs.filter(~held_out(id_col)), text_col, lang_col, id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        classifier = Classifier(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            found = [classifier.predict(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([x[0] != UNKNOWN and x[1] >= min_margin for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
