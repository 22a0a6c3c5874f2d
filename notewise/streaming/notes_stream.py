"""Incremental note processing with Structured Streaming.

The search against the theme corpus and the text cleaning are per-note
maps (the corpus is a bounded broadcast), so they run unchanged on a
stream: each micro-batch of new notes is cleaned and matched, and results
are appended to a sink.  Exactly-once output comes from the checkpoint
location (a shared folder on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from notewise.functions.text import clean_text
from notewise.operators.search import MAX_BROADCAST_BYTES, fits_broadcast, top_k


def read_notes(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
               max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming scan of note files (explicit schema, no inference)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def search_stream(notes: DataFrame, corpus: DataFrame, query_id: str, query_vec: str,
                  corpus_id: str = "item_id", corpus_vec: str = "embedding", k: int = 5,
                  max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Top-k corpus rows for every arriving note (append-only, no state).

    The corpus is read once (batch), size-checked and broadcast; a corpus
    above the bound would need a stateful merge, so it is refused here.
    """
    if not fits_broadcast(corpus, corpus_vec, max_bytes):
        raise ValueError("streaming search needs a corpus within the broadcast bound")
    return top_k(notes, corpus, query_id, query_vec, corpus_id, corpus_vec, k, max_bytes)


def clean_stream(notes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Cleaned text of every arriving note (B1-B5, B7 as one projection)."""
    return notes.select(id_col, clean_text(text_col).alias("clean_text"))


def start(df: DataFrame, sink_path: str, checkpoint_location: str, fmt: str = "parquet",
          available_now: bool = True):
    """Append the stream to files; ``available_now`` processes what is there and stops."""
    w = df.writeStream.format(fmt).option("path", sink_path) \
        .option("checkpointLocation", checkpoint_location).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
