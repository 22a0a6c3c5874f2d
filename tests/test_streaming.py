import os
import tempfile

import numpy as np

from notewise.streaming.notes_stream import read_notes, search_stream, start
from notewise.operators.search import top_k


def test_stream_search_equals_batch(spark):
    rng = np.random.default_rng(11)
    q = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(50)], "qid long, v array<double>")
    c = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(10)], "cid long, v array<double>")
    root = tempfile.mkdtemp(prefix="notewise-stream-")
    src, sink, ck = (os.path.join(root, x) for x in ("src", "sink", "ck"))
    q.repartition(3).write.parquet(src)
    notes = read_notes(spark, src, q.schema)
    query = start(search_stream(notes, c, "qid", "v", "cid", "v", 5), sink, ck)
    query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    want = sorted(tuple(r) for r in top_k(q, c, "qid", "v", "cid", "v", 5).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]


def test_clean_stream_equals_batch(spark):
    from notewise.functions.text import clean_text
    from notewise.streaming.notes_stream import clean_stream

    df = spark.createDataFrame([(1, "The pills, and MORE pills!"), (2, None), (3, "fatigue 3x daily")],
                               "id long, text string")
    root = tempfile.mkdtemp(prefix="notewise-clean-")
    src, sink, ck = (os.path.join(root, x) for x in ("src", "sink", "ck"))
    df.write.parquet(src)
    q = start(clean_stream(read_notes(spark, src, df.schema), "id", "text"), sink, ck)
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    want = sorted(tuple(r) for r in df.select("id", clean_text("text").alias("clean_text")).collect())
    assert got == want
