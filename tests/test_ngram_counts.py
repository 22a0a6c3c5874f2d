from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from notewise.operators.ngrams import ngram_counts, windows


def test_ngram_counts_equal_direct_counts(spark):
    rng = np.random.default_rng(8)
    words = np.array(["a", "ab", "abc", "b", "ba", "é"])
    docs = [[str(x) for x in rng.choice(words, int(n))] for n in rng.integers(0, 25, 300)] + [None, []]
    df = spark.createDataFrame([(d,) for d in docs], "tk array<string>").repartition(3)
    want = {}
    for n in range(1, 11):
        c = Counter(" ".join(d[i:i + n]) for d in docs if d for i in range(len(d) - n + 1))
        want[n] = (sum(c.values()), len(c), sum(len(g) * k for g, k in c.items()))
    got = {r.n: (r.n_grams, r.n_distinct, r.total_chars) for r in ngram_counts(df, "tk", 10).collect()}
    assert got == want
    assert ngram_counts(df.limit(0), "tk", 10).count() == 0
    # one window a word is sent, not ten n-grams
    sent = df.select(F.explode(windows("tk", 10)).alias("w")).count()
    assert sent == sum(len(d) for d in docs if d)


def test_label_codes_of_few_levels_take_no_shuffle(spark):
    from notewise.operators.encode import label_encode

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sizes unknown, as of checkpointed codes
    try:
        out = label_encode(spark.range(90).selectExpr("cast(id % 3 as string) as c"), "c", "code")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(c#" not in plan
        assert sorted({(r.c, r.code) for r in out.collect()}) == [("0", 0), ("1", 1), ("2", 2)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_searches_hold_few_rows_at_a_time(spark, monkeypatch):
    from notewise.operators import search

    x = np.random.default_rng(9).normal(size=(50, 6))
    batch = __import__("pyarrow").RecordBatch.from_pydict({"id": list(range(50)), "v": [list(v) for v in x]})
    monkeypatch.setattr(search, "SLICE_ROWS", 20)
    parts = list(search._vector_slices([batch]))
    assert [len(i) for i, _ in parts] == [20, 20, 10] and np.array_equal(np.vstack([m for _, m in parts]), x)
