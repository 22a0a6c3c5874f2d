"""A forest's rows keep their node numbers, so its tasks are not sent the trees."""

import numpy as np

from notewise.operators import models


def test_rows_keep_their_nodes(spark, monkeypatch):
    from pyspark.ml.regression import RandomForestRegressor

    seen, fit = [], RandomForestRegressor.fit

    def watched(self, df):
        seen.append((df.count(), self.getCacheNodeIds()))
        return fit(self, df)

    monkeypatch.setattr(RandomForestRegressor, "fit", watched)
    x = np.random.default_rng(1).random((60, 2))
    df = spark.createDataFrame([(float(a), float(b), float(a > 0.5), i % 3 + 1) for i, (a, b) in enumerate(x)],
                               "a double, b double, y double, fold long").repartition(8)
    out = models.forest_cv(df, "y", ["a", "b"], trees=3, depth=2).collect()
    assert sorted(r["fold"] for r in out) == [1, 2, 3] and all(r["mae"] < 0.3 for r in out)
    assert seen == [(40, True)] * 3
