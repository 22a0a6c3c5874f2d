import glob
import os
import tempfile

import numpy as np

from notewise.operators.models import fit_lme, load_model, save_model
from notewise.sources.tables import read_table, write_csv


def test_csv_round_trip_with_spaced_names(spark):
    root = tempfile.mkdtemp(prefix="notewise-csv-")
    df = spark.createDataFrame([(1, "a b", 0.123456), (2, "c", 1.0)], "`Query Index` long, `Query Text` string, score double")
    write_csv(df, f"{root}/out", digits=4)
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{root}/out/*.csv")))
    assert "0.1235" in text and "Query Index" in text
    back = read_table(spark, f"{root}/out", df.schema)
    assert sorted(r[0] for r in back.collect()) == [1, 2]


def test_lme_save_load(spark):
    rng = np.random.default_rng(5)
    rows = [(str(g), 1.0, float(x), float(1 + 0.3 * x + rng.normal())) for g in range(10) for x in rng.normal(size=4)]
    df = spark.createDataFrame(rows, "g string, one double, x double, y double")
    m = fit_lme(df, "y", ["one", "x"], "g")
    path = os.path.join(tempfile.mkdtemp(prefix="notewise-model-"), "lme")
    save_model(m, path, m.blups(df))
    m2 = load_model(spark, path)
    assert np.allclose(m2.fit["beta"], m.fit["beta"]) and m2.fixed == m.fixed
    assert spark.read.parquet(f"{path}/blups").count() == 10
