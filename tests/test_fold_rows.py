"""The rows of folds, baselines and the one-feature ridge carry what they read, and doses meet intervals span by span."""

import random
from datetime import date, timedelta

from notewise.operators.merge import interval_adherence
from notewise.plans.fixtures import modelling_table
from notewise.plans.q_merge import _with_folds
from tests.test_model_frame_width import _tables


def test_fold_rows_carry_no_texts(spark, tmp_path):
    sf_dir = _tables(spark, tmp_path / "t")
    rows = _with_folds(spark, sf_dir)
    assert set(rows.columns) == {"participant_id", "top1_similarity_score", "adherence", "drug", "fold"}
    cols = [c for c in rows.columns if c != "fold"]
    assert sorted(map(str, rows.select(cols).collect())) == sorted(map(str, modelling_table(spark, sf_dir).select(cols).collect()))
    assert rows.groupBy("drug", "participant_id").agg({"fold": "min"}).count() == rows.select("drug", "participant_id", "fold").distinct().count()


def test_adherence_counts_days_of_spans(spark):
    rnd = random.Random(4)
    start = date(1969, 12, 20)
    rows, doses = [], [(p, start + timedelta(days=rnd.randrange(60))) for p in "abc" for _ in range(25)] + [("a", None), (None, start)]
    for i in range(60):
        a = start + timedelta(days=rnd.randrange(50))
        rows.append((None if i == 7 else i // 2 if i < 10 else i, "c", rnd.choice(["a", "b", "c", "never", None]), a,
                     a + timedelta(days=rnd.choice([-3, 0, 6, 30]))))
    rows += [(99, "c", "a", None, start), (98, "c", "a", start, None)]
    iv = spark.createDataFrame(rows, "row_id long, chunk string, participant_id string, start_date date, end_date date")
    got = interval_adherence(iv, spark.createDataFrame(doses, "participant_id string, day date"))
    taken = {(p, d) for p, d in doses if p and d}

    def days(r):
        if not r[3] or not r[4]:
            return 0
        a, e = sorted(r[3:])
        return sum((r[2], a + timedelta(days=k)) in taken for k in range((e - a).days + 1))

    want = []
    for r in rows:
        n = sum(days(x) for x in rows if r[0] is not None and x[:2] == r[:2])
        whole = (r[4] - r[3]).days + 1 if r[3] and r[4] else 0
        want.append((*r, n, n / whole if whole else None))
    assert sorted(map(str, map(tuple, got.select(*iv.columns, "dose_days", "adherence").collect()))) == sorted(map(str, want))
    # a week meets two spans at most, and its join moves no row a day
    week = spark.createDataFrame([(i, "c", "a", start + timedelta(days=i), start + timedelta(days=i + 6)) for i in range(40)], iv.schema)
    plan = interval_adherence(week, spark.createDataFrame(doses, "participant_id string, day date"))._jdf.queryExecution().toString()
    assert "sequence(start_date" not in plan.replace("#", "")
