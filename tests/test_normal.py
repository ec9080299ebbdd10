"""Grouped least squares against a dense solver, group by group."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import impute as im
from riskweave.operators import normal


def make(spark, seed=5, groups=7):
    rng = random.Random(seed)
    rows = []
    for g in [*range(groups), None]:
        for i in range(rng.randint(40, 90)):
            age, z = rng.randint(19, 100), rng.choice([0, 1, 2])
            k = rng.choice("abc" if g != 3 else "ab")
            y = 3 + 0.1 * age + 1e-4 * age ** 3 * (z - 1) + {"a": 0, "b": 2.0, "c": -1.0}[k] + rng.gauss(0, 1)
            rows.append((len(rows), g, y if rng.random() < 0.8 else None, age, age ** 2, float(age ** 3), z, k if rng.random() < 0.97 else None))
    rows += [(len(rows), 3, None, 50, 2500, 125000.0, 1, "c"), (len(rows) + 1, 99, None, 50, 2500, 125000.0, 1, "a")]
    return rows, spark.createDataFrame(rows, "id int, g int, y double, age int, age2 int, age3 double, z int, k string").repartition(3)


FEATURES = ["age", "age2", "age3", "z", "k"]


def matrix(rows, levels="abc"):
    u = np.array([(r[3] - 60) / 40 for r in rows])
    z = np.array([float(r[6]) for r in rows])
    d = [np.array([float(r[7] == v) for r in rows]) for v in levels[1:]]
    return np.column_stack([np.ones(len(rows)), u, u ** 2, u ** 3, u ** 4, z, u * z, *d, *[u * x for x in d]])


def test_predictions_of_all_groups(spark):
    rows, df = make(spark)
    got = {r.id: r for r in im.impute_by_model(df, "y", "g", FEATURES, "age", flag="f").collect()}
    assert len(got) == len(rows)
    for g in range(7):
        seen = "ab" if g == 3 else "abc"
        train = [r for r in rows if r[1] == g and r[2] is not None and r[7] is not None]
        beta = np.linalg.lstsq(matrix(train, seen), np.array([r[2] for r in train]), rcond=None)[0]
        for r in (r for r in rows if r[1] == g and r[2] is None):
            if r[7] is None or r[7] not in seen:
                assert got[r[0]].y is None and got[r[0]].f is None
            else:
                assert got[r[0]].y == pytest.approx(float(matrix([r], seen)[0] @ beta), abs=1e-7) and got[r[0]].f == 2
    assert all(got[r[0]].y == r[2] for r in rows if r[2] is not None)
    assert all(got[r[0]].y is None for r in rows if r[1] in (None, 99) and r[2] is None)


def test_one_scan_for_any_number_of_groups(spark):
    _, df = make(spark)
    made = normal.design(df, "y", FEATURES, "age")
    plans = []
    for some in (df, df.where("g < 2")):
        plan = normal.fits(normal.grams(some, made, "y", ["g"]), made)._jdf.queryExecution().executedPlan().toString()
        plans.append((plan.count("MapInArrow"), plan.count("Exchange")))
    assert plans[0] == plans[1] and plans[0][0] == 1


def test_summary(spark):
    rows, df = make(spark)
    got = {(r.g, r.term): r for r in normal.summary(df, "y", ["age", "z", "k"], ["g"], "age").collect()}
    names = ["(Intercept)", "age", "z", "k=b", "k=c", "age:z", "age:k=b", "age:k=c"]
    for g in [*range(7), None]:
        train = [r for r in rows if r[1] == g and r[2] is not None and r[7] is not None]
        a, z = np.array([float(r[3]) for r in train]), np.array([float(r[6]) for r in train])
        d = [np.array([float(r[7] == v) for r in train]) for v in "bc"]
        x = np.column_stack([np.ones(len(a)), a, z, *d, a * z, a * d[0], a * d[1]])
        use = [k for k in range(8) if x[:, k].any()]
        x, y = x[:, use], np.array([r[2] for r in train])
        beta = np.linalg.solve(x.T @ x, x.T @ y)
        left = len(y) - len(use)
        sse = ((y - x @ beta) ** 2).sum()
        se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * sse / left)
        assert {t for h, t in got if h == g} == {names[k] for k in use}
        for j, k in enumerate(use):
            r = got[(g, names[k])]
            assert (r.estimate, r.std_error, r.n, r.df) == (pytest.approx(beta[j], rel=1e-6), pytest.approx(se[j], rel=1e-6), len(y), left)
            assert r.r2 == pytest.approx(1 - sse / ((y - y.mean()) ** 2).sum())
            assert r.t_value == pytest.approx(beta[j] / se[j], rel=1e-6) and r.p_value == pytest.approx(normal.t_tail(r.t_value, left))


def test_holdout_error_without_predictions(spark):
    rows, df = make(spark)
    split = df.where("g is not null").withColumn("split", F.when(F.col("id") % 3 == 0, "test").otherwise("training"))
    made = normal.design(split.where("split = 'training'"), "y", FEATURES, "age")
    got = {r.g: r for r in normal.holdout(split, made, "y", ["g"]).collect()}
    for g in range(7):
        mine = [r for r in rows if r[1] == g and r[2] is not None and r[7] is not None]
        train, test = [r for r in mine if r[0] % 3], [r for r in mine if r[0] % 3 == 0]
        seen = "ab" if g == 3 else "abc"
        beta = np.linalg.lstsq(matrix(train, seen), np.array([r[2] for r in train]), rcond=None)[0]
        sse = sum((r[2] - float(matrix([r], seen)[0] @ beta)) ** 2 for r in test)
        assert got[g].n_test == len(test) and got[g].sse_test == pytest.approx(sse, rel=1e-6)


def test_level_only_in_test_rows(spark):
    rows = [(g, float(i), i, "x", "training") for g in "ab" for i in range(9)] + [("a", 5.0, 5, "x", "test"), ("b", 5.0, 5, "w", "test")]
    rows += [("a", 1.0, 2, "w", "training")]
    df = spark.createDataFrame(rows, "g string, y double, n int, k string, split string")
    made = normal.design(df, "y", ["n", "k"])
    assert {r.g: r.sse_test is None for r in normal.holdout(df, made, "y", ["g"]).collect()} == {"a": False, "b": True}


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 2, "a"), (2, 5.0, 3, "b")], "g int, y double, n int, k string")
    assert normal.summary(df.limit(0), "y", ["n", "k"], ["g"]).count() == 0
    one = normal.summary(df, "y", ["n", "k"], ["g"]).collect()
    assert [(r.g, r.term, r.estimate, r.std_error, r.df) for r in one] == [(2, "(Intercept)", 5.0, None, 0)]
    with pytest.raises(ValueError):
        normal.design(df, "y", ["n", "k"], "k")
    with pytest.raises(ValueError):
        normal.design(spark.range(50).selectExpr("1.0D AS y", "cast(id AS string) AS k"), "y", ["k"], max_columns=10)


def test_student_tail():
    # P(|T| > t) has closed forms for 1, 2 and 4 degrees of freedom
    for t in (0.0, 0.3, 1.0, 2.5, 40.0):
        assert normal.t_tail(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-13)
        assert normal.t_tail(-t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-13)
        s = t / math.sqrt(4 + t * t)
        assert normal.t_tail(t, 4) == pytest.approx(1 - s * (1.5 - s * s / 2), abs=1e-13)
    assert normal.t_tail(1.959963984540054, 1e9) == pytest.approx(0.05, abs=1e-8)
