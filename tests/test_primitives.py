"""Brute-force and property tests for the scale primitives."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions.stats import inv_norm_py
from riskweave.operators.concordance import concordance
from riskweave.operators.cox import d_statistic
from riskweave.operators.rank import global_rank, scalable_ntile


def _ntile_py(n, k, rank):
    s, r = divmod(n, k)
    if rank <= r * (s + 1):
        return (rank - 1) // (s + 1) + 1
    return r + (rank - r * (s + 1) - 1) // s + 1


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_ntile_exact_with_hot_tie(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    random.seed(partitions)
    rows = []
    for i in range(3000):
        g = i % 3
        s = 5.0 if random.random() < 0.34 else float(random.randint(0, 400))  # a third share one value
        rows.append((g, i, s))
    df = spark.createDataFrame(rows, "g int, pid long, s double")
    got = {r.pid: r.q for r in scalable_ntile(df, ["g"], "s", "pid", 20).collect()}
    for g in range(3):
        grp = sorted([(s, pid) for gg, pid, s in rows if gg == g])
        for rank, (_, pid) in enumerate(grp, 1):
            assert got[pid] == _ntile_py(len(grp), 20, rank)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_ntile_fewer_rows_than_tiles_and_nulls(spark):
    df = spark.createDataFrame([(1, 0, 3.0), (2, 0, 1.0), (3, 0, None), (4, 1, 2.0)],
                               "pid long, g int, s double")
    got = {r.pid: r.q for r in scalable_ntile(df, ["g"], "s", "pid", 20).collect()}
    assert got == {2: 1, 1: 2, 3: None, 4: 1}


def test_global_rank_no_groups(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "pid long, s double")
    got = {r.pid: r.rank for r in global_rank(df, [], "s", "pid").collect()}
    exp = {pid: i for i, (_, pid) in enumerate(sorted((i % 7, i) for i in range(500)), 1)}
    assert got == exp


def _brute_conc(rs):
    con = dis = tie = 0.0
    n = len(rs)
    inf = [[0.0, 0.0, 0.0] for _ in range(n)]
    for a in range(n):
        ti, ei, ri, wi = rs[a]
        if ei != 1:
            continue
        for b in range(n):
            tj, ej, rj, wj = rs[b]
            if tj > ti or (tj == ti and ej == 0):
                kind = 0 if rj > ri else (1 if rj < ri else 2)
                pw = wi * wj
                if kind == 0:
                    con += pw
                elif kind == 1:
                    dis += pw
                else:
                    tie += pw
                inf[a][kind] += wj
                inf[b][kind] += wi
    tot = con + dis + tie
    c = (con + tie / 2) / tot
    var = sum((rs[m][3] * (inf[m][0] + inf[m][2] / 2 - c * sum(inf[m])) / tot) ** 2 for m in range(n))
    return con, dis, tie, c, var


def test_concordance_brute_force_weighted(spark):
    random.seed(7)
    rows = [(i % 2, random.randint(0, 20), int(random.random() < 0.3), float(random.randint(0, 25)),
             random.choice([1.0, 2.0, 0.5])) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, t int, e int, r double, w double")
    res = {r.g: r for r in concordance(df, ["g"], "t", "e", "r", "w", rows_per_range=20).collect()}
    for g in (0, 1):
        con, dis, tie, c, var = _brute_conc([(t, e, r, w) for gg, t, e, r, w in rows if gg == g])
        s = res[g]
        assert s.con == pytest.approx(con) and s.dis == pytest.approx(dis) and s.tied == pytest.approx(tie)
        assert s.conc == pytest.approx(c, abs=1e-12)
        assert s.conc_var == pytest.approx(var, rel=1e-9)


def test_concordance_properties(spark):
    random.seed(11)
    rows = [(random.randint(0, 30), int(random.random() < 0.25), random.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "t int, e int, r double").withColumn("g", F.lit(1))
    c1 = concordance(df, ["g"], "t", "e", "r", variance=False).first().conc
    c2 = concordance(df.withColumn("r", -F.col("r")), ["g"], "t", "e", "r", variance=False).first().conc
    c3 = concordance(df.withColumn("r", F.exp(F.col("r") * 3)), ["g"], "t", "e", "r", variance=False).first().conc
    assert c1 + c2 == pytest.approx(1.0)          # no ties in r
    assert c3 == pytest.approx(c1)                # invariant to monotone transforms
    # weight w == w copies of the row
    w = spark.createDataFrame([(t, e, r, 3.0) for t, e, r in rows[:60]], "t int, e int, r double, w double")
    rep = spark.createDataFrame([(t, e, r, 1.0) for t, e, r in rows[:60] for _ in range(3)],
                                "t int, e int, r double, w double")
    a = concordance(w.withColumn("g", F.lit(1)), ["g"], "t", "e", "r", "w", variance=False).first()
    b = concordance(rep.withColumn("g", F.lit(1)), ["g"], "t", "e", "r", "w", variance=False).first()
    assert (a.con, a.dis, a.tied) == (b.con, b.dis, b.tied)


def test_concordance_all_censored_and_single_row(spark):
    df = spark.createDataFrame([(1, 5, 0, 1.0), (1, 6, 0, 2.0), (2, 3, 1, 1.0)], "g int, t int, e int, r double")
    res = {r.g: r for r in concordance(df, ["g"], "t", "e", "r").collect()}
    assert res[1].conc is None and res[1].con == 0.0
    assert res[2].conc is None and res[2].n == 1


def test_inv_norm_accuracy():
    for p in [1e-6, 0.001, 0.02, 0.0243, 0.1, 0.5, 0.77, 0.975, 0.9999]:
        assert inv_norm_py(p) == pytest.approx(NormalDist().inv_cdf(p), rel=1.2e-9, abs=1e-12)


def test_inv_norm_column_matches_python(spark):
    from riskweave.functions.stats import inv_norm
    ps = [0.001, 0.02, 0.3, 0.5, 0.9, 0.99]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r.z for r in df.select(inv_norm(F.col("p")).alias("z")).collect()]
    assert got == pytest.approx([inv_norm_py(p) for p in ps], abs=1e-12)


def _brute_cox(rs):
    n = len(rs)
    order = sorted(range(n), key=lambda i: rs[i][0])
    rank = [0] * n
    for pos, i in enumerate(order):
        rank[i] = pos + 1
    z = [NormalDist().inv_cdf((rank[i] - 0.375) / (n + 0.25)) / math.sqrt(8 / math.pi) for i in range(n)]
    groups = {}
    for i in range(n):
        groups.setdefault(rs[i][0], []).append(z[i])
    z = np.array([np.mean(groups[rs[i][0]]) for i in range(n)])
    t = np.array([r[1] for r in rs])
    e = np.array([r[2] for r in rs])
    beta = 0.0
    for _ in range(40):
        u = info = 0.0
        for tt in np.unique(t[e == 1]):
            dead = (t == tt) & (e == 1)
            risk = t >= tt
            d = dead.sum()
            w = np.exp(beta * z)
            s0, s1, s2 = (w * risk).sum(), (w * z * risk).sum(), (w * z * z * risk).sum()
            e0, e1, e2 = (w * dead).sum(), (w * z * dead).sum(), (w * z * z * dead).sum()
            u += (z * dead).sum()
            for l in range(d):
                f = l / d
                den = s0 - f * e0
                m1, m2 = (s1 - f * e1) / den, (s2 - f * e2) / den
                u -= m1
                info += m2 - m1 * m1
        beta += u / info
    return beta, 1 / math.sqrt(info)


def test_d_statistic_brute_force(spark):
    random.seed(3)
    rows = []
    for i in range(300):
        s = float(random.randint(0, 30))
        rows.append((i % 2, i, s, random.randint(0, 25), int(random.random() < 0.15 + s / 100)))
    df = spark.createDataFrame(rows, "g int, pid long, score double, t int, e int")
    res = {r.g: r for r in d_statistic(df, ["g"], "t", "e", "score").collect()}
    for g in (0, 1):
        b, se = _brute_cox([(s, t, e) for gg, _, s, t, e in rows if gg == g])
        assert res[g].d_stat == pytest.approx(b, abs=1e-7)
        assert res[g].d_se == pytest.approx(se, abs=1e-7)


def _check_ntile(spark, rows, schema, k, **kw):
    df = spark.createDataFrame(rows, schema)
    got = {r.pid: r.q for r in scalable_ntile(df, ["g"], "s", "pid", k, **kw).collect()}
    for g in {r[0] for r in rows}:
        grp = sorted((s, pid) for gg, pid, s in rows if gg == g)
        for rank, (_, pid) in enumerate(grp, 1):
            assert got[pid] == _ntile_py(len(grp), k, rank)


def test_ntile_string_ids_on_a_hot_tie(spark):
    rows = [(0, str(i) if i % 3 else f"A{i}", 1.0) for i in range(2000)]
    _check_ntile(spark, rows, "g int, pid string, s double", 20, rows_per_range=100)


def test_ntile_value_hot_in_one_group_and_apart_ranges(spark):
    rows = [(0, i, 7.0 if i % 2 else float(i)) for i in range(900)]
    rows += [(1, 1000 + i, 1e6 + i % 50) for i in range(900)] + [(2, 2000 + i, i / 1e6) for i in range(40)]
    _check_ntile(spark, rows, "g int, pid long, s double", 7, rows_per_range=60)


def test_ntile_string_order_key(spark):
    rows = [(i % 2, i, f"k{i * 37 % 101}") for i in range(500)]
    _check_ntile(spark, rows, "g int, pid long, s string", 9, rows_per_range=50)


def test_rank_plan_has_no_literal_tree(spark):
    df = spark.createDataFrame([(i % 3, i, float(i % 11)) for i in range(600)], "g int, pid long, s double")
    plan = scalable_ntile(df, ["g"], "s", "pid", 7)._jdf.queryExecution().analyzed().toString()
    assert plan.count("CASE WHEN") <= 2 and "SinglePartition" not in plan


def test_row_number_keeps_null_keys(spark):
    from riskweave.operators.rank import global_row_number
    df = spark.createDataFrame([(3, None), (1, 2.0), (2, 1.0), (4, None)], "pid long, s double")
    assert {r.pid: r.row for r in global_row_number(df, ["s", "pid"]).collect()} == {2: 1, 1: 2, 3: 3, 4: 4}


def test_concordance_fractional_and_negative_times(spark):
    rows = [(0.2, 1, 1.0), (0.9, 1, 2.0), (1.5, 0, 3.0)]
    df = spark.createDataFrame(rows, "t double, e int, r double").withColumn("g", F.lit(1))
    res = concordance(df, ["g"], "t", "e", "r").first()
    assert (res.con, res.dis, res.tied) == (3.0, 0.0, 0.0)
    random.seed(5)
    rows = [(random.randint(-9, 9), int(random.random() < 0.5), float(random.randint(0, 9)), 1.0) for _ in range(120)]
    df = spark.createDataFrame(rows, "t int, e int, r double, w double").withColumn("g", F.lit(1))
    res = concordance(df, ["g"], "t", "e", "r", "w").first()
    con, dis, tie, c, var = _brute_conc(rows)
    assert (res.con, res.dis, res.tied) == (con, dis, tie)
    assert res.conc_var == pytest.approx(var, rel=1e-9)


def test_cox_reports_what_did_not_converge(spark):
    from riskweave.operators.cox import cox1
    random.seed(9)
    rows = [(random.random(), random.randint(0, 9), int(random.random() < 0.4), 1.0, 1) for _ in range(80)]
    df = spark.createDataFrame(rows, "z double, t int, e int, W double, N int").withColumn("g", F.lit(1))
    short, whole = cox1(df, ["g"], max_iter=1).first(), cox1(df, ["g"]).first()
    assert short.converged is False and short.se is None
    assert whole.converged is True and whole.se > 0


def test_scratch_folder_needs_sharing_on_a_cluster():
    from riskweave.session import ensure_checkpoint_dir

    class Context:
        def __init__(self, master):
            self.master, self.dir = master, None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

        def getConf(self):
            return {}

    class Session:
        def __init__(self, master):
            self.sparkContext = Context(master)

    assert ensure_checkpoint_dir(Session("local[2]"))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            ensure_checkpoint_dir(Session(master))


def _stepwise(d, s0, e0):
    q = d * s0 / e0
    x = [q - k for k in range(d)]
    return math.fsum(map(math.log, x)), math.fsum(1 / v for v in x), math.fsum(1 / (v * v) for v in x)


def test_tie_sums_equal_the_stepwise_sums(spark):
    from riskweave.operators.cox import with_tie_sums
    rows = [(d, e0 * (1 + r), e0) for d in (1, 2, 31, 32, 33, 34, 70, 400, 5000, 1_000_000) for r in (0.0, 1e-9, 0.01, 3.0, 1e5) for e0 in (0.3, 700.0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, d long, s0 double, e0 double")
    for r in with_tie_sums(df).collect():
        for got, want in zip((r.logs, r.ones, r.twos), _stepwise(r.d, r.s0, r.e0)):
            assert got == pytest.approx(want, rel=1e-9, abs=1e-12), r


def test_a_day_with_a_million_deaths(spark):
    from riskweave.operators.cox import cox1
    n = 1_000_000
    cells = spark.createDataFrame([(z, t, e, float(c), c) for z, t, e, c in (
        (-1.0, 5, 1, n // 4), (1.0, 5, 1, 3 * n // 4), (-1.0, 9, 0, n), (1.0, 9, 0, n), (0.5, 7, 1, 3))],
        "z double, t int, e int, W double, N long")
    r = cox1(cells, []).first()
    # the same fit, term by term
    beta = 0.0
    for _ in range(30):
        u = i = 0.0
        s = lambda p: n / 4 * (-1) ** p * math.exp(-beta) + 0.75 * n * math.exp(beta)
        rest = [n * ((-1) ** p * math.exp(-beta) + math.exp(beta)) for p in range(3)]
        late = [3 * 0.5 ** p * math.exp(0.5 * beta) for p in range(3)]
        k = np.arange(n) / n
        den = s(0) * (1 - k) + rest[0] + late[0]
        m1, m2 = ((s(p) * (1 - k) + rest[p] + late[p]) / den for p in (1, 2))
        u += n / 2 - m1.sum()
        i += (m2 - m1 * m1).sum()
        for j in range(3):
            den = late[0] * (1 - j / 3) + rest[0]
            a, b = ((late[p] * (1 - j / 3) + rest[p]) / den for p in (1, 2))
            u, i = u + 0.5 - a, i + b - a * a
        beta += u / i
        if abs(u / i) < 1e-12:
            break
    assert r.converged and r.coef == pytest.approx(beta, abs=1e-8) and r.se == pytest.approx(i ** -0.5, rel=1e-6)


def test_running_sums(spark):
    from riskweave.operators.running import running_sums
    rng = random.Random(6)
    rows = [(g, k, k // 7, float(rng.randint(0, 9))) for g in ("a", "b", None) for k in range(40)]
    df = spark.createDataFrame(rows, "g string, k int, _range int, v double")
    for reverse in (False, True):
        for inclusive in (False, True):
            got = running_sums(df, ["g"], "k", {"s": "v"}, reverse=reverse, inclusive=inclusive, totals={"all": "s"}).collect()
            for r in got:
                mine = [v for g, k, _, v in rows if g == r.g and ((k > r.k if reverse else k < r.k) or inclusive and k == r.k)]
                assert r.s == sum(mine) and r["all"] == sum(v for g, *_, v in rows if g == r.g)
    assert running_sums(df.drop("g"), [], "k", {"s": "v"}).count() == 120
    plan = running_sums(df, ["g"], "k", {"s": "v"})._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(g#" in plan
    rows_windowed = [line for line in plan.splitlines() if "windowspecdefinition" in line and "k#" in line.split("specifiedwindowframe")[0]]
    assert rows_windowed and all("_range#" in line for line in rows_windowed)


def test_fractional_times_in_cox(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice("ab"), rng.random() * 50, rng.random() * 20 - 3 * (k % 2), int(rng.random() < 0.6)) for k in range(300)]
    df = spark.createDataFrame(rows, "person_id long, g string, score double, t double, e int")
    got = {r.g: r for r in d_statistic(df, ["g"], "t", "e").collect()}
    ranked = spark.createDataFrame([(i, g, s, sorted({x[3] for x in rows}).index(t), e) for i, g, s, t, e in rows],
                                   "person_id long, g string, score double, t int, e int")
    for r in d_statistic(ranked, ["g"], "t", "e").collect():
        assert got[r.g].d_stat == pytest.approx(r.d_stat, abs=1e-9) and got[r.g].d_se == pytest.approx(r.d_se, rel=1e-9)


def test_empty_tables_give_no_rows(spark):
    from riskweave.operators import metrics as mt
    df = spark.createDataFrame([], "person_id long, sex int, score double, t int, death_covid int, age_group string, grp string, quint string")
    assert mt.metrics_table(df, ["sex"], with_d=True).count() == 0
    assert mt.concordance_ci(df, ["sex"]).count() == 0
    assert d_statistic(df, ["sex"]).count() == 0


def test_concordance_over_many_ranges(spark):
    rng = random.Random(12)
    rows = [("a" if k % 3 else None, rng.randint(0, 40), rng.randint(0, 30), int(rng.random() < 0.5), rng.choice([0.5, 1.0, 2.0])) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, r int, t int, e int, w double")
    one = {r.g: r for r in concordance(df, ["g"], "t", "e", "r", "w").collect()}
    many = {r.g: r for r in concordance(df, ["g"], "t", "e", "r", "w", rows_per_range=10).collect()}
    for g in ("a", None):
        con = dis = tied = 0.0
        for h, r, t, e, w in rows:
            for h2, r2, t2, e2, w2 in rows:
                if h == h2 == g and e == 1 and (t2 > t or t2 == t and e2 == 0):
                    con, dis, tied = con + w * w2 * (r2 > r), dis + w * w2 * (r2 < r), tied + w * w2 * (r2 == r)
        for got in (one[g], many[g]):
            assert (got.con, got.dis, got.tied) == (pytest.approx(con), pytest.approx(dis), pytest.approx(tied))
        assert one[g].conc_var == pytest.approx(many[g].conc_var)
