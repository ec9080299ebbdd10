"""DuckDB SQL of the full linear models: normal equations solved by elimination.

The designs are written out without the columns that the library drops while solving,
and for predictions in another basis of the same model (powers of a shifted age).
"""

from __future__ import annotations

GROUPS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
RECORDS = ("flag_a", "flag_b", "n_rec")


def _is(col: str, level: str) -> str:
    return f"CAST({col} = '{level}' AS INTEGER)"


_NUMBERS = [*[f"coalesce({c}, 0)" for c in RECORDS], "supplier_x"]
_U = "((age - 60) / 40.0::DOUBLE)"
_MAIN = [*_NUMBERS, *[_is("grp", v) for v in GROUPS[1:]], *[_is("quint", v) for v in SEGMENTS[1:]]]
FULL = ["1.0", *[f"pow({_U}, {k})" for k in (1, 2, 3, 4)], *_MAIN, *[f"{_U} * {m}" for m in _MAIN]]
KNOWN = "age IS NOT NULL AND supplier_x IS NOT NULL AND grp IS NOT NULL AND quint IS NOT NULL"

_FEW = {**{c: x for c, x in zip([*RECORDS, "supplier_x"], _NUMBERS)}, **{f"grp={v}": _is("grp", v) for v in GROUPS[1:]}}
SUMMARY = {"(Intercept)": "1.0", "age": "age", **_FEW, **{f"age:{t}": f"age * {x}" for t, x in _FEW.items()}}


def solved(rows: str, columns: list[str], inverse: bool = False) -> str:
    """CTEs: design (sex, y, x, and the columns of ``rows``), solved (sex, m, n, yy): m
    has the coefficients in column p + 1 and, if asked for, the inverse behind it."""
    p = len(columns)
    more = f" || list_transform(range(1, {p + 1}), lambda j: CASE WHEN i = j THEN 1.0 ELSE 0.0 END)" if inverse else ""
    values = ", ".join(f"CAST({c} AS DOUBLE)" for c in columns)
    return f"""
design AS MATERIALIZED (SELECT *, [{values}] AS x FROM {rows}),
sums AS (
  SELECT sex, i, j, sum(v[i] * v[j]) AS s FROM (SELECT sex, x || [y] AS v FROM design WHERE y IS NOT NULL AND sex IS NOT NULL),
         (SELECT unnest(range(1, {p + 1})) AS i), (SELECT unnest(range(1, {p + 2})) AS j) GROUP BY sex, i, j),
lines AS (SELECT sex, i, list(s ORDER BY j){more} AS r FROM sums GROUP BY sex, i),
sizes AS (SELECT sex, count(*) AS n, sum(y * y) AS yy, sum(y) AS ys FROM design WHERE y IS NOT NULL AND sex IS NOT NULL GROUP BY sex),
steps(sex, k, m) AS (
  SELECT sex, 0, list(r ORDER BY i) FROM lines GROUP BY sex
  UNION ALL
  SELECT sex, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / m[k + 1][k + 1])
         ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)
  FROM steps WHERE k < {p}),
solved AS (SELECT sex, m, list_transform(m, lambda r: r[{p + 1}]) AS b FROM steps WHERE k = {p})"""


def impute_sql(bc: str, two_stage: bool) -> str:
    first = """
means AS (SELECT bmi_cat, sex, avg(bmi) AS mean FROM bc WHERE bmi IS NOT NULL AND bmi_cat IS NOT NULL AND sex IS NOT NULL GROUP BY ALL),
stage AS (SELECT bc.*, CASE WHEN bmi IS NOT NULL THEN bmi ELSE mean END AS y,
                 CASE WHEN bmi IS NOT NULL THEN 0 WHEN mean IS NOT NULL THEN 1 END AS done FROM bc LEFT JOIN means USING (bmi_cat, sex)),"""
    if not two_stage:
        first = "\nstage AS (SELECT *, bmi AS y, CASE WHEN bmi IS NOT NULL THEN 0 END AS done FROM bc),"
    found = f"""{bc},{first}
rows_ AS (SELECT *, {KNOWN} AS known FROM stage),
usable AS (SELECT * FROM rows_ WHERE known), {solved("usable", FULL)},
filled AS (SELECT d.person_id, list_dot_product(d.x, s.b) AS guess FROM design d JOIN solved s USING (sex) WHERE d.y IS NULL)
"""
    if two_stage:
        return found + """SELECT person_id, sex, round(coalesce(y, guess), 6) AS bmi, bmi_cat,
    CASE WHEN y IS NULL AND guess IS NOT NULL THEN 2 ELSE done END AS imputed FROM rows_ LEFT JOIN filled USING (person_id)"""
    return found + "SELECT person_id, sex, round(guess, 6) AS bmi FROM rows_ JOIN filled USING (person_id) WHERE guess IS NOT NULL"


def holdout_sql(bc: str, split: str) -> str:
    return f"""{bc}, lab AS (SELECT *, CASE WHEN substr(md5(CAST(person_id AS VARCHAR) || 'split'), 1, 8) < '{split}'
    THEN 'training' ELSE 'test' END AS split FROM bc WHERE bmi IS NOT NULL AND bmi_cat IS NOT NULL),
usable AS (SELECT *, CASE WHEN split = 'training' THEN bmi END AS y FROM lab WHERE {KNOWN}), {solved("usable", FULL)},
lm AS (SELECT avg(pow(d.bmi - list_dot_product(d.x, s.b), 2)) AS mse_lm FROM design d JOIN solved s USING (sex) WHERE split = 'test'),
mm AS (SELECT bmi_cat, sex, avg(bmi) AS pm FROM lab WHERE split = 'training' AND sex IS NOT NULL GROUP BY ALL)
SELECT round(any_value(mse_lm), 6) AS mse_lm, round(avg(pow(bmi - pm, 2)), 6) AS mse_mm, count(*) AS n_test
FROM lab LEFT JOIN mm USING (bmi_cat, sex), lm WHERE split = 'test'"""


def summary_sql(bc: str) -> str:
    p = len(SUMMARY)
    names = ", ".join(f"'{t}'" for t in SUMMARY)
    return f"""{bc}, usable AS (SELECT *, bmi AS y FROM bc WHERE age IS NOT NULL AND supplier_x IS NOT NULL AND grp IS NOT NULL),
{solved("usable", list(SUMMARY.values()), inverse=True)},
fit AS (
  SELECT sex, m, b, n, n - {p} AS df, yy - ys * ys / n AS sst, resid AS sse FROM solved JOIN sizes USING (sex) JOIN (
    SELECT sex, sum(pow(y - list_dot_product(x, b), 2)) AS resid FROM design JOIN solved USING (sex) WHERE y IS NOT NULL GROUP BY sex) USING (sex)),
terms AS (
  SELECT sex, i, [{names}][i] AS term, b[i] AS estimate, sqrt(m[i][i + {p + 1}] * sse / df) AS se, 1 - sse / sst AS r2, n, df
  FROM fit, (SELECT unnest(range(1, {p + 1})) AS i)),
angles AS (SELECT *, atan(abs(estimate / se) / sqrt(df)) AS a FROM terms),
-- the finite series of Student's t: even and odd degrees of freedom
series AS (
  SELECT sex, i, j, sum(CASE WHEN j = 0 THEN 0 WHEN df % 2 = 0 THEN ln((2 * j - 1) / (2.0::DOUBLE * j)) ELSE ln(2 * j / (2.0::DOUBLE * j + 1)) END
                        + CASE WHEN j = 0 THEN 0 ELSE 2 * ln(cos(a)) END) OVER (PARTITION BY sex, i ORDER BY j) AS l
  FROM (SELECT sex, i, df, a, unnest(range(0, CASE WHEN df % 2 = 0 THEN df // 2 ELSE (df - 1) // 2 END)) AS j FROM angles)),
inner_ AS (SELECT sex, i, sum(exp(l)) AS s FROM series GROUP BY sex, i)
SELECT sex, term, round(estimate, 6) AS estimate, round(se, 6) AS std_error, round(estimate / se, 6) AS t_value,
       round(greatest(1 - CASE WHEN df % 2 = 0 THEN sin(a) * s ELSE 2 / pi() * (a + sin(a) * cos(a) * s) END, 0), 6) AS p_value,
       round(r2, 6) AS r2, n, df
FROM angles JOIN inner_ USING (sex, i)"""
