"""Independent DuckDB SQL for every SQL-checkable query (the correctness oracle).

Only the raw driver tables are registered, so the fixture views are inlined as
CTEs.  Sums are cast to BIGINT, doubles rounded to 6 places, exactly as the
Spark side prints them.
"""

from __future__ import annotations

COHORT = """
rec AS (
  SELECT l_orderkey AS person_id, count(*) AS n_rec,
         max(CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END) AS flag_a,
         max(CASE WHEN l_tax >= 0.08 THEN 1 ELSE 0 END) AS flag_b,
         CAST(min(CASE WHEN l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1998-01-01'
                       THEN l_shipdate END) AS DATE) AS death_date
  FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey),
cohort AS (
  SELECT o.o_orderkey AS person_id, o.o_custkey AS household_id,
         CAST(c.c_nationkey % 2 AS INTEGER) AS sex, CAST(19 + o.o_orderkey % 82 AS INTEGER) AS age,
         o.o_orderpriority AS grp, c.c_mktsegment AS quint, r.r_name AS region,
         CASE WHEN rec.person_id IS NULL THEN 0 ELSE 1 END AS linked,
         CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS supplier_x,
         rec.flag_a, rec.flag_b, rec.n_rec, rec.death_date,
         CASE WHEN o.o_orderkey % 7 = 0 THEN NULL WHEN o.o_orderkey % 11 = 0 THEN CAST(0 AS DOUBLE)
              ELSE 15 + o.o_totalprice / 15000 END AS bmi,
         CASE WHEN o.o_orderkey % 5 = 0 THEN NULL
              WHEN o.o_totalprice <  52500 THEN 'UNDERWEIGHT' WHEN o.o_totalprice < 150000 THEN 'IDEAL'
              WHEN o.o_totalprice < 225000 THEN 'OVERWEIGHT' ELSE 'OBESE' END AS bmi_cat
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation   n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region   r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN rec        ON o.o_orderkey = rec.person_id),
linked AS (
  SELECT *, CASE WHEN death_date IS NOT NULL AND death_date <= DATE '1998-07-06' THEN 1 ELSE 0 END AS death_covid
  FROM cohort),
linked_t AS (
  SELECT *, CAST(CASE WHEN death_covid = 1 THEN date_diff('day', DATE '1998-01-01', death_date)
                      ELSE date_diff('day', DATE '1998-01-01', DATE '1998-07-06') END AS INTEGER) AS t
  FROM linked),
pers_period AS (
  SELECT l.* EXCLUDE (death_covid, t), CAST(p.period AS INTEGER) AS period,
         CASE WHEN l.death_date <= p.pe AND l.death_covid = 1 THEN 1
              WHEN NOT (l.death_date <= p.pe AND l.death_covid = 1) THEN 0 END AS death_covid,
         CAST(CASE WHEN l.death_date IS NOT NULL AND l.death_date < p.pe THEN date_diff('day', p.ps, l.death_date)
                   ELSE date_diff('day', p.ps, p.pe) END AS INTEGER) AS t
  FROM linked_t l
  JOIN (VALUES (1, DATE '1998-01-01', DATE '1998-04-08'), (2, DATE '1998-04-09', DATE '1998-07-06')) p(period, ps, pe)
    ON l.death_date IS NULL OR l.death_date >= p.ps),
scored0 AS (
  SELECT *, 0.01::DOUBLE * (CAST(age AS DOUBLE) - 60) + 0.25::DOUBLE * (CAST(coalesce(n_rec, 0) AS DOUBLE) - 4)
            + 0.3::DOUBLE * CAST(coalesce(flag_a, 0) AS DOUBLE) AS a
  FROM pers_period WHERE linked = 1),
scored AS (
  SELECT person_id, sex, period, t, death_covid, age, a, round(100 * (1 - power(0.98, exp(a))), 9) AS score,
         linked, supplier_x, grp, quint, region,
         CASE WHEN age >= 19 AND age < 30 THEN '[19,30)' WHEN age >= 30 AND age < 40 THEN '[30,40)'
              WHEN age >= 40 AND age < 50 THEN '[40,50)' WHEN age >= 50 AND age < 60 THEN '[50,60)'
              WHEN age >= 60 AND age < 70 THEN '[60,70)' WHEN age >= 70 AND age < 80 THEN '[70,80)'
              WHEN age >= 80 AND age < 90 THEN '[80,90)' WHEN age >= 90 AND age < 101 THEN '[90,101)' END AS age_group
  FROM scored0),
first_death AS (
  SELECT l_orderkey AS person_id, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_suppkey) AS place
  FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1998-01-01'),
causes0 AS (
  SELECT c.person_id, c.death_date, CASE WHEN d.person_id IS NULL OR c.death_date > DATE '1998-07-06' THEN 'Alive'
         WHEN d.l_suppkey % 4 = 0 THEN 'Not COVID' ELSE 'COVID' END AS outcome
  FROM cohort c LEFT JOIN first_death d ON c.person_id = d.person_id AND d.place = 1),
causes AS (
  SELECT *, CASE WHEN outcome = 'COVID' THEN 1 ELSE 0 END AS death_covid,
         CASE WHEN outcome = 'Not COVID' THEN 1 ELSE 0 END AS death_other,
         CAST(date_diff('day', DATE '1998-01-01', CASE WHEN outcome <> 'Alive' THEN death_date ELSE DATE '1998-07-06' END) AS INTEGER) AS t
  FROM causes0)
"""


def with_cohort(body: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + COHORT.strip() + ",\n" + body.strip()


def tile_groups(k: int, src: str = "scored", score: str = "score") -> str:
    return f"""
tiles AS (
  SELECT sex, period, {score} AS s, death_covid,
         CAST(NTILE({k}) OVER (PARTITION BY sex, period ORDER BY {score}, person_id) AS INTEGER) AS q
  FROM {src} WHERE {score} IS NOT NULL),
tg AS (
  SELECT sex, period, q, min(s) AS mn, CAST(sum(death_covid) AS BIGINT) AS deaths, count(*) AS total,
         avg(s) AS predicted, avg(death_covid) * 100 AS observed
  FROM tiles GROUP BY sex, period, q),
cap AS (
  SELECT *, CAST(sum(deaths) OVER (PARTITION BY sex, period ORDER BY q DESC
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_deaths,
         CAST(sum(deaths) OVER (PARTITION BY sex, period) AS DOUBLE) AS all_deaths
  FROM tg)"""


def threshold_sql(k: int, where: str = "TRUE", src: str = "scored", score: str = "score") -> str:
    return with_cohort(tile_groups(k, src, score) + f"""
SELECT sex, period, q, round(mn, 6) AS min, deaths, total, cum_deaths,
       round(cum_deaths / nullif(all_deaths, 0), 6) AS cum_deaths_p
FROM cap WHERE {where}""")


def calibration_long_sql(k: int = 20, src: str = "scored", score: str = "score") -> str:
    return with_cohort(tile_groups(k, src, score) + """
SELECT sex, period, q, 'Predicted' AS type, round(predicted, 6) AS value FROM tg
UNION ALL
SELECT sex, period, q, 'Observed' AS type, round(observed, 6) AS value FROM tg""")
