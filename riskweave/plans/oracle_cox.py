"""DuckDB SQL for the D statistic: rankits from SQL's own ranks, then an unrolled
Newton iteration of a one-covariate Cox fit with Efron's ties."""

from __future__ import annotations

import math

from ..functions.stats import _A, _B, _C, _D, _P_LOW

KEYS = "sex, period, x, var"
ROUNDS = 9


def _horner(x: str, coefs) -> str:
    acc = f"({coefs[0]!r}::DOUBLE)"
    for c in coefs[1:]:
        acc = f"({acc} * {x} + ({c!r}::DOUBLE))"
    return acc


def _quantile(p: str) -> str:
    lo, hi, q = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    r = f"({q} * {q})"
    return (f"CASE WHEN {p} < {_P_LOW} THEN {_horner(lo, _C)} / ({_horner(lo, _D)} * {lo} + 1)"
            f" WHEN {p} > {1 - _P_LOW!r} THEN -{_horner(hi, _C)} / ({_horner(hi, _D)} * {hi} + 1)"
            f" ELSE {_horner(r, _A)} * {q} / ({_horner(r, _B)} * {r} + 1) END")


def d_sql(strata, where: str = "TRUE") -> str:
    """CTEs that end in ``d`` (keys, d_stat, d_lci, d_uci, rsq, rsq_lci, rsq_uci); x and
    var name the stratum as in the metrics SQL."""
    parts = [f"SELECT 'all' AS x, 'all' AS var, * FROM scored WHERE {where}"]
    parts += [f"SELECT '{n}' AS x, CAST({c} AS VARCHAR) AS var, * FROM scored WHERE {where}" for n, c in strata]
    z = _quantile("p")
    out = f"""
dr AS MATERIALIZED (
  SELECT *, (rk - 0.375) / (n + 0.25) AS p FROM (
    SELECT {KEYS}, score, t, death_covid AS e, row_number() OVER (PARTITION BY {KEYS} ORDER BY score, person_id) AS rk,
           count(*) OVER (PARTITION BY {KEYS}) AS n
    FROM ({' UNION ALL '.join(parts)}) WHERE score IS NOT NULL AND t IS NOT NULL AND death_covid IS NOT NULL)),
dz AS MATERIALIZED (SELECT {KEYS}, score, avg({z} / {math.sqrt(8 / math.pi)!r}) AS z FROM dr GROUP BY {KEYS}, score),
dc AS MATERIALIZED (SELECT {KEYS}, z, t, e, count(*) AS w FROM dr JOIN dz USING ({KEYS}, score) GROUP BY ALL),
b0 AS MATERIALIZED (SELECT {KEYS}, 0.0::DOUBLE AS beta, 0.0::DOUBLE AS step, 0.0::DOUBLE AS info FROM dc GROUP BY ALL),"""
    for k in range(1, ROUNDS + 1):
        out += f"""
days{k} AS (
  SELECT {KEYS}, beta, t, sum(w * exp(beta * z)) AS a0, sum(w * z * exp(beta * z)) AS a1, sum(w * z * z * exp(beta * z)) AS a2,
         sum(w * exp(beta * z)) FILTER (e = 1) AS e0, sum(w * z * exp(beta * z)) FILTER (e = 1) AS e1,
         sum(w * z * z * exp(beta * z)) FILTER (e = 1) AS e2, sum(w) FILTER (e = 1) AS d, sum(w * z) FILTER (e = 1) AS ez
  FROM dc JOIN b{k - 1} USING ({KEYS}) GROUP BY ALL),
risk{k} AS (
  SELECT *, sum(a0) OVER o AS s0, sum(a1) OVER o AS s1, sum(a2) OVER o AS s2 FROM days{k}
  WINDOW o AS (PARTITION BY {KEYS} ORDER BY t DESC)),
terms{k} AS (
  SELECT *, unnest(range(0, CAST(d AS BIGINT))) / d AS f FROM risk{k} WHERE d > 0),
b{k} AS MATERIALIZED (
  SELECT {KEYS}, beta + u / info AS beta, u / info AS step, info FROM (
    SELECT {KEYS}, beta, sum(ez / d - (s1 - f * e1) / (s0 - f * e0)) AS u,
           sum((s2 - f * e2) / (s0 - f * e0) - power((s1 - f * e1) / (s0 - f * e0), 2)) AS info
    FROM terms{k} GROUP BY {KEYS}, beta) WHERE info > 0),"""
    rsq = lambda d: f"({d} * {d} / (8 / pi())) / (pi() * pi() / 6 + {d} * {d} / (8 / pi()))"
    return out + f"""
d AS (
  SELECT *, {rsq('d_stat')} AS rsq, {rsq('d_lci')} AS rsq_lci, {rsq('d_uci')} AS rsq_uci FROM (
    SELECT {KEYS}, beta AS d_stat, 1 / sqrt(info) AS d_se, beta - 1.96 / sqrt(info) AS d_lci, beta + 1.96 / sqrt(info) AS d_uci
    FROM b{ROUNDS} WHERE abs(step) < 1e-8))"""
