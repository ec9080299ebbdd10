"""Spark vs independent DuckDB SQL on the sf0.001 tables (full run: tools/oracle_check.py)."""

import sys
from pathlib import Path

import pytest

from conftest import SF0001

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

KEYS = ["scan_cohort", "link_sources", "describe_all", "recensor_periods", "ntile20", "threshold_table",
        "calibration_long", "metrics_by_strata", "impute_audit", "imputer_mse", "relative_risk",
        "top_centiles_rel", "case_sample", "hash_split", "one_hot", "recode_group", "translate_id",
        "fanout_audit", "csv_roundtrip", "table_roundtrip", "csv_row_number", "natural_join", "join_suffix",
        "collapse", "derive_sequential", "truncate_outcome", "d_statistic", "metrics_summary", "ols_summary",
        "ols_impute", "impute_two_stage", "imputer_mse_full", "table_published", "csv_quarantine", "headings",
        "fanout_observed"]


@pytest.fixture(scope="module")
def duck():
    from oracle_check import duck as mk
    return mk(SF0001)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    import __spark_entry__ as E
    from oracle_check import check
    r = check(spark, duck, key, E.queries()[key], E.oracle_sql()[key], SF0001)
    assert r["ok"], r


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["sex", "period", "q", "type", "value"]
    assert df.count() > 0


def test_every_query_has_sql():
    import __spark_entry__ as E
    from riskweave.plans import catalog
    assert set(catalog.QUERIES) <= set(E.queries())
    assert set(catalog.QUERIES) <= set(E.oracle_sql())
