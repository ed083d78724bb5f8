"""A sample of the registered queries against their SQL twins; tools/check.py runs them all."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import TABLES, compare  # noqa: E402

from tidewatch.queries import ORACLE, QUERIES  # noqa: E402

SAMPLE = [
    "f01_velocity_ratio_1h_vs_30d", "f10_amount_zscore_90d", "f24_geo_cell_fraud_rate_30d",
    "f28_counterparty_confirmed_fraud_90d", "e01_auc", "e07_t05_recall_at_budget", "e20_psi", "d08_decision",
    "k08_circuit_breaker", "g01_component_sizes", "p01_request_validation",
    "s12_k14_envelope_routing", "k12_stream_ingest", "s14_stream_facts", "s15_stream_profiles", "k13_stream_first_copies",
    "f43_corridor_class", "g02_network",
]


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_its_sql(spark, con, sf, name):
    _, note, ok = compare(spark, con, sf, name)
    assert ok, note


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) > 190
