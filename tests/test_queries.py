"""The registry contract and a sample of queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from fieldtrace.plans.registry import TABLES
from tools.check_oracle import compare

SAMPLE = ["win01_label_runs", "win40_densest_window", "join03_asof_backward", "join05_containing_else_last", "join16_greedy_match", "join30_span_supply",
          "agg03_weighted_vote", "agg23_probability_metrics", "agg29_robust_prior", "win15_game_grid", "fn05_zones", "src20_cache_latest", "dq04_reviews"]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def test_registry_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 200 and set(o) <= set(q)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "run_id", "event_type", "start", "end", "n"] and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, con, sf_dir, name):
    status, _, _, info = compare(spark, con, name, sf_dir)
    assert status == "OK", info
