import re

import pytest

import __spark_entry__ as E
from check_oracles import compare, oracle_connection

SF = "/root/testdata/sf0.001"
# One or two queries of every block of the catalog; check_oracles.py runs them all.
SAMPLE = ["bronze_profile", "quality_scorecard", "demand_segments", "holiday_calendar", "future_known_inputs",
          "croston_sba_levels", "leaderboard", "mase_by_series", "policy_costs", "replenishment_levels",
          "price_recommendations", "promo_depth_economics", "weekly_health", "feature_drift", "executive_summary",
          "stock_flag_orientation", "hourly_profiles", "profile_recovery", "business_kpis", "scores_by_view"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_oracle(spark, name):
    want = oracle_connection(SF).execute(E.oracle_sql()[name]).df()
    assert compare(E.queries()[name](spark, SF).toPandas(), want) == ""


def test_entry_has_rows(spark):
    assert E.entry(spark).count() > 0


def test_names_are_plain():
    assert not [n for n in E.queries() if not re.fullmatch(r"[a-z0-9_]+", n)]
    assert set(E.oracle_sql()) <= set(E.queries())


def test_learned_queries_use_the_library_parameters():
    from shelfcast.catalog import learned
    from shelfcast.operators import hourly_forecast as HF
    from shelfcast.operators import recovery as R
    from shelfcast.plans import daily as DP

    assert learned.DAILY == DP.PARAMS and DP.PARAMS.rounds == 40
    assert learned.HOURLY.recovery == R.PARAMS and learned.HOURLY.forecaster == HF.PARAMS
    assert R.PARAMS.rounds == HF.PARAMS.rounds == 30
