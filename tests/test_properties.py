"""Properties that hold for any input."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks import views
from panelweave.operators.asof import asof_backfill, resolve_years
from panelweave.operators.distribution import quantiles, rank_pct, winsorize
from panelweave.operators.joins import join_null_safe, lookup_join
from panelweave.plans.blocs import SHARES, bloc_panel

SF = "/root/testdata/sf0.001"
few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
numbers = st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6))


def test_shares_sum_to_one_or_zero(spark):
    panel = bloc_panel(views.ballots(spark, SF), views.registered(spark, SF), views.label_maps(spark))
    total = sum(F.col(c) for c in SHARES)
    assert panel.filter((F.abs(total - 1) > 1e-9) & (total != 0)).isEmpty()
    assert not panel.filter(total == 0).isEmpty()
    assert panel.select("codecommune", "annee").distinct().count() == panel.count()


def test_backfill_never_uses_a_later_or_too_old_year(spark):
    features = views.feature_long(spark, SF)
    years = spark.createDataFrame([(y,) for y in range(1993, 2009)], "target int")
    resolved = resolve_years(features.select("feature", "annee").distinct(), years)
    assert resolved.filter("annee > target or annee < target - 5").isEmpty()
    assert resolved.groupBy("feature", "target").count().filter("count > 1").isEmpty()
    redated = asof_backfill(features, resolved)
    assert redated.groupBy("codecommune", "feature", "annee").count().filter("count > 1").isEmpty()


def test_left_joins_keep_their_rows(spark):
    ballots = views.ballots(spark, SF)
    labels = views.label_maps(spark)[0]
    assert lookup_join(ballots, labels, ["nuance"]).count() == ballots.count()
    assert lookup_join(ballots, labels, ["nuance"], max_rows=0).count() == ballots.count()
    assert join_null_safe(ballots, labels, ["nuance"], "left").count() == ballots.count()


@few
@given(st.lists(numbers, min_size=1, max_size=40))
def test_ranks_and_bounds(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    present = sorted(v for v in values if v is not None)
    for rows_per_task in (10**6, 3):
        ranks = [r["rank_pct"] for r in rank_pct(df, ["g"], "v", rows_per_task=rows_per_task).collect()]
        known = [r for r in ranks if r is not None]
        assert len(known) == len(present) and all(0 < r <= 1 for r in known)
        if present:
            assert math.isclose(sum(known), (len(present) + 1) / 2, rel_tol=1e-9)
        clipped = winsorize(df, ["g"], "v", rows_per_task=rows_per_task).collect()
        assert all((r["v"] is None) == (r["winsor"] is None) for r in clipped)
        low, high = quantiles(df, ["g"], "v", [0.0, 1.0], ["a", "b"], rows_per_task).first()[1:]
        assert (low, high) == ((present[0], present[-1]) if present else (None, None))
