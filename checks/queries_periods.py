"""Ranks, quantiles and previous-period features."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registry import query, rounded
from panelweave.fixed_values import AUGMENTATION_SUFFIXES
from panelweave.operators.augment import augment, augmented_long
from panelweave.operators.distribution import quantiles, winsorize
from panelweave.operators.distribution import rank_pct as ranked
from panelweave.operators.incremental import refreshed_augmentation
from panelweave.operators.periods import (
    delta_feature,
    lag_feature,
    pct_change_feature,
    period_catalog,
    with_previous,
    with_previous_elections,
)
from panelweave.storage import new_path

_KEYS = ["codecommune", "feature", "annee"]
_CHANGE = "case when prev_{v} <> 0 then ({v} - prev_{v}) / prev_{v} end"


def _previous(spark, sf):
    return with_previous(views.stored(views.feature_long, spark, sf), "codecommune", ["feature"], "annee", ["value"])


@query(
    """select feature, annee, round(low, 6) as low, round(high, 6) as high from bounds"""
)
def quantile_bounds(spark, sf):
    bounds = quantiles(
        views.stored(views.feature_long, spark, sf), ["feature", "annee"], "value", [0.01, 0.99], ["low", "high"]
    )
    return rounded(bounds, "low", "high")


@query(
    """select codecommune, feature, annee, round(rank, 6) as rank_pct from winsored where value is not null"""
)
def rank_pct(spark, sf):
    rows = ranked(views.stored(views.feature_long, spark, sf), ["feature", "annee"], "value")
    return rounded(rows.select(*_KEYS, "rank_pct"), "rank_pct")


@query("select feature, annee, prev_annee, next_annee from catalog")
def prev_feature_year(spark, sf):
    return period_catalog(views.feature_long(spark, sf), ["feature"], "annee")


@query(
    """select codecommune, feature, annee, round(prev_value, 6) as lag from lagged
       where value is not null or prev_value is not null"""
)
def feature_lag(spark, sf):
    return rounded(lag_feature(_previous(spark, sf)).select(*_KEYS, "lag"), "lag")


@query(
    """select codecommune, feature, annee, round(value - prev_value, 6) as delta from lagged
       where value is not null or prev_value is not null"""
)
def feature_delta(spark, sf):
    return rounded(delta_feature(_previous(spark, sf)).select(*_KEYS, "delta"), "delta")


@query(
    f"""select codecommune, feature, annee, round({_CHANGE.format(v='value')}, 6) as pct_change from lagged
        where value is not null or prev_value is not null"""
)
def feature_pct_change(spark, sf):
    return rounded(pct_change_feature(_previous(spark, sf)).select(*_KEYS, "pct_change"), "pct_change")


@query(
    """select codecommune, feature, annee, round(winsor, 6) as winsor from winsored where value is not null"""
)
def feature_winsor(spark, sf):
    rows = winsorize(views.stored(views.feature_long, spark, sf), ["feature", "annee"], "value")
    return rounded(rows.select(*_KEYS, "winsor"), "winsor")


def _winsor_variant(kind, expression):
    @query(
        f"""select codecommune, feature, annee, round({expression}, 6) as {kind} from lagged
            where value is not null or prev_value is not null""",
        name={"lagwinsor": "feature_winsor_lag", "deltawinsor": "feature_winsor_delta",
              "pct_changewinsor": "feature_winsor_pct_change"}[kind],
    )
    def run(spark, sf):
        return rounded(augment(views.stored(views.feature_long, spark, sf), [kind]), kind)


_winsor_variant("lagwinsor", "prev_winsor")
_winsor_variant("deltawinsor", "winsor - prev_winsor")
_winsor_variant("pct_changewinsor", _CHANGE.format(v="winsor"))

_KINDS = ["raw", *AUGMENTATION_SUFFIXES]
KIND_EXPRESSIONS = {
    "raw": "value",
    "rank": "rank",
    "winsor": "winsor",
    "delta": "value - prev_value",
    "lag": "prev_value",
    "pct_change": _CHANGE.format(v="value"),
    "deltawinsor": "winsor - prev_winsor",
    "lagwinsor": "prev_winsor",
    "pct_changewinsor": _CHANGE.format(v="winsor"),
}


@query(
    "select codecommune, feature, annee, "
    + ", ".join(f"round({e}, 6) as {k}" for k, e in KIND_EXPRESSIONS.items())
    + " from lagged where value is not null or prev_value is not null"
)
def augmented_features(spark, sf):
    return rounded(augment(views.stored(views.feature_long, spark, sf), _KINDS), *_KINDS)


@query(
    "select codecommune, feature, annee, "
    + ", ".join(f"round({e}, 6) as {k}" for k, e in KIND_EXPRESSIONS.items())
    + " from lagged where value is not null or prev_value is not null"
)
def augmented_increment(spark, sf):
    """The same table in three steps: without two years, with both, and with one year's values put right."""
    features = views.stored(views.feature_long, spark, sf)
    folder = new_path(spark, "augmented")
    wrong = features.withColumn("value", F.when(F.col("annee") == 1998, -F.col("value")).otherwise(F.col("value")))
    for arrived in (wrong.filter(~F.col("annee").isin(1996, 1997)), wrong):
        refreshed_augmentation(spark, folder, "features", arrived, _KINDS)
    return rounded(refreshed_augmentation(spark, folder, "features", features, _KINDS).rows, *_KINDS)


@query(
    """select codecommune, feature || '_rank' as feature, annee, round(rank, 6) as value from lagged
       where value is not null or prev_value is not null
       union all select codecommune, feature || '_lag', annee, round(prev_value, 6) from lagged
       where value is not null or prev_value is not null"""
)
def augmented_features_long(spark, sf):
    return rounded(augmented_long(views.stored(views.feature_long, spark, sf), ["rank", "lag"]), "value")


_HISTORY = ["pvotepreviousa", "pvotepreviouspreviousa", "pvotepreviousb", "pvotepreviouspreviousb"]


@query(
    "select codecommune, election_type, annee, "
    + ", ".join(f"round({c}, 6) as {c}" for c in ["pvotea", "pvoteb", *_HISTORY])
    + " from votes_history"
)
def previous_elections(spark, sf):
    rows = with_previous_elections(views.votes_gappy(spark, sf), views.VOTES).drop("inscrits")
    return rounded(rows, "pvotea", "pvoteb", *_HISTORY)
