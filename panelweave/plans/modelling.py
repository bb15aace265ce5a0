"""From a saved panel to chosen features and an evaluated model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.fixed_values import MISSING_RATE_LIMIT, RANDOM_SEED, STARTING_YEAR
from panelweave.functions.predicates import complete
from panelweave.operators.columns import numeric_columns, prepare, quoted
from panelweave.operators.distribution import impute_medians
from panelweave.operators.evaluation import Regression
from panelweave.operators.selection import FeatureSelector
from panelweave.sources.parquet import scan_year_filter
from panelweave.storage import stage

PANEL_KEYS = ("codecommune", "annee")


@dataclass(frozen=True)
class Modelled:
    """A fitted model with what led to it."""

    rows: DataFrame  # keys, target and filled features, stored
    scores: DataFrame  # feature, score: the relevant ones, best first
    selected: list[str]
    model: object
    importances: DataFrame
    metrics: dict[str, float]


def modelling_rows(
    spark: SparkSession,
    path: str,
    target: str,
    keys: tuple[str, ...] = PANEL_KEYS,
    starting_year: int = STARTING_YEAR,
    election_type: int = 0,
    threshold: float = MISSING_RATE_LIMIT,
) -> DataFrame:
    """Keys, target and filled numeric features of one election type after ``starting_year``.

    Years are pruned by the scan.  Columns beyond the missing-rate limit go, then
    rows without a target, and gaps take the column's median.  A column listed
    as a key or target must be within the limit.  The result is stored: every
    later step reads it.
    """
    kept = prepare(scan_year_filter(spark, path, starting_year), threshold, election_type)
    lost = {target, *keys} - set(kept.columns)
    if lost:
        raise ValueError(f"missing, or with too many missing values: {sorted(lost)}")
    known = kept.filter(complete([target]))
    features = [c for c in numeric_columns(known) if c not in {*keys, target, "type"}]
    known = stage(known.select(*[F.col(quoted(c)) for c in dict.fromkeys([*keys, target, *features])]), "prepared")
    return stage(impute_medians(known, features), "filled")


def model_of_panel(
    spark: SparkSession,
    path: str,
    regression: Regression,
    target: str,
    keys: tuple[str, ...] = PANEL_KEYS,
    selector: FeatureSelector | None = None,
    random_state: int = RANDOM_SEED,
    **choice,
) -> Modelled:
    """Prepare, select by relevance and redundancy, split, fit and explain.

    ``choice`` goes to ``modelling_rows``.  Features are chosen on all prepared
    rows; the model is fitted without the held-out ones that it is measured on.
    """
    rows = modelling_rows(spark, path, target, keys, **choice)
    features = [c for c in rows.columns if c not in {*keys, target}]
    if not features:
        raise ValueError("no numeric feature is left")
    selector = (selector or FeatureSelector()).fit_filled(rows, features, target)
    model, importances, metrics = regression.train_test_with_permutation_importance(
        rows, list(keys), selector.selected_features, target, random_state=random_state
    )
    return Modelled(rows, selector.scores, selector.selected_features, model, importances, metrics)
