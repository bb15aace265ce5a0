from panelweave.functions.names import (
    commune_code,
    department,
    election_year,
    feature_stem,
    feature_year,
    move_year_to_end,
    parse_election,
    parse_vote_column,
    with_default_year,
)
from panelweave.functions.numbers import (
    clip,
    gini_simpson,
    nan_to_null,
    ratio_or_zero,
    relative_change,
    row_total,
    share_or_zero,
)
from panelweave.functions.predicates import complete, name_matches, not_in

__all__ = [
    "clip", "commune_code", "complete", "department", "election_year", "feature_stem",
    "feature_year", "gini_simpson", "move_year_to_end", "name_matches",
    "nan_to_null", "not_in", "parse_election", "parse_vote_column",
    "ratio_or_zero", "relative_change", "row_total", "share_or_zero",
    "with_default_year",
]
