"""Settings of a panel build."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from panelweave.fixed_values import AUGMENTATION_SUFFIXES, MAX_PAST_YEARS


@dataclass(frozen=True)
class PanelConfig:
    """What to read, which elections to assemble and which features to derive."""

    data_path: str
    vote_variables: tuple[str, ...]
    elections_to_exclude: tuple[str, ...] = ()
    use_cached: bool = False
    cache_dir: str | None = None
    features_aug: tuple[str, ...] = ("raw",)
    geojson_path: str | None = None
    every_place: bool = False  # a row for each listing of a repeated code
    one_election: bool = False
    target_year: int | None = None
    target_type: str | None = None
    include_elections: tuple[str, ...] = ()
    min_year: int = 0
    max_past_years: int = MAX_PAST_YEARS
    encoding_type: str = "no"
    quality_filter: bool = False
    output_dir: str | None = None

    def __post_init__(self):
        unknown = set(self.features_aug) - {"raw", *AUGMENTATION_SUFFIXES}
        if unknown:
            raise ValueError(f"unknown augmentations: {sorted(unknown)}")
        if self.one_election and (self.target_year is None or not self.target_type):
            raise ValueError("one_election needs target_year and target_type")

    def covariate_key(self) -> str:
        """Digest of the settings that decide what the covariate table holds."""
        shaping = (self.data_path, self.vote_variables, tuple(sorted(self.elections_to_exclude)))
        return hashlib.md5(repr(shaping).encode()).hexdigest()[:12]
