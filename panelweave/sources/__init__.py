from panelweave.sources.cache import cached, refreshed
from panelweave.sources.elections import scan_elections
from panelweave.sources.covariates import covariate_versions, scan_covariates
from panelweave.sources.geojson import scan_geojson
from panelweave.sources.lookups import scan_lookup_csv
from panelweave.sources.parquet import scan_projected, scan_year_filter

__all__ = [
    "cached", "covariate_versions", "refreshed", "scan_covariates", "scan_elections", "scan_geojson",
    "scan_lookup_csv", "scan_projected", "scan_year_filter",
]
