"""Fixed values of the domain: codes, names and limits that results depend on."""

# --- fixed values: limits and seeds -----------------------------------------
STARTING_YEAR = 1990
RANDOM_SEED = 42
MISSING_RATE_LIMIT = 0.22
SAMPLE_ROWS = 50_000
MI_FEATURES = 50
VIF_LIMIT = 10.0
TEST_FRACTION = 0.15
PERMUTATION_REPEATS = 15
CV_FOLDS = 5
MAX_PAST_YEARS = 5
WINSOR_LOW, WINSOR_HIGH = 0.01, 0.99

# --- fixed values: political blocs and their share columns -------------------
BLOC_SHARE_COLUMNS = {
    "Centre": "pvotepvoteC",
    "Centre-droit": "pvotepvoteCD",
    "Centre-gauche": "pvotepvoteCG",
    "Droite": "pvotepvoteD",
    "Gauche": "pvotepvoteG",
}

# --- fixed values: election type codes ---------------------------------------
TYPE_CODES = {"presidentiel": 0, "legislative": 1, "referendum": 2}
UNKNOWN_TYPE_CODE = -1
EUROPEAN_TYPE_CODE = 3
LEGACY_EUROPEAN_TYPE_CODE = 2

# --- fixed values: commune codes removed from election tables ----------------
REMOVED_COMMUNES = (
    "26383", "69380", ".", "07350",
    "51700", "51701", "51702", "51703", "51704", "51705", "51706",
    "51707", "51708", "51709", "51710", "51711", "51712", "51713",
)

# --- fixed values: ballot ids that are not European elections ----------------
NON_EUROPEAN_ELECTIONS = (
    "2001_cant_t1", "2001_cant_t2",
    "2002_legi_t1", "2002_legi_t2", "2002_pres_t1", "2002_pres_t2",
    "2004_cant_t1", "2004_cant_t2", "2004_regi_t1",
    "2007_legi_t1", "2007_legi_t2", "2007_pres_t1", "2007_pres_t2",
    "2008_cant_t1", "2008_cant_t2", "2008_muni_t1", "2008_muni_t2",
    "2010_regi_t1", "2010_regi_t2",
    "2011_cant_t1", "2011_cant_t2",
    "2012_legi_t1", "2012_legi_t2", "2012_pres_t1", "2012_pres_t2",
    "2014_muni_t1", "2014_muni_t2",
    "2015_dpmt_t1", "2015_dpmt_t2", "2015_regi_t1", "2015_regi_t2",
    "2017_legi_t1", "2017_legi_t2", "2017_pres_t1", "2017_pres_t2",
    "2020_muni_t1", "2020_muni_t2",
    "2021_dpmt_t1", "2021_dpmt_t2", "2021_regi_t1", "2021_regi_t2",
    "2022_legi_t1", "2022_legi_t2", "2022_pres_t1", "2022_pres_t2",
    "2024_legi_t1", "2024_legi_t2",
)

# --- fixed values: ballot columns kept by the European scan ------------------
BALLOT_COLUMNS = (
    "id_election", "id_brut_miom", "Code du département", "Code de la commune",
    "Code du b.vote", "Libellé Abrégé Liste", "Libellé Etendu Liste",
    "Nom Tête de Liste", "Voix", "Nom", "Prénom", "Nuance", "Binôme", "Liste",
)

# --- fixed values: cities whose districts share the city's coordinates -------
# (city code, district code prefix, digits of the district number, districts)
CITY_DISTRICTS = (
    ("13055", "132", 2, 16),
    ("69123", "6938", 1, 9),
    ("75056", "751", 2, 20),
)

# --- fixed values: covariate files without a year in their column names ------
# (file stem, year, columns that are not features)
UNDATED_FEATURE_FILES = (
    ("menagescommunes", 1975, ("dep", "nomdep", "codecommune", "nomcommune")),
    ("terrescommunes", 1968,
     ("dep", "nomdep", "codecommune", "nomcommune", "plm", "nomcanton")),
)

# --- fixed values: feature augmentations and the suffix each one adds --------
AUGMENTATION_SUFFIXES = {
    "rank": "_rank",
    "winsor": "_winsor",
    "delta": "_delta",
    "lag": "_lag",
    "pct_change": "_pctchange",
    "deltawinsor": "_deltawinsor",
    "lagwinsor": "_lagwinsor",
    "pct_changewinsor": "_pctchangewinsor",
}
