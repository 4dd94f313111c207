"""Fixed values of the data model (domain constants, fitted coefficients, rule tables)."""

# --- fixed values: ensemble and time axis -----------------------------------
NUM_DRAWS = 250
STEPS_PER_DAY = 4
SCENARIOS = ["historical", "ssp126", "ssp245", "ssp585"]
START_YEAR = {"historical": 1970, "ssp126": 2015, "ssp245": 2015, "ssp585": 2015}
END_YEAR = {"historical": 2014, "ssp126": 2100, "ssp245": 2100, "ssp585": 2100}
MIN_YEAR, MAX_YEAR = 1950, 2100

# --- fixed values: basins ----------------------------------------------------
BASINS = ["EP", "NA", "NI", "SI", "AU", "SP", "WP"]
GLOBAL_BASIN = "GL"

# box_bounds: (west, south, east, north) as written in configuration
BOX_BOUNDS_TEXT = {
    "EP": ("180E", "0N", "290E", "60N"),
    "NA": ("260E", "0N", "360E", "60N"),
    "NI": ("30E", "0N", "100E", "50N"),
    "SI": ("20E", "45S", "100E", "0S"),
    "AU": ("100E", "45S", "180E", "0S"),
    "SP": ("180E", "45S", "250E", "0S"),
    "WP": ("100E", "0N", "180E", "60N"),
    "GL": ("0E", "90S", "360E", "90N"),
}
BOX_BOUNDS = {
    "EP": (180.0, 0.0, 290.0, 60.0),
    "NA": (260.0, 0.0, 360.0, 60.0),
    "NI": (30.0, 0.0, 100.0, 50.0),
    "SI": (20.0, -45.0, 100.0, 0.0),
    "AU": (100.0, -45.0, 180.0, 0.0),
    "SP": (180.0, -45.0, 250.0, 0.0),
    "WP": (100.0, 0.0, 180.0, 60.0),
    "GL": (0.0, -90.0, 360.0, 90.0),
}
# mask_bounds differ from the boxes for NA, NI, SI, AU and SP
MASK_BOUNDS = {
    "NA": (255.0, 0.0, 360.0, 60.0),
    "EP": (180.0, 0.0, 290.0, 60.0),
    "WP": (100.0, 0.0, 180.0, 60.0),
    "NI": (30.0, 0.0, 100.0, 49.0),
    "SI": (10.0, -45.0, 100.0, 0.0),
    "AU": (100.0, -45.0, 170.0, 0.0),
    "SP": (170.0, -45.0, 260.0, 0.0),
}
# stair steps: the Atlantic keeps cells at or above (lat) and at or east of (lon)
NA_STEPS = [(0.0, 285.0), (9.0, 278.0), (10.0, 276.0), (14.0, 271.0), (18.0, 262.0)]
# the eastern Pacific keeps cells at or below (lat) and at or west of (lon)
EP_STEPS = [(7.5, 295.0), (8.8, 282.0), (9.0, 277.0), (10.0, 276.5), (15.0, 276.0),
            (18.0, 271.0), (60.0, 262.0)]
GLOBAL_MASK_LAT = 50.0
LAT_VORT_FAC = 2.0
LAT_VORT_POWER = {"NA": 6.0, "EP": 6.0, "WP": 3.5, "AU": 6.0, "SI": 3.0, "SP": 7.0, "NI": 2.5}

# --- fixed values: wind thresholds (m/s) and storm classes -------------------
THRESHOLDS = {"any": 0.0, "tropical_storm": 17.0, "hurricane_minor": 33.0, "hurricane_major": 58.0}
CATEGORY_LIMITS = [33.0, 43.0, 50.0, 58.0, 70.0]
SEVERITY = {"tropical": [0], "moderate": [1, 2, 3], "severe": [4, 5]}
EXPOSURE_WIND = 18.0

# --- fixed values: unit factors ----------------------------------------------
MS_TO_KT = 1.943844
NM_TO_KM = 1.852
C_TO_K = 273.15
EARTH_RADIUS_M = 6378100.0

# --- fixed values: regressions -----------------------------------------------
PRESSURE_FIT = (1026.3401, -0.05504, -0.03536, -0.7357)
RMW_KNOTS = ([872.0, 940.0, 980.0, 1021.0], [14.907318, 15.726927, 25.742142, 56.856522])
ROCI_KNOTS = ([872.0, 950.0, 985.0, 1005.0, 1021.0],
              [210.711487, 215.897110, 198.261520, 159.589508, 90.900116])
MEMORY_FIT = (2.41, 0.5090, 1.32)
RUNTIME_FIT = (29.18, 0.3929, 6.59)
COST_BUFFER = 0.25

# --- fixed values: thermodynamics (SI units) ---------------------------------
T_TRIP = 273.16
E_TRIP = 611.65
RD = 287.04
RV = 461.5
CP = 718 + 287.04
CPV = 1870.0
CL = 4190.0
EPS = 287.04 / 461.5
LV = 2.5e6
L0 = 2.555e6
# lifting condensation level, published closed form
LCL_E0V, LCL_CVV, LCL_CVL = 2.3740e6, 1418.0, 4119.0
CK, CD, PI_REDUCTION = 0.0012, 0.0012, 0.8
LOG_CHI_FAC, CHI_FAC = 0.5, 1.3

# --- fixed values: genesis acceptance -----------------------------------------
SEED_V, SEED_V_2D, SEED_VMAX, SEED_PI = 15.0, 6.5, 18.0, 35.0

# --- fixed values: inventory rules --------------------------------------------
VARIABLES = ["ua", "va", "tos", "psl", "hus", "ta"]
VARIABLE_FREQUENCY = {"tos": "mon", "psl": "mon", "ta": "mon", "hus": "mon", "ua": "day", "va": "day"}
GRID_PRIORITY = ["gn", "gr", "gr1", "gr2"]
FORBIDDEN_DIMS = ["ncells"]
KEY_LEVELS = ["model", "variant", "scenario", "time_period", "basin"]
VARIABLE_KEYS = {
    "ERA5": {"sst": "sst", "mslp": "sp", "temp": "t", "sp_hum": "q", "u": "u", "v": "v",
             "lvl": "isobaricInhPa", "lon": "longitude", "lat": "latitude"},
    "GCM": {"sst": "tos", "mslp": "psl", "temp": "ta", "sp_hum": "hus", "u": "ua", "v": "va",
            "lvl": "plev", "lon": "lon", "lat": "lat"},
}
