"""Labels, codes, edges and limits the published results depend on."""

# Education groups, in order, with their display names.
EDUCATION_LEVELS = ["Primary\nor less", "Some \nsecondary", "Matric", "Some \ntertiary"]
EDUCATION_DISPLAY = {
    "Primary\nor less": "Primary or less",
    "Some \nsecondary": "Some secondary",
    "Matric": "Matric",
    "Some \ntertiary": "Some tertiary",
}
REFERENCE_EDUCATION = "Matric"

# Birth cohorts as (label, from, to, from is included); the upper edge is never in.
COHORT_BINS = [
    ("Gen1", "1945-01-01", "1965-01-01", False),
    ("Gen2", "1965-01-01", "1985-01-01", True),
    ("Gen3", "1985-01-01", "1995-01-01", False),
]
COHORT_DATE_BREAKS = ["0001-01-01", "1945-01-01", "1965-01-01", "1985-01-01", "1995-01-01", "2050-01-01"]
COHORT_DATE_LABELS = ["Other", "Gen1", "Gen2", "Gen3", "Other"]
COHORT_LEVELS = ["Gen1", "Gen2", "Gen3"]
COHORT_DISPLAY = {"Gen1": "1945-64", "Gen2": "1965-84", "Gen3": "1985-94"}
OTHER_COHORT = "Other"

# Five-year age groups, closed on the right.
AGE_BREAKS = [0, 15, 20, 25, 30, 35, 40, 45, 50, 100]
AGE_LABELS = ["xu15", "x1519", "x2024", "x2529", "x3034", "x3539", "x4044", "x4549", "xo50"]
FERTILE_AGES = ["x1519", "x2024", "x2529", "x3034", "x3539", "x4044", "x4549"]
AGE_DISPLAY = {
    "x1519": "15-19",
    "x2024": "20-24",
    "x2529": "25-29",
    "x3034": "30-34",
    "x3539": "35-39",
    "x4044": "40-44",
    "x4549": "45-49",
}
AGE_GROUP_WIDTH = 5
# Cells reached by fewer than half of a cohort: not reported.
MASKED_RATES = [("Gen2", "45-49"), ("Gen3", "30-34")]

# Codes.
FEMALE, MALE = 2, 1
HOUSEHOLD_HEAD = 1
SINGLE, MARRIED, INFORMAL_UNION = 1, 2, 5
EVER_MARRIED_PATTERN = "2|3|4"
EVER_MARRIED_CODES = [2, 3, 4]
LIVE_BIRTH_PATTERN = "L|M|F"
MATRIC_GRADE = 12
GRADES_BEFORE_MATRIC = [10, 11]
EMPLOYMENT_LABELS = {1: "Full-time", 2: "Part-time"}
UNEMPLOYED_LABEL = "Unemployed"

# Follow-up and age limits, calendar limits.
MIN_AGE_LAST_SEEN = 23
MIN_AGE_EDUCATION_SEEN = 21
FIRST_YEAR, LAST_YEAR = 1945, 2019
BIRTHS_AFTER = "1945-01-01"
DELIVERIES_BEFORE = "2019-01-01"
LAST_COHORT_WINDOW = ("1985-01-01", "1995-01-01")
ALL_COHORTS_WINDOW = ("1945-01-01", "1995-01-01")
CURRENT_STATE_WINDOW = ("2018-01-01", "2019-01-01")
MATRIC_GAP_YEARS = 2.1
UNION_GAP_YEARS = 2
LIFE_EVENT_AGE = 25
TEEN_AGE = 20

# Event orders as (code, first, second, third), in table order.
EVENT_ORDERS = [
    ("BUM", "Birth", "Union", "Matric"),
    ("BMU", "Birth", "Matric", "Union"),
    ("UBM", "Union", "Birth", "Matric"),
    ("UMB", "Union", "Matric", "Birth"),
    ("MUB", "Matric", "Union", "Birth"),
    ("MBU", "Matric", "Birth", "Union"),
]
FALLBACK_ORDER = "BUM"

# Columns of the two input tables that no calculation uses.
EPISODE_DROP_NAMES = ["Node", "FatherID", "Days", "LocationId", "Resident"]
EPISODE_DROP_RANGES = [("Enumeration", "Memberships"), ("SpouseId", "SEObsDate")]

# Significance marks, strictest first.
SIGNIFICANCE = [(0.001, "***"), (0.01, "**"), (0.05, "*")]
