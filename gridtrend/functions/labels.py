"""Fixed values of the survey grid. Every operator takes them as parameters."""

# Site abbreviations and names.
SITE_NAMES = {
    "Alr": "Alrust",
    "Arh": "Arhelleren",
    "Fau": "Fauske",
    "Gud": "Gudmedalen",
    "Hog": "Hogsete",
    "Lav": "Lavisdalen",
    "Ovs": "Ovstedal",
    "Ram": "Rambera",
    "Skj": "Skjellingahaugen",
    "Ulv": "Ulvhaugen",
    "Ves": "Veskre",
    "Vik": "Vikesland",
}

# Site, temperature level 1-3, precipitation level 1-4.
SITE_LEVELS = [
    ("Alrust", 2, 1),
    ("Arhelleren", 3, 3),
    ("Fauske", 3, 1),
    ("Gudmedalen", 1, 3),
    ("Hogsete", 2, 2),
    ("Lavisdalen", 1, 2),
    ("Ovstedal", 3, 4),
    ("Rambera", 2, 3),
    ("Skjellingahaugen", 1, 4),
    ("Ulvhaugen", 1, 1),
    ("Veskre", 2, 4),
    ("Vikesland", 3, 2),
]

# Level labels in display order.
TEMPERATURE_LABELS = {1: "alpine", 2: "subalpine", 3: "boreal"}
PRECIPITATION_LABELS = {1: "600", 2: "1200", 3: "2000", 4: "2700"}
PRECIPITATION_MM_LABELS = {1: "600mm", 2: "1200mm", 3: "2000mm", 4: "2700mm"}

# Average summer temperature and precipitation per level.
TEMPERATURE_AVERAGES = {1: 6.5, 2: 8.5, 3: 10.5}
PRECIPITATION_AVERAGES = {1: 500.0, 2: 1200.0, 3: 2000.0, 4: 2700.0}

# Treatments, their groups, and the ones that count as controls.
TREATMENT_GROUPS = {
    "TTC": "Control",
    "TT1": "Control",
    "TT2": "Warm",
    "TT3": "Wet",
    "TT4": "WarmWet",
}
TREATMENT_ORDER = ["Control", "Warm", "Wet", "WarmWet"]
CONTROL_TREATMENTS = ["TTC", "TT1"]

# Season codes that arrive damaged.
FINISH_REPAIRS = {"H<f8>st": "Host", "V<e5>r": "Var"}
START_REPAIRS = {"V<e5>r": "Var"}

# Traits dropped after the pivot, and traits renamed.
DROPPED_TRAITS = ["Common-rear", "Habitat", "Soil type"]
RENAMED_TRAITS = {"Season finish": "season_finish", "Season start": "season_start"}

# Functional groups that stay in the curated table.
KEPT_GROUPS = ["graminoid", "forb"]

# Labels of the climate terms in display order.
TERM_LABELS = {
    "prev_ann_prec_anomaly": "Previous year Aug - Jul precipitation",
    "prev_summer_temp_anomaly": "Previous summer mean temperature",
    "ann_prec_anomaly": "Aug - Jul precipitation",
    "summer_temp_anomaly": "Summer mean temperature",
}
