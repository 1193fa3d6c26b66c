"""Fixed values of the worked examples: names, codes and spellings that the source files use."""

# Reporting countries by area.
COUNTRIES_BY_REGION = {
    "North": [
        "Algeria", "Egypt", "Libya", "Mauritania", "Morocco", "Sahrawi Arab Democratic Republic", "Tunisia",
        "Western Sahara",
    ],
    "South": [
        "Angola", "Botswana", "Lesotho", "Malawi", "Mozambique", "Namibia", "South Africa", "Eswatini", "Zambia",
        "Zimbabwe",
    ],
    "West": [
        "Benin", "Burkina Faso", "Cabo Verde", "Cote d'Ivoire", "Gambia", "Ghana", "Guinea-Bissau", "Guinea",
        "Liberia", "Mali", "Niger", "Nigeria", "Senegal", "Sierra Leone", "Togo",
    ],
    "East": [
        "Comoros", "Djibouti", "Ethiopia", "Eritrea", "Kenya", "Madagascar", "Mauritius", "Rwanda", "Seychelles",
        "Somalia", "South Sudan", "Sudan", "Tanzania", "Uganda",
    ],
    "Central": [
        "Burundi", "Cameroon", "Central African Republic", "Chad", "Congo (Kinshasa)", "Congo (Brazzaville)",
        "Equatorial Guinea", "Gabon", "Sao Tome and Principe",
    ],
}

# Header of the entity column before and after the snapshot files changed, and the first new day.
ERA_HEADERS = {"old": "Country/Region", "new": "Country_Region"}
ERA_CHANGE = "2020-03-22"
FIRST_SNAPSHOT = "2020-01-22"
DAY_ZERO = "2020-03-31"

# Covariates averaged per country, and the ones in the forecast model.
COVARIATES = [
    "lnrchange", "lncaseload_lastobs", "lnexpo", "lnsdi", "lnurban", "lnp70p", "lnhhsn", "lnihr2018", "lnsqualty",
    "lnhiv", "lnasthma", "lntraffic",
]
FORECAST_TERMS = ["exposure", "lnsdi", "lnurban", "lnp70p", "lnhhsn", "lnihr2018", "lnsqualty"]
TRAINING_ROWS = 21
HORIZON = 21
LEFT_OUT_OF_TRAINING = ["Mayotte", "Cape Verde"]

# Spellings brought to those of the panel before the forecast model.
COVARIATE_NAMES = [
    ("Cabo Verde", "Cape Verde"),
    ("Congo", "Congo (Brazzaville)"),
    ("Côte d'Ivoire", "Cote d'Ivoire"),
    ("Dem. Republic of the Congo", "Congo (Kinshasa)"),
    ("Swaziland", "Eswatini"),
    ("United Republic of Tanzania", "Tanzania"),
]
POPULATION_NAMES_FORECAST = [("United Republic of Tanzania", "Tanzania")]

# Spellings of the display panel, its population table and the joined feeds.
DISPLAY_NAMES = [
    ("Congo (Brazzaville)", "Republic of Congo"),
    ("Congo (Kinshasa)", "Democratic Republic of the Congo"),
    ("Cote d'Ivoire", "Ivory Coast"),
    ("Eswatini", "Swaziland"),
    ("Guinea-Bissau", "Guinea Bissau"),
    ("Tanzania", "United Republic of Tanzania"),
]
POPULATION_NAMES_DISPLAY = [("Congo", "Republic of Congo"), ("Côte d'Ivoire", "Ivory Coast")]
POLICY_NAMES = [
    ("Cote d'Ivoire", "Ivory Coast"),
    ("Democratic Republic of Congo", "Democratic Republic of the Congo"),
    ("Eswatini", "Swaziland"),
    ("Tanzania", "United Republic of Tanzania"),
    ("Congo", "Republic of Congo"),
]
DOSE_NAMES = [("Cote d'Ivoire", "Ivory Coast"), ("Eswatini", "Swaziland"), ("Cape Verde", "Cabo Verde")]

# Policy flag, its source column, and the level from which it counts as on.
POLICY_FLAGS = {
    "C1": ("C1_School closing", 2),
    "C2": ("C2_Workplace closing", 2),
    "C3": ("C3_Cancel public events", 2),
    "C4": ("C4_Restrictions on gatherings", 2),
    "C5": ("C5_Close public transport", 2),
    "C6": ("C6_Stay at home requirements", 2),
    "C7": ("C7_Restrictions on internal movement", 2),
    "C8": ("C8_International travel controls", 2),
    "H1": ("H1_Public information campaigns", 1),
    "H2": ("H2_Testing policy", 2),
    "H3": ("H3_Contact tracing", 2),
}
POLICY_ROWS = 60

# Years of the governance sheets, the measures kept, and the short name of each sheet.
GOVERNANCE_YEARS = [1996, 1998, 2000, *range(2002, 2020)]
GOVERNANCE_MEASURES = ["Estimate", "StdErr", "NumSrc"]
GOVERNANCE_COLUMNS_PER_YEAR = 6
GOVERNANCE_SHEETS = ["GovEff", "VoiceAcc", "PolStab", "RegQual", "RuleLaw", "CorruptControl"]
GOVERNANCE_SKIP = 14

# Spellings of the governance sheets.
GOVERNANCE_NAMES = [
    ("Bahamas, The", "Bahamas"),
    ("Cape Verde", "Cabo Verde"),
    ("Congo, Dem. Rep.", "Democratic Republic of the Congo"),
    ("Congo, Rep.", "Congo"),
    ("Egypt, Arab Rep.", "Egypt"),
    ("Swaziland", "Eswatini"),
    ("Gambia, The", "Gambia"),
    ("Kyrgyz Republic", "Kyrgyzstan"),
    ("Lao PDR", "Lao People's Democratic Republic"),
    ("St. Kitts and Nevis", "Saint Kitts and Nevis"),
    ("St. Lucia", "Saint Lucia"),
    ("St. Vincent and the Grenadines", "Saint Vincent and the Grenadines"),
    ("São Tomé and Principe", "Sao Tome and Principe"),
    ("Slovak Republic", "Slovakia"),
    ("Yemen, Rep.", "Yemen"),
]

# Spellings of the coverage tables.
COVERAGE_NAMES = [
    ("Bolivia (Plurinational State of)", "Bolivia"),
    ("Viet Nam", "Vietnam"),
    ("Czechia", "Czech Republic"),
    ("Democratic People's Republic of Korea", "Korea, Dem. Rep."),
    ("United Republic of Tanzania", "Tanzania"),
    ("Republic of Korea", "Korea, Rep."),
    ("Iran (Islamic Republic of)", "Iran, Islamic Rep."),
    ("Micronesia (Federated States of)", "Micronesia, Fed. Sts."),
    ("Republic of Moldova", "Moldova"),
    ("United Kingdom of Great Britain and Northern Ireland", "United Kingdom"),
    ("Venezuela (Bolivarian Republic of)", "Venezuela, RB"),
    ("United States of America", "United States"),
]

# Spellings after coverage and governance are merged, before the development index joins.
MERGED_NAMES = [
    ("Brunei Darussalam", "Brunei"),
    ("Côte d'Ivoire", "Cote d'Ivoire"),
    ("Korea, Rep.", "South Korea"),
    ("Korea, Dem. Rep.", "Korea"),
    ("Democratic Republic of the Congo", "Democratic Republic of Congo"),
    ("Iran, Islamic Rep.", "Iran"),
    ("Lao People's Democratic Republic", "Laos"),
    ("Micronesia, Fed. Sts.", "Micronesia (country)"),
    ("Russian Federation", "Russia"),
    ("Syrian Arab Republic", "Syria"),
    ("Timor-Leste", "Timor"),
    ("Venezuela, RB", "Venezuela"),
    ("Hong Kong SAR, China", "Hong Kong"),
]
DEVELOPMENT_NAMES = [("Cape Verde", "Cabo Verde"), ("Czechia", "Czech Republic")]

# Short names of the spending indicators, in the order in which the sheet lists them.
SPENDING_VARIABLES = [
    "CHEPctGDP", "CHEpCapUSD", "DOMExpPctCHE", "DomGGHEPctGDP", "DomGGHEpCapUSD", "PHCExpendpCapUSD",
    "DomGGEPCHpctGGHE", "PHCPctGDP",
]
SPENDING_YEARS = [str(y) for y in range(2000, 2019)]

# Spellings on the way to the yearly feature table.
SPENDING_NAMES = [
    ("Cabo Verde Republic of", "Cabo Verde"),
    ("Côte d'Ivoire", "Ivory Coast"),
    ("Congo", "Republic of Congo"),
]
NURSE_NAMES = [("Congo", "Republic of Congo"), ("Côte d'Ivoire", "Ivory Coast")]
FEATURE_NAMES = [
    ("Congo", "Republic of Congo"),
    ("Côte d'Ivoire", "Ivory Coast"),
    ("Cote d'Ivoire", "Ivory Coast"),
    ("Democratic Republic of Congo", "Democratic Republic of the Congo"),
    ("Tanzania", "United Republic of Tanzania"),
]
BIRTH_NAMES = [("Côte d'Ivoire", "Ivory Coast"), ("Congo", "Republic of Congo")]
AFTER_BIRTH_NAMES = [("Ivory Coast", "Cote d'Ivoire"), ("Cabo Verde", "Cape Verde"), ("Gambia", "The Gambia")]
AID_NAMES = [
    ("Congo", "Republic of Congo"),
    ("Swaziland", "Eswatini"),
    ("Tanzania", "United Republic of Tanzania"),
]
POPULATION_NAMES_FEATURES = [
    ("Cabo Verde", "Cape Verde"),
    ("Congo", "Republic of Congo"),
    ("Gambia", "The Gambia"),
    ("Côte d'Ivoire", "Cote d'Ivoire"),
]

# Money columns of the aid table by programme area.
CHILD_AID = {
    "Other": "nch_other_dah_19",
    "HumanResources": "nch_hss_hrh_dah_19",
    "HealthSystemStrengthening": "nch_hss_other_dah_19",
    "Immunization": "nch_cnv_dah_19",
    "Nutrition": "nch_cnn_dah_19",
}
PANDEMIC_AID = {"PandemicPrep": "swap_hss_pp_dah_19"}
MATERNAL_AID = {
    "Other": "rmh_other_dah_19",
    "HumanResources": "rmh_hss_hrh_dah_19",
    "HealthSystemStrengthening": "rmh_hss_other_dah_19",
    "MaternalHealth": "rmh_mh_dah_19",
    "FamilyPlanning": "rmh_fp_dah_19",
}

# Doses per clinic and day, and the cells of the staffing sheet that are set by hand.
CLINIC_DOSES = {"four": 1900, "eight": 5000}
STAFF_NAMES = [("Supply <anager", "Supply Manager")]
STAFF_CELLS = {("EMT", "four"): 1, ("IT Support", "four"): 1, ("IT Support", "eight"): 1}
TRANSLATOR = "Translator"
