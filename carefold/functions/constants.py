"""Fixed values. They have to equal the published or documented ones for results to be right."""

# ICD-10 chapters: first code, last code, title (fixed values; first match wins).
ICD_CHAPTERS = [
    ("A00-B99", "Certain infectious and parasitic diseases"),
    ("C00-D49", "Neoplasms"),
    ("D50-D89", "Diseases of the blood and blood-forming organs and certain disorders involving the immune mechanism"),
    ("E00-E89", "Endocrine, nutritional and metabolic diseases"),
    ("F01-F99", "Mental, Behavioral and Neurodevelopmental disorders"),
    ("G00-G99", "Diseases of the nervous system"),
    ("H00-H59", "Diseases of the eye and adnexa"),
    ("H60-H95", "Diseases of the ear and mastoid process"),
    ("I00-I99", "Diseases of the circulatory system"),
    ("J00-J99", "Diseases of the respiratory system"),
    ("K00-K95", "Diseases of the digestive system"),
    ("L00-L99", "Diseases of the skin and subcutaneous tissue"),
    ("M00-M99", "Diseases of the musculoskeletal system and connective tissue"),
    ("N00-N99", "Diseases of the genitourinary system"),
    ("O00-O9A", "Pregnancy, childbirth and the puerperium"),
    ("P00-P96", "Certain conditions originating in the perinatal period"),
    ("Q00-Q99", "Congenital malformations, deformations and chromosomal abnormalities"),
    ("R00-R99", "Symptoms, signs and abnormal clinical and laboratory findings, not elsewhere classified"),
    ("S00-T88", "Injury, poisoning and certain other consequences of external causes"),
    ("U00-U85", "Codes for special purposes"),
    ("V00-Y99", "External causes of morbidity"),
    ("Z00-Z99", "Factors influencing health status and contact with health services"),
]

UNKNOWN = "Unknown"

# Chapter ranges that flag a chronic condition (fixed values).
CONDITION_CHAPTERS = {
    "is_diabetes": ["E00-E89", "R00-R99", "Z00-Z99"],
    "is_heart_failure": ["I00-I99"],
    "is_hypertension": ["I00-I99"],
    "is_renal_failure": ["N00-N99", "E00-E89", "I00-I99"],
}

# Clinical prefixes for the same conditions (fixed values).
CONDITION_PREFIXES = {
    "is_diabetes": ["E08", "E09", "E10", "E11", "E12", "E13"],
    "is_heart_failure": ["I50"],
    "is_hypertension": ["I10", "I11"],
}

# Diagnosis flags by code prefix (fixed values).
DX_PREFIXES = {
    "dx_hypertension": ["I10", "I11", "I12", "I13"],
    "dx_copd": ["J44", "J43"],
    "dx_diabetes_t2": ["E11"],
    "dx_heart_failure": ["I50"],
    "dx_afib": ["I48"],
    "dx_coronary": ["I25"],
    "dx_stroke_sequelae": ["I69"],
    "dx_pneumonia": ["J18", "J15", "J16"],
    "dx_uti": ["N39.0"],
    "dx_parkinsons": ["G20"],
    "dx_surgical_after": ["Z47", "Z48"],
    "dx_weakness": ["M62.81", "R53.1"],
}

# Code labels (fixed values).
GENDER = {1: "Male", 2: "Female"}
DISCIPLINE = {1: "RN", 2: "PT", 3: "SLP/ST", 4: "OT"}

# BMI classes as (lower bound, upper bound, label); anything else is the last class (fixed values).
BMI_CLASSES = [
    (None, 18.5, "Underweight"),
    (18.5, 24.9, "Normal weight"),
    (25.0, 29.9, "Overweight"),
    (30.0, 34.9, "Obese-Class1"),
    (35.0, 39.9, "Obese-Class2"),
]
BMI_REST = "Obese-Class3"
# Factors for pounds and inches (fixed values).
BMI_FACTOR_CEIL = 704.5
BMI_FACTOR = 703.0

# Age bins (fixed values).
AGE_EDGES = [0, 18, 35, 50, 65, 80, 100]

# Texts that stand for a missing answer (fixed values).
ORDINAL_SENTINELS = ["UK", "-", "88", "9"]
DASH_SENTINEL = ["-"]

# Active-diagnosis items that write a dash for a missing answer (fixed values).
DASH_COLUMNS = ["Active_Diagnoses_Diabetes_Mellitus", "Active_Diagnoses_PVD_or_PAD"]

# Ordinal assessment items that carry the sentinels above (fixed values).
ORDINAL_COLUMNS = [
    "Ability_To_Hear",
    "Understanding_Of_Verbal_Content",
    "Patient_Treated_For_UTI_Last_14_Days",
    "Bowel_Incontinence_Frequency",
    "Frequency_Of_ADL_Or_IADL_Assistance_From_Caregiver",
    "Mobility_Discharge_Goal_Lying_to_Sitting",
    "Mobility_SOC_ROC_Performance_Lying_to_Sitting",
    "Drug_regimen_review",
    "Medication_intervention",
]

# Column names and prefixes that leak the outcome (fixed values).
LEAK_PREFIXES = ["Emergent_Care_Reason", "Hospital_Reason", "Inpatient_"]
LEAK_COLUMNS = [
    "Date_of_Last_Home_Visit",
    "Last_Assessment_Date",
    "NumVisits",
    "Days_Cared_For",
    "DaysBetweenVisits",
    "PrevVisitDate",
    "Discharge_Disposition",
    "Discharge_Transfer_Death_Date",
    "Most_Recent_Inpatient_Discharge_Date",
    "Most_Recent_Inpat_Discharge_Date_UK",
    "Resumption_of_Care_Date",
    "Resumption_of_Care_Date_NA",
    "Emergent_care_use_since_most_recent_SOC_ROC",
]
# Identifiers (fixed values).
ID_COLUMNS = [
    "Beneficiary_ID",
    "Episode_ID",
    "Agency_Medicare_Number",
    "HHA_Agency_ID",
    "State_ID",
    "Submission_Date",
    "Branch_State",
    "Patient_State",
    "Patient_Overall_Status",
]
# Administrative columns (fixed values).
ADMIN_COLUMNS = [
    "Assessment_ID",
    "HHA_Assessment_Internal_ID",
    "Facility_Internal_ID",
    "Branch_Identifier_Number",
    "Patient_Birth_Date",
    "Patient_ZIP_Code",
    "ZIP5",
    "ZIPCODE",
    "ZCTA",
    "POINT_ZIP",
]
# Columns without variance, words of payment columns, prefixes of social indicators (fixed values).
ZERO_VARIANCE_COLUMNS = ["V00-Y99", "diab", "diabwc", "msld", "blane", "diabc", "diabunc", "pud_elixhauser"]
PAYMENT_WORDS = ["payment", "pymnt", "hipps", "medicare_fee", "medicare_hmo", "medicare_hha"]
SDOH_PREFIXES = ["ACS_", "CEN_", "POS_", "HIFLD_"]

# Race flags (fixed values).
RACE_COLUMNS = [
    "White",
    "Black_or_African_American",
    "Asian",
    "Hispanic_or_Latino",
    "American_Indian_or_Alaska_Native",
    "Native_Hawiian_or_Pacific_Islander",
]

# Diagnosis code columns (fixed values).
CODE_COLUMNS = [
    "Primary_Diagnosis_ICD_10_C_M_Code",
    "Other_Diagnosis_Code_1_ICD_10_C_M",
    "Other_Diagnosis_Code_2_ICD_10_C_M",
    "Other_Diagnosis_Code_3_ICD_10_C_M",
    "Other_Diagnosis_Code_4_ICD_10_C_M",
    "Other_Diagnosis_Code_5_ICD_10_C_M",
]

# Outcome classes (fixed values).
OUTCOMES = ["Stable", "ED Only", "Hospitalized"]

# Item codes of the core assessment columns and their readable names (fixed values). The full
# list of a questionnaire version is an input file; see sources.readers.read_rename_map.
CORE_RENAMES = {
    "BENE_ID": "Beneficiary_ID",
    "ASMT_ID": "Assessment_ID",
    "ASMTFFDT": "Assessment_Effective_Date",
    "FACINTID": "Facility_Internal_ID",
    "STATE_ID": "State_ID",
    "SBMHPSCD": "Submitted_HIPPS_Code",
    "M0010": "Agency_Medicare_Number",
    "M0030": "Start_of_Care_Date",
    "M0032RDT": "Resumption_of_Care_Date",
    "M0060": "Patient_ZIP_Code",
    "M0066": "Patient_Birth_Date",
    "M0069": "Gender",
    "M0080": "Discipline_of_Person_Completing_Assessment",
    "M0140AIN": "American_Indian_or_Alaska_Native",
    "M0140ASN": "Asian",
    "M0140BLK": "Black_or_African_American",
    "M0140HSP": "Hispanic_or_Latino",
    "M0140HPI": "Native_Hawiian_or_Pacific_Islander",
    "M0140WHT": "White",
}

# Disparity topics and their indicators (fixed values).
TOPICS = {
    "Attainment": [
        "ACS_PCT_BACHELOR_DGR", "ACS_PCT_COLLEGE_ASSOCIATE_DGR", "ACS_PCT_GRADUATE_DGR", "ACS_PCT_HS_GRADUATE",
        "ACS_PCT_LT_HS", "ACS_PCT_NO_WORK_NO_SCHL_16_19", "ACS_PCT_POSTHS_ED", "ACS_PCT_VET_BACHELOR",
        "ACS_PCT_VET_COLLEGE", "ACS_PCT_VET_HS",
    ],
    "English Fluency": ["ACS_PCT_HH_LIMIT_ENGLISH"],
    "Internet Connectivity": [
        "ACS_PCT_HH_BROADBAND", "ACS_PCT_HH_BROADBAND_ONLY", "ACS_PCT_HH_CELLULAR", "ACS_PCT_HH_CELLULAR_ONLY",
        "ACS_PCT_HH_DIAL_INTERNET_ONLY", "ACS_PCT_HH_INTERNET", "ACS_PCT_HH_INTERNET_NO_SUBS",
        "ACS_PCT_HH_NO_COMP_DEV", "ACS_PCT_HH_NO_INTERNET", "ACS_PCT_HH_OTHER_COMP", "ACS_PCT_HH_OTHER_COMP_ONLY",
        "ACS_PCT_HH_PC", "ACS_PCT_HH_PC_ONLY", "ACS_PCT_HH_SAT_INTERNET", "ACS_PCT_HH_SMARTPHONE",
        "ACS_PCT_HH_SMARTPHONE_ONLY", "ACS_PCT_HH_TABLET", "ACS_PCT_HH_TABLET_ONLY",
    ],
    "Living Conditions": [
        "ACS_PCT_CHILDREN_GRANDPARENT", "ACS_PCT_CHILD_1FAM", "ACS_PCT_GRANDP_NO_RESPS", "ACS_PCT_GRANDP_RESPS_NO_P",
        "ACS_PCT_GRANDP_RESPS_P", "ACS_PCT_HH_1PERS", "ACS_PCT_HH_ABOVE65", "ACS_PCT_HH_ALONE_ABOVE65",
        "ACS_PCT_HH_KID_1PRNT", "ACS_TOT_GRANDCHILDREN_GP",
    ],
    "Poverty": [
        "ACS_PCT_HEALTH_INC_138_199", "ACS_PCT_HEALTH_INC_200_399", "ACS_PCT_HEALTH_INC_ABOVE400",
        "ACS_PCT_HEALTH_INC_BELOW137", "ACS_PCT_HH_1FAM_FOOD_STMP", "ACS_PCT_HH_FOOD_STMP_BLW_POV",
        "ACS_PCT_HH_NO_FD_STMP_BLW_POV", "ACS_PCT_HH_PUB_ASSIST", "ACS_PCT_INC50", "ACS_PCT_INC50_ABOVE65",
        "ACS_PCT_NONVET_POV_18_64", "ACS_PCT_PERSON_INC_100_124", "ACS_PCT_PERSON_INC_125_199",
        "ACS_PCT_PERSON_INC_ABOVE200", "ACS_PCT_PERSON_INC_BELOW99", "ACS_PCT_POV_AIAN", "ACS_PCT_POV_ASIAN",
        "ACS_PCT_POV_BLACK", "ACS_PCT_POV_HISPANIC", "ACS_PCT_POV_MULTI", "ACS_PCT_POV_NHPI", "ACS_PCT_POV_OTHER",
        "ACS_PCT_POV_WHITE", "ACS_PCT_VET_POV_18_64",
    ],
}

# Threshold grid of the classifier tuning (fixed values): 0.10 to 0.85 in steps of 0.05.
THRESHOLD_PERCENTS = list(range(10, 90, 5))
