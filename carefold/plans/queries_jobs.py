"""The end-to-end jobs on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from carefold.functions import constants as C
from carefold.functions import risk_tables as R
from carefold.functions import scalars as S
from carefold.operators import columns as P
from carefold.operators import diagnosis as D
from carefold.operators import reshape as RS
from carefold.operators import risk as RK
from carefold.operators import visits as V
from carefold.plans import jobs
from carefold.plans.domain import BLOCK, CODES, q6, r6
from carefold.plans.queries_columns import AGE_SQL, BMI_CLASS, ZIP_SQL
from carefold.plans.queries_domain import CHARLSON, HAD_ED, HAD_HOSP, OUTCOME, UNIT_WEIGHTS, _risk_sql, _spans_sql
from carefold.plans.queries_models import SMALL
from carefold.plans.registry import query
from carefold.session import scratch_path
from carefold.sources import readers, sinks

NAMED = "[" + ", ".join(C.CODE_COLUMNS) + "]"
WIN = "OVER (PARTITION BY Beneficiary_ID, Facility_Internal_ID ORDER BY Assessment_Effective_Date"
AGE = "CAST(trunc(date_diff('day', Patient_Birth_Date, Assessment_Effective_Date) / 365.0) AS INT)"


def _raw(t):
    """The assessments as they arrive: a CSV folder with item codes and ddMMMyyyy dates, written and
    read back with an explicit schema."""
    back = {v: k for k, v in C.CORE_RENAMES.items()}
    a = t.assessments().withColumns({c: F.upper(F.date_format(c, "ddMMMyyyy")) for c in jobs.DATES})
    raw = a.withColumnsRenamed(back)
    path = scratch_path(t.spark, "raw")
    sinks.write_csv(raw, path)
    return readers.read_csv(t.spark, path, raw.schema)


SETS = f"""sets AS (SELECT DISTINCT Beneficiary_ID, s FROM (SELECT Assessment_ID, any_value(Beneficiary_ID) AS Beneficiary_ID, array_to_string(list_sort(list_distinct(array_agg(code_range))), ',') AS s
    FROM (SELECT Assessment_ID, Beneficiary_ID, unnest({NAMED}) AS code FROM asm) JOIN chapters ON substr(code, 1, 3) BETWEEN lo AND hi GROUP BY 1)),
    counts AS (SELECT Beneficiary_ID, {', '.join(f"count(*) FILTER (WHERE contains(s, '{span}')) AS " + chr(34) + span + chr(34) for span, _ in C.ICD_CHAPTERS)} FROM sets GROUP BY 1)"""


@query("job_01", f""", {SETS} SELECT a.Assessment_ID, CAST(year(Assessment_Effective_Date) AS INT) AS "AssessmentYear", count(*) {WIN}) AS "NumVisits",
    CAST(Assessment_Effective_Date - lag(Assessment_Effective_Date) {WIN}, a.Assessment_ID) AS INT) AS "DaysBetweenVisits",
    CAST(max(Assessment_Effective_Date) OVER (PARTITION BY a.Beneficiary_ID) - Start_of_Care_Date AS INT) AS "Days_Cared_For", {AGE} AS "Age",
    CASE Gender WHEN 1 THEN 'Male' ELSE 'Female' END AS "Gender", CASE Discipline_of_Person_Completing_Assessment WHEN 1 THEN 'RN' WHEN 2 THEN 'PT' WHEN 3 THEN 'SLP/ST' WHEN 4 THEN 'OT' END AS "ByDiscipline",
    {', '.join(f'coalesce(c.{chr(34)}{s}{chr(34)}, 0) AS {chr(34)}{s}{chr(34)}' for s in ('I00-I99', 'E00-E89', 'Z00-Z99'))}
    FROM asm a LEFT JOIN counts c USING (Beneficiary_ID)""", "asm chapters")
def job_01(t):
    out = jobs.prepare_assessments(_raw(t))
    return out.select("Assessment_ID", "AssessmentYear", "NumVisits", "DaysBetweenVisits", "Days_Cared_For", "Age", "Gender", "ByDiscipline", "I00-I99", "E00-E89", "Z00-Z99")


@query("job_02", """SELECT 'section=' || code_range AS file_name, count(*) AS num_rows, CAST(24 AS INT) AS num_columns, count(DISTINCT beneficiary_id) AS num_patients FROM
    (SELECT DISTINCT l.beneficiary_id, w.assessment_id, c.code_range FROM (SELECT assessment_id, unnest([""" + ", ".join(CODES) + """]) AS code FROM wide) w JOIN chapters c ON substr(w.code, 1, 3) BETWEEN c.lo AND c.hi
    JOIN assess l ON l.assessment_id = w.assessment_id % """ + str(BLOCK) + ") GROUP BY 1", "wide chapters assess")
def job_02(t):
    flags = D.chapter_counts(t.wide(), "assessment_id", CODES)
    df = t.coded(t.assess().select(F.col("beneficiary_id").alias("Beneficiary_ID"), "assessment_id"), flags).drop("_order")
    return jobs.split_sections(df, scratch_path(t.spark, "sections"), ["Beneficiary_ID", "assessment_id"])


BMI = "coalesce(CAST(ceil(CASE WHEN TRY_CAST(Height_in_inches AS DOUBLE) <> 0 THEN TRY_CAST(Weight_in_pounds AS DOUBLE) / (TRY_CAST(Height_in_inches AS DOUBLE) * TRY_CAST(Height_in_inches AS DOUBLE)) * 704.5::DOUBLE END) AS INT), 0)"
NAMED_SPANS = {n: _spans_sql(s) for n, s in C.CONDITION_CHAPTERS.items()}
for _i, _n in enumerate(C.CODE_COLUMNS):
    NAMED_SPANS = {k: v.replace(f"substr(code_{_i + 1},", f"substr({_n},") for k, v in NAMED_SPANS.items()}
READMIT = "CASE WHEN Resumption_of_Care_Date - Assessment_Effective_Date BETWEEN 0 AND 29 THEN 1 ELSE 0 END"


@query("job_03", f""", r AS (SELECT *, {READMIT} AS readm, {AGE} AS age, max(Assessment_Effective_Date) OVER (PARTITION BY Beneficiary_ID) - Start_of_Care_Date AS cared, {ZIP_SQL.replace('zip', 'Patient_ZIP_Code')} AS z FROM asm)
    SELECT Beneficiary_ID AS "Beneficiary_ID", readm AS "READMISSION", Assessment_ID AS "Assessment_ID", age AS "Age", CAST(cared AS INT) AS "Days_Cared_For", b AS "BMI", {BMI_CLASS} AS "BMI_Category",
    {', '.join(f'{v} AS {k}' for k, v in NAMED_SPANS.items())}, s.ACS_PCT_INC50 AS "ACS_PCT_INC50" FROM
    (SELECT *, {BMI} AS b, row_number() OVER (PARTITION BY Beneficiary_ID, readm ORDER BY Assessment_Effective_Date, Assessment_ID) AS rn FROM r WHERE State_ID = 'S3') x JOIN zip_areas s ON x.z = s.zip5 WHERE rn = 1""", "asm zip_areas")
def job_03(t):
    out = jobs.state_patients(t.assessments(), t.zip_areas(), "S3")
    return out.select("Beneficiary_ID", "READMISSION", "Assessment_ID", "Age", "Days_Cared_For", "BMI", "BMI_Category", *C.CONDITION_CHAPTERS, "ACS_PCT_INC50")


PLONG = f"plong AS (SELECT Beneficiary_ID AS beneficiary_id, {AGE} AS age, code FROM (SELECT *, unnest({NAMED}) AS code FROM asm) WHERE code IS NOT NULL), ages AS (SELECT beneficiary_id, max(age) AS age FROM plong GROUP BY 1)"
NARROW = "SELECT {w} AS weight, beneficiary_id, comorbidity_score FROM ({q})"
SCHEMES = " UNION ALL ".join(NARROW.format(w=f"'{w}'", q=q) for w, q in [
    ("Charlson", _risk_sql("charlson_codes", list(R.CHARLSON_CODES), R.CHARLSON_QUAN_WEIGHTS, R.CHARLSON_BEATEN_BY, "beneficiary_id", "plong")),
    ("Van Walraven", _risk_sql("elix_codes", list(R.ELIXHAUSER_CODES), R.ELIXHAUSER_VW_WEIGHTS, R.ELIXHAUSER_BEATEN_BY, "beneficiary_id", "plong")),
    ("Unit weights", _risk_sql("elix_codes", list(R.ELIXHAUSER_CODES), UNIT_WEIGHTS, R.ELIXHAUSER_BEATEN_BY, "beneficiary_id", "plong"))])


@query("job_04", f""", {PLONG} SELECT s.weight, s.beneficiary_id AS "Beneficiary_ID", s.comorbidity_score, CAST(s.comorbidity_score + least(greatest(floor((a.age - 40) / 10), 0), 4) AS BIGINT) AS age_adj_comorbidity_score,
    coalesce(h.hfrs, 0) AS hfrs, CAST(CASE WHEN h.hfrs IS NULL THEN 0 ELSE d.frail END AS INT) AS frail FROM ({SCHEMES}) s JOIN ages a USING (beneficiary_id)
    LEFT JOIN (SELECT beneficiary_id, sum(coalesce(tenths, 0)) / 10.0::DOUBLE AS hfrs FROM (SELECT DISTINCT beneficiary_id, substr(code, 1, 3) AS c FROM plong WHERE age >= 75) LEFT JOIN hfrs_points ON c = category GROUP BY 1) h USING (beneficiary_id)
    LEFT JOIN ({_risk_sql('disab_codes', list(R.DISABILITY_CODES), None, {}, 'beneficiary_id', 'plong')}) d USING (beneficiary_id)""", "asm diag charlson_codes elix_codes disab_codes hfrs_points")
def job_04(t):
    df = t.assessments().withColumn("Age", S.age_years(F.col(jobs.DAY), F.col("Patient_Birth_Date")))
    out = jobs.risk_scores(df, UNIT_WEIGHTS, second_label="Unit weights")
    return out.select("weight", "Beneficiary_ID", "comorbidity_score", F.col("age_adj_comorbidity_score").cast("bigint").alias("age_adj_comorbidity_score"), "hfrs", "frail")


ALONG = f"along AS (SELECT Beneficiary_ID, {HAD_HOSP} AS h, code FROM (SELECT *, unnest({NAMED}) AS code FROM asm) WHERE code IS NOT NULL)"
TITLE = "coalesce((SELECT section FROM chapters WHERE substr({c}, 1, 3) BETWEEN lo AND hi), 'Unknown')"


@query("job_05", f""", {ALONG}, bc AS (SELECT code, count(DISTINCT Beneficiary_ID) FILTER (WHERE NOT h) AS n_0, count(DISTINCT Beneficiary_ID) FILTER (WHERE h) AS n_1 FROM along GROUP BY 1),
    rr AS (SELECT DISTINCT Assessment_ID, code_range AS label FROM (SELECT Assessment_ID, unnest({NAMED}) AS code FROM asm) JOIN chapters ON substr(code, 1, 3) BETWEEN lo AND hi)
    SELECT 'code' AS kind, code AS name, {TITLE.format(c='code')} AS section, n_0, n_1 FROM bc
    UNION ALL SELECT 'stem', split_part(code, '.', 1), any_value({TITLE.format(c='code')}), count(*) FILTER (WHERE NOT h), count(*) FILTER (WHERE h) FROM along GROUP BY 2
    UNION ALL SELECT 'section', s, s, count(*), 0 FROM (SELECT {TITLE.format(c='code')} AS s FROM bc) GROUP BY 2, 3
    UNION ALL SELECT 'edge', x.label, y.label, count(*), 0 FROM rr x JOIN rr y ON x.Assessment_ID = y.Assessment_ID AND x.label < y.label GROUP BY 2, 3 HAVING count(*) >= 2""", "asm chapters")
def job_05(t):
    df = t.assessments().withColumn("readmitted", P.any_filled(["Hospital_Reason_Injury"]).cast("int"))
    out = jobs.section_analysis(df, "readmitted")
    zero = F.lit(0).cast("bigint")
    return RS.stack(
        out["by_code"].select(F.lit("code").alias("kind"), F.col("code").alias("name"), "section", "n_0", "n_1"),
        out["by_stem"].select(F.lit("stem").alias("kind"), F.col("stem").alias("name"), "section", F.col("rows_0").alias("n_0"), F.col("rows_1").alias("n_1")),
        out["by_section"].select(F.lit("section").alias("kind"), F.col("section").alias("name"), "section", F.col("n_codes").alias("n_0"), zero.alias("n_1")),
        out["edges"].select(F.lit("edge").alias("kind"), F.col("a").alias("name"), F.col("b").alias("section"), F.col("weight").alias("n_0"), zero.alias("n_1")))


def _county_patients(t):
    a = t.assessments()
    p = t.patient().select(F.col("beneficiary_id").alias("Beneficiary_ID"), "county_key").join(t.county_sdoh(), "county_key")
    last = a.groupBy("Beneficiary_ID").agg(F.max(jobs.DAY).alias("_last"))
    full = D.condition_flags(a, C.CODE_COLUMNS).join(last, "Beneficiary_ID").withColumns({
        "READMISSION": S.readmitted(F.col("Resumption_of_Care_Date"), F.col(jobs.DAY)), "Age": S.age_years(F.col(jobs.DAY), F.col("Patient_Birth_Date")),
        "Days_Cared_For": F.datediff("_last", jobs.SOC), "Gender": S.decode(F.col("Gender"), C.GENDER),
        "ByDiscipline": S.decode(F.col("Discipline_of_Person_Completing_Assessment"), C.DISCIPLINE),
        "BMI_Category": S.bmi_category(S.bmi_ceil(F.col("Weight_in_pounds").try_cast("double"), F.col("Height_in_inches").try_cast("double")))})
    return full.join(p, "Beneficiary_ID")


@query("job_06", f""", cp AS (SELECT a.*, {READMIT} AS readm, {AGE} AS age, max(Assessment_Effective_Date) OVER (PARTITION BY a.Beneficiary_ID) - Start_of_Care_Date AS cared, s.county, s.POPPCT_URB, s.ACS_PCT_INC50,
    {NAMED_SPANS['is_diabetes']} AS dia FROM asm a JOIN patient p ON a.Beneficiary_ID = p.beneficiary_id JOIN county_sdoh s ON p.county_key = s.county_key),
    areas AS (SELECT county, avg(ACS_PCT_INC50) AS x FROM cp GROUP BY 1)
    SELECT county, count(DISTINCT Beneficiary_ID) AS n_patients, {q6('avg(age)', 'mean_age')}, {q6('avg(cared)', 'mean_days_cared_for')}, count(*) FILTER (WHERE dia = 1) AS n_diabetes,
    count(*) FILTER (WHERE readm = 1) AS n_readmitted, count(*) FILTER (WHERE Gender = 2) AS n_female, {q6('abs(any_value(a.x) - (SELECT avg(x) FROM areas))', 'poverty_index')} FROM cp JOIN areas a USING (county) GROUP BY 1""", "asm patient county_sdoh")
def job_06(t):
    rollup, disparity = jobs.county_tables(_county_patients(t), ["county"])
    poverty = disparity.filter(F.col("indicator") == "ACS_PCT_INC50").select("county", r6(F.col("absolute"), "poverty_index"))
    return rollup.join(poverty, "county").select("county", "n_patients", r6(F.col("mean_age"), "mean_age"), r6(F.col("mean_days_cared_for"), "mean_days_cared_for"), "n_diabetes", "n_readmitted",
                                                 F.coalesce(F.col("Gender_counts")["Female"], F.lit(0)).alias("n_female"), "poverty_index")


EPISODE = "CAST(Beneficiary_ID AS VARCHAR) || '_' || CAST(Start_of_Care_Date AS VARCHAR)"
ELONG = f"elong AS (SELECT DISTINCT episode, code FROM (SELECT {EPISODE} AS episode, unnest({NAMED}) AS code FROM merged) WHERE code IS NOT NULL)"


@query("job_07", f""", merged AS (SELECT a.*, s.ACS_PCT_INC50 FROM (SELECT *, {ZIP_SQL.replace('zip', 'Patient_ZIP_Code')} AS z FROM asm) a JOIN zip_areas s ON a.z = s.zip5), {ELONG}
    SELECT Assessment_ID AS "Assessment_ID", {EPISODE} AS "Episode_ID", coalesce(c.comorbidity_score, 0) AS comorbidity_score_charlson, coalesce(e.comorbidity_score, 0) AS comorbidity_score_elixhauser, coalesce(h.hfrs, 0) AS hfrs, ACS_PCT_INC50 AS "ACS_PCT_INC50" FROM merged m
    LEFT JOIN ({_risk_sql('charlson_codes', list(R.CHARLSON_CODES), R.CHARLSON_QUAN_WEIGHTS, R.CHARLSON_BEATEN_BY, 'episode', 'elong')}) c ON {EPISODE} = c.episode
    LEFT JOIN ({_risk_sql('elix_codes', list(R.ELIXHAUSER_CODES), R.ELIXHAUSER_VW_WEIGHTS, R.ELIXHAUSER_BEATEN_BY, 'episode', 'elong')}) e ON {EPISODE} = e.episode
    LEFT JOIN (SELECT episode, sum(coalesce(tenths, 0)) / 10.0::DOUBLE AS hfrs FROM (SELECT DISTINCT episode, substr(code, 1, 3) AS c FROM elong) LEFT JOIN hfrs_points ON c = category GROUP BY 1) h ON {EPISODE} = h.episode""",
       "asm zip_areas diag charlson_codes elix_codes hfrs_points")
def job_07(t):
    out = jobs.national_dataset(t.assessments(), t.zip_areas())
    return out.select("Assessment_ID", "Episode_ID", "comorbidity_score_charlson", "comorbidity_score_elixhauser", "hfrs", "ACS_PCT_INC50")


@query("job_08", f"""SELECT Beneficiary_ID AS "Beneficiary_ID", CAST(Assessment_Effective_Date AS VARCHAR) AS "Assessment_Effective_Date", {OUTCOME} AS outcome, CAST(29 AS INT) AS n_columns FROM asm""", "asm")
def job_08(t):
    out = jobs.surface_clean(t.assessments())
    return out.select("Beneficiary_ID", F.col(jobs.DAY).cast("string").alias(jobs.DAY), "outcome", F.lit(len(out.columns)).alias("n_columns"))


SINCE = "1997-01-01"
BMI703 = "CASE WHEN b BETWEEN 5 AND 250 THEN round(b, 6) END"
BMI_RAW = "TRY_CAST(nullif({w}, '-') AS DOUBLE) * 703 / (TRY_CAST(nullif({h}, '-') AS DOUBLE) * TRY_CAST(nullif({h}, '-') AS DOUBLE))"
HEAR = "CASE WHEN {c} NOT IN ('UK', '-', '88', '9') THEN TRY_CAST({c} AS DOUBLE) END"
DX_HYP = "CAST(" + " OR ".join(f"coalesce(starts_with({c}, '{p}'), FALSE)" for c in C.CODE_COLUMNS for p in C.DX_PREFIXES["dx_hypertension"]) + " AS INT)"


@query("job_09", f""", ep AS (SELECT *, max(CAST({HAD_HOSP} AS INT)) OVER e AS target, max(CAST({HAD_ED} AS INT)) OVER e AS any_ed, row_number() OVER (PARTITION BY Beneficiary_ID, Start_of_Care_Date
      ORDER BY CAST(Patient_Overall_Status IS NULL AS INT), Assessment_Effective_Date, Assessment_ID) AS rn FROM asm WINDOW e AS (PARTITION BY Beneficiary_ID, Start_of_Care_Date))
    SELECT CAST(month(Assessment_Effective_Date) AS INT) AS "Assessment_Month", {DX_HYP} AS dx_hypertension, CASE WHEN b BETWEEN 5 AND 250 THEN round(b, 6) END AS "BMI", {HEAR.format(c='Ability_To_Hear')} AS "Ability_To_Hear", target
    FROM (SELECT *, {BMI_RAW.format(w='Weight_in_pounds', h='Height_in_inches')} AS b FROM ep) WHERE rn = 1 AND Patient_Overall_Status IS NOT NULL AND (target = 1 OR any_ed = 0) AND Start_of_Care_Date >= DATE '{SINCE}'""", "asm")
def job_09(t):
    out = jobs.task1_cohort(t.assessments(), SINCE)
    return out.select("Assessment_Month", "dx_hypertension", F.round("BMI", 6).alias("BMI"), "Ability_To_Hear", "target")


FIRST = "arg_min({c}, Assessment_Effective_Date::VARCHAR || lpad(Assessment_ID::VARCHAR, 12, '0'))"


@query("job_10", f""", ed AS (SELECT *, CAST({HAD_HOSP} AS INT) AS t0 FROM asm WHERE {HAD_ED}), f AS (SELECT Beneficiary_ID, Start_of_Care_Date, min(Assessment_Effective_Date) AS d, {FIRST.format(c='t0')} AS target,
      {FIRST.format(c='Height_in_inches')} AS h, {FIRST.format(c='Weight_in_pounds')} AS w, {FIRST.format(c='Ability_To_Hear')} AS a, {', '.join(f'{FIRST.format(c=c)} AS {c}' for c in C.CODE_COLUMNS)} FROM ed GROUP BY 1, 2)
    SELECT CAST(month(d) AS INT) AS "Assessment_Month", {DX_HYP} AS dx_hypertension, CASE WHEN b BETWEEN 5 AND 250 THEN round(b, 6) END AS "BMI", {HEAR.format(c='a')} AS "Ability_To_Hear", target
    FROM (SELECT *, {BMI_RAW.format(w='w', h='h')} AS b FROM f) WHERE Start_of_Care_Date >= DATE '{SINCE}'""", "asm")
def job_10(t):
    out = jobs.task2_cohort(t.assessments(), SINCE)
    return out.select("Assessment_Month", "dx_hypertension", F.round("BMI", 6).alias("BMI"), "Ability_To_Hear", "target")


@query("job_11")
def job_11(t):
    space = {"n_estimators": (3, 5, "int"), "learning_rate": (0.1, 0.3, "log")}
    return jobs.train_report(t.matrix(), "target", "row_key", space, trials=3, folds=3, params={"max_depth": 3})


@query("job_12", """SELECT 'rows' AS part, CAST(m AS VARCHAR) AS name, count(*) AS n FROM (SELECT """ + " + ".join(f"CAST({c} IS NULL{' OR ' + c + f' = {chr(39)*2}' if c.endswith('_ICD_10_C_M') else ''} AS INT)" for c in C.CODE_COLUMNS[1:] + ["Sparse_Item", "Wound_Count", "Resumption_of_Care_Date"]) +
       """ AS m FROM asm) GROUP BY 2 UNION ALL """ + " UNION ALL ".join(f"SELECT 'columns', '{c}', count(*) FILTER (WHERE {c} IS NULL) FROM asm" for c in C.CODE_COLUMNS[1:] + ["Sparse_Item", "Wound_Count", "Resumption_of_Care_Date"]), "asm")
def job_12(t):
    cols = C.CODE_COLUMNS[1:] + ["Sparse_Item", "Wound_Count", "Resumption_of_Care_Date"]
    df = t.assessments().select(jobs.ID, *cols)
    out = jobs.missingness_report(df, age="Sparse_Item")
    return RS.stack(out["columns"].filter(F.col("column") != jobs.ID).select(F.lit("columns").alias("part"), F.col("column").alias("name"), F.col("n_missing").alias("n")),
                    out["rows"].select(F.lit("rows").alias("part"), F.col("num_missing").cast("string").alias("name"), "n"))


# -- patient table: scores, gaps, encoding, reduction -------------------------------------------------
FLAGS = C.RACE_COLUMNS
LABELS = ["Facility_Internal_ID", "Assessment_Effective_Year", "Assessment_Effective_Month", *FLAGS]
CODED = ["Submitted_HIPPS_Code", C.CODE_COLUMNS[0]]
RAW_CODE = {CODED[0]: "CASE WHEN f.Beneficiary_ID % 10 <> 0 AND Assessment_ID % 3 <> 0 THEN Submitted_HIPPS_Code END",
            CODED[1]: f"CASE WHEN Assessment_ID % 7 <> 0 THEN {CODED[1]} END"}
READMITTED = "CAST(coalesce(Resumption_of_Care_Date - Assessment_Effective_Date BETWEEN 0 AND 29, FALSE) AS INT)"
GENDER_TEXT = "CASE Gender WHEN 1 THEN 'Male' ELSE 'Female' END"
RACE_BEST = "CASE " + " ".join(f"WHEN p{i} = greatest({', '.join(f'p{j}' for j in range(6))}) THEN {i}" for i in range(6)) + " END"


def _patient_mode(keys: str, c: str) -> str:
    return f"(SELECT {keys}, {c} AS m FROM (SELECT {keys}, {c}, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {c}) AS rn FROM src WHERE {c} IS NOT NULL GROUP BY {keys}, {c}) WHERE rn = 1)"


def _label_rows(cols: list[str]) -> str:
    """(position, column, order, value) of every label column; numbers are ordered as numbers."""
    rows = [f"{{'p': {i}, 'c': '{c}', 'k': {c if c in LABELS else 'NULL'}::BIGINT, 'v': CAST({c} AS VARCHAR)}}" for i, c in enumerate(cols)]
    return f"[{', '.join(rows)}]"


IDS = "Beneficiary_ID, READMISSION"
JOB_13 = f""", first_rows AS (SELECT *, {READMITTED} AS READMISSION, row_number() OVER (PARTITION BY Beneficiary_ID, {READMITTED} ORDER BY Assessment_Effective_Date, Assessment_ID) AS rn FROM asm),
    src AS (SELECT *, {AGE_SQL.replace('age', '"Age"')} AS grp FROM (SELECT f.Beneficiary_ID, READMISSION, Facility_Internal_ID, year(Assessment_Effective_Date) AS Assessment_Effective_Year,
        month(Assessment_Effective_Date) AS Assessment_Effective_Month, {AGE} AS "Age", {GENDER_TEXT} AS Gender, p.county_key, p.balance AS Balance, f.Wound_Items AS Wound_Items, {', '.join(FLAGS)},
        {', '.join(f'{RAW_CODE[c]} AS {c}' for c in CODED)}, s.comorbidity_score AS score_charlson
        FROM (SELECT *, coalesce(Wound_Count, 0) AS Wound_Items FROM first_rows WHERE rn = 1) f JOIN patient p ON f.Beneficiary_ID = p.beneficiary_id JOIN ({{charlson}}) s ON f.Beneficiary_ID = s.beneficiary_id)),
    county AS (SELECT county_key, {', '.join(f'avg({r}) AS c{i}' for i, r in enumerate(FLAGS))} FROM src GROUP BY 1),
    aged AS (SELECT grp, Gender, {', '.join(f'avg({r}) AS g{i}' for i, r in enumerate(FLAGS))} FROM src WHERE grp IS NOT NULL GROUP BY 1, 2),
    priors AS (SELECT src.*, {', '.join(f'c{i} * g{i} AS p{i}' for i in range(6))} FROM src LEFT JOIN county USING (county_key) LEFT JOIN aged ON src.grp = aged.grp AND src.Gender = aged.Gender),
    raced AS (SELECT * EXCLUDE ({', '.join(FLAGS)}), {', '.join(f'CAST(CASE WHEN ({" OR ".join(f"{x} IS NULL" for x in FLAGS)}) AND {RACE_BEST} IS NOT NULL THEN CAST({RACE_BEST} = {i} AS INT) ELSE {r} END AS INT) AS {r}' for i, r in enumerate(FLAGS))} FROM priors),
    filled AS (SELECT r.* EXCLUDE ({', '.join(CODED)}), {', '.join(f"coalesce(r.{c}, own{i}.m, grp{i}.m, 'UNKNOWN') AS {c}" for i, c in enumerate(CODED))} FROM raced r
        {' '.join(f"LEFT JOIN {_patient_mode('Beneficiary_ID', c)} own{i} ON r.Beneficiary_ID = own{i}.Beneficiary_ID LEFT JOIN {_patient_mode('grp, Gender', c)} grp{i} ON r.grp = grp{i}.grp AND r.Gender = grp{i}.Gender" for i, c in enumerate(CODED))}),
    whole AS (SELECT * FROM filled WHERE {' AND '.join(f'{c} IS NOT NULL' for c in ['"Age"', 'Gender', 'county_key', 'Balance', 'score_charlson', *FLAGS])}),
    labels AS (SELECT {IDS}, x.p AS p, x.c AS c, x.k AS k, x.v AS v FROM (SELECT {IDS}, unnest({_label_rows(['Gender', *CODED, *LABELS])}) AS x FROM whole)),
    books AS (SELECT p, c, v, row_number() OVER (PARTITION BY c ORDER BY k, v) AS o, count(*) OVER (PARTITION BY c) AS n FROM (SELECT DISTINCT p, c, k, v FROM labels)),
    encoded AS (SELECT {IDS}, 0 AS kind, x.p AS p, 0 AS o, x.f AS feature, x.v AS value FROM (SELECT {IDS}, unnest([{', '.join(f"{{'p': {i}, 'f': '{c}', 'v': {c}::DOUBLE}}" for i, c in enumerate(['Age', 'county_key', 'Balance', 'Wound_Items', 'score_charlson']))}]) AS x FROM whole)
        UNION ALL SELECT {IDS}, 1, p, b, c || '_' || b, CAST((o >> (w - 1 - b)) & 1 AS DOUBLE) FROM (SELECT l.{IDS.replace(', ', ', l.')}, l.p, l.c, o, w, unnest(range(w)) AS b FROM labels l JOIN (SELECT *, CAST(floor(log2(n)) + 1 AS BIGINT) AS w FROM books WHERE n > 55) k ON l.c = k.c AND l.v = k.v)
        UNION ALL SELECT l.{IDS.replace(', ', ', l.')}, 2, l.p, o, l.c || '_' || l.v, 1.0 FROM labels l JOIN books k ON l.c = k.c AND l.v = k.v WHERE n <= 55),
    sums AS (SELECT kind, p, o, feature, sum(value) AS s, sum(value * value) AS q, (SELECT count(*) FROM whole) AS n FROM encoded GROUP BY 1, 2, 3, 4),
    products AS (SELECT a.feature AS i, b.feature AS j, sum(a.value * b.value) AS xy FROM encoded a JOIN encoded b USING ({IDS}) GROUP BY 1, 2),
    gone AS (SELECT DISTINCT y.feature FROM sums x JOIN sums y ON (x.kind, x.p, x.o) < (y.kind, y.p, y.o) LEFT JOIN products ON i = x.feature AND j = y.feature
        WHERE x.n * x.q - x.s * x.s > 1e-6 AND y.n * y.q - y.s * y.s > 1e-6
        AND abs(x.n * coalesce(xy, 0) - x.s * y.s) > 0.7 * sqrt(x.n * x.q - x.s * x.s) * sqrt(y.n * y.q - y.s * y.s))
    SELECT Beneficiary_ID, READMISSION, feature, {q6('value', 'value')} FROM encoded WHERE value <> 0 AND feature NOT IN (SELECT feature FROM gone)"""


@query("job_13", JOB_13.replace("{charlson}", CHARLSON), "asm patient long charlson_codes")
def job_13(t):
    """The reduced patient matrix, one row per patient, readmission flag and feature that is not zero."""
    a = t.assessments()
    flag = S.readmitted(F.col("Resumption_of_Care_Date"), F.col(jobs.DAY)).alias("READMISSION")
    one = V.one_per_key(a.select("*", flag), [jobs.ID, "READMISSION"], [jobs.DAY, jobs.ROW])
    areas = t.patient().select(F.col("beneficiary_id").alias(jobs.ID), "county_key", F.col("balance").alias("Balance"))
    df = one.join(areas, jobs.ID).select(
        jobs.ID, "READMISSION", "Facility_Internal_ID", jobs.DAY, S.age_years(F.col(jobs.DAY), F.col("Patient_Birth_Date")).alias("Age"),
        S.decode(F.col("Gender"), C.GENDER).alias("Gender"), "county_key", "Balance", F.coalesce("Wound_Count", F.lit(0)).alias("Wound_Items"), *FLAGS,
        F.when((F.col(jobs.ID) % 10 != 0) & (F.col(jobs.ROW) % 3 != 0), F.col(CODED[0])).alias(CODED[0]),
        F.when(F.col(jobs.ROW) % 7 != 0, F.col(CODED[1])).alias(CODED[1]))
    codes = t.long().select(F.col("beneficiary_id").alias(jobs.ID), "code")
    scores = RK.comorbidity(codes, jobs.ID, "code", "charlson").select(jobs.ID, F.col("comorbidity_score").alias("score_charlson"))
    whole = jobs.complete_patients(df, scores, FLAGS, CODED, "county_key")
    keep = [jobs.ID, "READMISSION"]
    out = jobs.encode_patients(whole, keep, labels=LABELS)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), r6(F.col(f"`{c}`"), "value")) for c in out.columns if c not in keep])
    return out.select(*keep, F.inline(cells)).filter("value <> 0")


@query("job_13_text")
def job_13_text(t):
    """Encoding and reduction of a table as it stands, text columns only."""
    p = t.patient()
    df = p.select("beneficiary_id", "zip", "segment", "balance", (F.col("balance") * 3.0).alias("balance_copy"), "gender_code", F.col("county_key").cast("string").alias("county"))
    return jobs.encode_patients(df, ["beneficiary_id"], limit=10)
