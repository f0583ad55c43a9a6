"""Diagnosis features, outcomes, disparity, risk scores, graph and classifier evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from carefold.functions import codes as K
from carefold.functions import constants as C
from carefold.functions import risk_tables as R
from carefold.functions import scalars as S
from carefold.operators import aggregates as AG
from carefold.operators import cohort as CO
from carefold.operators import columns as P
from carefold.operators import diagnosis as D
from carefold.operators import disparity as DS
from carefold.operators import graph as G
from carefold.operators import metrics as M
from carefold.operators import reshape as RS
from carefold.operators import risk as RK
from carefold.plans.domain import BLOCK, CODES, q6, r6
from carefold.plans.queries_columns import dx_sql
from carefold.plans.queries_relational import CODE_LIST, PATIENT_SETS, ROW_RANGES, _chapter_sets, _patient_codes
from carefold.plans.registry import query

# -- domain features ----------------------------------------------------------------------------


@query("dom_01", "SELECT d.assessment_id, d.line_no, d.code, c.code_range, c.section FROM diag d LEFT JOIN chapters c ON substr(d.code, 1, 3) BETWEEN c.lo AND c.hi", "diag chapters")
def dom_01(t):
    c = F.col("code")
    return t.diag().select("assessment_id", "line_no", "code", K.icd_range(c).alias("code_range"), K.icd_title(c).alias("section"))


@query("dom_02", f"""SELECT w.assessment_id, coalesce(x.r, 'Unknown') AS icd_range_text, coalesce(x.s, 'Unknown') AS icd_title_text FROM wide w LEFT JOIN
    (SELECT assessment_id, array_to_string(list_sort(list_distinct(array_agg(code_range))), ', ') AS r, array_to_string(list_sort(list_distinct(array_agg(section))), ', ') AS s
     FROM (SELECT assessment_id, unnest({CODE_LIST}) AS code FROM wide) JOIN chapters ON substr(code, 1, 3) BETWEEN lo AND hi GROUP BY 1) x USING (assessment_id)""", "wide chapters")
def dom_02(t):
    return D.row_chapters(t.wide(), CODES).select("assessment_id", "icd_range_text", "icd_title_text")


@query("dom_03", f""", {PATIENT_SETS} SELECT a.beneficiary_id, """ + ", ".join(f"count(*) FILTER (WHERE contains(s, '{span}')) AS \"{span}\"" for span, _ in C.ICD_CHAPTERS)
       + " FROM (SELECT DISTINCT beneficiary_id FROM assess a JOIN wide w ON a.assessment_id = w.assessment_id % " + str(BLOCK) + ") a LEFT JOIN psets USING (beneficiary_id) GROUP BY 1", "wide assess chapters")
def dom_03(t):
    return D.chapter_counts(_patient_codes(t), "beneficiary_id", CODES)


def _spans_sql(spans, how="prefix"):
    if how == "prefix":
        tests = [f"coalesce(substr({c}, 1, 3) BETWEEN '{s[:3]}' AND '{s[4:]}', FALSE)" for c in CODES for s in spans]
    else:
        tests = [f"coalesce(substr({c}, 1, 1) = '{s[0]}' AND TRY_CAST(regexp_replace(substr({c}, 2), '[^0-9]', '', 'g') AS BIGINT) BETWEEN {int(s[1:3])} AND {int(s[5:])}, FALSE)"
                 for c in CODES for s in spans]
    return f"CAST({' OR '.join(tests)} AS INT)"


@query("dom_04", "SELECT assessment_id, " + ", ".join(f"{_spans_sql(spans)} AS {n}" for n, spans in C.CONDITION_CHAPTERS.items()) + ", "
       + ", ".join(f"{dx_sql(p)} AS {n}_clinical" for n, p in C.CONDITION_PREFIXES.items()) + ", "
       + f"{_spans_sql(C.CONDITION_CHAPTERS['is_diabetes'], 'digits')} AS is_diabetes_compat FROM wide", "wide")
def dom_04(t):
    w = D.condition_flags(t.wide(), CODES)
    clinical = D.condition_flags(w, CODES, clinical=True).select("assessment_id", *[F.col(n).alias(f"{n}_clinical") for n in C.CONDITION_PREFIXES])
    compat = D.condition_flags(t.wide(), CODES, compat=True).select("assessment_id", F.col("is_diabetes").alias("is_diabetes_compat"))
    return w.drop(*CODES).join(clinical, "assessment_id").join(compat, "assessment_id")


@query("dom_05", "SELECT assessment_id, " + ", ".join(f"{dx_sql(p)} AS {n}" for n, p in C.DX_PREFIXES.items()) + " FROM wide", "wide")
def dom_05(t):
    return D.dx_flags(t.wide(), CODES).drop(*CODES)


ED, HOSP = ["Emergent_Care_Reason_Fall", "Emergent_Care_Reason_Other"], ["Hospital_Reason_Injury"]
HAD_ED = "(coalesce(Emergent_Care_Reason_Fall <> 0, FALSE) OR coalesce(CAST(Emergent_Care_Reason_Other AS INT) <> 0, FALSE))"
HAD_HOSP = "coalesce(Hospital_Reason_Injury <> 0, FALSE)"
OUTCOME = f"CASE WHEN {HAD_HOSP} THEN 'Hospitalized' WHEN {HAD_ED} THEN 'ED Only' ELSE 'Stable' END"


@query("dom_06", f"SELECT assessment_id, {OUTCOME} AS outcome FROM flags", "flags")
def dom_06(t):
    return t.flags().select("assessment_id", CO.outcome_class(ED, HOSP).alias("outcome"))


@query("dom_07", f"SELECT assessment_id, CAST({HAD_HOSP} AS INT) AS target FROM flags WHERE {HAD_ED}", "flags")
def dom_07(t):
    return CO.ed_target(t.flags(), ED, HOSP).select("assessment_id", "target")


def _episodes(t):
    """Episode = patient and year; rows without a status are the uncoded ones."""
    return t.flags().withColumn("episode_year", F.year("visit_date"))


@query("dom_08", f"""SELECT beneficiary_id, episode_year, assessment_id, amount, target FROM (
    SELECT *, row_number() OVER (PARTITION BY beneficiary_id, episode_year ORDER BY (CASE WHEN status <> 'P' THEN 0 ELSE 1 END), visit_date, assessment_id) AS rn,
    max(CAST({HAD_HOSP} AS INT)) OVER (PARTITION BY beneficiary_id, episode_year) AS target FROM (SELECT *, CAST(year(visit_date) AS INT) AS episode_year FROM flags))
    WHERE rn = 1 AND status <> 'P'""", "flags")
def dom_08(t):
    out = CO.episode_label(_episodes(t), ["beneficiary_id", "episode_year"], F.col("status") != "P", P.any_filled(HOSP), ["visit_date", "assessment_id"])
    return out.select("beneficiary_id", "episode_year", "assessment_id", "amount", "target")


@query("dom_09", """SELECT beneficiary_id, CAST(year(visit_date) AS INT) AS episode_year, CAST(min(visit_date) AS VARCHAR) AS visit_date,
    arg_min(Emergent_Care_Reason_Fall, visit_date::VARCHAR || lpad(assessment_id::VARCHAR, 12, '0')) AS Emergent_Care_Reason_Fall,
    arg_min(Hospital_Reason_Injury, visit_date::VARCHAR || lpad(assessment_id::VARCHAR, 12, '0')) AS Hospital_Reason_Injury FROM flags GROUP BY 1, 2""", "flags")
def dom_09(t):
    out = CO.episode_first(_episodes(t), ["beneficiary_id", "episode_year"], ["visit_date", "assessment_id"], ["Emergent_Care_Reason_Fall", "Hospital_Reason_Injury"])
    return out.drop("assessment_id").withColumn("visit_date", F.col("visit_date").cast("string"))


@query("dom_10", "SELECT assessment_id, coalesce(Emergent_Care_Reason_Fall, 0) AS Emergent_Care_Reason_Fall, Hospital_Reason_Injury FROM flags", "flags")
def dom_10(t):
    return CO.fill_absent(t.flags().select("assessment_id", "Emergent_Care_Reason_Fall", "Hospital_Reason_Injury"), ["Emergent_Care_Reason_Fall"])


@query("dom_11", "SELECT assessment_id, CAST(month(visit_date) AS INT) AS Assessment_Month FROM assess", "assess")
def dom_11(t):
    return CO.month_and_drop(t.assess().select("assessment_id", "visit_date"), "visit_date", ["visit_date", "AssessmentYear"])


# -- disparity ----------------------------------------------------------------------------------
IND = "ACS_PCT_HS_GRADUATE"
AID = f"abs({IND} - (SELECT avg({IND}) FROM county_sdoh))"


@query("dsp_01", f"SELECT county, {q6(AID, 'absolute')} FROM county_sdoh", "county_sdoh")
def dsp_01(t):
    return DS.absolute_index(t.county_sdoh(), IND).select("county", r6(F.col("absolute"), "absolute"))


@query("dsp_02", f"SELECT county, {q6(f'{AID} / (SELECT avg({IND}) FROM county_sdoh)', 'relative')} FROM county_sdoh", "county_sdoh")
def dsp_02(t):
    return DS.relative_index(t.county_sdoh(), IND).select("county", r6(F.col("relative"), "relative"))


@query("dsp_03", f"SELECT county, {q6(f'{AID} * (POPPCT_URB + POPPCT_RUR) / (SELECT sum(POPPCT_URB + POPPCT_RUR) FROM county_sdoh)', 'weighted')} FROM county_sdoh", "county_sdoh")
def dsp_03(t):
    return DS.population_weighted_index(t.county_sdoh(), IND, "POPPCT_URB", "POPPCT_RUR").select("county", r6(F.col("weighted"), "weighted"))


@query("dsp_04", f"""SELECT county, {q6('CASE WHEN tot = 0 THEN 0 ELSE u / tot END', 'pap_urban')}, {q6('CASE WHEN tot = 0 THEN 0 ELSE r / tot END', 'pap_rural')}
    FROM (SELECT county, {AID} * POPPCT_URB AS u, {AID} * POPPCT_RUR AS r, {AID} * POPPCT_URB + {AID} * POPPCT_RUR AS tot FROM county_sdoh)""", "county_sdoh")
def dsp_04(t):
    out = DS.attributable_share(t.county_sdoh(), IND, "POPPCT_URB", "POPPCT_RUR")
    return out.select("county", r6(F.col("pap_urban"), "pap_urban"), r6(F.col("pap_rural"), "pap_rural"))


SDOH_COLS = ["ACS_PCT_HS_GRADUATE", "ACS_PCT_POSTHS_ED", "ACS_PCT_HH_LIMIT_ENGLISH", "ACS_PCT_HH_BROADBAND", "ACS_PCT_HH_1PERS", "ACS_PCT_INC50"]
DISP = f"""disp AS (SELECT l.county, tp.topic, l.indicator, aid AS absolute, CASE WHEN m = 0 THEN 0 ELSE aid / m END AS relative, aid * (u + r) / w AS weighted,
    CASE WHEN aid * u + aid * r = 0 THEN 0 ELSE aid * u / (aid * u + aid * r) END AS pap_urban, CASE WHEN aid * u + aid * r = 0 THEN 0 ELSE aid * r / (aid * u + aid * r) END AS pap_rural
    FROM (SELECT county, indicator, u, r, w, abs(x - avg(x) OVER (PARTITION BY indicator)) AS aid, avg(x) OVER (PARTITION BY indicator) AS m FROM
    ({' UNION ALL '.join(f"SELECT county, '{c}' AS indicator, {c} AS x, POPPCT_URB AS u, POPPCT_RUR AS r, (SELECT sum(POPPCT_URB + POPPCT_RUR) FROM county_sdoh) AS w FROM county_sdoh" for c in SDOH_COLS)})) l
    JOIN topics tp ON tp.indicator = l.indicator)"""
MEASURES = ["absolute", "relative", "weighted", "pap_urban", "pap_rural"]


def _disp(t):
    return DS.disparity_table(t.county_sdoh(), C.TOPICS)


@query("dsp_05", f", {DISP} SELECT county, topic, replace(replace(replace(indicator, 'ACS_PCT', '%'), 'ACS_TOT', 'TOTAL'), '_', ' ') AS indicator, {', '.join(q6(m, m) for m in MEASURES)} FROM disp", "county_sdoh topics")
def dsp_05(t):
    return _disp(t).select("county", "topic", S.pretty_indicator(F.col("indicator")).alias("indicator"), *[r6(F.col(m), m) for m in MEASURES])


@query("dsp_06", f", {DISP} SELECT indicator, {', '.join(q6(m, m) for m in MEASURES[:3])} FROM disp WHERE county = 'NATION_7' AND topic = 'Attainment'", "county_sdoh topics")
def dsp_06(t):
    return DS.disparity_slice(_disp(t), "NATION_7", "Attainment").select("indicator", *[r6(F.col(m), m) for m in MEASURES[:3]])


@query("dsp_07", f", {DISP} SELECT indicator, {', '.join(q6(f'coalesce({m}, 0)', m) for m in MEASURES[:3])} FROM disp WHERE county = 'NATION_4' AND topic = 'Attainment'", "county_sdoh topics")
def dsp_07(t):
    return DS.disparity_pivot(_disp(t), "NATION_4", "Attainment").select("indicator", *[r6(F.col(m), m) for m in MEASURES[:3]])


@query("ag_13", f""", {DISP} SELECT d.county, CASE WHEN c.POPPCT_RUR >= c.POPPCT_URB THEN 'Rural' ELSE 'Urban' END AS class,
    {q6("coalesce(max(absolute) FILTER (WHERE indicator = 'ACS_PCT_HS_GRADUATE'), 0)", 'ACS_PCT_HS_GRADUATE')}, {q6("coalesce(max(absolute) FILTER (WHERE indicator = 'ACS_PCT_POSTHS_ED'), 0)", 'ACS_PCT_POSTHS_ED')}
    FROM disp d JOIN county_sdoh c ON d.county = c.county WHERE topic = 'Attainment' GROUP BY 1, 2""", "county_sdoh topics")
def ag_13(t):
    levels = ["ACS_PCT_HS_GRADUATE", "ACS_PCT_POSTHS_ED"]
    part = _disp(t).filter(F.col("topic") == "Attainment")
    grid = AG.pivot_first(part, "county", "indicator", levels, "absolute", fill=0.0)
    cls = t.county_sdoh().select("county", S.urban_rural(F.col("POPPCT_URB"), F.col("POPPCT_RUR")).alias("class"))
    return grid.join(cls, "county").select("county", "class", *[r6(F.col(c), c) for c in levels])


# -- county roll-ups ----------------------------------------------------------------------------
def _dashboard(t):
    """Patient visits with county attributes, condition flags, BMI class and chapters."""
    k = F.col("_order")
    w = D.condition_flags(t.wide(), CODES).withColumn("icd_ranges", K.chapter_set([F.col(c) for c in CODES]))
    v = t.coded(t.visit(), w)
    n = t("nation").select(F.col("n_nationkey").alias("county_key"), F.upper("n_name").alias("county"))
    s = t.sdoh().select("county_key", "POPPCT_URB", "POPPCT_RUR")
    return (v.join(n, "county_key").join(s, "county_key", "left")
            .withColumn("gender", S.decode(F.col("gender_code"), C.GENDER))
            .withColumn("discipline", S.decode(F.col("discipline_code"), C.DISCIPLINE))
            .withColumn("bmi_category", S.bmi_category((k % 30 + 15).cast("int")))
            .withColumn("ever_readmitted", (F.col("status") == "P").cast("int")))


DASH = f"""dash AS (SELECT v.*, upper(n.n_name) AS county, s.POPPCT_URB, s.POPPCT_RUR, CASE gender_code WHEN 1 THEN 'Male' ELSE 'Female' END AS gender,
    CASE discipline_code WHEN 1 THEN 'RN' WHEN 2 THEN 'PT' WHEN 3 THEN 'SLP/ST' WHEN 4 THEN 'OT' END AS discipline,
    {{bmi}} AS bmi_category, CAST(v.status = 'P' AS INT) AS ever_readmitted, {_spans_sql(C.CONDITION_CHAPTERS['is_diabetes'])} AS is_diabetes,
    {_spans_sql(C.CONDITION_CHAPTERS['is_heart_failure'])} AS is_heart_failure, {_spans_sql(C.CONDITION_CHAPTERS['is_hypertension'])} AS is_hypertension
    FROM visit v JOIN wide w ON v.assessment_id = w.assessment_id % {BLOCK} JOIN nation n ON v.county_key = n.n_nationkey LEFT JOIN sdoh s ON v.county_key = s.county_key)"""
from carefold.plans.queries_columns import BMI_CLASS  # noqa: E402

DASH = DASH.format(bmi=BMI_CLASS.replace("b <", "CAST(v.assessment_id % 30 + 15 AS INT) <").replace("b >=", "CAST(v.assessment_id % 30 + 15 AS INT) >="))


def _map_text(values: str, where: str, more: str = "") -> str:
    """Counts of a column per county as sorted 'value=count' text."""
    return f"(SELECT array_to_string(list_sort(array_agg(x || '=' || n)), ';') FROM (SELECT {values} AS x, CAST(count(*) AS VARCHAR) AS n FROM dash i WHERE i.county = {where} AND {values} IS NOT NULL {more} GROUP BY 1))"


def _text_map(name):
    pairs = F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(F.array_sort(pairs), ";").alias(name)


def county_rollup(df, by):
    """One row per county: distinct counts, means, value counts, condition counts and chapters."""
    base = df.groupBy(*by).agg(
        F.countDistinct("beneficiary_id").alias("n_patients"), F.countDistinct("facility_id").alias("n_facilities"), F.countDistinct("segment").alias("n_hipps"),
        F.avg("age").alias("mean_age"), F.count_if(F.col("is_diabetes") == 1).alias("n_diabetes"), F.count_if(F.col("is_heart_failure") == 1).alias("n_heart_failure"),
        F.count_if(F.col("is_hypertension") == 1).alias("n_hypertension"), F.count_if(F.col("ever_readmitted") == 1).alias("n_readmitted"),
        F.count_if(F.col("ever_readmitted") == 0).alias("n_not_readmitted"), F.min("POPPCT_URB").alias("POPPCT_URB"), F.min("POPPCT_RUR").alias("POPPCT_RUR"))
    base = base.join(AG.count_maps(df, by, ["gender", "discipline", "bmi_category"]), by, "left")
    return base.join(AG.label_union(df, by, "icd_ranges").withColumnRenamed("labels", "icd_ranges"), by, "left")


ROLLUP = f"""SELECT d.county, count(DISTINCT beneficiary_id) AS n_patients, count(DISTINCT facility_id) AS n_facilities, count(DISTINCT segment) AS n_hipps, {q6('avg(age)', 'mean_age')},
    count(*) FILTER (WHERE is_diabetes = 1) AS n_diabetes, count(*) FILTER (WHERE is_heart_failure = 1) AS n_heart_failure, count(*) FILTER (WHERE is_hypertension = 1) AS n_hypertension,
    count(*) FILTER (WHERE ever_readmitted = 1) AS n_readmitted, count(*) FILTER (WHERE ever_readmitted = 0) AS n_not_readmitted, min(POPPCT_URB) AS POPPCT_URB, min(POPPCT_RUR) AS POPPCT_RUR,
    {_map_text('gender', 'd.county')} AS gender_counts, {_map_text('discipline', 'd.county')} AS discipline_counts, {_map_text('bmi_category', 'd.county')} AS bmi_category_counts,
    (SELECT array_to_string(list_sort(list_distinct(array_agg(label))), ',') FROM {ROW_RANGES} r JOIN dash i ON r.assessment_id % {BLOCK} = i.assessment_id WHERE i.county = d.county) AS icd_ranges
    FROM dash d GROUP BY d.county"""


@query("ag_35", f", {DASH} {ROLLUP}", "visit wide sdoh chapters")
def ag_35(t):
    out = county_rollup(_dashboard(t), ["county"])
    return out.select(*[c for c in out.columns if not c.endswith("_counts") and c not in ("mean_age", "icd_ranges")], r6(F.col("mean_age"), "mean_age"),
                      *[_text_map(c) for c in out.columns if c.endswith("_counts")], F.array_join("icd_ranges", ",").alias("icd_ranges"))


RACE_GROUPS = {"White": [0], "Black": [1], "Asian": [2], "Hispanic": [3], "Other": [4, 5]}


def cohort_rollup(df, county, cond):
    """Roll-up of one cohort with condensed race counts; county names are normalised first."""
    part = P.cohort(df, cond).withColumn(county, S.title_case(F.col(county)))
    races = {n: sum((F.coalesce(F.col(f"race_{i}"), F.lit(0.0)) for i in ids), F.lit(0.0)) for n, ids in RACE_GROUPS.items()}
    base = part.groupBy(county).agg(
        F.countDistinct("beneficiary_id").alias("n_patients"), F.countDistinct("facility_id").alias("n_facilities"), F.avg("age").alias("mean_age"),
        F.min("POPPCT_URB").alias("POPPCT_URB"), *[F.sum(x).cast("bigint").alias(f"race_{n}") for n, x in races.items()])
    return base.join(AG.count_map(part, [county], "gender", "gender_counts"), county, "left")


COHORT = f"""SELECT upper(d.county[1]) || lower(d.county[2:]) AS county, count(DISTINCT beneficiary_id) AS n_patients, count(DISTINCT facility_id) AS n_facilities, {q6('avg(age)', 'mean_age')}, min(POPPCT_URB) AS POPPCT_URB,
    {', '.join('CAST(sum(' + ' + '.join(f'coalesce(race_{i}, 0)' for i in ids) + f') AS BIGINT) AS "race_{n}"' for n, ids in RACE_GROUPS.items())},
    {_map_text('gender', 'd.county', 'AND i.is_diabetes = 1')} AS gender_counts FROM dash d WHERE is_diabetes = 1 GROUP BY d.county"""


@query("ag_36", f", {DASH} {COHORT}", "visit wide sdoh chapters")
def ag_36(t):
    out = cohort_rollup(_dashboard(t), "county", "is_diabetes")
    return out.select(*[c for c in out.columns if c not in ("mean_age", "gender_counts")], r6(F.col("mean_age"), "mean_age"), _text_map("gender_counts"))


@query("ag_39", f", {DASH} SELECT county, n_patients, n_facilities, mean_age, \"race_White\" FROM ({COHORT}) WHERE county = 'Nation_7'", "visit wide sdoh chapters")
def ag_39(t):
    """The figures of one county; the filter runs before the roll-up."""
    part = _dashboard(t).filter(S.title_case(F.col("county")) == "Nation_7")
    return cohort_rollup(part, "county", "is_diabetes").select("county", "n_patients", "n_facilities", r6(F.col("mean_age"), "mean_age"), "race_White")


# -- risk scores --------------------------------------------------------------------------------
def _scored_codes(t):
    return t.long().select("beneficiary_id", "code")


def _risk_sql(table: str, names: list[str], weights: dict | None, beaten: dict, id: str = "beneficiary_id", source: str = "long") -> str:
    raw = ", ".join(f"max(CAST(coalesce(m.condition = '{c}', FALSE) AS INT)) AS \"{c}\"" for c in names)
    flag = {c: f'CASE WHEN "{beaten[c]}" = 1 THEN 0 ELSE "{c}" END' if c in beaten else f'"{c}"' for c in names}
    score = "" if weights is None else ", CAST(" + " + ".join(f'({flag[c]}) * {weights[c]}' for c in names if weights[c]) + " AS INT) AS comorbidity_score"
    return (f"SELECT {id}, {', '.join(f'{flag[c]} AS \"{c}\"' for c in names)}{score} FROM (SELECT d.{id}, {raw} FROM {source} d LEFT JOIN "
            f"(SELECT DISTINCT x.code, m.condition FROM (SELECT DISTINCT code FROM diag) x JOIN {table} m ON starts_with(replace(x.code, '.', ''), m.prefix)) m ON d.code = m.code GROUP BY 1)")


CHARLSON = _risk_sql("charlson_codes", list(R.CHARLSON_CODES), R.CHARLSON_QUAN_WEIGHTS, R.CHARLSON_BEATEN_BY)
ELIX = _risk_sql("elix_codes", list(R.ELIXHAUSER_CODES), R.ELIXHAUSER_VW_WEIGHTS, R.ELIXHAUSER_BEATEN_BY)
# A stand-in for a second published weighting, which callers pass in: one point per condition.
UNIT_WEIGHTS = {c: 1 for c in R.ELIXHAUSER_CODES}
ELIX_UNIT = _risk_sql("elix_codes", list(R.ELIXHAUSER_CODES), UNIT_WEIGHTS, R.ELIXHAUSER_BEATEN_BY)
DISAB = _risk_sql("disab_codes", list(R.DISABILITY_CODES), None, {})


@query("rsk_01", CHARLSON, "long charlson_codes")
def rsk_01(t):
    return RK.comorbidity(_scored_codes(t), "beneficiary_id", "code", "charlson")


AGED = "aged AS (SELECT beneficiary_id, max(age) AS age FROM visit GROUP BY 1)"


@query("rsk_02", f""", {AGED} SELECT s.beneficiary_id, a.age, s.comorbidity_score, CAST(s.comorbidity_score + least(greatest(floor((a.age - 40) / 10), 0), 4) AS BIGINT) AS age_adj_comorbidity_score,
    {q6('power(0.983::DOUBLE, exp((s.comorbidity_score + least(greatest(floor((a.age - 40) / 10), 0), 4)) * 0.9::DOUBLE))', 'survival_10yr')} FROM ({CHARLSON}) s JOIN aged a USING (beneficiary_id)""", "long charlson_codes visit")
def rsk_02(t):
    ages = t.visit().groupBy("beneficiary_id").agg(F.max("age").alias("age"))
    out = RK.charlson(_scored_codes(t).join(ages, "beneficiary_id"), "beneficiary_id", "code", age="age")
    return out.select("beneficiary_id", "age", "comorbidity_score", F.col("age_adj_comorbidity_score").cast("bigint").alias("age_adj_comorbidity_score"),
                      r6(RK.survival_10yr(F.col("age_adj_comorbidity_score")), "survival_10yr"))


@query("rsk_03", ELIX, "long elix_codes")
def rsk_03(t):
    return RK.comorbidity(_scored_codes(t), "beneficiary_id", "code", "elixhauser")


@query("rsk_04", ELIX_UNIT, "long elix_codes")
def rsk_04(t):
    return RK.comorbidity(_scored_codes(t), "beneficiary_id", "code", "elixhauser", weights=UNIT_WEIGHTS)


@query("rsk_05", DISAB, "long disab_codes")
def rsk_05(t):
    return RK.disability(_scored_codes(t), "beneficiary_id", "code")


HFRS = "SELECT beneficiary_id, sum(coalesce(tenths, 0)) / 10.0::DOUBLE AS hfrs FROM (SELECT DISTINCT beneficiary_id, substr(code, 1, 3) AS c FROM {src}) LEFT JOIN hfrs_points ON c = category GROUP BY 1"


@query("rsk_06", f", {AGED} SELECT h.beneficiary_id, h.hfrs, CAST(a.age >= 75 AS INT) AS old FROM ({HFRS.format(src='long')}) h JOIN aged a USING (beneficiary_id)", "long hfrs_points visit")
def rsk_06(t):
    """All ages; the age-limited path gives the same scores for those of 75 and over."""
    ages = t.visit().groupBy("beneficiary_id").agg(F.max("age").alias("age"))
    codes = _scored_codes(t).join(ages, "beneficiary_id")
    old = RK.hfrs(codes, "beneficiary_id", "code", 75, "age").select("beneficiary_id", F.col("hfrs").alias("hfrs_old"))
    both = RK.hfrs(codes, "beneficiary_id", "code").join(old, "beneficiary_id", "left")
    return both.select("beneficiary_id", F.coalesce("hfrs_old", "hfrs").alias("hfrs"), F.col("hfrs_old").isNotNull().cast("int").alias("old"))


@query("rsk_07", f"SELECT CASE WHEN hfrs < 5 THEN 'low' WHEN hfrs <= 15 THEN 'intermediate' ELSE 'high' END AS tier, count(*) AS n FROM ({HFRS.format(src='long')}) GROUP BY 1", "long hfrs_points")
def rsk_07(t):
    scores = RK.hfrs(_scored_codes(t), "beneficiary_id", "code")
    return scores.groupBy(RK.frailty_tier(F.col("hfrs")).alias("tier")).agg(F.count("*").alias("n"))


def _risk_parts(t):
    scores, disability = RK.all_schemes(_scored_codes(t), "beneficiary_id", "code", UNIT_WEIGHTS, second_label="Unit weights")
    narrow = {k: s.select("beneficiary_id", "comorbidity_score") for k, s in scores.items()}
    return narrow, RK.hfrs(_scored_codes(t), "beneficiary_id", "code"), disability


RISK_TABLE = f"""SELECT s.weight, s.beneficiary_id, s.comorbidity_score, h.hfrs, {', '.join(f'd.{c}' for c in R.DISABILITY_CODES)} FROM (
    SELECT 'Charlson' AS weight, beneficiary_id, comorbidity_score FROM ({CHARLSON}) UNION ALL SELECT 'Van Walraven', beneficiary_id, comorbidity_score FROM ({ELIX})
    UNION ALL SELECT 'Unit weights', beneficiary_id, comorbidity_score FROM ({ELIX_UNIT})) s JOIN ({HFRS.format(src='long')}) h USING (beneficiary_id) JOIN ({DISAB}) d USING (beneficiary_id)"""


@query("rsk_08", RISK_TABLE, "long charlson_codes elix_codes hfrs_points disab_codes")
def rsk_08(t):
    rows = RK.risk_rows(_scored_codes(t), "beneficiary_id", "code", UNIT_WEIGHTS, second_label="Unit weights")
    return rows.select("weight", "beneficiary_id", "comorbidity_score", "hfrs", *R.DISABILITY_CODES)


RISK_ROWS = f"r AS (SELECT h.hfrs, d.* FROM ({HFRS.format(src='long')}) h JOIN ({DISAB}) d USING (beneficiary_id))"


@query("rsk_09", f", {RISK_ROWS} SELECT disability, presence, {q6('avg(hfrs)', 'mean_score')}, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS disability, {c} AS presence, hfrs FROM r" for c in R.DISABILITY_CODES) + ") GROUP BY 1, 2", "long hfrs_points disab_codes")
def rsk_09(t):
    _, frail, impaired = _risk_parts(t)
    out = RK.frailty_by_disability(frail.join(impaired, "beneficiary_id"), list(R.DISABILITY_CODES))
    return out.select("disability", "presence", r6(F.col("mean_score"), "mean_score"), "n")


EP_LONG = "eplong AS (SELECT a.beneficiary_id || '_' || CAST(year(a.visit_date) AS VARCHAR) AS episode, d.code FROM diag d JOIN assess a USING (assessment_id))"


@query("rsk_10", f""", {EP_LONG} SELECT a.assessment_id, coalesce(c.comorbidity_score, 0) AS score_charlson, coalesce(h.hfrs, 0) AS hfrs FROM assess a
    LEFT JOIN ({_risk_sql('charlson_codes', list(R.CHARLSON_CODES), R.CHARLSON_QUAN_WEIGHTS, R.CHARLSON_BEATEN_BY, 'episode', 'eplong')}) c ON a.beneficiary_id || '_' || CAST(year(a.visit_date) AS VARCHAR) = c.episode
    LEFT JOIN ({HFRS.format(src='(SELECT episode AS beneficiary_id, code FROM eplong)')}) h ON c.episode = h.beneficiary_id""", "assess diag charlson_codes hfrs_points")
def rsk_10(t):
    episode = F.concat_ws("_", F.col("beneficiary_id").cast("string"), F.year("visit_date").cast("string")).alias("episode")
    a = t.assess().select("assessment_id", episode)
    codes = t.diag().select("assessment_id", "code").join(a, "assessment_id").select("episode", "code")
    scores = [RK.charlson(codes, "episode", "code").select("episode", F.col("comorbidity_score").alias("score_charlson")), RK.hfrs(codes, "episode", "code")]
    return RK.attach_episode_scores(a, scores, "episode").drop("episode")


# -- graph --------------------------------------------------------------------------------------
STEMS = f"(SELECT DISTINCT assessment_id, substr(code, 1, 3) AS label FROM (SELECT assessment_id, unnest({CODE_LIST}) AS code FROM wide) WHERE code IS NOT NULL)"
EDGES = f"SELECT x.label AS a, y.label AS b, count(*) AS weight FROM {STEMS} x JOIN {STEMS} y ON x.assessment_id = y.assessment_id AND x.label < y.label GROUP BY 1, 2 HAVING count(*) >= 2"


def _stem_sets(t):
    return t.wide().select(K.label_set([F.substring(c, 1, 3) for c in CODES]).alias("stems"))


@query("grf_01", EDGES, "wide")
def grf_01(t):
    return G.cooccurrence_edges(_stem_sets(t), "stems", 2)


@query("grf_02", f""", e AS MATERIALIZED ({EDGES}), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.other = w.a)
    SELECT node, min(other) AS component FROM reach GROUP BY 1""", "wide")
def grf_02(t):
    return G.components(G.cooccurrence_edges(_stem_sets(t), "stems", 2))


@query("grf_03", f"SELECT DISTINCT a.beneficiary_id, r.label FROM {ROW_RANGES} r JOIN assess a ON a.assessment_id = r.assessment_id % {BLOCK}", "wide chapters assess")
def grf_03(t):
    sets = t.coded(t.assess().select("assessment_id", "beneficiary_id"), _chapter_sets(t))
    return D.bipartite_edges(sets, "beneficiary_id", "icd_ranges")


# -- evaluation ---------------------------------------------------------------------------------
@query("met_01", f"SELECT label, prediction, count(*) AS n, {q6('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY label)', 'row_percent')} FROM scored3 GROUP BY 1, 2", "scored3")
def met_01(t):
    return M.confusion(t.scored3()).select("label", "prediction", "n", r6(F.col("row_percent"), "row_percent"))


REPORT = """SELECT c AS class, CASE WHEN p = 0 THEN 0 ELSE tp / p END AS precision, CASE WHEN s = 0 THEN 0 ELSE tp / s END AS recall,
    CASE WHEN p + s = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (p + s) END AS f1, s AS support FROM (SELECT c, count(*) FILTER (WHERE label = c AND prediction = c) AS tp,
    count(*) FILTER (WHERE prediction = c) AS p, count(*) FILTER (WHERE label = c) AS s FROM scored3, (SELECT DISTINCT label AS c FROM scored3) GROUP BY 1)"""


@query("met_02", f"SELECT CAST(class AS VARCHAR) AS class, {q6('precision', 'precision')}, {q6('recall', 'recall')}, {q6('f1', 'f1')}, support FROM ({REPORT}) UNION ALL "
       f"SELECT 'macro', {q6('avg(precision)', 'p')}, {q6('avg(recall)', 'r')}, {q6('avg(f1)', 'f')}, CAST(sum(support) AS BIGINT) FROM ({REPORT}) UNION ALL "
       f"SELECT 'weighted', {q6('sum(precision * support) / sum(support)', 'p')}, {q6('sum(recall * support) / sum(support)', 'r')}, {q6('sum(f1 * support) / sum(support)', 'f')}, CAST(sum(support) AS BIGINT) FROM ({REPORT})", "scored3")
def met_02(t):
    report = M.class_report(t.scored3())
    avg = M.report_averages(report)
    names = ["precision", "recall", "f1"]
    rows = [report.select(F.col("class").cast("string").alias("class"), *[r6(F.col(n), n) for n in names], "support")]
    rows += [avg.select(F.lit(k).alias("class"), *[r6(F.col(f"{k}_{n}"), n) for n in names], "support") for k in ["macro", "weighted"]]
    return RS.stack(*rows)


@query("met_03", f"SELECT {q6('avg(CAST(label = prediction AS INT))', 'accuracy')} FROM scored3", "scored3")
def met_03(t):
    return M.accuracy(t.scored3()).select(r6(F.col("accuracy"), "accuracy"))


def auc_sql(source: str) -> str:
    return f"""SELECT sum(p * (below + n / 2.0::DOUBLE)) / (sum(p) * sum(n)) FROM (SELECT p, n, sum(n) OVER (ORDER BY probability) - n AS below FROM
    (SELECT probability, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM {source} GROUP BY 1))"""


def ap_sql(source: str) -> str:
    return f"""SELECT sum(p * tp / (tp + fp)::DOUBLE) / sum(p) FROM (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM
    (SELECT probability, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM {source} GROUP BY 1) WINDOW w AS (ORDER BY probability DESC))"""


@query("met_04", f"SELECT {q6('(' + auc_sql('scored') + ')', 'roc_auc')}", "scored")
def met_04(t):
    return M.roc_auc(t.scored()).select(r6(F.col("roc_auc"), "roc_auc"))


@query("met_05", f"SELECT {q6('(' + ap_sql('scored') + ')', 'average_precision')}", "scored")
def met_05(t):
    return M.average_precision(t.scored()).select(r6(F.col("average_precision"), "average_precision"))


@query("met_06", " UNION ALL ".join(f"SELECT {k} AS class, {q6('(' + auc_sql(f'(SELECT CAST(label = {k} AS INT) AS label, p{k} AS probability FROM scored3)') + ')', 'roc_auc')}, "
                                    f"{q6('(' + ap_sql(f'(SELECT CAST(label = {k} AS INT) AS label, p{k} AS probability FROM scored3)') + ')', 'average_precision')}" for k in range(3)), "scored3")
def met_06(t):
    return M.ovr_curves(t.scored3(), {0: "p0", 1: "p1", 2: "p2"}).select("class", r6(F.col("roc_auc"), "roc_auc"), r6(F.col("average_precision"), "average_precision"))


@query("met_07", f"""SELECT probability AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {q6('tp / tot_p', 'tpr')}, {q6('fp / tot_n', 'fpr')}, {q6('tp / (tp + fp)', 'precision')} FROM
    (SELECT probability, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS tot_p, sum(n) OVER () AS tot_n FROM (SELECT probability, count(*) FILTER (WHERE label = 1) AS p,
    count(*) FILTER (WHERE label = 0) AS n FROM scored GROUP BY 1) WINDOW w AS (ORDER BY probability DESC))""", "scored")
def met_07(t):
    return M.curve_points(t.scored()).select("threshold", "tp", "fp", *[r6(F.col(c), c) for c in ["tpr", "fpr", "precision"]])


@query("met_08", f"SELECT 'rule' AS model, {q6('avg(f1)', 'macro_f1')} FROM ({REPORT}) UNION ALL SELECT 'swapped', {q6('avg(f1)', 'macro_f1')} FROM ({REPORT.replace('FROM scored3,', 'FROM (SELECT label, 2 - prediction AS prediction FROM scored3),')})", "scored3")
def met_08(t):
    s = t.scored3().select("label", "prediction")
    two = RS.stack(s.withColumn("model", F.lit("rule")), s.select("label", (2 - F.col("prediction")).alias("prediction"), F.lit("swapped").alias("model")))
    return M.compare_models(two).select("model", r6(F.col("macro_f1"), "macro_f1"))


@query("met_09", f"SELECT split, label, count(*) AS n, {q6('count(*) / sum(count(*)) OVER (PARTITION BY split)', 'share')} FROM (SELECT CAST(row_id % 3 AS INT) AS split, label FROM scored3) GROUP BY 1, 2", "scored3")
def met_09(t):
    df = t.scored3().select((F.col("row_id") % 3).cast("int").alias("split"), "label")
    return M.split_rates(df, "split", "label").select("split", "label", "n", r6(F.col("share"), "share"))


THRESHOLDS = f"""SELECT t.threshold, tp, fp, fn, tn, {q6('(2.0::DOUBLE * tp / (2 * tp + fp + fn) + 2.0::DOUBLE * tn / (2 * tn + fp + fn)) / 2', 'macro_f1')} FROM (
    SELECT threshold, count(*) FILTER (WHERE label = 1 AND probability >= threshold) AS tp, count(*) FILTER (WHERE label = 0 AND probability >= threshold) AS fp,
    count(*) FILTER (WHERE label = 1 AND probability < threshold) AS fn, count(*) FILTER (WHERE label = 0 AND probability < threshold) AS tn
    FROM scored, (SELECT unnest(range(10, 90, 5)) / 100.0::DOUBLE AS threshold) GROUP BY 1) t"""


@query("tun_05", THRESHOLDS, "scored")
def tun_05(t):
    return M.threshold_table(t.scored()).withColumn("macro_f1", F.round("macro_f1", 6))
