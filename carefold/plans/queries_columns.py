"""Sources, sinks, projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from carefold.functions import constants as C
from carefold.functions import scalars as S
from carefold.functions import codes as K
from carefold.operators import aggregates as AG
from carefold.operators import columns as P
from carefold.plans.domain import CODES, q6, r6
from carefold.plans.registry import query
from carefold.session import dealt, scratch_path
from carefold.sources import readers, sinks

ORDERS_CSV = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"


# -- sources ------------------------------------------------------------------------------------
def _orders_csv(t):
    path = scratch_path(t.spark, "orders-csv")
    sinks.write_csv(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path)
    return path


@query("src_01", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def src_01(t):
    return readers.read_csv(t.spark, _orders_csv(t), ORDERS_CSV)


@query("src_02", f"SELECT o_orderstatus, count(*) AS n, {q6('sum(o_totalprice)', 'total')} FROM orders GROUP BY 1")
def src_02(t):
    df = readers.read_csv(t.spark, _orders_csv(t), ORDERS_CSV)
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), r6(F.sum("o_totalprice"), "total"))


@query("src_03", "SELECT p_brand, count(*) AS n, max(p_size) AS biggest FROM part GROUP BY 1")
def src_03(t):
    df = readers.read_parquet(t.spark, f"{t.folder}/part.parquet", ["p_brand", "p_size"])
    return df.groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_size").alias("biggest"))


@query("src_04", """SELECT c.code_range, c.section, count(*) AS n FROM diag d JOIN chapters c ON substr(d.code, 1, 3) BETWEEN c.lo AND c.hi
    GROUP BY 1, 2""", "diag chapters")
def src_04(t):
    table = F.broadcast(K.chapter_table(t.spark).select("code_range", "section"))
    coded = t.diag().select(K.icd_range(F.col("code")).alias("code_range"))
    return coded.groupBy("code_range").agg(F.count("*").alias("n")).join(table, "code_range")


@query("src_05", """SELECT s_name AS county, CAST(s_suppkey AS VARCHAR) AS fips, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS state,
    '{"type":"Point","coordinates":[' || CAST(s_suppkey AS VARCHAR) || ',1]}' AS geometry FROM supplier WHERE s_nationkey = 3""")
def src_05(t):
    """Feature collections written by Spark from the supplier table, one per line, then read back."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("s_suppkey"), F.lit(1)).alias("coordinates"))
    feature = F.struct(F.col("s_suppkey").cast("string").alias("id"),
                       F.struct(F.col("s_name").alias("NAME"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("STATE")).alias("properties"),
                       point.alias("geometry"))
    text = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")))
    path = scratch_path(t.spark, "counties")
    t("supplier").select(text.alias("value")).write.text(path)
    return readers.read_feature_collection(t.spark, path, state="03", multi_line=False)


@query("src_06", """SELECT 'section=' || c.code_range AS file_name, count(*) AS num_rows, CAST(2 AS INT) AS num_columns,
    count(DISTINCT l.beneficiary_id) AS num_patients FROM long l JOIN chapters c ON c.code_range = l.chapter GROUP BY 1""", "long chapters")
def src_06(t):
    path = scratch_path(t.spark, "sections")
    t.long().filter(F.col("chapter").isNotNull()).select("beneficiary_id", "code", F.col("chapter").alias("section")).write.partitionBy(
        "section").option("header", True).csv(path)
    return readers.summarise_files(t.spark, path, "beneficiary_id bigint, code string", "beneficiary_id")


@query("src_07", """SELECT p_brand AS topic, CAST(pos AS INT) AS pos, word AS indicator FROM
    (SELECT p_partkey, p_brand, unnest(string_split(p_name, ' ')) AS word, unnest(range(0, len(string_split(p_name, ' ')))) AS pos FROM part)""")
def src_07(t):
    """The list column is quoted text, as a catalogue file stores it."""
    listed = F.concat(F.lit("['"), F.replace(F.col("p_name"), F.lit(" "), F.lit("', '")), F.lit("']"))
    return readers.topic_rows(t("part").select("p_brand", listed.alias("names")), "p_brand", "names")


# -- sinks --------------------------------------------------------------------------------------
@query("snk_01", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def snk_01(t):
    path = scratch_path(t.spark, "single")
    sinks.write_csv(t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), path, single=True)
    return readers.read_csv(t.spark, path, "o_orderpriority string, n bigint")


def _section_flags(t):
    """Per assessment one flag column per chapter."""
    from carefold.operators.diagnosis import chapter_counts
    return chapter_counts(dealt(t.wide(), t("lineitem").count(), "assessment_id"), "assessment_id", CODES)


SECTION_SQL = """SELECT section, count(*) AS num_rows FROM (SELECT DISTINCT w.assessment_id, c.code_range AS section
    FROM (SELECT assessment_id, unnest([code_1, code_2, code_3, code_4, code_5, code_6]) AS code FROM wide) w
    JOIN chapters c ON substr(w.code, 1, 3) BETWEEN c.lo AND c.hi) GROUP BY 1"""


@query("snk_02", SECTION_SQL, "wide chapters")
def snk_02(t):
    """A folder per chapter is written and its rows are counted as read back."""
    path = scratch_path(t.spark, "sections")
    sinks.split_by_section(_section_flags(t), path)
    return readers.read_sections(t.spark, path, "assessment_id long").groupBy("section").agg(F.count("assessment_id").alias("num_rows"))


@query("snk_03", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def snk_03(t):
    path = scratch_path(t.spark, "suppliers")
    sinks.write_csv(t("supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return readers.read_csv(t.spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


@query("snk_04", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def snk_04(t):
    path = scratch_path(t.spark, "orders-parquet")
    sinks.csv_to_parquet(readers.read_csv(t.spark, _orders_csv(t), ORDERS_CSV), path)
    return readers.read_parquet(t.spark, path)


@query("snk_05", """SELECT 'first' AS run, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 2
    UNION ALL SELECT 'second', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def snk_05(t):
    path = scratch_path(t.spark, "log")
    for run, col in [("first", "o_orderstatus"), ("second", "o_orderpriority")]:
        sinks.append_results(t("orders").groupBy(F.col(col).alias("label")).agg(F.count("*").alias("n")).withColumn("run", F.lit(run)), path)
    return readers.read_parquet(t.spark, path)


@query("snk_06", f"SELECT label, count(*) AS n, {q6('avg(probability)', 'mean_probability')} FROM scored GROUP BY 1", "scored")
def snk_06(t):
    path = scratch_path(t.spark, "metrics")
    df = t.scored().groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("probability"), "mean_probability"))
    sinks.write_metrics(df, path)
    return t.spark.read.schema("label int, n bigint, mean_probability double").json(path)


@query("snk_09", """SELECT 'code_' || i AS "column", n AS n_distinct FROM (SELECT """ + ", ".join(f"count(DISTINCT code_{i}) AS n{i}" for i in range(1, 7))
       + " FROM wide), LATERAL (VALUES " + ", ".join(f"('{i}', n{i})" for i in range(1, 7)) + ") AS v(i, n)", "wide")
def snk_09(t):
    return sinks.distinct_counts(t.wide(), CODES)


# -- projections --------------------------------------------------------------------------------
RENAMES = {"o_orderkey": "Assessment_ID", "o_custkey": "Beneficiary_ID", "o_orderstatus": "Status", "not_there": "Nothing"}


@query("prj_01", "SELECT o_orderkey AS Assessment_ID, o_custkey AS Beneficiary_ID, o_orderstatus AS Status FROM orders")
def prj_01(t):
    return P.rename_by_map(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), RENAMES)


@query("prj_02", "SELECT s_suppkey, s_name FROM supplier")
def prj_02(t):
    return P.drop_present(t("supplier"), ["s_nationkey", "s_acctbal", "absent"])


@query("prj_03", "SELECT p_partkey, p_retailprice, p_brand FROM part")
def prj_03(t):
    df = t("part")
    return df.select("p_partkey", *P.columns_like(df, suffix="price", contains="BRAND", ignore_case=True))


@query("prj_04", """SELECT ACS_PCT_HS_GRADUATE, ACS_PCT_POSTHS_ED, ACS_PCT_HH_LIMIT_ENGLISH, ACS_PCT_HH_BROADBAND, ACS_PCT_HH_1PERS, ACS_PCT_INC50,
    county_key FROM sdoh""", "sdoh")
def prj_04(t):
    social, _ = P.split_feature_groups(t.sdoh(), keep=["county_key"])
    return social


@query("prj_06", "SELECT p_retailprice, p_size FROM part")
def prj_06(t):
    return P.select_types(t("part"), ["double", "int"])


@query("prj_07", "SELECT o_orderkey, CAST(o_totalprice > 200000 AS INT) AS expensive FROM orders")
def prj_07(t):
    return P.bool_to_int(t("orders").select("o_orderkey", (F.col("o_totalprice") > 200000).alias("expensive")))


@query("prj_08", "SELECT c_custkey, 'Charlson' AS weight FROM customer")
def prj_08(t):
    return P.with_constant(t("customer").select("c_custkey"), "weight", "Charlson")


@query("prj_09", """SELECT assessment_id, CAST(nullif(beneficiary_id, 5) AS VARCHAR) || '_' ||
    coalesce(CAST(CASE WHEN assessment_id % 10 <> 0 THEN visit_date END AS VARCHAR), 'nan') AS episode_id FROM assess""", "assess")
def prj_09(t):
    a = t.assess()
    bene = F.when(F.col("beneficiary_id") != 5, F.col("beneficiary_id"))
    day = F.when(F.col("assessment_id") % 10 != 0, F.col("visit_date"))
    return a.select("assessment_id", S.episode_id(bene, day).alias("episode_id"))


@query("prj_10", "SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def prj_10(t):
    s = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("s")
    return P.expand_struct(t("orders").select("o_orderkey", s), "s")


@query("prj_11", "SELECT assessment_id, CAST(" + " + ".join(f"CAST(code_{i} IS NOT NULL AS INT)" for i in range(1, 7)) + " AS INT) AS n_filled FROM wide", "wide")
def prj_11(t):
    return t.wide().select("assessment_id", P.count_filled(CODES).alias("n_filled"))


@query("prj_12", "SELECT n_nationkey, n_name, n_regionkey, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def prj_12(t):
    s = t("supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    n = t("nation")
    return P.unique_names(n.join(s, n["n_nationkey"] == s["n_nationkey"]))


@query("prj_13", """SELECT DISTINCT p_brand, replace(replace(replace('ACS_PCT_' || p_type || '_ACS_TOT', 'ACS_PCT', '%'), 'ACS_TOT', 'TOTAL'), '_', ' ') AS label FROM part""")
def prj_13(t):
    raw = F.concat(F.lit("ACS_PCT_"), F.col("p_type"), F.lit("_ACS_TOT"))
    return t("part").select("p_brand", S.pretty_indicator(raw).alias("label")).distinct()


# -- filters ------------------------------------------------------------------------------------
@query("flt_01", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 100000")
def flt_01(t):
    return t("orders").filter((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") >= 100000)).select("o_orderkey", "o_totalprice")


@query("flt_02", "SELECT assessment_id, CAST(visit_date AS VARCHAR) AS visit_date FROM assess WHERE visit_date >= DATE '1998-01-01'", "assess")
def flt_02(t):
    return t.assess().filter(F.col("visit_date") >= F.lit("1998-01-01").cast("date")).select("assessment_id", F.col("visit_date").cast("string").alias("visit_date"))


@query("flt_03", "SELECT assessment_id, code_1, code_3 FROM wide WHERE code_1 IS NOT NULL AND code_3 IS NOT NULL", "wide")
def flt_03(t):
    return P.drop_nulls(t.wide().select("assessment_id", "code_1", "code_3"), ["code_1", "code_3"])


def _conditions(t):
    k = F.col("assessment_id")
    return t.assess().select("assessment_id", F.when(k % 5 != 0, (k % 2).cast("int")).alias("is_diabetes"), (k % 3).cast("int").alias("is_frail"))


COND = "(SELECT assessment_id, CASE WHEN assessment_id % 5 <> 0 THEN CAST(assessment_id % 2 AS INT) END AS is_diabetes, CAST(assessment_id % 3 AS INT) AS is_frail FROM assess)"


@query("flt_04", f"SELECT * FROM {COND} WHERE is_diabetes = 1", "assess")
def flt_04(t):
    return P.cohort(_conditions(t), "is_diabetes")


@query("flt_05", f"SELECT * FROM {COND} WHERE is_diabetes = 1 AND is_frail = 1", "assess")
def flt_05(t):
    return P.cohort_all(_conditions(t), ["is_diabetes", "is_frail"])


@query("flt_06", f"SELECT * FROM {COND} WHERE is_diabetes = 1 OR is_frail = 1", "assess")
def flt_06(t):
    return P.cohort_any(_conditions(t), ["is_diabetes", "is_frail"])


@query("flt_07", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS half FROM orders""")
def flt_07(t):
    k = F.col("o_orderkey")
    df = t("orders").select("o_orderkey", F.when(k % 2 == 0, F.col("o_totalprice")).alias("half"), F.when(k % 1000 == 0, F.col("o_orderstatus")).alias("sparse"))
    return P.drop_sparse_columns(df, 0.99, decimals=1)


@query("flt_08", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def flt_08(t):
    return P.groups_above(t("orders"), ["o_custkey"], 12)


@query("flt_09", """SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS left_keys, (SELECT count(DISTINCT k) FROM b) AS right_keys,
    (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT k FROM b)) AS shared_keys,
    (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT k FROM b)) AS matching_rows
    FROM (SELECT 1)""".replace("FROM b", "FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000)"))
def flt_09(t):
    b = t("customer").filter(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("o_custkey"))
    return P.key_overlap(t("orders").select("o_custkey"), b, "o_custkey")


ED, HOSP = ["Emergent_Care_Reason_Fall", "Emergent_Care_Reason_Other"], ["Hospital_Reason_Injury"]


@query("flt_10", """SELECT assessment_id FROM flags WHERE coalesce(TRY_CAST(Emergent_Care_Reason_Fall AS DOUBLE) <> 0, FALSE)
    OR coalesce(TRY_CAST(Emergent_Care_Reason_Other AS DOUBLE) <> 0, FALSE)""", "flags")
def flt_10(t):
    df = t.flags()
    cols = P.columns_like(df, prefix="Emergent_Care_Reason")
    return df.filter(P.any_filled(cols)).select("assessment_id")


@query("flt_11", """SELECT p_partkey, CASE WHEN p_size * 6.0::DOUBLE BETWEEN 5 AND 250 THEN p_size * 6.0::DOUBLE END AS bmi FROM part""")
def flt_11(t):
    return t("part").select("p_partkey", S.plausible(F.col("p_size") * F.lit(6.0), 5, 250).alias("bmi"))


ZIP_SQL = """CASE WHEN regexp_full_match(split_part(zip, '-', 1), '[0-9]{1,9}') THEN lpad(substr(split_part(zip, '-', 1), 1, 5), 5, '0') END"""


@query("flt_12", f"SELECT beneficiary_id, {ZIP_SQL} AS zip5 FROM patient WHERE length({ZIP_SQL}) = 5", "patient")
def flt_12(t):
    return t.patient().select("beneficiary_id", S.zip5(F.col("zip")).alias("zip5")).filter(F.length("zip5") == 5)


# -- scalars ------------------------------------------------------------------------------------
def _day_text(t):
    """Dates written as ddMMMyyyy, with junk and nulls."""
    k = F.col("assessment_id")
    text = F.upper(F.date_format("visit_date", "ddMMMyyyy"))
    return t.assess().select("assessment_id", F.when(k % 11 == 0, "junk").when(k % 13 != 0, text).alias("day"))


@query("scl_01", """SELECT assessment_id, CASE WHEN assessment_id % 11 = 0 THEN NULL WHEN assessment_id % 13 <> 0 THEN CAST(visit_date AS VARCHAR) END AS day FROM assess""", "assess")
def scl_01(t):
    return _day_text(t).select("assessment_id", S.parse_date(F.col("day")).cast("string").alias("day"))


@query("scl_02", """SELECT assessment_id, CAST(year(visit_date) AS INT) AS y, CAST(month(visit_date) AS INT) AS m, CAST(isodow(visit_date) - 1 AS INT) AS dow FROM assess""", "assess")
def scl_02(t):
    y, m, d = S.date_parts(F.col("visit_date"))
    return t.assess().select("assessment_id", y.alias("y"), m.alias("m"), d.alias("dow"))


@query("scl_03", "SELECT assessment_id, CAST(visit_date - birth_date AS INT) AS days FROM visit", "visit")
def scl_03(t):
    return t.visit().select("assessment_id", S.days_between(F.col("visit_date"), F.col("birth_date")).alias("days"))


@query("scl_04", "SELECT assessment_id, age FROM visit", "visit")
def scl_04(t):
    return t.visit().select("assessment_id", S.age_years(F.col("visit_date"), F.col("birth_date")).alias("age"))


@query("scl_05", """SELECT beneficiary_id, CASE gender_code WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END AS gender,
    CASE discipline_code WHEN 1 THEN 'RN' WHEN 2 THEN 'PT' WHEN 3 THEN 'SLP/ST' WHEN 4 THEN 'OT' END AS discipline FROM patient""", "patient")
def scl_05(t):
    return t.patient().select("beneficiary_id", S.decode(F.col("gender_code"), C.GENDER).alias("gender"),
                              S.decode(F.col("discipline_code"), C.DISCIPLINE).alias("discipline"))


def _resume(t):
    k = F.col("assessment_id")
    return t.assess().select("assessment_id", "visit_date", F.when(k % 4 != 0, F.date_add("visit_date", (k % 90 - 20).cast("int"))).alias("resume"))


@query("scl_06", """SELECT assessment_id, CASE WHEN assessment_id % 4 <> 0 AND assessment_id % 90 - 20 BETWEEN 0 AND 29 THEN 1 ELSE 0 END AS readmitted,
    CASE WHEN assessment_id % 4 <> 0 AND assessment_id % 90 - 20 < 30 THEN 1 ELSE 0 END AS readmitted_compat FROM assess""", "assess")
def scl_06(t):
    r, v = F.col("resume"), F.col("visit_date")
    return _resume(t).select("assessment_id", S.readmitted(r, v).alias("readmitted"), S.readmitted(r, v, compat=True).alias("readmitted_compat"))


def _body(t):
    """Height and weight with zero heights and missing weights."""
    k = F.col("p_partkey")
    return t("part").select("p_partkey", F.when(k % 17 != 0, 60.0 + F.col("p_size") % 16).otherwise(0.0).alias("inch"),
                            F.when(k % 19 != 0, 90.0 + F.col("p_retailprice") % 200).alias("lb"))


BODY = """(SELECT p_partkey, CASE WHEN p_partkey % 17 <> 0 THEN 60.0::DOUBLE + p_size % 16 ELSE 0.0 END AS inch,
    CASE WHEN p_partkey % 19 <> 0 THEN 90.0::DOUBLE + p_retailprice % 200 END AS lb FROM part)"""
BMI_CEIL = "coalesce(CAST(ceil(CASE WHEN inch <> 0 THEN lb / (inch * inch) * 704.5::DOUBLE END) AS INT), 0)"
BMI_CLASS = """CASE WHEN b < 18.5 THEN 'Underweight' WHEN b >= 18.5 AND b < 24.9 THEN 'Normal weight' WHEN b >= 25 AND b < 29.9 THEN 'Overweight'
    WHEN b >= 30 AND b < 34.9 THEN 'Obese-Class1' WHEN b >= 35 AND b < 39.9 THEN 'Obese-Class2' ELSE 'Obese-Class3' END"""


@query("scl_07", f"SELECT p_partkey, {BMI_CEIL} AS bmi FROM {BODY}")
def scl_07(t):
    return _body(t).select("p_partkey", S.bmi_ceil(F.col("lb"), F.col("inch")).alias("bmi"))


@query("scl_08", f"""SELECT p_partkey, CASE WHEN b BETWEEN 5 AND 250 THEN {q6('b', 'x').rsplit(' AS', 1)[0]} END AS bmi FROM
    (SELECT p_partkey, CASE WHEN inch <> 0 THEN lb * 703 / (inch * inch) END AS b FROM {BODY})""")
def scl_08(t):
    return _body(t).select("p_partkey", r6(S.bmi(F.col("lb"), F.col("inch")), "bmi"))


@query("scl_09", f"SELECT p_partkey, {BMI_CLASS} AS category FROM (SELECT p_partkey, {BMI_CEIL} AS b FROM {BODY})")
def scl_09(t):
    return _body(t).select("p_partkey", S.bmi_category(S.bmi_ceil(F.col("lb"), F.col("inch"))).alias("category"))


AGE_SQL = "CASE " + " ".join(f"WHEN age >= {a} AND age < {b} THEN '[{a}, {b})'" for a, b in zip(C.AGE_EDGES, C.AGE_EDGES[1:])) + " END"


@query("scl_10", f"SELECT assessment_id, {AGE_SQL} AS age_group FROM visit", "visit")
def scl_10(t):
    return t.visit().select("assessment_id", S.age_group(F.col("age")).alias("age_group"))


@query("scl_11", "SELECT p_partkey, CAST(round(p_size * 2.0::DOUBLE / 10) * 10 AS INT) AS decile FROM part")
def scl_11(t):
    return t("part").select("p_partkey", S.missing_decile(F.col("p_size") * F.lit(2.0)).alias("decile"))


@query("scl_12", """SELECT p_partkey, CASE WHEN p_partkey % 9 IN (0, 1, 2) THEN NULL WHEN p_size IN (88, 9) THEN NULL ELSE p_size::DOUBLE END AS hearing FROM part""")
def scl_12(t):
    k = F.col("p_partkey")
    raw = F.when(k % 9 == 0, "UK").when(k % 9 == 1, "-").when(k % 9 == 2, "n/a").otherwise(F.col("p_size").cast("string"))
    return t("part").select("p_partkey", S.clean_numeric(raw, C.ORDINAL_SENTINELS).alias("hearing"))


@query("scl_13", "SELECT assessment_id, coalesce(code_5, 'none') AS code_5, coalesce(code_6, 'none') AS code_6 FROM wide", "wide")
def scl_13(t):
    return S.fill_const(t.wide().select("assessment_id", "code_5", "code_6"), "none", ["code_5", "code_6"])


@query("scl_14", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS ratio FROM part")
def scl_14(t):
    x = F.when(F.col("p_partkey") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("p_retailprice"))
    return t("part").select("p_partkey", S.inf_to_null(x).alias("ratio"))


@query("scl_15", "SELECT beneficiary_id, coalesce(race_0, 0) AS race_0, coalesce(race_1, 0) AS race_1, CAST(race_0 IS NULL AS INT) AS race_unknown FROM patient", "patient")
def scl_15(t):
    return S.flag_and_fill(t.patient().select("beneficiary_id", "race_0", "race_1"), ["race_0", "race_1"], "race_unknown")


@query("scl_16", f"SELECT beneficiary_id, {ZIP_SQL} AS zip5 FROM patient", "patient")
def scl_16(t):
    return t.patient().select("beneficiary_id", S.zip5(F.col("zip")).alias("zip5"))


@query("scl_17", "SELECT substr(code, 1, 3) AS first3, split_part(code, '.', 1) AS stem, count(*) AS n FROM diag GROUP BY 1, 2", "diag")
def scl_17(t):
    c = F.col("code")
    return t.diag().groupBy(K.icd_prefix(c).alias("first3"), K.icd_prefix(c, "stem").alias("stem")).agg(F.count("*").alias("n"))


def dx_sql(prefixes: list[str]) -> str:
    tests = [f"coalesce(starts_with({c}, '{p}'), FALSE)" for c in CODES for p in prefixes]
    return f"CAST({' OR '.join(tests)} AS INT)"


@query("scl_18", f"SELECT assessment_id, {dx_sql(['E11', 'I50', 'J18'])} AS hit FROM wide", "wide")
def scl_18(t):
    return t.wide().select("assessment_id", K.has_dx([F.col(c) for c in CODES], ["E11", "I50", "J18"]).alias("hit"))


@query("scl_19", "SELECT assessment_id, CAST(coalesce(contains(code_6, '1.'), FALSE) AS INT) AS hit FROM wide", "wide")
def scl_19(t):
    return t.wide().select("assessment_id", K.contains_flag(F.col("code_6"), "1.").alias("hit"))


@query("scl_20", """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM part""")
def scl_20(t):
    return t("part").select("p_partkey", S.title_case(F.col("p_name")).alias("name"))


@query("scl_22", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ', ,' || p_type, ','), lambda w: trim(w)), lambda w: w <> ''), '|') AS parts FROM part")
def scl_22(t):
    raw = F.concat("p_name", F.lit(", ,"), "p_type")
    return t("part").select("p_partkey", F.array_join(S.split_trim(raw), "|").alias("parts"))


SET_SQL = "list_sort(list_distinct(list_filter([" + ", ".join(f"substr({c}, 1, 1)" for c in CODES) + "], lambda x: x IS NOT NULL)))"


@query("scl_23", f"SELECT assessment_id, array_to_string({SET_SQL}, ',') AS labels FROM wide", "wide")
def scl_23(t):
    labels = K.label_set([F.substring(c, 1, 1) for c in CODES])
    return t.wide().select("assessment_id", F.array_join(labels, ",").alias("labels"))


@query("scl_24", """SELECT assessment_id, CASE WHEN code_6 IS NULL AND code_5 IS NULL THEN 'Unknown' ELSE
    array_to_string(list_sort(list_distinct(list_filter([code_5, code_6], lambda x: x IS NOT NULL))), ', ') END AS text FROM wide""", "wide")
def scl_24(t):
    return t.wide().select("assessment_id", K.join_labels(K.label_set([F.col("code_5"), F.col("code_6")])).alias("text"))


@query("scl_25", """SELECT event_type, 'k' AS category, sum(CAST(props->>'$.k' AS BIGINT))::BIGINT AS n FROM events GROUP BY 1""")
def scl_25(t):
    """The text is turned into its single-quoted form first, as a saved dict looks."""
    text = F.translate("props", '"', "'")
    rows = t("events").select("event_type", F.explode(S.count_map_rows(text)).alias("category", "count"))
    return rows.groupBy("event_type", "category").agg(F.sum("count").alias("n"))


@query("scl_26", "SELECT county_key, CASE WHEN POPPCT_RUR >= POPPCT_URB THEN 'Rural' ELSE 'Urban' END AS class FROM sdoh", "sdoh")
def scl_26(t):
    return t.sdoh().select("county_key", S.urban_rural(F.col("POPPCT_URB"), F.col("POPPCT_RUR")).alias("class"))


@query("scl_27", "SELECT CAST(probability >= 0.35 AS INT) AS class, count(*) AS n FROM scored GROUP BY 1", "scored")
def scl_27(t):
    return t.scored().groupBy(S.classify(F.col("probability"), 0.35).alias("class")).agg(F.count("*").alias("n"))
