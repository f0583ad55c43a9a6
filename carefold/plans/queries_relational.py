"""Joins, aggregations, windows, sorting, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from carefold.functions import codes as K
from carefold.functions import constants as C
from carefold.functions import scalars as S
from carefold.operators import aggregates as AG
from carefold.operators import joins as J
from carefold.operators import profile as PR
from carefold.operators import reshape as RS
from carefold.operators import visits as V
from carefold.operators.columns import count_filled
from carefold.operators.diagnosis import chapter_counts, row_chapters
from carefold.plans.domain import BLOCK, CODES, q6, r6
from carefold.plans.queries_columns import AGE_SQL, BMI_CEIL, BMI_CLASS, BODY, ZIP_SQL, _body
from carefold.plans.registry import query

CODE_LIST = "[" + ", ".join(CODES) + "]"


# -- joins --------------------------------------------------------------------------------------
@query("jn_01", "SELECT a.assessment_id, CAST(m.d AS VARCHAR) AS last_date FROM assess a JOIN (SELECT beneficiary_id, max(visit_date) AS d FROM assess GROUP BY 1) m USING (beneficiary_id)", "assess")
def jn_01(t):
    out = J.with_last_date(t.assess().select("assessment_id", "beneficiary_id", "visit_date"), "beneficiary_id", "visit_date")
    return out.select("assessment_id", F.col("last_date").cast("string").alias("last_date"))


def _patient_codes(t):
    return t.coded(t.assess().select("assessment_id", "beneficiary_id")).drop("_order")


PATIENT_SETS = f"""psets AS (SELECT DISTINCT a.beneficiary_id, w.s FROM (SELECT assessment_id,
    array_to_string(list_sort(list_distinct(array_agg(code_range))), ',') AS s FROM (SELECT assessment_id, unnest({CODE_LIST}) AS code FROM wide)
    JOIN chapters ON substr(code, 1, 3) BETWEEN lo AND hi GROUP BY 1) w JOIN assess a ON a.assessment_id = w.assessment_id % {BLOCK})"""


@query("jn_02", f""", {PATIENT_SETS} SELECT a.assessment_id, coalesce(p.i, 0)::BIGINT AS circulatory, coalesce(p.j, 0)::BIGINT AS respiratory FROM assess a LEFT JOIN
    (SELECT beneficiary_id, count(*) FILTER (WHERE contains(s, 'I00-I99')) AS i, count(*) FILTER (WHERE contains(s, 'J00-J99')) AS j FROM psets GROUP BY 1) p
    USING (beneficiary_id)""", "wide assess chapters")
def jn_02(t):
    counts = chapter_counts(_patient_codes(t), "beneficiary_id", CODES)
    joined = J.left_join(t.assess().select("assessment_id", "beneficiary_id"), counts, ["beneficiary_id"])
    return joined.select("assessment_id", F.coalesce("I00-I99", F.lit(0)).alias("circulatory"), F.coalesce("J00-J99", F.lit(0)).alias("respiratory"))


def _sdoh_zip(t):
    return t.sdoh().withColumn("zip5", (F.col("county_key") + 75000).cast("string")).select("zip5", "ACS_PCT_INC50", "POPPCT_URB")


@query("jn_03", f"""SELECT p.beneficiary_id, s.ACS_PCT_INC50, s.POPPCT_URB FROM (SELECT beneficiary_id, {ZIP_SQL} AS zip5 FROM patient) p
    JOIN sdoh s ON p.zip5 = CAST(75000 + s.county_key AS VARCHAR)""", "patient sdoh")
def jn_03(t):
    p = t.patient().select("beneficiary_id", S.zip5(F.col("zip")).alias("zip5"))
    return J.join_sdoh(p, _sdoh_zip(t)).drop("zip5")


@query("jn_04", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def jn_04(t):
    return J.join_renamed(t("customer").select("c_custkey", "c_nationkey"), t("nation").select("n_nationkey", "n_name"), "c_nationkey", "n_nationkey")


@query("jn_05", "SELECT n_name AS \"County\", n_nationkey AS \"Fips\", s_suppkey, c_custkey FROM nation JOIN supplier ON n_nationkey = s_nationkey JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 10 = s_suppkey % 10")
def jn_05(t):
    n = t("nation").select(F.col("n_name").alias("County"), F.col("n_nationkey").alias("Fips"))
    s = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("Fips"), (F.col("s_suppkey") % 10).alias("d"))
    c = t("customer").select("c_custkey", F.col("c_nationkey").alias("Fips"), (F.col("c_custkey") % 10).alias("d"))
    return J.join_county(n.join(s, "Fips"), n.join(c, "Fips"), ["County", "Fips", "d"]).drop("d")


@query("jn_06", """SELECT a.c_custkey AS k, a.n AS n_a, b.n AS n_b FROM (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) a
    JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b USING (c_custkey)""")
def jn_06(t):
    o = t("orders").withColumnRenamed("o_custkey", "k")
    a, b = (x.groupBy("k").agg(F.count("*").alias("n")) for x in (o, o.filter(F.col("o_orderstatus") == "P")))
    return J.join_suffixed(a, b, ["k"], ("_a", "_b"))


@query("jn_07", """SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON c_custkey = o_custkey""")
def jn_07(t):
    n = t("orders").filter(F.col("o_totalprice") > 400000).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return J.left_join_fill(t("customer").select("c_custkey"), n, ["c_custkey"])


@query("jn_08", """SELECT coalesce(a.k, b.k) AS k, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM (SELECT o_custkey AS k, count(*) AS x FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a
    FULL JOIN (SELECT o_custkey AS k, count(*) AS y FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k""")
def jn_08(t):
    o = t("orders").withColumnRenamed("o_custkey", "k")
    a = o.filter(F.col("o_orderstatus") == "P").groupBy("k").agg(F.count("*").alias("x"))
    b = o.filter(F.col("o_orderstatus") == "O").groupBy("k").agg(F.count("*").alias("y"))
    return J.outer_join_fill(a, b, ["k"])


@query("jn_09", "SELECT d.assessment_id, d.line_no, d.code, c.code_range FROM diag d LEFT JOIN chapters c ON substr(d.code, 1, 3) BETWEEN c.lo AND c.hi", "diag chapters")
def jn_09(t):
    ranges = K.chapter_table(t.spark).select("lo", "hi", "code_range")
    out = J.range_join(t.diag().select("assessment_id", "line_no", "code"), ranges, F.substring("code", 1, 3), "lo", "hi")
    return out.select("assessment_id", "line_no", "code", "code_range")


@query("jn_10", "SELECT a.beneficiary_id, a.facility_id, a.n, b.total FROM (SELECT beneficiary_id, facility_id, count(*) AS n FROM assess GROUP BY 1, 2) a JOIN "
       f"(SELECT beneficiary_id, facility_id, {q6('sum(amount)', 'total')} FROM assess WHERE status = 'P' GROUP BY 1, 2) b USING (beneficiary_id, facility_id)", "assess")
def jn_10(t):
    a = t.assess().groupBy("beneficiary_id", "facility_id").agg(F.count("*").alias("n"))
    b = t.assess().filter(F.col("status") == "P").groupBy("beneficiary_id", "facility_id").agg(r6(F.sum("amount"), "total"))
    return J.join_multi(a, b, ["beneficiary_id", "facility_id"])


@query("jn_11", f"""SELECT p.beneficiary_id, c.mean_county, g.mean_group FROM patient p
    LEFT JOIN (SELECT county_key, {q6('avg(race_0)', 'mean_county')} FROM patient GROUP BY 1) c ON p.county_key = c.county_key
    LEFT JOIN (SELECT segment, gender_code, {q6('avg(race_0)', 'mean_group')} FROM patient GROUP BY 1, 2) g ON p.segment = g.segment AND p.gender_code = g.gender_code""", "patient")
def jn_11(t):
    p = t.patient()
    county = p.groupBy("county_key").agg(r6(F.avg("race_0"), "mean_county"))
    group = p.groupBy("segment", "gender_code").agg(r6(F.avg("race_0"), "mean_group"))
    out = J.attach_priors(p.select("beneficiary_id", "county_key", "segment", "gender_code"), county, ["county_key"], group, ["segment", "gender_code"])
    return out.select("beneficiary_id", "mean_county", "mean_group")


@query("jn_12", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def jn_12(t):
    big = t("orders").filter(F.col("o_totalprice") > 450000).select(F.col("o_custkey").alias("c_custkey"))
    return J.matching_rows(t("customer").select("c_custkey", "c_name"), big, ["c_custkey"])


@query("jn_13", """SELECT m.condition, count(*) AS n, count(DISTINCT d.code) AS n_codes FROM diag d JOIN charlson_codes m
    ON starts_with(replace(d.code, '.', ''), m.prefix) GROUP BY 1""", "diag charlson_codes")
def jn_13(t):
    from carefold.functions.risk_tables import CHARLSON_CODES
    hits = J.prefix_join(t.diag().select("code"), K.condition_table(t.spark, CHARLSON_CODES), "code", how="inner")
    return hits.groupBy("condition").agg(F.count("*").alias("n"), F.countDistinct("code").alias("n_codes"))


ROW_RANGES = f"(SELECT DISTINCT assessment_id, code_range AS label FROM (SELECT assessment_id, unnest({CODE_LIST}) AS code FROM wide) JOIN chapters ON substr(code, 1, 3) BETWEEN lo AND hi)"


@query("jn_14", f"SELECT x.assessment_id, x.label AS a, y.label AS b FROM {ROW_RANGES} x JOIN {ROW_RANGES} y ON x.assessment_id = y.assessment_id AND x.label < y.label", "wide chapters")
def jn_14(t):
    return J.label_pairs(_chapter_sets(t), "icd_ranges")


@query("jn_15", "SELECT a.county_key, a.n, s.POPPCT_URB FROM (SELECT county_key, count(*) AS n FROM patient GROUP BY 1) a LEFT JOIN sdoh s ON a.county_key = s.county_key", "patient sdoh")
def jn_15(t):
    p = t.patient().select("county_key").join(t.sdoh().select("county_key", "POPPCT_URB"), "county_key", "left")
    agg = p.groupBy("county_key").agg(F.count("*").alias("n"))
    return J.attach_constants(agg, p, "county_key", ["POPPCT_URB"])


# -- aggregations -------------------------------------------------------------------------------
@query("ag_01", "SELECT beneficiary_id, CAST(max(visit_date) AS VARCHAR) AS last_date FROM assess GROUP BY 1", "assess")
def ag_01(t):
    return AG.last_date(t.assess(), "beneficiary_id", "visit_date").withColumn("last_date", F.col("last_date").cast("string"))


@query("ag_02", "SELECT 'all' AS facility, count(DISTINCT beneficiary_id) AS n_unique FROM assess UNION ALL SELECT CAST(facility_id AS VARCHAR), count(DISTINCT beneficiary_id) FROM assess GROUP BY 1", "assess")
def ag_02(t):
    a = t.assess().withColumn("facility", F.col("facility_id").cast("string"))
    whole = AG.n_unique(a, "beneficiary_id").withColumn("facility", F.lit("all"))
    return RS.stack(whole, AG.n_unique(a, "beneficiary_id", ["facility"]))


@query("ag_03", f"SELECT priority, count(*) AS n, {q6('count(*) / (SELECT count(*) FROM assess)', 'share')} FROM assess GROUP BY 1", "assess")
def ag_03(t):
    out = AG.value_counts(t.assess(), "priority", normalize=True)
    return out.select("priority", "n", r6(F.col("share"), "share"))


@query("ag_04", "SELECT facility_id, count(*) FILTER (WHERE status = 'P') AS hospitalized, count(*) FILTER (WHERE amount > 300000) AS expensive FROM assess GROUP BY 1", "assess")
def ag_04(t):
    return AG.count_where(t.assess(), ["facility_id"], {"hospitalized": F.col("status") == "P", "expensive": F.col("amount") > 300000})


@query("ag_05", f"SELECT status, {q6('avg(amount)', 'amount')}, {q6('avg(facility_id)', 'facility_id')} FROM assess GROUP BY 1", "assess")
def ag_05(t):
    out = AG.mean_by(t.assess(), ["status"], ["amount", "facility_id"])
    return out.select("status", r6(F.col("amount"), "amount"), r6(F.col("facility_id"), "facility_id"))


@query("ag_06", "SELECT county_key, min(POPPCT_URB) AS POPPCT_URB, min(ACS_PCT_INC50) AS ACS_PCT_INC50 FROM patient JOIN sdoh USING (county_key) GROUP BY 1", "patient sdoh")
def ag_06(t):
    return AG.first_by(t.patient().select("county_key").join(t.sdoh(), "county_key"), ["county_key"], ["POPPCT_URB", "ACS_PCT_INC50"])


@query("ag_07", "SELECT beneficiary_id, sum(Emergent_Care_Reason_Fall)::BIGINT AS Emergent_Care_Reason_Fall, sum(Hospital_Reason_Injury)::BIGINT AS Hospital_Reason_Injury FROM flags GROUP BY 1", "flags")
def ag_07(t):
    return AG.sum_by(t.flags(), ["beneficiary_id"], ["Emergent_Care_Reason_Fall", "Hospital_Reason_Injury"])


@query("ag_08", "SELECT county_key, segment AS category, count(*) AS n FROM patient GROUP BY 1, 2", "patient")
def ag_08(t):
    return AG.map_rows(AG.count_map(t.patient(), ["county_key"], "segment"), ["county_key"], "counts")


def _chapter_sets(t):
    return row_chapters(t.wide(), CODES).select("assessment_id", "icd_ranges")


@query("ag_09", f"SELECT facility_id, array_to_string(list_sort(list_distinct(array_agg(label))), ',') AS labels FROM {ROW_RANGES} r JOIN assess a ON a.assessment_id = r.assessment_id % {BLOCK} GROUP BY 1", "wide chapters assess")
def ag_09(t):
    sets = t.coded(t.assess().select("assessment_id", "facility_id"), _chapter_sets(t))
    out = AG.label_union(sets, ["facility_id"], "icd_ranges")
    return out.withColumn("labels", F.array_join("labels", ","))


def _gappy(t):
    """A patient table with gaps of different size, an empty string and a complete column."""
    k = F.col("beneficiary_id")
    return t.patient().select("beneficiary_id", "zip", "race_0", F.when(k % 2 == 0, F.col("balance")).alias("balance"),
                              F.when(k % 3 == 0, "").otherwise(F.col("segment")).alias("segment"),
                              F.when(k % 50 == 0, F.col("county_key")).alias("county_key"))


GAPPY = """gappy AS (SELECT beneficiary_id, zip, race_0, CASE WHEN beneficiary_id % 2 = 0 THEN balance END AS balance,
    CASE WHEN beneficiary_id % 3 = 0 THEN '' ELSE segment END AS segment, CASE WHEN beneficiary_id % 50 = 0 THEN county_key END AS county_key FROM patient)"""
GAP_COLS = ["beneficiary_id", "zip", "race_0", "balance", "segment", "county_key"]
MISS = {c: f"({c} IS NULL" + (f" OR {c} = '')" if c in ("zip", "segment") else ")") for c in GAP_COLS}


def _gap_rows(source: str = "gappy") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {MISS[c]}) AS n_missing, count(*) AS n_rows FROM {source}" for c in GAP_COLS)


PROFILE = 'SELECT "column", n_missing, {pct}, CAST(round(n_missing * 100.0::DOUBLE / n_rows / 10) * 10 AS INT) AS missing_group FROM ({rows})'


@query("ag_10", f""", {GAPPY} SELECT missing_group, array_to_string(list_sort(array_agg("column")), ',') AS names, count(*) AS n
    FROM ({PROFILE.format(pct='1 AS x', rows=_gap_rows())}) GROUP BY 1""", "patient")
def ag_10(t):
    out = AG.names_by_bucket(PR.missing_profile(_gappy(t)), "missing_group", "column")
    return out.select("missing_group", F.array_join("names", ",").alias("names"), "n")


@query("ag_11", f"""SELECT * FROM (SELECT county_key, count(*) FILTER (WHERE status = 'F') AS "F", count(*) FILTER (WHERE status = 'O') AS "O",
    count(*) FILTER (WHERE status = 'P') AS "P", count(*) AS total, {q6("count(*) FILTER (WHERE status = 'P') * 100.0 / count(*)", 'rate')} FROM visit GROUP BY 1) WHERE total > 550""", "visit")
def ag_11(t):
    out = AG.crosstab_rate(t.visit(), "county_key", "status", ["F", "O", "P"], "P", 550)
    return out.withColumn("rate", F.round("rate", 6))


def _coded(t):
    return t.long().withColumn("readmitted", (F.col("status") == "P").cast("int"))


@query("ag_12", """SELECT code, count(DISTINCT beneficiary_id) FILTER (WHERE status <> 'P') AS n_0, count(DISTINCT beneficiary_id) FILTER (WHERE status = 'P') AS n_1,
    count(DISTINCT beneficiary_id) FILTER (WHERE status <> 'P') + count(DISTINCT beneficiary_id) FILTER (WHERE status = 'P') AS total FROM long GROUP BY 1""", "long")
def ag_12(t):
    return AG.code_by_outcome(_coded(t), "code", "readmitted", "beneficiary_id")


@query("ag_14", """SELECT split_part(code, '.', 1) AS stem, count(DISTINCT beneficiary_id) AS n_patients, count(*) FILTER (WHERE status <> 'P') AS rows_0,
    count(*) FILTER (WHERE status = 'P') AS rows_1, count(*) AS rows_total FROM long GROUP BY 1""", "long")
def ag_14(t):
    return AG.prefix_stats(_coded(t).withColumn("stem", K.icd_prefix(F.col("code"), "stem")), "stem", "readmitted", "beneficiary_id")


@query("ag_15", "SELECT coalesce(chapter, 'Unknown') AS chapter, count(DISTINCT code) AS n_codes FROM long GROUP BY 1", "long")
def ag_15(t):
    df = t.diag().select("code", F.coalesce(K.icd_range(F.col("code")), F.lit(C.UNKNOWN)).alias("chapter"))
    return RS.sort_by(AG.codes_per_chapter(df, "code", "chapter"), ["n_codes", "chapter"], [False, True])


QUART = "quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75"


@query("ag_16", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, {q6(f'avg({c})', 'mean')}, {q6(f'stddev_samp({c})', 'std')}, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
    {q6(f'quantile_cont({c}::DOUBLE, 0.25)', 'p25')}, {q6(f'quantile_cont({c}::DOUBLE, 0.5)', 'p50')}, {q6(f'quantile_cont({c}::DOUBLE, 0.75)', 'p75')} FROM visit""" for c in ["age", "amount", "balance"]), "visit")
def ag_16(t):
    out = AG.summary(t.visit(), ["age", "amount", "balance"])
    return out.select("column", "n", r6(F.col("mean"), "mean"), r6(F.col("std"), "std"), "min", "max", *[r6(F.col(c), c) for c in ["p25", "p50", "p75"]])


@query("ag_17", f', {GAPPY} SELECT "column", n_missing, n_rows FROM ({_gap_rows()})', "patient")
def ag_17(t):
    return PR.nulls_per_column(_gappy(t))


GAPPY_BY = [c for c in GAP_COLS if c not in ("beneficiary_id", "county_key")]


@query("ag_18", f""", {GAPPY} SELECT county_key, {', '.join(f'count(*) FILTER (WHERE {MISS[c]}) AS {c}_missing' for c in GAPPY_BY)},
    {' + '.join(f'count(*) FILTER (WHERE {MISS[c]})' for c in GAPPY_BY)} AS total_missing
    FROM (SELECT g.* EXCLUDE (county_key), p.county_key FROM gappy g JOIN patient p USING (beneficiary_id)) GROUP BY 1""", "patient")
def ag_18(t):
    df = _gappy(t).drop("county_key").join(t.patient().select("beneficiary_id", "county_key"), "beneficiary_id").drop("beneficiary_id")
    return PR.nulls_per_group(df, "county_key")


@query("ag_19", f""", {GAPPY} SELECT CAST({' + '.join(f'CAST({MISS[c]} AS INT)' for c in GAP_COLS if c != 'beneficiary_id')} AS INT) AS num_missing, count(*) AS n FROM gappy GROUP BY 1""", "patient")
def ag_19(t):
    return PR.row_null_histogram(_gappy(t), "beneficiary_id")


@query("ag_20", f", {GAPPY} {PROFILE.format(pct=q6('n_missing * 100.0 / n_rows', 'missing_percent'), rows=_gap_rows())}", "patient")
def ag_20(t):
    return PR.missing_profile(_gappy(t)).withColumn("missing_percent", F.round("missing_percent", 6))


@query("ag_21", f", {GAPPY} {PROFILE.format(pct=q6('n_missing * 100.0 / n_rows', 'missing_percent'), rows=_gap_rows('(SELECT * FROM gappy WHERE race_0 IS NULL)'))}", "patient")
def ag_21(t):
    df = _gappy(t)
    return PR.missing_profile_where(df, F.col("race_0").isNull()).withColumn("missing_percent", F.round("missing_percent", 6))


@query("ag_22", f""", {GAPPY} SELECT CASE WHEN p = 0 THEN 'Complete (0%)' WHEN p <= 10 THEN '0-10%' WHEN p <= 50 THEN '10-50%' WHEN p <= 95 THEN '50-95%' ELSE '>95%' END AS bucket, count(*) AS n_columns
    FROM (SELECT round(n_missing * 100.0::DOUBLE / n_rows, 1) AS p FROM ({_gap_rows()})) GROUP BY 1""", "patient")
def ag_22(t):
    return PR.completeness_buckets(_gappy(t))


CORR_COLS = ["f_quantity", "f_price", "f_discount", "f_tax", "f_line", "f_price_copy", "f_empty", "f_signal"]


def corr_sql(a: str, b: str, source: str = "features") -> str:
    """r over rows where both are present, null when either is constant there."""
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    return (f"(SELECT CASE WHEN count(*) > 0 AND max({a}) > min({a}) AND max({b}) > min({b}) THEN round(corr({a}::DOUBLE, {b}::DOUBLE), 6) + 0.0::DOUBLE END "
            f"FROM {source} WHERE {both})")


def corr_pairs_sql(cols: list[str], source: str = "features") -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, {corr_sql(a, b, source)} AS r" for n, a in enumerate(cols) for b in cols[n + 1:])


@query("ag_23", corr_pairs_sql(CORR_COLS), "features")
def ag_23(t):
    return PR.corr_matrix(t.features(), CORR_COLS).select("i", "j", r6(F.col("r"), "r"))


@query("ag_24", f"SELECT i, j, r FROM ({corr_pairs_sql(CORR_COLS)}) WHERE abs(r) >= 0.95", "features")
def ag_24(t):
    return PR.high_corr_pairs(t.features(), CORR_COLS).select("i", "j", r6(F.col("r"), "r"))


@query("ag_25", "SELECT feature, r FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {corr_sql(c, 'target')} AS r" for c in CORR_COLS) + ") WHERE r IS NOT NULL ORDER BY r DESC, feature LIMIT 3", "features")
def ag_25(t):
    out = PR.target_corr(t.features(), CORR_COLS, "target").select("feature", r6(F.col("r"), "r")).filter(F.col("r").isNotNull())
    return RS.top_k(out, "r", 3, tie=["feature"])


DOM_COLS = ["f_quantity", "f_discount", "f_rare", "f_line"]


@query("ag_26", " UNION ALL ".join(f"""SELECT '{c}' AS "column", {q6(f'(SELECT max(n) FROM (SELECT count(*) AS n FROM features WHERE {c} IS NOT NULL GROUP BY {c})) / count({c})', 'share')} FROM features""" for c in DOM_COLS), "features")
def ag_26(t):
    return PR.dominant_share(t.features(), DOM_COLS).select("column", r6(F.col("share"), "share"))


@query("ag_27", f"SELECT status, count(amount) AS n, {q6('avg(amount)', 'mean')}, {q6('quantile_cont(amount, 0.25)', 'q1')}, {q6('quantile_cont(amount, 0.5)', 'median')}, {q6('quantile_cont(amount, 0.75)', 'q3')} FROM assess GROUP BY 1", "assess")
def ag_27(t):
    out = AG.box_summary(t.assess(), "status", "amount")
    return out.select("status", "n", *[r6(F.col(c), c) for c in ["mean", "q1", "median", "q3"]])


@query("ag_28", f""", e AS (SELECT status, min(age) AS lo, max(age) AS hi, count(age) AS t FROM visit GROUP BY 1)
    SELECT v.status, CAST(least(floor((v.age - e.lo) / ((e.hi - e.lo) / 50.0::DOUBLE)), 49) AS INT) AS bin, count(*) AS n,
    {q6('count(*) / (min(e.t) * min((e.hi - e.lo) / 50.0::DOUBLE))', 'density')} FROM visit v JOIN e USING (status) GROUP BY 1, 2""", "visit")
def ag_28(t):
    return AG.histogram(t.visit(), "age", "status").select("status", "bin", "n", r6(F.col("density"), "density"))


@query("ag_29", """SELECT count(*) FILTER (WHERE e AND h) AS both, count(*) FILTER (WHERE e AND NOT h) AS only_a, count(*) FILTER (WHERE h AND NOT e) AS only_b, count(*) FILTER (WHERE e) AS all_a
    FROM (SELECT coalesce(Emergent_Care_Reason_Fall <> 0, FALSE) OR coalesce(CAST(Emergent_Care_Reason_Other AS INT) <> 0, FALSE) AS e, coalesce(Hospital_Reason_Injury <> 0, FALSE) AS h FROM flags)""", "flags")
def ag_29(t):
    from carefold.operators.columns import any_filled
    return AG.flag_overlap(t.flags(), any_filled(["Emergent_Care_Reason_Fall", "Emergent_Care_Reason_Other"]), any_filled(["Hospital_Reason_Injury"]))


@query("ag_30", "SELECT CAST(" + " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in CODES) + " AS INT) AS n_filled, count(DISTINCT beneficiary_id) AS n_patients FROM wide w JOIN assess a ON a.assessment_id = w.assessment_id % " + str(BLOCK) + " GROUP BY 1", "wide assess")
def ag_30(t):
    return AG.patients_by_filled(_patient_codes(t), count_filled(CODES), "beneficiary_id")


@query("ag_31", """SELECT beneficiary_id, coalesce(v, 'UNKNOWN') AS mode FROM (SELECT beneficiary_id, v, row_number() OVER (PARTITION BY beneficiary_id ORDER BY (v IS NULL)::INT, n DESC, v) AS rn FROM
    (SELECT beneficiary_id, CASE WHEN assessment_id % 4 = 0 THEN priority END AS v, count(*) AS n FROM assess GROUP BY 1, 2)) WHERE rn = 1""", "assess")
def ag_31(t):
    df = t.assess().select("beneficiary_id", F.when(F.col("assessment_id") % 4 == 0, F.col("priority")).alias("v"))
    return AG.mode_by(df, ["beneficiary_id"], "v")


@query("ag_32", f"SELECT a, b, count(*) AS weight FROM (SELECT x.label AS a, y.label AS b FROM {ROW_RANGES} x JOIN {ROW_RANGES} y ON x.assessment_id = y.assessment_id AND x.label < y.label) GROUP BY 1, 2 HAVING count(*) >= 2", "wide chapters")
def ag_32(t):
    return AG.cooccurrence(J.label_pairs(_chapter_sets(t), "icd_ranges").select("a", "b"))


@query("ag_33", "SELECT CAST(count(*) FILTER (WHERE (race_0 IS NULL) <> (race_1 IS NULL) OR (race_0 IS NULL) <> (race_5 IS NULL)) = 0 AS INT) AS same FROM patient", "patient")
def ag_33(t):
    return PR.same_nulls(t.patient(), ["race_0", "race_1", "race_5"])


@query("ag_34", " UNION ALL ".join(f"SELECT 'ByDiscipline_{d}' AS flag, {q6('avg((gender_code = 2)::INT)', 'rate')} FROM patient WHERE discipline_code = {k}" for k, d in C.DISCIPLINE.items())
       + f" UNION ALL SELECT 'overall', {q6('avg((gender_code = 2)::INT)', 'rate')} FROM patient", "patient")
def ag_34(t):
    from carefold.operators.encoding import one_hot
    df = t.patient().select(S.decode(F.col("discipline_code"), C.DISCIPLINE).alias("ByDiscipline"), (F.col("gender_code") == 2).cast("int").alias("target"))
    coded = one_hot(df, ["ByDiscipline"], levels={"ByDiscipline": list(C.DISCIPLINE.values())})
    return AG.rate_by_flag(coded, [c for c in coded.columns if c != "target"], "target").select("flag", r6(F.col("rate"), "rate"))


@query("ag_37", "SELECT segment AS category, count(*) AS n FROM patient GROUP BY 1", "patient")
def ag_37(t):
    return AG.sum_category_counts(AG.count_map(t.patient(), ["county_key"], "segment"), "counts")


@query("ag_38", f"SELECT label, count(*) AS n FROM {ROW_RANGES} GROUP BY 1", "wide chapters")
def ag_38(t):
    return AG.range_counts(_chapter_sets(t), "icd_ranges")


# -- windows ------------------------------------------------------------------------------------
KEYS = ["beneficiary_id", "facility_id"]
WIN = "OVER (PARTITION BY beneficiary_id, facility_id ORDER BY visit_date"


def _text_dates(df, *cols):
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


@query("wn_01", f"SELECT assessment_id, count(assessment_id) {WIN}) AS num_visits FROM assess", "assess")
def wn_01(t):
    return V.visit_number(t.assess(), KEYS, "visit_date", "assessment_id").select("assessment_id", "num_visits")


@query("wn_02", f"SELECT assessment_id, CAST(lag(visit_date) {WIN}, assessment_id) AS VARCHAR) AS prev_visit_date FROM assess", "assess")
def wn_02(t):
    out = V.previous_visit(t.assess(), KEYS, "visit_date", "assessment_id").select("assessment_id", "prev_visit_date")
    return _text_dates(out, "prev_visit_date")


@query("wn_03", f"SELECT assessment_id, CAST(visit_date - lag(visit_date) {WIN}, assessment_id) AS INT) AS days_between_visits FROM assess", "assess")
def wn_03(t):
    return V.visit_gap(t.assess(), KEYS, "visit_date", "assessment_id").select("assessment_id", "days_between_visits")


@query("wn_04", """SELECT assessment_id, count(*) OVER (PARTITION BY beneficiary_id, visit_date) AS num_visits,
    CAST(visit_date - lag(visit_date) OVER (PARTITION BY beneficiary_id, visit_date ORDER BY assessment_id) AS INT) AS days_between_visits FROM assess""", "assess")
def wn_04(t):
    return V.visit_gap_same_day(t.assess(), "beneficiary_id", "visit_date", "assessment_id").select("assessment_id", "num_visits", "days_between_visits")


@query("wn_05", "SELECT assessment_id, CAST(max(visit_date) OVER (PARTITION BY beneficiary_id) - (visit_date - CAST(assessment_id % 60 AS INT)) AS INT) AS days_cared_for FROM assess", "assess")
def wn_05(t):
    a = t.assess().withColumn("start", F.date_sub("visit_date", (F.col("assessment_id") % 60).cast("int")))
    return V.days_cared_for(a, "beneficiary_id", "visit_date", "start").select("assessment_id", "days_cared_for")


@query("wn_06", "SELECT beneficiary_id, status, assessment_id, amount FROM (SELECT *, row_number() OVER (PARTITION BY beneficiary_id, status ORDER BY visit_date, assessment_id) AS rn FROM assess) WHERE rn = 1", "assess")
def wn_06(t):
    return V.one_per_key(t.assess(), ["beneficiary_id", "status"], ["visit_date", "assessment_id"]).select("beneficiary_id", "status", "assessment_id", "amount")


@query("visit_history_report", f"""SELECT status, readmitted, count(*) AS n, {q6('avg(num_visits)', 'mean_visits')}, {q6('avg(gap)', 'mean_gap')}, {q6('avg(cared)', 'mean_days_cared_for')},
    max(last_date)::VARCHAR AS last_date FROM (SELECT *, CAST(next_gap IS NOT NULL AND next_gap < 30 AS INT) AS readmitted FROM (
    SELECT *, count(assessment_id) {WIN}) AS num_visits, visit_date - lag(visit_date) {WIN}, assessment_id) AS gap,
    visit_date - lag(visit_date) {WIN}, assessment_id) AS next_gap, max(visit_date) OVER (PARTITION BY beneficiary_id) - visit_date AS cared,
    max(visit_date) OVER (PARTITION BY beneficiary_id) AS last_date FROM assess)) GROUP BY 1, 2""", "assess")
def visit_history_report(t):
    """Visit number, gap, last date, days cared for and readmission within 30 days, per status."""
    h = V.days_cared_for(V.visit_history(t.assess(), KEYS, "visit_date", "assessment_id"), "beneficiary_id", "visit_date", "visit_date")
    h = h.withColumn("readmitted", S.readmitted(F.col("visit_date"), F.col("prev_visit_date")))
    return h.groupBy("status", "readmitted").agg(
        F.count("*").alias("n"), r6(F.avg("num_visits"), "mean_visits"), r6(F.avg("days_between_visits"), "mean_gap"),
        r6(F.avg("days_cared_for"), "mean_days_cared_for"), F.max("last_date").cast("string").alias("last_date"))


# -- sort, sets, reshape ------------------------------------------------------------------------
@query("srt_01", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def srt_01(t):
    return RS.sort_by(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], [False, True])


@query("srt_02", "(SELECT 'top' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) UNION ALL (SELECT 'bottom', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10)")
def srt_02(t):
    o = t("orders").select("o_orderkey", "o_totalprice")
    top = RS.top_k(o, "o_totalprice", 10, tie=["o_orderkey"]).withColumn("side", F.lit("top"))
    return RS.stack(top, RS.top_k(o, "o_totalprice", 10, largest=False, tie=["o_orderkey"]).withColumn("side", F.lit("bottom")))


@query("srt_03", "SELECT " + ", ".join(f"CAST({c} IS NULL AS INT) AS {c}" for c in CODES) + " FROM (SELECT * FROM wide ORDER BY assessment_id LIMIT 200)", "wide")
def srt_03(t):
    return PR.null_matrix(t.wide(), CODES, 200, key="assessment_id")


@query("set_01", "SELECT s_suppkey AS k, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def set_01(t):
    s = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"))
    c = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return RS.stack(s, c)


@query("set_02", "SELECT DISTINCT beneficiary_id, facility_id, status FROM assess", "assess")
def set_02(t):
    return RS.drop_duplicates(t.assess().select("beneficiary_id", "facility_id", "status"))


@query("set_03", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_03(t):
    o = t("orders").withColumnRenamed("o_custkey", "k")
    return RS.key_intersection(o.filter(F.col("o_orderstatus") == "P"), o.filter(F.col("o_orderstatus") == "F"), "k")


@query("set_04", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_04(t):
    o = t("orders").filter(F.col("o_orderstatus") == "F").withColumnRenamed("o_custkey", "k")
    return RS.only_in(t("customer").withColumnRenamed("c_custkey", "k"), o, "k")


@query("rsh_01", " UNION ALL ".join(f"SELECT assessment_id, '{c}' AS source, {c} AS code FROM wide" for c in CODES), "wide")
def rsh_01(t):
    return RS.melt(t.wide(), ["assessment_id"], CODES, "source", "code")


@query("rsh_02", f"SELECT assessment_id, label AS icd_ranges FROM {ROW_RANGES}", "wide chapters")
def rsh_02(t):
    return RS.explode_list(_chapter_sets(t), "icd_ranges")


@query("rsh_03", "SELECT 'n' AS \"column\", count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'cheapest', min(o_totalprice) FROM orders UNION ALL SELECT 'dearest', max(o_totalprice) FROM orders")
def rsh_03(t):
    row = t("orders").agg(F.count("*").cast("double").alias("n"), F.min("o_totalprice").alias("cheapest"), F.max("o_totalprice").alias("dearest"))
    return RS.transpose_row(row)


@query("rsh_04", "SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INT) AS seg_building, CAST(c_acctbal > 0 AS INT) AS positive FROM customer")
def rsh_04(t):
    return RS.add_blocks(t("customer"), [(F.col("c_mktsegment") == "BUILDING").cast("int").alias("seg_building")],
                         [(F.col("c_acctbal") > 0).cast("int").alias("positive")]).select("c_custkey", "seg_building", "positive")
