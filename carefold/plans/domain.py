"""The care domain expressed on the given tables: every view exists once for Spark and once as a SQL
common table expression, so that a query and its check start from the same rows.

orders = assessments, customer = patients, lineitem = diagnosis rows and scored rows, supplier =
social-determinant attributes per area, nation / region = county / state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from carefold.functions import constants as C
from carefold.functions.codes import icd_range
from carefold.session import dealt

CODES = [f"code_{i}" for i in range(1, 7)]
#: An assessment has six code columns. Further codes of an order go to further assessment rows, whose keys lie this far apart.
BLOCK = 1 << 50


class Tables:
    """Lazy access to the tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- views ------------------------------------------------------------------------------
    def assess(self) -> DataFrame:
        return self("orders").select(
            F.col("o_orderkey").alias("assessment_id"), F.col("o_custkey").alias("beneficiary_id"),
            (F.col("o_orderkey") % 3).cast("int").alias("facility_id"), F.col("o_orderdate").cast("date").alias("visit_date"),
            F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"),
            F.col("o_orderpriority").alias("priority"))

    def patient(self) -> DataFrame:
        k, n = F.col("c_custkey"), F.col("c_nationkey")
        zip5 = (75000 + n).cast("string")
        # the birth date is a day offset from a fixed date
        return self("customer").select(
            k.alias("beneficiary_id"), F.date_add(F.lit("1920-01-01").cast("date"), (k * 37 % 29000).cast("int")).alias("birth_date"),
            (k % 2 + 1).cast("int").alias("gender_code"), (k % 5 + 1).cast("int").alias("discipline_code"),
            F.when(k % 5 == 0, F.concat(zip5, F.lit("-1234"))).when(k % 5 == 1, (501 + n).cast("string"))
            .when(k % 5 == 2, F.lit(None)).when(k % 5 == 3, F.lit("junk")).otherwise(zip5).alias("zip"),
            n.alias("county_key"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
            *[F.when(k % 11 != 0, (k % 6 == i).cast("double")).alias(f"race_{i}") for i in range(6)])

    def visit(self) -> DataFrame:
        """Assessments with the patient's attributes and age."""
        v = self.assess().join(self.patient(), "beneficiary_id")
        return v.withColumn("age", (F.datediff("visit_date", "birth_date") / F.lit(365)).cast("int"))

    def diag(self) -> DataFrame:
        p = F.col("l_partkey")
        code = F.concat(F.char(65 + p % 26), F.lpad((p % 100).cast("string"), 2, "0"), F.lit("."), (p % 10).cast("string"))
        return self("lineitem").select(
            F.col("l_orderkey").alias("assessment_id"), F.col("l_linenumber").alias("line_no"), code.alias("code"),
            "l_partkey", "l_suppkey", "l_shipdate")

    def wide(self) -> DataFrame:
        """All codes of every order, six an assessment row: the first row has the order's key, every further one a key that is
        BLOCK larger. The second grouping keeps the window's partitioning, so rows are shuffled once; the parts are as many as the rows need."""
        w = W.partitionBy("assessment_id").orderBy("line_no", "l_partkey", "l_suppkey", "l_shipdate")
        placed = dealt(self.diag(), self("lineitem").count(), "assessment_id").withColumn("rn", F.row_number().over(w) - 1)
        rows = placed.groupBy("assessment_id", F.floor(F.col("rn") / 6).alias("block")).agg(
            *[F.max(F.when(F.col("rn") % 6 == i, F.col("code"))).alias(c) for i, c in enumerate(CODES)])
        return rows.select((F.col("assessment_id") + F.col("block") * BLOCK).alias("assessment_id"), *CODES)

    def coded(self, df: DataFrame, wide: DataFrame | None = None, how: str = "inner") -> DataFrame:
        """``df`` (one row per order) with the code rows of its orders; the key becomes that of the code row."""
        w = (self.wide() if wide is None else wide).withColumn("_order", F.col("assessment_id") % BLOCK)
        own = df.withColumnRenamed("assessment_id", "_order")
        out = own.join(w, "_order", how)
        return out.withColumn("assessment_id", F.coalesce("assessment_id", "_order"))

    def long(self) -> DataFrame:
        """Distinct-free long diagnosis rows with patient, age and chapter."""
        a = self.assess().select("assessment_id", "beneficiary_id", "status")
        return self.diag().select("assessment_id", "code").join(a, "assessment_id").withColumn("chapter", icd_range(F.col("code")))

    def flags(self) -> DataFrame:
        """Assessments with raw reason flags: numbers, text numbers and nulls."""
        k, s = F.col("assessment_id"), F.col("status")
        return self.assess().select(
            "*", F.when(s == "O", 1).when(k % 7 != 0, 0).alias("Emergent_Care_Reason_Fall"),
            F.when(k % 13 == 0, "1").when(k % 5 != 0, "0").alias("Emergent_Care_Reason_Other"),
            F.when(s == "P", 1).when(k % 9 != 0, 0).alias("Hospital_Reason_Injury"))

    def assessments(self) -> DataFrame:
        """Assessments with readable names: one row per order with the patient's attributes, reason
        flags, six codes, body measures and an ordinal item with sentinels."""
        k = F.col("_order")
        a = self.coded(self.flags().join(self.patient(), "beneficiary_id"), how="left")
        names = {f"race_{i}": c for i, c in enumerate(C.RACE_COLUMNS)}
        return a.select(
            F.col("assessment_id").alias("Assessment_ID"), F.col("beneficiary_id").alias("Beneficiary_ID"), F.col("facility_id").alias("Facility_Internal_ID"),
            F.concat(F.lit("S"), (F.col("county_key") % 5).cast("string")).alias("State_ID"), F.col("priority").alias("Submitted_HIPPS_Code"),
            F.concat(F.lit("A"), (k % 17).cast("string")).alias("Agency_Medicare_Number"), F.col("visit_date").alias("Assessment_Effective_Date"),
            F.trunc("visit_date", "year").alias("Start_of_Care_Date"),
            F.when(k % 4 != 0, F.date_add("visit_date", (k % 90 - 20).cast("int"))).alias("Resumption_of_Care_Date"), F.col("zip").alias("Patient_ZIP_Code"),
            F.col("birth_date").alias("Patient_Birth_Date"), F.col("gender_code").alias("Gender"), F.col("discipline_code").alias("Discipline_of_Person_Completing_Assessment"),
            *[F.col(r).alias(c) for r, c in names.items()],
            F.when(F.col("status") == "F", "00").when(F.col("status") == "O", "01").alias("Patient_Overall_Status"),
            "Emergent_Care_Reason_Fall", "Emergent_Care_Reason_Other", "Hospital_Reason_Injury", *[F.col(c).alias(n) for c, n in zip(CODES, C.CODE_COLUMNS)],
            F.when(k % 17 == 0, "-").otherwise((k % 16 + 60).cast("string")).alias("Height_in_inches"),
            F.when(k % 19 != 0, (k % 200 + 90).cast("string")).alias("Weight_in_pounds"),
            F.when(k % 9 == 0, "UK").when(k % 9 == 1, "88").otherwise((k % 4).cast("string")).alias("Ability_To_Hear"),
            F.when(k % 400 == 0, F.lit(1)).alias("Sparse_Item"), F.when(k % 20 == 0, (k % 3).cast("int")).alias("Wound_Count"), (k % 2).cast("int").alias("Medicare_Fee_For_Service"))

    def zip_areas(self) -> DataFrame:
        return self.sdoh().withColumn("zip5", (F.col("county_key") + 75000).cast("string")).drop("county_key")

    def sdoh(self) -> DataFrame:
        b = F.col("s_acctbal")
        urb = F.round(F.avg(F.when(b > 5000, 100.0).otherwise(0.0)), 4)
        return self("supplier").groupBy(F.col("s_nationkey").alias("county_key")).agg(
            F.round(F.avg(b) / F.lit(100.0), 4).alias("ACS_PCT_HS_GRADUATE"), F.round(F.max(b) / F.lit(100.0), 4).alias("ACS_PCT_POSTHS_ED"),
            F.count("*").cast("double").alias("ACS_PCT_HH_LIMIT_ENGLISH"), F.round(F.min(b) / F.lit(50.0), 4).alias("ACS_PCT_HH_BROADBAND"),
            F.round((F.max(b) - F.min(b)) / F.lit(200.0), 4).alias("ACS_PCT_HH_1PERS"),
            F.count_if(b < 2000).cast("double").alias("ACS_PCT_INC50"), urb.alias("POPPCT_URB"), (F.lit(100.0) - urb).alias("POPPCT_RUR"))

    def county_sdoh(self) -> DataFrame:
        n = self("nation").select(F.col("n_nationkey").alias("county_key"), F.col("n_name").alias("county"), F.col("n_regionkey").alias("state_key"))
        return self.sdoh().join(n, "county_key")

    def features(self) -> DataFrame:
        """Numeric matrix with an unbalanced target, a near copy, a dominant and an empty column."""
        q, e, d, x = (F.col(c) for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
        return self("lineitem").select(
            q.alias("f_quantity"), e.alias("f_price"), d.alias("f_discount"), x.alias("f_tax"), (e * F.lit(2.0) + q).alias("f_price_copy"),
            F.when(F.col("l_partkey") % 500 == 0, 1).otherwise(0).alias("f_rare"), F.lit(None).cast("double").alias("f_empty"),
            F.when(F.col("l_partkey") % 7 != 0, F.col("l_linenumber")).alias("f_line"),
            (e * d - F.when(F.col("l_returnflag") == "R", 900.0).otherwise(0.0)).alias("f_signal"),
            (F.col("l_returnflag") == "R").cast("int").alias("target"))

    def matrix(self) -> DataFrame:
        """The feature matrix with a row key made of the columns that identify a line."""
        names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
        e, d = F.col("l_extendedprice"), F.col("l_discount")
        lost = F.when(F.col("l_returnflag") == "R", 900.0).otherwise(0.0)
        return self("lineitem").select(
            F.concat_ws("|", *[F.col(c).cast("string") for c in names]).alias("row_key"), F.col("l_quantity").alias("f_quantity"), e.alias("f_price"),
            d.alias("f_discount"), F.col("l_tax").alias("f_tax"), F.col("l_linenumber").cast("double").alias("f_line"), (e * d - lost).alias("f_signal"),
            (F.col("l_suppkey") % 10).cast("double").alias("ACS_PCT_INC50"), (F.col("l_returnflag") == "R").cast("int").alias("target"))

    def scored(self) -> DataFrame:
        p = F.round(F.col("l_discount") * F.lit(10.0), 2)
        return self("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), p.alias("probability"),
                                       (p >= 0.5).cast("int").alias("prediction"))

    def scored3(self) -> DataFrame:
        """Three-class scores: true class from the status, predicted class and probabilities."""
        k = F.col("o_orderkey")
        true = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
        p0, p1, p2 = (k % 7 + 1), (k % 5 + 1), (k % 3 + 1)
        total = (p0 + p1 + p2).cast("double")
        pred = F.when((p0 >= p1) & (p0 >= p2), 0).when(p1 >= p2, 1).otherwise(2)
        return self("orders").select(true.alias("label"), pred.alias("prediction"), (p0 / total).alias("p0"), (p1 / total).alias("p1"),
                                     (p2 / total).alias("p2"), k.alias("row_id"))


# -- the same views for the SQL checks ---------------------------------------------------------
CTE = {
    "assess": ([], """SELECT o_orderkey AS assessment_id, o_custkey AS beneficiary_id, CAST(o_orderkey % 3 AS INT) AS facility_id,
        CAST(o_orderdate AS DATE) AS visit_date, o_orderstatus AS status, o_totalprice AS amount, o_orderpriority AS priority FROM orders"""),
    "patient": ([], """SELECT c_custkey AS beneficiary_id, DATE '1920-01-01' + CAST(c_custkey * 37 % 29000 AS INT) AS birth_date,
        CAST(c_custkey % 2 + 1 AS INT) AS gender_code, CAST(c_custkey % 5 + 1 AS INT) AS discipline_code,
        CASE c_custkey % 5 WHEN 0 THEN CAST(75000 + c_nationkey AS VARCHAR) || '-1234' WHEN 1 THEN CAST(501 + c_nationkey AS VARCHAR)
          WHEN 2 THEN NULL WHEN 3 THEN 'junk' ELSE CAST(75000 + c_nationkey AS VARCHAR) END AS zip,
        c_nationkey AS county_key, c_mktsegment AS segment, c_acctbal AS balance,
        """ + ", ".join(f"CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey % 6 = {i} AS INT)::DOUBLE END AS race_{i}" for i in range(6)) + " FROM customer"),
    "visit": (["assess", "patient"], """SELECT a.*, p.* EXCLUDE (beneficiary_id),
        CAST(trunc(date_diff('day', p.birth_date, a.visit_date) / 365.0) AS INT) AS age
        FROM assess a JOIN patient p ON a.beneficiary_id = p.beneficiary_id"""),
    "diag": ([], """SELECT l_orderkey AS assessment_id, l_linenumber AS line_no, chr(CAST(65 + l_partkey % 26 AS INT))
        || lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0') || '.' || CAST(l_partkey % 10 AS VARCHAR) AS code,
        l_partkey, l_suppkey, l_shipdate FROM lineitem"""),
    "wide": (["diag"], f"SELECT CAST(diag.assessment_id + rn // 6 * {BLOCK} AS BIGINT) AS assessment_id, " + ", ".join(f"max(code) FILTER (WHERE rn % 6 = {i - 1}) AS code_{i}" for i in range(1, 7)) + """
        FROM (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY line_no, l_partkey, l_suppkey, l_shipdate) - 1 AS rn FROM diag) diag
        GROUP BY diag.assessment_id, rn // 6"""),
    "long": (["diag", "assess", "chapters"], """SELECT d.assessment_id, d.code, a.beneficiary_id, a.status, c.code_range AS chapter FROM diag d
        JOIN assess a ON d.assessment_id = a.assessment_id LEFT JOIN chapters c ON substr(d.code, 1, 3) BETWEEN c.lo AND c.hi"""),
    "flags": (["assess"], """SELECT *, CASE WHEN status = 'O' THEN 1 WHEN assessment_id % 7 <> 0 THEN 0 END AS Emergent_Care_Reason_Fall,
        CASE WHEN assessment_id % 13 = 0 THEN '1' WHEN assessment_id % 5 <> 0 THEN '0' END AS Emergent_Care_Reason_Other,
        CASE WHEN status = 'P' THEN 1 WHEN assessment_id % 9 <> 0 THEN 0 END AS Hospital_Reason_Injury FROM assess"""),
    "asm": (["flags", "patient", "wide"], """SELECT coalesce(w.assessment_id, f.assessment_id) AS Assessment_ID, f.beneficiary_id AS Beneficiary_ID, f.facility_id AS Facility_Internal_ID,
        'S' || CAST(p.county_key % 5 AS VARCHAR) AS State_ID, f.priority AS Submitted_HIPPS_Code, 'A' || CAST(f.assessment_id % 17 AS VARCHAR) AS Agency_Medicare_Number,
        f.visit_date AS Assessment_Effective_Date, CAST(date_trunc('year', f.visit_date) AS DATE) AS Start_of_Care_Date,
        CASE WHEN f.assessment_id % 4 <> 0 THEN f.visit_date + CAST(f.assessment_id % 90 - 20 AS INT) END AS Resumption_of_Care_Date, p.zip AS Patient_ZIP_Code,
        p.birth_date AS Patient_Birth_Date, p.gender_code AS Gender, p.discipline_code AS Discipline_of_Person_Completing_Assessment,
        """ + ", ".join(f"p.race_{i} AS {c}" for i, c in enumerate(C.RACE_COLUMNS)) + """,
        CASE f.status WHEN 'F' THEN '00' WHEN 'O' THEN '01' END AS Patient_Overall_Status, f.Emergent_Care_Reason_Fall, f.Emergent_Care_Reason_Other, f.Hospital_Reason_Injury,
        """ + ", ".join(f"w.code_{i + 1} AS {n}" for i, n in enumerate(C.CODE_COLUMNS)) + """,
        CASE WHEN f.assessment_id % 17 = 0 THEN '-' ELSE CAST(f.assessment_id % 16 + 60 AS VARCHAR) END AS Height_in_inches,
        CASE WHEN f.assessment_id % 19 <> 0 THEN CAST(f.assessment_id % 200 + 90 AS VARCHAR) END AS Weight_in_pounds,
        CASE WHEN f.assessment_id % 9 = 0 THEN 'UK' WHEN f.assessment_id % 9 = 1 THEN '88' ELSE CAST(f.assessment_id % 4 AS VARCHAR) END AS Ability_To_Hear,
        CASE WHEN f.assessment_id % 400 = 0 THEN 1 END AS Sparse_Item, CASE WHEN f.assessment_id % 20 = 0 THEN CAST(f.assessment_id % 3 AS INT) END AS Wound_Count,
        CAST(f.assessment_id % 2 AS INT) AS Medicare_Fee_For_Service
        FROM flags f JOIN patient p ON f.beneficiary_id = p.beneficiary_id LEFT JOIN wide w ON f.assessment_id = w.assessment_id % """ + str(BLOCK)),
    "zip_areas": (["sdoh"], "SELECT * EXCLUDE (county_key), CAST(75000 + county_key AS VARCHAR) AS zip5 FROM sdoh"),
    "sdoh": ([], """SELECT *, 100.0::DOUBLE - POPPCT_URB AS POPPCT_RUR FROM (SELECT s_nationkey AS county_key, round(avg(s_acctbal) / 100.0, 4) AS ACS_PCT_HS_GRADUATE,
        round(max(s_acctbal) / 100.0, 4) AS ACS_PCT_POSTHS_ED, count(*)::DOUBLE AS ACS_PCT_HH_LIMIT_ENGLISH,
        round(min(s_acctbal) / 50.0, 4) AS ACS_PCT_HH_BROADBAND, round((max(s_acctbal) - min(s_acctbal)) / 200.0, 4) AS ACS_PCT_HH_1PERS,
        count(*) FILTER (WHERE s_acctbal < 2000)::DOUBLE AS ACS_PCT_INC50,
        round(avg(CASE WHEN s_acctbal > 5000 THEN 100.0::DOUBLE ELSE 0 END), 4) AS POPPCT_URB FROM supplier GROUP BY s_nationkey)"""),
    "county_sdoh": (["sdoh"], """SELECT s.*, n.n_name AS county, n.n_regionkey AS state_key FROM sdoh s JOIN nation n ON s.county_key = n.n_nationkey"""),
    "features": ([], """SELECT l_quantity AS f_quantity, l_extendedprice AS f_price, l_discount AS f_discount, l_tax AS f_tax,
        l_extendedprice * 2.0 + l_quantity AS f_price_copy, CASE WHEN l_partkey % 500 = 0 THEN 1 ELSE 0 END AS f_rare, CAST(NULL AS DOUBLE) AS f_empty,
        CASE WHEN l_partkey % 7 <> 0 THEN l_linenumber END AS f_line,
        l_extendedprice * l_discount - CASE WHEN l_returnflag = 'R' THEN 900.0::DOUBLE ELSE 0 END AS f_signal,
        CAST(l_returnflag = 'R' AS INT) AS target FROM lineitem"""),
    "matrix": ([], """SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS row_key, l_quantity AS f_quantity, l_extendedprice AS f_price,
        l_discount AS f_discount, l_tax AS f_tax, l_linenumber::DOUBLE AS f_line, l_extendedprice * l_discount - CASE WHEN l_returnflag = 'R' THEN 900.0::DOUBLE ELSE 0 END AS f_signal,
        (l_suppkey % 10)::DOUBLE AS ACS_PCT_INC50, CAST(l_returnflag = 'R' AS INT) AS target FROM lineitem"""),
    "scored": ([], """SELECT CAST(l_returnflag = 'R' AS INT) AS label, round(l_discount * 10, 2) AS probability,
        CAST(round(l_discount * 10, 2) >= 0.5 AS INT) AS prediction FROM lineitem"""),
    "scored3": ([], """SELECT label, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS prediction,
        a / (a + b + c)::DOUBLE AS p0, b / (a + b + c)::DOUBLE AS p1, c / (a + b + c)::DOUBLE AS p2, row_id
        FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label, o_orderkey % 7 + 1 AS a, o_orderkey % 5 + 1 AS b,
              o_orderkey % 3 + 1 AS c, o_orderkey AS row_id FROM orders)"""),
}


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(lit(x) for x in r) + ')' for r in rows)}) AS v({names})"


def constant_cte(name: str, rows: list[tuple], names: str) -> None:
    CTE[name] = ([], _values(rows, names))


def with_views(views: str, body: str) -> str:
    """``WITH`` the named views and whatever they build on, then the query."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in CTE[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for v in views.split():
        add(v)
    if not order:
        return body
    head = ", ".join(f"{n} AS ({CTE[n][1]})" for n in order)
    more = body.lstrip().startswith(",")
    return f"WITH RECURSIVE {head}{',' if more else ''} {body.lstrip().lstrip(',')}"


def _register_constants() -> None:
    from carefold.functions import constants as C
    from carefold.functions import risk_tables as R
    from carefold.functions.codes import expand_codes

    constant_cte("chapters", [(i, *s.split("-"), s, t) for i, (s, t) in enumerate(C.ICD_CHAPTERS)], "pos, lo, hi, code_range, section")
    for name, codes in [("charlson_codes", R.CHARLSON_CODES), ("elix_codes", R.ELIXHAUSER_CODES), ("disab_codes", R.DISABILITY_CODES)]:
        constant_cte(name, [(c, p) for c, text in codes.items() for p in expand_codes(text)], "condition, prefix")
    constant_cte("hfrs_points", [(c, round(p * 10)) for c, p in R.HFRS_POINTS.items()], "category, tenths")
    constant_cte("topics", [(t, i) for t, names in C.TOPICS.items() for i in names], "topic, indicator")
    constant_cte("dx_codes", [(f, p) for f, ps in C.DX_PREFIXES.items() for p in ps], "flag, prefix")


_register_constants()


def md5_sql(key: str) -> str:
    """SQL for the 32-bit md5 hash used by the samplers."""
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"


def r6(c: Column, name: str) -> Column:
    """Six decimals: enough to compare sums taken in a different order. Adding zero removes -0.0."""
    return (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(name)


def q6(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0::DOUBLE AS {name}"
