"""Sampling, splits, balance, encoding, scaling, imputation and statistical feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from carefold.functions import scalars as S
from carefold.operators import encoding as E
from carefold.operators import feature_selection as FS
from carefold.operators import metrics as M
from carefold.operators import sampling as SM
from carefold.plans.domain import md5_sql, q6, r6
from carefold.plans.queries_columns import AGE_SQL
from carefold.plans.queries_relational import corr_sql
from carefold.plans.registry import query

H = md5_sql("o_orderkey")


# -- samples ------------------------------------------------------------------------------------
@query("smp_01", f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {H} < 0.25 * 4294967296")
def smp_01(t):
    return SM.sample_fraction_by_key(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 0.25)


@query("smp_01_bernoulli", "SELECT count(*) AS n_rows, TRUE AS inside FROM orders")
def smp_01_bernoulli(t):
    """Spark's own sampler: whether it takes the share, give or take six standard deviations."""
    orders = t("orders").select("o_orderkey", "o_orderstatus")
    taken = SM.sample_fraction(orders, 0.8, 42).agg(F.count("*").alias("taken"))
    return orders.agg(F.count("*").alias("n_rows")).join(taken).select(
        "n_rows", (F.abs(F.col("taken") - F.col("n_rows") * F.lit(0.8)) <= 6 * F.sqrt(F.col("n_rows") * F.lit(0.16))).alias("inside"))


@query("smp_02", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {H}, o_orderkey LIMIT 700")
def smp_02(t):
    return SM.sample_n(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 700)


@query("smp_03", f"SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {H}, o_orderkey) AS rn FROM orders) WHERE rn <= 1500")
def smp_03(t):
    return SM.sample_per_class(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 1500)


RANKED = f"(SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {H}, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS size FROM orders)"


def _split_sql(cuts):
    chain = " ".join(f"WHEN rn <= round(size * {c}::DOUBLE) THEN {i}" for i, c in enumerate(cuts))
    return f"SELECT o_orderkey, o_orderstatus, CASE {chain} ELSE {len(cuts)} END AS split FROM {RANKED}"


def _status(t):
    return t("orders").select("o_orderkey", "o_orderstatus")


@query("spl_01", _split_sql([0.8, 0.9]))
def spl_01(t):
    return SM.stratified_split(_status(t), "o_orderstatus", "o_orderkey", (0.8, 0.1, 0.1))


@query("spl_02", _split_sql([0.7, 0.85]))
def spl_02(t):
    return SM.stratified_split(_status(t), "o_orderstatus", "o_orderkey", (0.7, 0.15, 0.15))


@query("spl_03", f"SELECT o_orderkey, CASE WHEN {H} < 0.8 * 4294967296 THEN 0 ELSE 1 END AS split FROM orders")
def spl_03(t):
    return SM.split(t("orders").select("o_orderkey"), "o_orderkey", (0.8, 0.2))


@query("spl_04", f"SELECT o_orderstatus, fold, count(*) AS n, {q6('avg(o_orderkey)', 'mean_key')} FROM (SELECT o_orderkey, o_orderstatus, CAST((rn - 1) % 5 AS INT) AS fold FROM {RANKED}) GROUP BY 1, 2")
def spl_04(t):
    out = SM.assign_folds(_status(t), "o_orderstatus", "o_orderkey", 5)
    return out.groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n"), r6(F.avg("o_orderkey"), "mean_key"))


@query("bal_01", f"SELECT o_orderkey, o_orderstatus FROM {RANKED} WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderstatus))")
def bal_01(t):
    return SM.undersample(_status(t), "o_orderstatus", "o_orderkey")


@query("bal_02", """SELECT o_orderstatus, copy, count(*) AS n FROM (SELECT o_orderstatus, unnest(range(1, CAST(big // size + CAST(rn <= big % size AS INT) + 1 AS BIGINT))) AS copy FROM
    (SELECT *, (SELECT max(c) FROM (SELECT count(*) AS c FROM orders GROUP BY (o_orderkey % 5 = 0))) AS big FROM (SELECT o_orderkey, CAST(o_orderkey % 5 = 0 AS INT) AS o_orderstatus,
    row_number() OVER (PARTITION BY o_orderkey % 5 = 0 ORDER BY {h}, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderkey % 5 = 0) AS size FROM orders))) GROUP BY 1, 2""".format(h=H))
def bal_02(t):
    df = t("orders").select("o_orderkey", (F.col("o_orderkey") % 5 == 0).cast("int").alias("o_orderstatus"))
    out = SM.oversample(df, "o_orderstatus", "o_orderkey")
    return out.groupBy("o_orderstatus", F.col("copy").cast("bigint").alias("copy")).agg(F.count("*").alias("n"))


@query("bal_03", """SELECT target, CAST(0 AS INT) AS synthetic, count(*) AS n, TRUE AS inside, count(*) AS n_original FROM matrix GROUP BY 1
    UNION ALL SELECT 1, 1, count(*), TRUE, 0 FROM matrix WHERE target = 1""", "matrix")
def bal_03(t):
    """Class 1 raised to twice its size: rows per class and kind, and whether all lie inside the range of their class."""
    df = t.matrix().select("row_key", "target", "f_quantity", "f_discount", "f_signal")
    n = df.filter("target = 1").count()
    out = SM.smote(df, "target", 1, 2 * n, ["f_quantity", "f_discount", "f_signal"], "row_key")
    span = df.groupBy("target").agg(F.min("f_quantity").alias("low"), F.max("f_quantity").alias("high"))
    made = out.groupBy("target", "synthetic").agg(F.count("*").alias("n"), F.min("f_quantity").alias("least"), F.max("f_quantity").alias("most"), F.count("row_key").alias("n_original"))
    return made.join(span, "target").select("target", F.col("synthetic").cast("int").alias("synthetic"), "n", ((F.col("least") >= F.col("low")) & (F.col("most") <= F.col("high"))).alias("inside"), "n_original")


@query("bal_04", f"SELECT o_orderstatus, count(*) AS n, {q6('(SELECT count(*) FROM orders) / (3.0::DOUBLE * count(*))', 'weight')} FROM orders GROUP BY 1")
def bal_04(t):
    return SM.class_weights(_status(t), "o_orderstatus").select("o_orderstatus", "n", r6(F.col("weight"), "weight"))


@query("bal_05", f"SELECT count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg, {q6('count(*) FILTER (WHERE label = 1) / count(*) FILTER (WHERE label = 0)', 'pos_over_neg')} FROM scored", "scored")
def bal_05(t):
    return SM.pos_weight(t.scored(), "label").select("n_pos", "n_neg", r6(F.col("pos_over_neg"), "pos_over_neg"))


# -- encoding -----------------------------------------------------------------------------------
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _segment(t):
    k = F.col("c_custkey")
    return t("customer").select("c_custkey", F.when(k % 7 != 0, F.col("c_mktsegment")).alias("seg"))


SEG = "(SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS seg FROM customer)"


def _hot(first: int) -> str:
    return "SELECT c_custkey, " + ", ".join(f"CAST(coalesce(seg = '{s}', FALSE) AS INT) AS \"seg_{s}\"" for s in SEGMENTS[first:]) + f" FROM {SEG}"


@query("enc_01", _hot(0))
def enc_01(t):
    return E.one_hot(_segment(t), ["seg"])


@query("enc_02", _hot(1))
def enc_02(t):
    return E.one_hot(_segment(t), ["seg"], drop_first=True)


@query("enc_03", "SELECT c_custkey, " + ", ".join(f"CAST((coalesce(o, 0) >> {2 - b}) & 1 AS INT) AS seg_{b}" for b in range(3)) +
       f" FROM {SEG} LEFT JOIN (SELECT seg, row_number() OVER (ORDER BY seg) AS o FROM (SELECT DISTINCT seg FROM {SEG} WHERE seg IS NOT NULL)) USING (seg)")
def enc_03(t):
    return E.binary_encode(_segment(t), ["seg"])


@query("enc_03_wide", "SELECT o, count(*) AS n, sum(s)::BIGINT AS total FROM (SELECT dense_rank() OVER (ORDER BY s_name) AS o, s_suppkey AS s FROM supplier) GROUP BY 1")
def enc_03_wide(t):
    """The codebook of a column with as many values as rows."""
    book = E.codebook(t("supplier"), "s_name")
    return t("supplier").join(book, "s_name").groupBy(F.col("ordinal").alias("o")).agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("total"))


@query("enc_04", "SELECT 'high' AS kind, p_name FROM part GROUP BY 2 HAVING (SELECT count(DISTINCT p_name) FROM part) > 10 UNION ALL SELECT 'low', p_type FROM part GROUP BY 2 HAVING (SELECT count(DISTINCT p_type) FROM part) <= 10")
def enc_04(t):
    high, low = E.split_by_cardinality(t("part"), ["p_name", "p_type"], limit=10)
    rows = [t("part").select(F.lit(k).alias("kind"), F.col(c).alias("p_name")).distinct() for k, cols in [("high", high), ("low", low)] for c in cols]
    return rows[0].unionByName(rows[1]) if len(rows) > 1 else rows[0]


@query("enc_05", f"SELECT c_custkey, CASE WHEN seg IS NOT NULL THEN o - 1 END AS seg FROM {SEG} LEFT JOIN (SELECT seg, row_number() OVER (ORDER BY seg) AS o FROM (SELECT DISTINCT seg FROM {SEG} WHERE seg IS NOT NULL)) USING (seg)")
def enc_05(t):
    return E.label_encode(_segment(t), ["seg"])


@query("enc_06", "SELECT beneficiary_id, CAST(gender_code = 2 AS INT) AS gender FROM patient", "patient")
def enc_06(t):
    from carefold.functions.constants import GENDER
    return t.patient().select("beneficiary_id", S.encode_gender(S.decode(F.col("gender_code"), GENDER)).alias("gender"))


TRAIN = f"SELECT * FROM orders WHERE {H} < 0.8 * 4294967296"


@query("sca_01", f"""SELECT o_orderkey, CASE WHEN {H} < 0.8 * 4294967296 THEN 0 ELSE 1 END AS split, {q6(f'(o_totalprice - (SELECT avg(o_totalprice) FROM ({TRAIN}))) / (SELECT stddev_pop(o_totalprice) FROM ({TRAIN}))', 'o_totalprice')} FROM orders""")
def sca_01(t):
    parts = SM.split(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", (0.8, 0.2))
    train, test = E.standard_scale(parts.filter("split = 0"), [parts.filter("split = 1")], ["o_totalprice"])
    return train.unionByName(test).select("o_orderkey", "split", r6(F.col("o_totalprice"), "o_totalprice"))


@query("imp_01", f"SELECT c_custkey, {q6('coalesce(b, (SELECT avg(b) FROM (SELECT CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS b FROM customer)))', 'b')}, coalesce(seg, '') AS seg "
       "FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS b, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS seg FROM customer)")
def imp_01(t):
    df = _segment(t).join(t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("b")), "c_custkey")
    return E.impute_mean(df, ["b"], ["seg"]).select("c_custkey", r6(F.col("b"), "b"), "seg")


def _gappy_visits(t):
    k = F.col("assessment_id")
    v = t.visit()
    return v.select("assessment_id", "beneficiary_id", "segment", "gender_code",
                    F.when((k % 3 != 0) & (F.col("beneficiary_id") % 10 != 0), F.col("priority")).alias("hipps"),
                    F.when((k % 5 == 0) & (F.col("segment") != "BUILDING"), F.col("status")).alias("code"))


GV = """gv AS (SELECT assessment_id, beneficiary_id, segment, gender_code, CASE WHEN assessment_id % 3 <> 0 AND beneficiary_id % 10 <> 0 THEN priority END AS hipps,
    CASE WHEN assessment_id % 5 = 0 AND segment <> 'BUILDING' THEN status END AS code FROM visit)"""


def _mode_sql(keys: str, col: str) -> str:
    return f"(SELECT {keys}, {col} AS m FROM (SELECT {keys}, {col}, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {col}) AS rn FROM gv WHERE {col} IS NOT NULL GROUP BY {keys}, {col}) WHERE rn = 1)"


@query("imp_02", f""", {GV} SELECT assessment_id, coalesce(gv.hipps, a.m, b.m, 'UNKNOWN') AS hipps, coalesce(gv.code, c.m, d.m, 'UNKNOWN') AS code FROM gv
    LEFT JOIN {_mode_sql('beneficiary_id', 'hipps')} a ON gv.beneficiary_id = a.beneficiary_id LEFT JOIN {_mode_sql('segment, gender_code', 'hipps')} b ON gv.segment = b.segment AND gv.gender_code = b.gender_code
    LEFT JOIN {_mode_sql('beneficiary_id', 'code')} c ON gv.beneficiary_id = c.beneficiary_id LEFT JOIN {_mode_sql('segment, gender_code', 'code')} d ON gv.segment = d.segment AND gv.gender_code = d.gender_code""", "visit")
def imp_02(t):
    return E.impute_mode(_gappy_visits(t), ["hipps", "code"], "beneficiary_id", ["segment", "gender_code"]).select("assessment_id", "hipps", "code")


RACES = [f"race_{i}" for i in range(6)]
BEST = "CASE " + " ".join(f"WHEN p{i} = greatest(p0, p1, p2, p3, p4, p5) THEN {i}" for i in range(6)) + " END"


@query("imp_03", f""", aged AS (SELECT beneficiary_id, {AGE_SQL} AS grp FROM (SELECT beneficiary_id, max(age) AS age FROM visit GROUP BY 1)), p AS (SELECT patient.*, grp FROM patient JOIN aged USING (beneficiary_id)),
    c AS (SELECT county_key, {', '.join(f'avg({r}) AS c{i}' for i, r in enumerate(RACES))} FROM p GROUP BY 1),
    g AS (SELECT grp, gender_code, {', '.join(f'avg({r}) AS g{i}' for i, r in enumerate(RACES))} FROM p WHERE grp IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT p.*, {', '.join(f'c{i} * g{i} AS p{i}' for i in range(6))} FROM p LEFT JOIN c ON p.county_key = c.county_key LEFT JOIN g ON p.grp = g.grp AND p.gender_code = g.gender_code)
    SELECT beneficiary_id, {', '.join(f'CASE WHEN race_0 IS NULL AND best IS NOT NULL THEN CAST(best = {i} AS INT)::DOUBLE ELSE {r} END AS {r}' for i, r in enumerate(RACES))} FROM (SELECT *, {BEST} AS best FROM s)""", "patient visit")
def imp_03(t):
    ages = t.visit().groupBy("beneficiary_id").agg(F.max("age").alias("age")).select("beneficiary_id", S.age_group(F.col("age")).alias("grp"))
    df = t.patient().join(ages, "beneficiary_id")
    return E.impute_race(df, RACES, "county_key", "grp", "gender_code").select("beneficiary_id", *RACES)


# -- statistical feature selection --------------------------------------------------------------
FEATURES = ["f_quantity", "f_price", "f_discount", "f_tax", "f_price_copy", "f_rare", "f_empty", "f_line", "f_signal"]


def _kept(t, cols, values):
    """The surviving columns, each with a figure of the data."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), r6(values(c), "value")) for c in cols])
    return t.features().agg(rows.alias("r")).select(F.inline("r"))


SHARE = "(SELECT max(n) FROM (SELECT count(*) AS n FROM features WHERE {c} IS NOT NULL GROUP BY {c})) / (SELECT count({c}) FROM features)::DOUBLE"
DOMINANT = " UNION ALL ".join(f"SELECT '{c}' AS feature, {q6(f'(SELECT max({c}) FROM features)', 'value')} WHERE coalesce({SHARE.format(c=c)}, 1) < 0.99" for c in FEATURES)
AFTER_DOMINANT = [c for c in FEATURES if c not in ("f_rare", "f_empty")]


@query("fs_01", DOMINANT, "features")
def fs_01(t):
    return _kept(t, FS.drop_dominant(t.features(), FEATURES), F.max)


def _uncorrelated(cols: list[str], limit: float) -> str:
    out = []
    for j, c in enumerate(cols):
        high = " OR ".join(f"coalesce(abs({corr_sql(i, c)}) > {limit}, FALSE)" for i in cols[:j]) or "FALSE"
        out.append(f"SELECT '{c}' AS feature, {q6(f'(SELECT max({c}) FROM features)', 'value')} WHERE NOT ({high})")
    return " UNION ALL ".join(out)


@query("fs_02", _uncorrelated(AFTER_DOMINANT, 0.95), "features")
def fs_02(t):
    return _kept(t, FS.drop_correlated(t.features(), AFTER_DOMINANT), F.max)


AFTER_CORR = [c for c in AFTER_DOMINANT if c != "f_price_copy"]
FILLED = "(SELECT " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in AFTER_CORR) + ", target FROM features)"


@query("fs_03", " UNION ALL ".join(f"SELECT '{c}' AS feature, {q6(f'(SELECT max({c}) FROM features)', 'value')} WHERE coalesce(abs({corr_sql(c, 'target', FILLED)}) >= 0.01, TRUE)" for c in AFTER_CORR), "features")
def fs_03(t):
    return _kept(t, FS.drop_weak(t.features(), AFTER_CORR, "target"), F.max)


@query("fs_04", f"""SELECT * FROM (SELECT 'start' AS stage, {len(FEATURES)}::BIGINT AS n_features, count(*) AS n_rows FROM features UNION ALL SELECT 'dominant', (SELECT count(*) FROM ({DOMINANT})), count(*) FROM features
    UNION ALL SELECT 'correlated', (SELECT count(*) FROM ({_uncorrelated(AFTER_DOMINANT, 0.95)})), count(*) FROM features UNION ALL SELECT 'target', (SELECT count(*) FROM (""" +
       " UNION ALL ".join(f"SELECT '{c}' AS feature WHERE coalesce(abs({corr_sql(c, 'target', FILLED)}) >= 0.01, TRUE)" for c in AFTER_CORR) + ")), count(*) FROM features)", "features")
def fs_04(t):
    stages = FS.select_features(t.features(), "target", FEATURES)
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(len(c)).cast("bigint").alias("n_features"), F.count("*").alias("n_rows")) for s, c in stages.items()])
    return t.features().agg(rows.alias("r")).select(F.inline("r"))


@query("fs_05", "SELECT feature, score FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {q6(f'var_pop({c})', 'score')} FROM features" for c in ["f_quantity", "f_discount", "f_tax", "f_rare", "f_line"]) + ") WHERE score > 0.1", "features")
def fs_05(t):
    out = FS.variance_threshold(t.features(), ["f_quantity", "f_discount", "f_tax", "f_rare", "f_line"])
    return out.select("feature", r6(F.col("score"), "score"))


RANK_A = " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(abs({corr_sql(c, 'target')}), 0) AS score" for c in ["f_quantity", "f_price", "f_discount", "f_signal"])
RANK_B = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS score FROM features" for c in ["f_discount", "f_tax", "f_rare"])


@query("fs_17", f"""SELECT feature, score_a, score_b, {q6('(score_a + score_b) / 2', 'avg_score')} FROM (SELECT coalesce(a.feature, b.feature) AS feature, coalesce(a.score, 0)::DOUBLE AS score_a, coalesce(b.score, 0)::DOUBLE AS score_b
    FROM ({RANK_A}) a FULL JOIN ({RANK_B}) b ON a.feature = b.feature) ORDER BY (score_a + score_b) DESC, feature LIMIT 5""", "features")
def fs_17(t):
    from carefold.operators.profile import target_corr
    a = target_corr(t.features(), ["f_quantity", "f_price", "f_discount", "f_signal"], "target").select("feature", F.round(F.abs("r"), 6).alias("score"))
    b = t.features().agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.avg(c), 6).alias("score")) for c in ["f_discount", "f_tax", "f_rare"]]).alias("r")).select(F.inline("r"))
    return FS.compare_selections(a, b, 5).withColumn("avg_score", F.round("avg_score", 6))
