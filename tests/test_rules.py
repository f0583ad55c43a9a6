"""Behaviour on small frames with awkward values."""

import datetime as dt
import hashlib

import numpy as np
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
from carefold.operators import encoding as E
from carefold.operators import feature_selection as FS
from carefold.operators import joins as J
from carefold.operators import metrics as M
from carefold.operators import models as ML
from carefold.operators import profile as PR
from carefold.operators import risk as RK
from carefold.operators import tuning as TU
from carefold.operators import visits as V
from carefold.plans import jobs


def one(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_chapters(spark):
    cases = {"E11.9": "E00-E89", "I50.9": "I00-I99", "I10": "I00-I99", "B99.9": "A00-B99", "U99": None, "F00": None, "O9A.1": "O00-O9A", "D49": "C00-D49",
             "D50": "D50-D89", "D90": None, "H59.9": "H00-H59", "H60": "H60-H95", "T88": "S00-T88", "T89": None, "Y99": "V00-Y99", "I1": None, "": None, None: None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "code string, want string")
    assert one(df, K.icd_range(F.col("code"))) == list(cases.values())
    titles = dict(C.ICD_CHAPTERS)
    assert one(df, K.icd_title(F.col("code"))) == [titles.get(v) for v in cases.values()]


def test_every_chapter_edge(spark):
    edges = [(e, span) for span, _ in C.ICD_CHAPTERS for e in span.split("-")]
    df = spark.createDataFrame(edges, "code string, span string")
    assert df.filter(K.icd_range(F.col("code")) != F.col("span")).count() == 0


def test_condition_flags_and_digit_rule(spark):
    df = spark.createDataFrame([("E11.9", None), ("I50.9", "I10"), (None, "")], "a string, b string")
    assert one(D.condition_flags(df, ["a", "b"]), "is_diabetes") == [1, 0, 0]
    assert one(D.condition_flags(df, ["a", "b"]), "is_heart_failure") == [0, 1, 0]
    assert one(D.condition_flags(df, ["a", "b"], compat=True), "is_diabetes") == [0, 0, 0]
    assert one(D.condition_flags(df, ["a", "b"], compat=True), "is_heart_failure") == [0, 1, 0]
    assert one(D.condition_flags(df, ["a", "b"], clinical=True), "is_hypertension") == [0, 1, 0]


def test_zip(spark):
    df = spark.createDataFrame([("78666-1234",), ("501",), (None,), ("junk",), ("787011234",)], "z string")
    assert one(df, S.zip5(F.col("z"))) == ["78666", "00501", None, None, "78701"]


def test_dates_and_readmission(spark):
    df = spark.createDataFrame([("12JAN2017",), ("junk",), (None,)], "d string")
    assert one(df, S.parse_date(F.col("d"))) == [dt.date(2017, 1, 12), None, None]
    gaps = spark.createDataFrame([(dt.date(2020, 1, d), dt.date(2020, 1, 10)) for d in (5, 10, 31)] + [(None, dt.date(2020, 1, 10))], "r date, a date")
    assert one(gaps, S.readmitted(F.col("r"), F.col("a"))) == [0, 1, 1, 0]
    assert one(gaps, S.readmitted(F.col("r"), F.col("a"), compat=True)) == [1, 1, 1, 0]


def test_text_flags_are_numbers(spark):
    df = spark.createDataFrame([(0, "0"), (1, None), (None, "1"), (None, None), (0, "x")], "Hospital_Reason_A int, Hospital_Reason_B string")
    assert one(df, P.any_filled(df.columns)) == [False, True, True, False, False]
    assert one(df, CO.outcome_class(["Hospital_Reason_B"], ["Hospital_Reason_A"])) == ["Stable", "Hospitalized", "ED Only", "Stable", "Stable"]


def test_body_mass(spark):
    df = spark.createDataFrame([(150.0, 60.0), (150.0, 0.0), (None, 60.0), (9000.0, 60.0)], "lb double, inch double")
    assert one(df, S.bmi_ceil(F.col("lb"), F.col("inch"))) == [30, 0, 0, 1762]
    got = one(df, S.bmi(F.col("lb"), F.col("inch")))
    assert round(got[0], 4) == 29.2917 and got[1:] == [None, None, None]
    ages = spark.createDataFrame([(17,), (18,), (99,), (100,), (None,)], "age int")
    assert one(ages, S.age_group(F.col("age"))) == ["[0, 18)", "[18, 35)", "[80, 100)", None, None]


def test_sentinels(spark):
    df = spark.createDataFrame([("UK",), ("-",), ("88",), ("9",), ("3",), ("abc",), (None,)], "v string")
    assert one(df, S.clean_numeric(F.col("v"), C.ORDINAL_SENTINELS)) == [None] * 4 + [3.0, None, None]


def test_same_day_visits(spark):
    day = dt.date
    rows = [(1, 1, day(2020, 1, 1), 10), (1, 1, day(2020, 1, 1), 11), (1, 1, day(2020, 1, 9), 12), (1, 2, day(2020, 1, 9), 13), (2, 1, None, 14)]
    df = spark.createDataFrame(rows, "p int, f int, d date, id int")
    got = {r["id"]: (r["num_visits"], r["prev_visit_date"], r["days_between_visits"]) for r in V.visit_history(df, ["p", "f"], "d", "id").collect()}
    assert got == {10: (2, None, None), 11: (2, day(2020, 1, 1), 0), 12: (3, day(2020, 1, 1), 8), 13: (1, None, None), 14: (1, None, None)}


def test_first_value_per_column(spark):
    rows = [(1, "s", 2, None, "b"), (1, "s", 1, None, None), (1, "s", 3, 7, "c"), (2, None, 1, 5, "x")]
    df = spark.createDataFrame(rows, "id int, soc string, o int, x int, y string")
    assert [tuple(r) for r in CO.episode_first(df, ["id", "soc"], ["o"]).collect()] == [(1, "s", 1, 7, "b")]


def test_label_from_all_rows(spark):
    rows = [(1, 1, "00", 0), (1, 2, None, 1), (2, 1, "01", 0), (3, 1, None, 1)]
    df = spark.createDataFrame(rows, "ep int, o int, status string, flag int")
    out = CO.episode_label(df, ["ep"], F.col("status").isNotNull(), F.col("flag") == 1, ["o"])
    assert sorted((r["ep"], r["o"], r["target"]) for r in out.collect()) == [(1, 1, 1), (2, 1, 0)]


def test_mode_ties_and_empty_groups(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "z"), (3, "z"), (3, "a")], "g int, v string")
    assert {r["g"]: r["mode"] for r in AG.mode_by(df, ["g"], "v").collect()} == {1: "a", 2: "UNKNOWN", 3: "z"}


def test_mode_fill_goes_patient_group_default(spark):
    df = spark.createDataFrame([(1, "g", "x"), (1, "g", None), (2, "g", None), (3, "h", None)], "p int, grp string, v string")
    assert {r["p"]: r["v"] for r in E.impute_mode(df, ["v"], "p", ["grp"]).collect()} == {1: "x", 2: "x", 3: "UNKNOWN"}


def test_race_fill(spark):
    rows = [(1, "c", "a", 1, 1.0, 0.0), (2, "c", "a", 1, 1.0, 0.0), (3, "c", "a", 1, None, None), (4, "d", "a", 1, None, None), (5, "c", "a", 1, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, county string, grp string, g int, r0 double, r1 double")
    got = {r["id"]: (r["r0"], r["r1"]) for r in E.impute_race(df, ["r0", "r1"], "county", "grp", "g").collect()}
    assert got[3] == (1.0, 0.0) and got[4] == (None, None) and got[5] == (None, 1.0)
    assert {r["id"]: r["r0"] for r in E.impute_race(df, ["r0", "r1"], "county", "grp", "g", any_gap=True).collect()}[5] == 1.0


def test_one_risk_aggregate_equals_the_joined_tables(spark):
    """All schemes from a patient's bits: the same table as separate aggregates, stacked and joined, with null and repeated codes,
    ages on both sides of the limit, patients without conditions."""
    codes = [p for text in [*R.CHARLSON_CODES.values(), *R.ELIXHAUSER_CODES.values(), *R.DISABILITY_CODES.values()] for p in K.expand_codes(text)] + list(R.HFRS_POINTS) + ["Q00", None, "", "i1", "E1"]
    rows = [(i % 37, 60 + i % 37, c if not c or i % 3 else f"{c[:3]}.{c[3:]}9".lower() if i % 2 else c) for i, c in enumerate(codes * 2)] + [(100, None, "I50.9"), (101, 90, None)]
    df = spark.createDataFrame(rows, "id int, age int, code string")
    weights = {c: i % 5 for i, c in enumerate(R.ELIXHAUSER_CODES)}
    schemes, disability = RK.all_schemes(df, "id", "code", weights, "age")
    want = RK.risk_table(schemes, RK.hfrs(df, "id", "code", 75, "age"), disability, "id")
    got = RK.risk_rows(df, "id", "code", weights, "age", 75)
    assert sorted(want.columns) == sorted(got.columns)
    cols = sorted(want.columns)
    assert sorted(map(tuple, want.select(cols).collect())) == sorted(map(tuple, got.select(cols).collect()))
    assert RK.risk_rows(df.limit(0), "id", "code", weights, "age", 75).count() == 0


def test_conditions_as_bits_equal_prefixes_by_hand(spark):
    rng = np.random.default_rng(3)
    known = [p for text in R.ELIXHAUSER_CODES.values() for p in K.expand_codes(text)]
    rows = [(int(rng.integers(50)), str(rng.choice(known)) + str(rng.integers(10))) for _ in range(400)] + [(99, None), (98, "I5")]
    got = {r["id"]: r for r in RK.elixhauser(spark.createDataFrame(rows, "id int, code string"), "id", "code", assign0=False).collect()}
    for id in {i for i, _ in rows}:
        mine = [c for i, c in rows if i == id and c]
        for name, text in R.ELIXHAUSER_CODES.items():
            assert got[id][name] == int(any(c[:n] in K.expand_codes(text) for c in mine for n in (3, 4)))


def test_lasso_meets_its_conditions(spark):
    """At the minimum the pull of every column is alpha in the coefficient's direction, or below it at zero."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4))
    x[:, 3] = x[:, 0] + 0.01 * rng.normal(size=300)
    y = 2 * x[:, 0] - 0.5 * x[:, 1] + 7 + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame([(*map(float, r), 5.0, float(v)) for r, v in zip(x, y)], "a double, b double, c double, d double, e double, y double")
    w = {r["feature"]: r["score"] for r in FS.lasso(df, ["a", "b", "c", "d", "e"], "y", 0.05).collect()}
    assert set(w) <= {"a", "b", "c", "d"} and "b" in w
    xc, yc = x - x.mean(0), y - y.mean()
    pull = xc.T @ (yc - xc @ np.array([w.get(c, 0.0) for c in "abcd"])) / 300
    for c, p in zip("abcd", pull):
        assert abs(p - 0.05 * np.sign(w[c])) < 1e-9 if c in w else abs(p) <= 0.05 + 1e-9
    assert FS.lasso(df.limit(0), ["a", "b"], "y").count() == 0


def test_group_values_reach_every_row_on_both_ways(spark):
    """Sent to all executors or dealt over salted copies: the same rows, null keys and keys without a group included."""
    rows = [(i, "hot" if i % 3 else "cold", i % 2) for i in range(300)] + [(1000, None, 1), (1001, "lost", 0), (1001, "lost", 0)]
    df = spark.createDataFrame(rows, "id int, g string, _salt int")
    groups = spark.createDataFrame([("hot", 1.0), ("cold", 2.0)], "g string, v double")
    want = sorted((i, g, s, {"hot": 1.0, "cold": 2.0}.get(g)) for i, g, s in rows)
    for limit in (0, 1, 2, 100):
        got = J.attach_groups(df, groups, ["g"], limit=limit).select("id", "g", "_salt", "v").collect()
        assert sorted(map(tuple, got), key=lambda r: (r[0], r[1] or "")) == sorted(want, key=lambda r: (r[0], r[1] or ""))
    assert J.attach_groups(df.limit(0), groups, ["g"]).count() == 0
    assert {r["v"] for r in J.attach_groups(df, groups.limit(0), ["g"]).collect()} == {None}


def test_codebooks_of_many_columns_in_one_pass(spark):
    """Text and numbers, nulls, a column without values, one value on most rows: bits and positions as counted by hand."""
    rows = [(i, "hot" if i % 3 else f"v{i:03d}", None if i % 5 == 0 else "ab"[i % 2], i % 12, None) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, `a.b` string, c string, m int, e string").withColumnRenamed("a.b", "a")
    place = {k: {v: n for n, v in enumerate(sorted({r[j] for r in rows if r[j] is not None}), 1)} for k, j in [("a", 1), ("c", 2), ("m", 3), ("e", 4)]}
    got = {r["id"]: r for r in E.label_encode(df, ["a", "c", "e"]).collect()}
    bits = {r["id"]: r for r in E.binary_encode(df, ["a", "m", "e"]).collect()}
    for i, a, c, m, _ in rows:
        assert (got[i]["a"], got[i]["c"], got[i]["m"], got[i]["e"]) == (place["a"][a] - 1, None if c is None else place["c"][c] - 1, m, None)
        for name, value in (("a", a), ("m", m)):
            width = len(place[name]).bit_length()
            assert [bits[i][f"{name}_{b}"] for b in range(width)] == [int(x) for x in f"{place[name][value]:0{width}b}"]
        assert bits[i]["e_0"] == 0 and bits[i]["c"] == c
    assert E.label_encode(df.limit(0), ["a", "c"]).count() == 0


def test_patient_gaps_are_filled_before_rows_are_dropped(spark):
    """Scores are merged, flags come from county and age group, codes from patient, group, default; flags without a prior stay."""
    day = dt.date(2020, 3, 4)
    rows = [(1, day, 40, "F", "c", 1.0, 0.0, "x"), (1, day, 40, "F", "c", 1.0, 0.0, None), (2, day, 41, "F", "c", None, None, None), (3, day, 70, "M", "d", None, None, None),
            (4, day, 42, "F", "c", 0.0, None, "x"), (9, day, 40, "F", "c", 0.0, 1.0, "y")]
    df = spark.createDataFrame(rows, "Beneficiary_ID int, Assessment_Effective_Date date, Age int, Gender string, county string, r0 double, r1 double, code string")
    scores = spark.createDataFrame([(i, i * 10) for i in (1, 2, 3, 4)], "Beneficiary_ID int, score int")
    out = jobs.complete_patients(df, scores, ["r0", "r1"], ["code"], "county")
    got = {(r["Beneficiary_ID"], r["r0"], r["r1"], r["code"], r["score"], r["Assessment_Effective_Year"], r["Assessment_Effective_Month"]) for r in out.collect()}
    assert got == {(1, 1, 0, "x", 10, 2020, 3), (2, 1, 0, "x", 20, 2020, 3), (3, None, None, "UNKNOWN", 30, 2020, 3), (4, 1, 0, "x", 40, 2020, 3)}
    assert out.count() == 5 and "Assessment_Effective_Date" not in out.columns
    assert jobs.complete_patients(df.limit(0), scores, ["r0", "r1"], ["code"], "county").count() == 0


def test_ridge_penalty_stands_next_to_the_plain_squared_error(spark):
    """Permutation importance of a small, strongly penalised table equals the one computed by hand from the normal equations."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2)) * [0.3, 2.0]
    y = 3 * x[:, 0] - x[:, 1] + 10 + rng.normal(size=60)
    df = spark.createDataFrame([(f"k{i:03d}", float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "k string, a double, b double, y double")
    got = {r["feature"]: r["score"] for r in FS.permutation_importance_ridge(df, df, ["a", "b"], "y", "k", alpha=20.0, repeats=3).collect()}
    xc = x - x.mean(0)
    w = np.linalg.solve(xc.T @ xc + 20.0 * np.eye(2), xc.T @ (y - y.mean()))
    guess = xc @ w + y.mean()
    place = lambda mark: [int(k[1:]) for k in sorted((f"k{i:03d}" for i in range(60)), key=lambda k: (int(hashlib.md5((k + mark).encode()).hexdigest()[:8], 16), k))]
    first = place("")
    for j, name in enumerate("ab"):
        lost = [sum((guess[i] + w[j] * (x[o, j] - x[i, j]) - y[i]) ** 2 for i, o in zip(first, place(f"#p1.{r}"))) for r in range(3)]
        assert abs(got[name] - (np.mean(lost) - ((guess - y) ** 2).sum()) / ((y - y.mean()) ** 2).sum()) < 1e-9


def test_forward_selection_gives_ties_to_the_first_column(spark):
    """A column and its copy reach the same score; the first one is taken whatever the order of the rows."""
    rows = [(i, float(i % 7), float(i % 7), float(i % 3), float(i % 7) * 2 + i % 3, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, a double, copy double, c double, y double, fold int")
    for parts in (1, 5):
        assert [r["feature"] for r in FS.sfs_ridge(df.repartition(parts), ["a", "copy", "c"], "y", "fold", keep=2).collect()] == ["a", "c"]


def test_share_of_columns_is_drawn(spark):
    """Every described space draws the share of columns, and a search trains with it."""
    for space in (TU.RANDOM_SPACE, TU.RANGE_SPACE, TU.CHOICE_SPACE):
        maps = TU.draws(ML.gbt("y"), space, 20)
        shares = {float(v) for m in maps for p, v in m.items() if p.name == "featureSubsetStrategy"}
        assert len(maps) == 20 and len(shares) > 1 and min(shares) >= 0.4 and max(shares) <= 1.0
    df = spark.createDataFrame([(float(i % 7), float(i % 5), i % 2) for i in range(200)], "a double, b double, y int")
    model = TU.random_search(df, ["a", "b"], "y", ML.gbt("y"), {"n_estimators": [2], "colsample": (0.4, 0.6, "float")}, n=1, folds=2)
    assert 0.4 <= float(model.bestModel.getOrDefault("featureSubsetStrategy")) <= 0.6


def test_constant_and_empty_columns(spark):
    rows = [(1.0, 5.0, None, 1, float(i), i % 2) for i in range(100)] + [(2.0, 5.0, None, None, 200.0, 1)]
    df = spark.createDataFrame(rows, "almost double, const double, empty double, flag int, ok double, target int")
    cols = ["almost", "const", "empty", "flag", "ok"]
    assert FS.drop_dominant(df, cols) == ["ok"]
    assert FS.drop_dominant(df, cols, 0.995) == ["almost", "ok"]
    assert FS.drop_weak(df.drop("empty"), ["const", "ok"], "target") == ["const", "ok"]
    r = {(x["i"], x["j"]): x["r"] for x in PR.corr_matrix(df, ["const", "empty", "ok"]).collect()}
    assert set(r.values()) == {None}


def test_correlation_filter_is_not_greedy(spark):
    rows = [(float(i), i * 2.0 + (i % 3) * 0.01, i * 4.0, float((i * 7) % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    assert FS.drop_correlated(df, ["a", "b", "c", "d"]) == ["a", "d"]


def test_published_confusion_matrices(spark):
    for cells, want in [([[356545, 91482], [20449, 80362]], 0.7269), ([[11268, 4707], [20580, 56116]], 0.6437)]:
        counts = [(i, j, cells[i][j]) for i in (0, 1) for j in (0, 1)]
        df = spark.createDataFrame(counts, "label int, prediction int, n int").select("label", "prediction", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("col")
        assert round(M.report_averages(M.class_report(df)).first()["macro_f1"], 4) == want


def test_class_that_is_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "label int, prediction int")
    got = {r["class"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in M.class_report(df).collect()}
    assert got[1] == (0.0, 0.0, 0.0, 1) and got[0][1] == 1.0


def test_threshold_lowest_wins_tie(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.95)], "label int, probability double")
    assert M.find_threshold(df) == 0.10
    assert M.threshold_table(df).count() == 16
    assert M.find_threshold(spark.createDataFrame([], "label int, probability double")) == 0.5


def test_milder_form_is_cleared(spark):
    rows = [(1, "E11.9"), (1, "E11.2"), (2, "E11.9"), (3, "Z99.9"), (4, "C50.1"), (4, "C78.0"), (5, None)]
    df = spark.createDataFrame(rows, "id int, code string")
    got = {r["id"]: r for r in RK.charlson(df, "id", "code").collect()}
    assert (got[1]["diab"], got[1]["diabwc"], got[1]["comorbidity_score"]) == (0, 1, 1)
    assert got[2]["diab"] == 1 and got[3]["comorbidity_score"] == 0 and got[5]["comorbidity_score"] == 0
    assert (got[4]["canc"], got[4]["metacanc"], got[4]["comorbidity_score"]) == (0, 1, 6)
    assert {r["id"]: r["comorbidity_score"] for r in RK.charlson(df, "id", "code", assign0=False).collect()}[4] == 8


def test_code_lists():
    assert len(R.CHARLSON_CODES) == 17 and len(R.ELIXHAUSER_CODES) == 31 and len(R.HFRS_POINTS) == 109
    assert set(R.CHARLSON_QUAN_WEIGHTS) == set(R.CHARLSON_CODES) and set(R.ELIXHAUSER_VW_WEIGHTS) == set(R.ELIXHAUSER_CODES)
    assert K.expand_codes("I60-I62 E102-E103 G45") == ["I60", "I61", "I62", "E102", "E103", "G45"]


def test_age_points_and_frailty(spark):
    df = spark.createDataFrame([(39,), (40,), (49,), (50,), (85,), (99,)], "age int")
    assert one(df, RK.age_adjust(F.lit(0), F.col("age"))) == [0, 0, 0, 1, 4, 4]
    codes = spark.createDataFrame([(1, "F00.1"), (1, "F00.2"), (1, "R50"), (2, "A00")], "id int, code string")
    assert {r["id"]: r["hfrs"] for r in RK.hfrs(codes, "id", "code").collect()} == {1: 7.2, 2: 0.0}


def test_disparity_zero_cases(spark):
    df = spark.createDataFrame([("a", 0.0, 100.0, 0.0), ("b", 0.0, 50.0, 50.0)], "county string, x double, u double, r double")
    assert one(DS.relative_index(df, "x"), "relative") == [0.0, 0.0]
    assert one(DS.attributable_share(df, "x", "u", "r"), "pap_urban") == [0.0, 0.0]


def test_episode_key_and_labels(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 2)), ("a", None), (None, dt.date(2020, 1, 2))], "id string, d date")
    assert one(df, S.episode_id(F.col("id"), F.col("d"))) == ["a_2020-01-02", "a_nan", None]
    assert one(df, K.join_labels(K.label_set([F.col("id"), F.lit("b")]))) == ["a, b", "a, b", "b"]
    assert one(df, K.join_labels(K.label_set([F.lit(None).cast("string")]))) == ["Unknown"] * 3


def test_binary_codes(spark):
    df = spark.createDataFrame([("c",), ("a",), (None,), ("b",), ("a",)], "v string")
    got = sorted((r["v_0"], r["v_1"]) for r in E.binary_encode(df, ["v"]).collect())
    assert got == [(0, 0), (0, 1), (0, 1), (1, 0), (1, 1)]


def test_cohort_columns(spark):
    """Dashes in the active diagnoses are missing values; of the code columns only those on severity stay, of the regimen none."""
    from carefold.plans import jobs

    day = dt.date
    rows = [("p", day(2020, 1, 1), day(2020, 2, 1), "-", "1", "I10", "2", "x", 1), ("q", day(2020, 1, 1), day(2020, 3, 1), "0", "-", "E11", "3", "y", 0)]
    df = spark.createDataFrame(rows, f"{jobs.ID} string, {jobs.SOC} date, {jobs.DAY} date, Active_Diagnoses_Diabetes_Mellitus string, Active_Diagnoses_PVD_or_PAD string, "
                                     "Primary_Diagnosis_ICD_10_C_M_Code string, Other_Severity_ICD_10_C_M string, Regimen_Change_Severity string, target int")
    out = jobs.encode_cohort(df, "target").orderBy("Assessment_Month")
    assert "Other_Severity_ICD_10_C_M" in out.columns and "Regimen_Change_Severity" not in out.columns and "Primary_Diagnosis_ICD_10_C_M_Code" not in out.columns
    assert [tuple(r) for r in out.select("Active_Diagnoses_Diabetes_Mellitus", "Active_Diagnoses_PVD_or_PAD", "dx_hypertension").collect()] == [(None, 1.0, 1), (0.0, None, 0)]
