"""The distributed forms against brute force, with a third of the rows on one value."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from carefold.operators import feature_selection as FS
from carefold.operators import graph as G
from carefold.operators import metrics as M
from carefold.operators import neighbours as NN
from carefold.operators import ordered as O
from carefold.operators import profile as PR
from carefold.operators import sampling as SM
from carefold.operators import visits as V


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice("abc"), 5.0 if i % 3 == 0 else round(rng.gauss(0, 10), 3), rng.randint(0, 1)) for i in range(6000)]
    return pd.DataFrame(rows, columns=["id", "g", "x", "y"]), spark.createDataFrame(rows, "id long, g string, x double, y int")


def test_running_totals(skewed):
    pdf, df = skewed
    counts = O.value_counts_by(df, "x")
    got = {r["x"]: r["c"] for r in O.running_totals(counts, "x", {"c": "_n"}).collect()}
    assert got == pdf["x"].value_counts().sort_index().cumsum().to_dict()
    down = {r["x"]: r["c"] for r in O.running_totals(counts, "x", {"c": "_n"}, descending=True).collect()}
    assert down == pdf["x"].value_counts().sort_index(ascending=False).cumsum().to_dict()


def test_quantiles(skewed):
    pdf, df = skewed
    got = {r["g"]: (r["q0"], r["q1"], r["q2"]) for r in O.quantiles(df, "x", [0.1, 0.5, 0.9], ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g], part["x"].quantile([0.1, 0.5, 0.9]))
    assert np.isclose(O.quantiles(df, "x", [0.25]).first()["q0"], pdf["x"].quantile(0.25))


def test_smallest_and_numbers(skewed):
    pdf, df = skewed
    hashed = df.withColumn("h", SM.hash_bucket(F.col("id")))
    local = hashed.toPandas().sort_values(["h", "id"])
    for n in (0, 1, 500, 10_000):
        got = {r["id"] for r in O.smallest(hashed, "h", "id", F.lit(n), ["g"]).collect()}
        assert got == set(local.groupby("g").head(n)["id"])
    ranks = {r["id"]: r["rn"] for r in O.numbered(hashed, "h", "id", "rn", ["g"]).collect()}
    assert ranks == dict(zip(local["id"], local.groupby("g").cumcount() + 1))


def test_splits_and_balance(skewed):
    pdf, df = skewed
    sizes = pdf["g"].value_counts()
    got = SM.stratified_split(df, "g", "id", (0.8, 0.1, 0.1)).groupBy("g", "split").count().collect()
    for r in got:
        assert abs(r["count"] - sizes[r["g"]] * (0.8 if r["split"] == 0 else 0.1)) <= 1
    assert set(SM.undersample(df, "g", "id").toPandas()["g"].value_counts()) == {sizes.min()}
    assert set(SM.oversample(df, "g", "id").toPandas()["g"].value_counts()) == {sizes.max()}
    folds = SM.assign_folds(df, "g", "id", 5).groupBy("g", "fold").count().toPandas()
    assert (folds.groupby("g")["count"].max() - folds.groupby("g")["count"].min()).max() <= 1


def test_auc_and_average_precision(skewed):
    pdf, df = skewed
    pos, neg = pdf[pdf.y == 1]["x"].to_numpy(), pdf[pdf.y == 0]["x"].to_numpy()
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert np.isclose(M.roc_auc(df, "y", "x").first()[0], wins / (len(pos) * len(neg)))
    steps, tp, seen = 0.0, 0, 0
    for _, part in sorted(pdf.groupby("x"), key=lambda kv: -kv[0]):
        tp, seen = tp + part.y.sum(), seen + len(part)
        steps += part.y.sum() * tp / seen
    assert np.isclose(M.average_precision(df, "y", "x").first()[0], steps / len(pos))


def test_correlation_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 6)) * [1, 10, 1e4, 1, 1, 1] + [0, 0, 1e6, 0, 5, 0]
    x[:, 3] = x[:, 0] * 2 + rng.normal(size=800) * 0.1
    x[:, 4] = 7.0
    pdf = pd.DataFrame(x, columns=list("abcdef"))
    pdf.loc[::5, "b"] = np.nan
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abcdef"])
    want = pdf.corr()
    for r in PR.corr_matrix(df, list("abcdef")).collect():
        assert (r["r"] is None) if "e" in (r["i"], r["j"]) else np.isclose(r["r"], want.loc[r["i"], r["j"]])
    for r in PR.corr_matrix(df, ["a", "b", "d"]).collect():
        assert np.isclose(r["r"], want.loc[r["i"], r["j"]])


def _brute(train, query, k, own=False):
    out = {}
    for qid, q in query.items():
        d = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(q, t)))), tid) for tid, t in train.items() if not (own and tid == qid))
        out[qid] = [tid for _, tid in d[:k]]
    return out


def test_neighbours_exact(spark, monkeypatch):
    monkeypatch.setattr(NN, "CELL", 30)  # many cells, and a hot cell split into tiles
    rng = random.Random(5)
    pts = {i: (1.0, 1.0) if i % 3 == 0 else (float(rng.randint(-20, 20)), float(rng.randint(-20, 20))) for i in range(600)}
    df = spark.createDataFrame([(i, *p) for i, p in pts.items()], "id long, a double, b double")
    train, query = {i: p for i, p in pts.items() if i % 4}, {i: p for i, p in pts.items() if i % 4 == 0}
    near = NN.nearest(df.filter("id % 4 <> 0"), df.filter("id % 4 = 0"), "id", ["a", "b"], 5).orderBy("query_id", "rank").collect()
    got = {}
    for r in near:
        got.setdefault(r["query_id"], []).append(r["train_id"])
    assert got == _brute(train, query, 5)
    mine = {}
    for r in NN.nearest(df, df, "id", ["a", "b"], 3, exclude_self=True).orderBy("query_id", "rank").collect():
        mine.setdefault(r["query_id"], []).append(r["train_id"])
    assert mine == _brute(pts, pts, 3, own=True)


@pytest.mark.parametrize("width", [7, 20])
def test_neighbours_in_many_dimensions(spark, monkeypatch, width):
    """Rows in clusters, as patients are: most cells are out of reach, and the result is that of comparing all pairs."""
    monkeypatch.setattr(NN, "CELL", 50)
    rng = random.Random(width)
    centres = [[rng.uniform(-50, 50) for _ in range(width)] for _ in range(40)]
    pts = {i: tuple(x + rng.gauss(0, 1) for x in centres[rng.randrange(40)]) for i in range(3000)}
    names = [f"f{n}" for n in range(width)]
    df = spark.createDataFrame([(i, *p) for i, p in pts.items()], "id long, " + ", ".join(f"{c} double" for c in names))
    train, query = df.filter("id % 10 <> 0"), df.filter("id % 10 = 0")
    assert NN.pairs_searched(train, query, "id", names) < 0.2 * 2700 * 300
    got = {}
    for r in NN.nearest(train, query, "id", names, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["train_id"])
    assert got == _brute({i: p for i, p in pts.items() if i % 10}, {i: p for i, p in pts.items() if i % 10 == 0}, 5)


def test_neighbours_groups_missing_values_and_few_rows(spark):
    rows = [(i, float(i % 13), float(i % 7), "a" if i % 3 else "b") for i in range(60)] + [(100, None, 1.0, "a"), (101, float("nan"), 1.0, "a"), (102, 1.0, 1.0, "c"), (103, 2.0, 2.0, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double, g string")
    got = {}
    for r in NN.nearest(df, df, "id", ["x", "y"], 4, exclude_self=True, by=["g"]).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["train_id"])
    want = {}
    for g in "ab":
        some = {i: (x, y) for i, x, y, h in rows if h == g and i < 100}
        want |= _brute(some, some, 4, own=True)
    assert got == want
    assert NN.nearest(df.limit(0), df, "id", ["x", "y"]).collect() == [] == NN.nearest(df, df.limit(0), "id", ["x", "y"]).collect()


def test_smote(spark):
    rng = random.Random(1)
    rows = [(i, 1 if i % 10 == 0 else 0, rng.random(), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    out = SM.smote(df, "y", 1, 100, ["a", "b"], "id").toPandas()
    assert (out.y == 1).sum() == 100 and (out.y == 0).sum() == 360 and out.synthetic.sum() == 60
    old = out[(out.y == 1) & (out.synthetic == 0)]
    new = out[out.synthetic == 1]
    assert new.a.between(old.a.min(), old.a.max()).all() and new.b.between(old.b.min(), old.b.max()).all()


def test_ridge_from_gram(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = x @ [3, 0.001, -2, 1] + 5 + rng.normal(size=300) * 0.1
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=[*"abcd", "y"])).withColumn("fold", (F.monotonically_increasing_id() % 5).cast("int"))
    w, b = FS.ridge_from_gram(FS.gram(df, list("abcd"), "y")[0], [0, 1, 2, 3])
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ yc)
    assert np.allclose(w, want) and np.isclose(b, 0)  # over the centred columns
    far = df.withColumns({c: F.col(c) + 1e8 for c in "abcd"})
    assert np.allclose(FS.ridge_from_gram(FS.gram(far, list("abcd"), "y")[0], [0, 1, 2, 3])[0], want, rtol=1e-5)
    assert {r["feature"] for r in FS.rfe_ridge(df, list("abcd"), "y", keep=3).collect()} == {"a", "c", "d"}
    assert [r["feature"] for r in FS.sfs_ridge(df, list("abcd"), "y", "fold", keep=2).collect()] == ["a", "c"]


def test_knn_forward_selection(spark):
    rng = random.Random(2)
    rows = [(i, rng.random(), float(i % 2), rng.random(), i % 2) for i in range(120)]
    df = SM.assign_folds(spark.createDataFrame(rows, "id long, noise double, good double, more double, y int"), "y", "id")
    assert FS.sfs_knn(df, ["noise", "good", "more"], "y", "id", "fold", keep=1).first()["feature"] == "good"


def test_components(spark):
    rng = random.Random(4)
    edges = [(f"n{a:03d}", f"n{b:03d}") for a, b in {tuple(sorted(rng.sample(range(200), 2))) for _ in range(120)}] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    parent = {}

    def root(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in G.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {v: root(v) for v in parent}


def test_one_row_per_key_and_hot_patient(spark):
    rows = [(1 if i % 3 else i, i % 40, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "p long, d int, id long").withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    pdf = df.toPandas().sort_values(["p", "day", "id"])
    hist = V.visit_history(df, ["p"], "day", "id").toPandas().sort_values(["p", "day", "id"])
    want = pdf.groupby("p")["day"].shift()
    assert [None if pd.isna(x) else x for x in hist["prev_visit_date"]] == [None if pd.isna(x) else x for x in want]
    first = V.one_per_key(df, ["p"], ["day", "id"]).toPandas().set_index("p")["id"].to_dict()
    assert first == pdf.groupby("p").head(1).set_index("p")["id"].to_dict()


def test_one_nan_changes_only_its_own_row(spark):
    from carefold.operators import profile
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 6))
    x[:, 1] = x[:, 0] * 2
    x[7, 1] = np.nan
    want = pd.DataFrame(x, columns=list("abcdef")).corr()
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], [*"abcdef"])
    for cols in (["a", "b"], list("abcdef")):
        got = {(r["i"], r["j"]): r["r"] for r in profile.corr_matrix(df, cols).collect()}
        assert all(np.isclose(got[i, j], want.loc[i, j]) for i, j in got) and len(got) == len(cols) * (len(cols) - 1) // 2


def test_small_shares_are_exact(spark):
    from carefold.operators import sampling
    n = sampling.sample_fraction_by_key(spark.range(2_000_000), "id", 1e-5).count()
    assert 5 <= n <= 45


def test_components_of_a_shuffled_chain(spark):
    from carefold.operators.graph import components
    order = list(range(10_000))
    random.Random(1).shuffle(order)
    out = components(spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")).collect()
    assert len(out) == 10_000 and {r["component"] for r in out} == {0}


def test_every_line_reaches_the_code_rows(spark):
    from carefold.plans.domain import CODES, Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    filled = sum((F.col(c).isNotNull().cast("int") for c in CODES), F.lit(0))
    assert t.wide().agg(F.sum(filled)).first()[0] == t("lineitem").count()


def test_curve_measures_use_one_ranking(spark, skewed):
    """Both areas come out of one ranking: no more exchanges than one of them needs alone."""
    _, df = skewed

    def exchanges(x):
        return x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    both = M.ovr_curves(df.select("y", "x"), {1: "x", 0: "x"}, "y")
    assert exchanges(both) <= 9
    assert exchanges(both) == exchanges(both.select("class", "roc_auc"))
    got = {r["class"]: r for r in both.collect()}
    assert np.isclose(got[1]["roc_auc"], M.roc_auc(df, "y", "x").first()[0]) and np.isclose(got[0]["roc_auc"], 1 - got[1]["roc_auc"])
    one = df.filter("y = 1")
    assert M.curve_measures(one, "y", "x").first()["roc_auc"] is None  # no pairs without negatives


def test_report_summary_names_the_positive_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "label int, prediction int")
    r = M.report_summary(M.class_report(df)).first()
    assert np.allclose([r["precision"], r["recall"], r["macro_f1"]], [2 / 3, 2 / 3, (2 / 3 + 1 / 2) / 2])


def test_levels_are_bounded(spark):
    from carefold.operators import encoding as E

    df = spark.range(1000).select(F.col("id").cast("string").alias("wide"), (F.col("id") % 3).alias("slim"))
    assert E.levels_of(df, ["slim"], limit=100) == {"slim": [0, 1, 2]}
    with pytest.raises(ValueError, match="wide"):
        E.levels_of(df, ["wide", "slim"], limit=100)


def test_scratch_area_is_gone_after_a_job(spark):
    """Tables that operators write in an area vanish with it, also after an error; an inner area leaves the outer one alone."""
    import os

    from carefold.operators.graph import components
    from carefold.session import scratch_area, scratch_path, work_dir

    shared = work_dir(spark)
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    with scratch_area(spark) as area:
        assert area.startswith(shared) and scratch_path(spark, "x").startswith(area)
        with scratch_area(spark) as inner:
            assert inner.startswith(area)
            got = {r["node"]: r["component"] for r in components(edges).collect()}
            assert len(os.listdir(inner.removeprefix("file:"))) > 0
        assert not os.path.exists(inner.removeprefix("file:")) and work_dir(spark) == area
        edges.write.parquet(f"{area}/kept")
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert not os.path.exists(area.removeprefix("file:")) and work_dir(spark) == shared
    with pytest.raises(RuntimeError):
        with scratch_area(spark) as area:
            edges.write.parquet(f"{area}/kept")
            raise RuntimeError
    assert not os.path.exists(area.removeprefix("file:"))


def test_copies_are_not_searched(spark):
    """Forty copies of every point: searched pairs do not grow, and neighbours are still those of the rows."""
    few = [(i, float(i % 17), float(i % 5)) for i in range(85)]
    many = [(i + 1000 * c, x, y) for c in range(40) for i, x, y in few]
    small, large = (spark.createDataFrame(r, "id long, a double, b double") for r in (few, many))
    assert NN.pairs_searched(large, large, "id", ["a", "b"], 1) == NN.pairs_searched(small, small, "id", ["a", "b"], 1)
    assert NN.pairs_searched(large, large, "id", ["a", "b"], 3) <= 3 * NN.pairs_searched(small, small, "id", ["a", "b"], 3)
    query = large.filter("id % 97 = 0")
    got = {}
    for r in NN.nearest(large, query, "id", ["a", "b"], 3, exclude_self=True).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["train_id"])
    points = {i: (x, y) for i, x, y in many}
    assert got == _brute(points, {r["id"]: points[r["id"]] for r in query.collect()}, 3, own=True)


def test_knn_forward_selection_of_copies(spark):
    """Equal rows in all folds, ties by id, against the rule itself."""
    rng = random.Random(11)
    rows = [(i, float(rng.randint(0, 3)), float(rng.randint(0, 2)), rng.randint(0, 1), rng.randint(0, 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int, fold int")

    def r2(col):
        out = []
        for f in range(5):
            own, rest = [r for r in rows if r[4] == f], [r for r in rows if r[4] != f]
            guess = [np.mean([t[3] for t in sorted(rest, key=lambda t: (abs(t[col] - q[col]), t[0]))[:5]]) for q in own]
            y = np.array([q[3] for q in own], float)
            out.append(1 - ((y - guess) ** 2).sum() / (y.var() * len(y)))
        return float(np.mean(out))

    got = FS.sfs_knn(df, ["a", "b"], "y", "id", "fold", keep=1).first()
    want = {"a": r2(1), "b": r2(2)}
    assert got["feature"] == max(want, key=want.get) and np.isclose(got["score"], max(want.values()))


def test_joins_of_hot_keys_are_spread(spark):
    """No part makes most of the joined rows, and none is lost or made twice."""
    from carefold.operators import joins as J
    a = spark.range(900).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 9).alias("k"), F.col("id").alias("x"))
    b = spark.range(300).select(F.when(F.col("id") < 250, 1).otherwise(F.col("id") % 9).alias("k"), F.col("id").alias("y"))
    want = a.join(b, "k").count()
    out = J.spread_join(a, b, ["k"], pairs=2000)
    assert out.columns == ["k", "x", "y"] and out.exceptAll(a.join(b, "k")).isEmpty() and out.count() == want
    most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < want / 8


def test_chapters_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    from carefold import session
    from carefold.sources import sinks
    flags = spark.range(200).select(F.col("id"), (F.col("id") % 2).alias("one"), (F.col("id") % 3).alias("two"))
    seen = []
    write = sinks.section_rows
    monkeypatch.setattr(sinks, "section_rows", lambda *x: seen.append(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) or write(*x))
    sinks.split_by_section(flags, str(tmp_path / "out"), ["one", "two"])
    assert seen == ["2"] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    got = {r["section"]: r["n"] for r in spark.read.option("header", True).csv(str(tmp_path / "out")).groupBy("section").agg(F.count("*").alias("n")).collect()}
    assert got == {"one": 100, "two": 133}
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    assert session.dealt(flags, 200, "id").rdd.getNumPartitions() == 20 and session.dealt(flags, 50, "id") is flags
