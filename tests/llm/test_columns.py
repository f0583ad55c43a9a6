"""Stages hand back rows as they were, whatever their columns are called."""

from carefold.llm import decontaminate, neardup, secrets, toxicity

SCHEMA = "doc_id long, text string, _kid string, _kmark long, _row int, _own string, _text string, _set long, spans string"


def rows():
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words), " ".join(words[::-1]), None, "", " ".join(words[5:20])]
    return [(i, t, f"k{i}", -i, i, "own", "other", 7, "s") for i, t in enumerate(texts)]


def test_near_duplicates_keep_columns(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    out = neardup.keep_one(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [r for r in rows() if r[0] in (0, 2, 3, 5)]


def test_decontamination_keeps_columns(spark):
    df, none = spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame([], "item_id long, text string")
    tests = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(10, 20))), (2, None), (3, "")], "item_id long, text string")
    for size in (10, decontaminate.PASS_BYTES):
        out = decontaminate.clean(df, tests, pass_bytes=size)
        assert out.columns == df.columns and sorted(map(tuple, out.collect())) == rows()[2:5]
    assert sorted(map(tuple, decontaminate.clean(df, none).collect())) == rows() and decontaminate.clean(df.limit(0), tests).collect() == []


def test_redaction_keeps_columns(spark):
    schema = "doc_id long, text string, source string, spans string, base int, _spans string, _text string, _doc int, _row long, hash string, live boolean"
    texts = ["my password=hunter2secret here", None, "", "plain words", "my password=hunter2secret here"]
    made = [(k, t, "s", "a", 1, "b", "c", 2, 3, "h", None) for k, t in enumerate(texts)]
    made.append(made[0])  # a repeated row
    df = spark.createDataFrame(made, schema)
    out = secrets.redact(df)
    assert out.columns == df.columns
    want = [(k, t and t.replace("password=hunter2secret", "[secret]"), *rest) for k, t, *rest in made]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert secrets.redact(df.limit(0)).collect() == []


def test_toxicity_rejects_nothing_without_labels(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.keep_civil(df, toxicity.train(df, none)).count() == df.count()
    every = toxicity.train(df, spark.createDataFrame([(k, 1) for k in range(6)], "doc_id long, toxic int"), l1=0.0)  # even if all labels are toxic
    assert {r["doc_id"] for r in toxicity.keep_civil(df, every).collect()} == {3, 4}
