"""Samples, splits and class balance, all driven by an md5 hash of the row key so that a re-run, a
retried task and another engine choose the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from carefold.functions.scalars import hash_bucket
from carefold.operators import ordered
from carefold.operators.joins import attach_groups
from carefold.operators.neighbours import attach_nearest, nearest_of_points, slim_rows


def _salt(seed) -> str:
    return "" if seed in (None, 0) else f"#{seed}"


def sample_fraction(df: DataFrame, f: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample by Spark's own sampler."""
    return df.sample(False, f, seed)


def sample_fraction_by_key(df: DataFrame, key: str, f: float, seed: int = 0) -> DataFrame:
    """Repeatable fraction: the key's 32-bit hash falls below the fraction of the hash range."""
    return df.filter(hash_bucket(F.col(key), salt=_salt(seed)) < F.lit(f * 2.0**32))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    hashed = df.withColumn("_h", hash_bucket(F.col(key), salt=_salt(seed)))
    return ordered.smallest(hashed, "_h", key, F.lit(n)).drop("_h")


def sample_per_class(df: DataFrame, label: str, key: str, n: int, seed: int = 0) -> DataFrame:
    hashed = df.withColumn("_h", hash_bucket(F.col(key), salt=_salt(seed)))
    return ordered.smallest(hashed, "_h", key, F.lit(n), [label]).drop("_h")


def split(df: DataFrame, key: str, parts: tuple[float, ...], seed: int = 0, name: str = "split") -> DataFrame:
    """Assign each row to part 0, 1, ... by its hash bucket; one projection, no shuffle. Every class
    gets the same shares up to sampling error."""
    bucket = hash_bucket(F.col(key), salt=_salt(seed))
    upto, chain = 0.0, None
    for i, share in enumerate(parts[:-1]):
        upto += share
        test = bucket < F.lit(round(upto, 12) * 2.0**32)
        chain = F.when(test, i) if chain is None else chain.when(test, i)
    last = len(parts) - 1
    return df.withColumn(name, chain.otherwise(last) if chain is not None else F.lit(last))


def stratified_split(df: DataFrame, label: str, key: str, parts: tuple[float, ...], seed: int = 0,
                     name: str = "split") -> DataFrame:
    """Exact shares per class: rows are numbered in hash order inside the class and cut at the
    rounded shares."""
    hashed = df.withColumn("_h", hash_bucket(F.col(key), salt=_salt(seed)))
    ranked = ordered.numbered(hashed, "_h", key, "_rn", [label])
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    joined = attach_groups(ranked, sizes.filter(F.col(label).isNotNull()), [label]).filter(F.col("_size").isNotNull())
    upto, chain = 0.0, None
    for i, share in enumerate(parts[:-1]):
        upto += share
        test = F.col("_rn") <= F.round(F.col("_size") * F.lit(round(upto, 6)))
        chain = F.when(test, i) if chain is None else chain.when(test, i)
    return joined.withColumn(name, chain.otherwise(len(parts) - 1)).select(*df.columns, name)


def assign_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Stratified folds of equal size: number inside the class, modulo k."""
    hashed = df.withColumn("_h", hash_bucket(F.col(key), salt=_salt(seed)))
    ranked = ordered.numbered(hashed, "_h", key, "_rn", [label])
    return ranked.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).select(*df.columns, "fold")


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("_size"))


def undersample(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Every class cut to the size of the smallest."""
    target = class_sizes(df, label).agg(F.min("_size")).scalar()
    hashed = df.withColumn("_h", hash_bucket(F.col(key), salt=_salt(seed)))
    return ordered.smallest(hashed, "_h", key, target, [label]).drop("_h")


def oversample(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Every class repeated up to the size of the largest: whole copies plus a remainder taken in
    hash order."""
    sizes = class_sizes(df, label)
    target = sizes.agg(F.max("_size")).scalar()
    hashed = df.withColumn("_h", hash_bucket(F.col(key), salt=_salt(seed)))
    ranked = ordered.numbered(hashed, "_h", key, "_rn", [label])
    ranked = attach_groups(ranked, sizes.withColumn("_target", target), [label]).filter(F.col("_size").isNotNull())
    extra = (F.col("_rn") <= F.pmod(F.col("_target"), F.col("_size"))).cast("int")
    copies = F.floor(F.col("_target") / F.col("_size")).cast("int") + extra
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select(*df.columns, "copy")


def balance(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """The binary rule: cut class 0 when it is the larger one, otherwise repeat the smaller one."""
    row = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).first()
    if row["n0"] > row["n1"]:
        return undersample(df, label, key, seed)
    return oversample(df, label, key, seed).drop("copy")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_c) per class."""
    sizes = class_sizes(df, label)
    total = sizes.agg(F.sum("_size")).scalar()
    k = sizes.agg(F.count("*")).scalar()
    return sizes.select(label, F.col("_size").alias("n"), (total / (k * F.col("_size"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """The weight of its class on every row; rows without a label go."""
    weights = class_weights(df, label).select(label, F.col("weight").alias(name))
    return attach_groups(df.filter(F.col(label).isNotNull()), weights, [label])


def pos_weight(df: DataFrame, label: str) -> DataFrame:
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(pos.alias("n_pos"), neg.alias("n_neg"), F.try_divide(pos, neg).alias("pos_over_neg"))


def smote(df: DataFrame, label: str, cls, target_n: int, features: list[str], key: str, k: int = 5,
          seed: int = 42) -> DataFrame:
    """Synthetic rows for one class up to ``target_n``: every new row lies between a class member and
    one of its k nearest neighbours, which are searched once a point and reach its members by a join on the point. The original rows are kept; new ones have ``synthetic`` = 1."""
    members = df.filter(F.col(label) == cls).select(key, *features)
    n = members.count()
    rows = df.withColumn("synthetic", F.lit(0))
    if n < 2 or target_n <= n:
        return rows
    each, rest = divmod(target_n - n, n)
    if rest:
        hashed = members.withColumn("_h", hash_bucket(F.col(key), salt=_salt(seed)))
        members = ordered.numbered(hashed, "_h", key, "_rn").withColumn("_copies", F.lit(each) + (F.col("_rn") <= rest).cast("int"))
    else:
        members = members.withColumn("_copies", F.lit(each))
    # of a neighbour only its place goes to the rows, and a 64-bit hash of its id, which tells a row's own entry
    id_hash = lambda c: F.when(c.isNotNull(), F.xxhash64(c))
    points = nearest_of_points(members, members, key, features, k + 1).withColumn(
        "near", F.transform("near", lambda x: F.struct(id_hash(x["id"]).alias("id"), *[x[f"to_{c}"].alias(f"to_{c}") for c in features])))
    wanted = slim_rows(members.filter(F.col("_copies") > 0), key, ["_copies"], features)
    near = attach_nearest(wanted, points, features, k, exclude_self=True, own=id_hash(F.col("_id"))).filter(F.size("near") > 0)
    each_copy = near.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    choice = hash_bucket(F.concat_ws(":", "_id", "_copy"), salt=f"#n{seed}")
    step = hash_bucket(F.concat_ws(":", "_id", "_copy"), salt=f"#g{seed}") / F.lit(4294967296.0)
    picked = each_copy.withColumn("_other", F.get("near", (choice % F.size("near")).cast("int"))).withColumn("_step", step)
    made = picked.select(
        F.lit(cls).alias(label), F.lit(1).alias("synthetic"),
        *[(F.col(c) + (F.col(f"_other.to_{c}") - F.col(c)) * F.col("_step")).alias(c) for c in features])
    return rows.unionByName(made, allowMissingColumns=True)


def take(df: DataFrame, split_col: str, part: int) -> DataFrame:
    return df.filter(F.col(split_col) == part).drop(split_col)


def hashed_key(cols: list[str]) -> Column:
    """A text key for rows without one."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
