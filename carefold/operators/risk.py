"""Comorbidity scores from a weighted condition table.

Every condition is a bit. A code finds the bits of its 3- and 4-character prefixes in tables whose size is fixed by the constant
code lists, and a patient's bits are joined by ``bit_or``: rows are neither repeated nor made distinct, and one hash aggregate with
map-side combining serves any number of conditions and schemes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from carefold.functions import risk_tables as R
from carefold.functions.codes import bare_code, expand_codes

#: Bits used of a long.
WORD = 62


def _bits(df: DataFrame, key: Column, lists: dict[str, list[str]], length: int, name: str) -> DataFrame:
    """``df`` with the bits of the conditions that list the key's prefix of that length, one column a word; null without any."""
    words = -(-len(lists) // WORD)
    found: dict[str, list[int]] = {}
    for i, prefixes in enumerate(lists.values()):
        for p in prefixes:
            if len(p) == length:
                found.setdefault(p, [0] * words)[i // WORD] |= 1 << (i % WORD)
    schema = ", ".join([f"{name}_key string", *[f"{name}_{k} bigint" for k in range(words)]])
    table = df.sparkSession.createDataFrame([(p, *w) for p, w in sorted(found.items())], schema)
    return df.join(F.broadcast(table), F.substring(key, 1, length) == F.col(f"{name}_key"), "left").drop(f"{name}_key")


def _with_bits(df: DataFrame, key: Column, lists: dict[str, list[str]], name: str) -> tuple[DataFrame, list[Column]]:
    """The same for all prefix lengths of the lists, with the words to aggregate."""
    lengths = sorted({len(p) for prefixes in lists.values() for p in prefixes})
    for n in lengths:
        df = _bits(df, key, lists, n, f"{name}{n}")
    words = []
    for k in range(-(-len(lists) // WORD)):
        word = F.lit(0).cast("bigint")
        for n in lengths:
            word = word.bitwiseOR(F.coalesce(F.col(f"{name}{n}_{k}"), F.lit(0).cast("bigint")))
        words.append(word)
    return df, words


def _flag(name: str, i: int) -> Column:
    return F.getbit(F.coalesce(F.col(f"{name}_{i // WORD}"), F.lit(0).cast("bigint")), F.lit(i % WORD)).cast("int")


def _prefixes(codes: dict[str, str]) -> dict[str, list[str]]:
    return {c: expand_codes(text) for c, text in codes.items()}


def weighted_conditions(df: DataFrame, id: str, code: str, codes: dict[str, str], weights: dict[str, float] | None = None,
                        beaten_by: dict[str, str] | None = None, age: str | None = None, largest: list[str] | None = None) -> DataFrame:
    """Flag per condition and, with ``weights``, ``comorbidity_score``. A mild form is set to 0 when
    the severe form in ``beaten_by`` is present. Patients without any condition keep zeros."""
    extra = [*([age] if age else []), *(largest or [])]
    marked, words = _with_bits(df.select(*[F.col(c) for c in [id, code, *extra]]), bare_code(F.col(code)), _prefixes(codes), "_bits")
    masks = marked.groupBy(id).agg(*[F.max(c).alias(c) for c in extra], *[F.bit_or(w).alias(f"_bits_{k}") for k, w in enumerate(words)])
    out = masks.select(id, *extra, *[_flag("_bits", i).alias(c) for i, c in enumerate(codes)])
    for mild, severe in (beaten_by or {}).items():
        out = out.withColumn(mild, F.when(F.col(severe) == 1, 0).otherwise(F.col(mild)))
    return out if weights is None else with_score(out, weights, age)


def with_score(flags: DataFrame, weights: dict[str, float], age: str | None = None) -> DataFrame:
    score = sum((F.col(c) * F.lit(w) for c, w in weights.items() if w and c in flags.columns), F.lit(0))
    out = flags.withColumn("comorbidity_score", score)
    return out.withColumn("age_adj_comorbidity_score", age_adjust(F.col("comorbidity_score"), F.col(age))) if age else out


def all_schemes(df: DataFrame, id: str, code: str, second_weights: dict[str, float] | None = None,
                age: str | None = None, second_label: str = "Second weights") -> tuple[dict[str, DataFrame], DataFrame]:
    """Charlson, both Elixhauser weightings and the disability flags from a single pass: the three
    code lists meet the codes in one join, and every table is a projection of one aggregate, whose
    shuffle the optimizer then shares."""
    lists = {"charlson": R.CHARLSON_CODES, "elixhauser": R.ELIXHAUSER_CODES, "disability": R.DISABILITY_CODES}
    merged = {f"{k}_{c}": text for k, codes in lists.items() for c, text in codes.items()}
    flags = weighted_conditions(df.withColumn("_age", F.col(age) if age else F.lit(None).cast("int")), id, code, merged, None, None, None, ["_age"])

    def scheme(name: str, weights: dict[str, float] | None, beaten_by: dict[str, str]) -> DataFrame:
        got = {c: F.col(f"{name}_{c}") for c in lists[name]}
        for mild, severe in beaten_by.items():
            got[mild] = F.when(F.col(f"{name}_{severe}") == 1, 0).otherwise(got[mild])
        out = flags.select(id, *([F.col("_age").alias(age)] if age else []), *[x.alias(c) for c, x in got.items()])
        return out if weights is None else with_score(out, weights, age)

    schemes = {"Charlson": scheme("charlson", R.CHARLSON_QUAN_WEIGHTS, R.CHARLSON_BEATEN_BY),
               "Van Walraven": scheme("elixhauser", R.ELIXHAUSER_VW_WEIGHTS, R.ELIXHAUSER_BEATEN_BY)}
    if second_weights is not None:
        schemes[second_label] = scheme("elixhauser", second_weights, R.ELIXHAUSER_BEATEN_BY)
    disability_flags = scheme("disability", None, {})
    return schemes, disability_flags.drop(age) if age else disability_flags


def charlson(df: DataFrame, id: str, code: str, age: str | None = None, assign0: bool = True,
             weights: dict[str, float] | None = None) -> DataFrame:
    return weighted_conditions(df, id, code, R.CHARLSON_CODES, weights or R.CHARLSON_QUAN_WEIGHTS,
                               R.CHARLSON_BEATEN_BY if assign0 else None, age)


def elixhauser(df: DataFrame, id: str, code: str, weights: dict[str, float] | None = None, age: str | None = None,
               assign0: bool = True) -> DataFrame:
    """van Walraven weights unless others are given, such as a national set."""
    return weighted_conditions(df, id, code, R.ELIXHAUSER_CODES, weights or R.ELIXHAUSER_VW_WEIGHTS,
                               R.ELIXHAUSER_BEATEN_BY if assign0 else None, age)


def comorbidity(df: DataFrame, id: str, code: str, score: str = "charlson", weights: dict[str, float] | None = None,
                assign0: bool = True, age: str | None = None) -> DataFrame:
    fn = {"charlson": charlson, "elixhauser": elixhauser}[score]
    return fn(df, id, code, weights=weights, assign0=assign0, age=age)


def age_adjust(score: Column, age: Column) -> Column:
    """One point per decade over 40, at most four."""
    return score + F.least(F.greatest(F.floor((age - 40) / F.lit(10)), F.lit(0)), F.lit(4))


def survival_10yr(score: Column) -> Column:
    """Ten-year survival of the (age-adjusted) Charlson score: 0.983 ^ exp(0.9 * score)."""
    return F.pow(F.lit(0.983), F.exp(score * F.lit(0.9)))


def disability(df: DataFrame, id: str, code: str, codes: dict[str, str] | None = None) -> DataFrame:
    return weighted_conditions(df, id, code, codes or R.DISABILITY_CODES)


def _category(code: str) -> Column:
    return F.upper(F.substring(F.col(code), 1, 3))


def _frailty_points(name: str) -> Column:
    """Points of the categories whose bits are set; added up in tenths, so the order does not matter."""
    tenths = [_flag(name, i).cast("bigint") * round(p * 10) for i, p in enumerate(R.HFRS_POINTS.values())]
    while len(tenths) > 1:  # added in pairs, so that the expression stays flat
        tenths = [x + y for x, y in zip(tenths[::2], tenths[1::2])] + tenths[len(tenths) // 2 * 2:]
    return tenths[0] / F.lit(10.0)


def hfrs(df: DataFrame, id: str, code: str, min_age: int | None = None, age: str | None = None) -> DataFrame:
    """Hospital frailty risk score: points of every distinct scored category of the patient."""
    rows = df.filter(F.col(age) >= min_age) if min_age is not None else df
    marked, words = _with_bits(rows.select(id, code), _category(code), {c: [c] for c in R.HFRS_POINTS}, "_frail")
    masks = marked.groupBy(id).agg(*[F.bit_or(w).alias(f"_frail_{k}") for k, w in enumerate(words)])
    return masks.select(id, _frailty_points("_frail").alias("hfrs"))


def _scheme(codes: dict[str, str], start: int, weights: dict[str, float], beaten_by: dict[str, str]) -> tuple[dict[str, Column], Column]:
    """Flags of a scheme whose first condition is bit ``start`` of a profile, and its score."""
    raw = {c: _flag("_bits", start + i) for i, c in enumerate(codes)}
    flags = {c: F.when(raw[beaten_by[c]] == 1, 0).otherwise(x) if c in beaten_by else x for c, x in raw.items()}
    return flags, sum((flags[c] * F.lit(w) for c, w in weights.items() if w and c in flags), F.lit(0))


def profile(df: DataFrame, id: str, code: str, age: str | None = None, min_age: int | None = None) -> DataFrame:
    """One row per patient: the bits of the Charlson, Elixhauser and disability lists and of the frailty categories, the largest
    age, and whether a row of the frailty age exists. All schemes are projections of this one aggregate."""
    lists = {f"{k}_{c}": p for k, codes in enumerate([R.CHARLSON_CODES, R.ELIXHAUSER_CODES, R.DISABILITY_CODES]) for c, p in _prefixes(codes).items()}
    slim = df.select(id, code, *([age] if age else []))
    marked, words = _with_bits(slim, bare_code(F.col(code)), lists, "_bits")
    marked, frail = _with_bits(marked, _category(code), {c: [c] for c in R.HFRS_POINTS}, "_frail")
    old = F.lit(True) if min_age is None else F.coalesce(F.col(age) >= min_age, F.lit(False))
    return marked.groupBy(id).agg(
        *([F.max(age).alias(age)] if age else []), F.max(old).alias("_old"), *[F.bit_or(w).alias(f"_bits_{k}") for k, w in enumerate(words)],
        *[F.bit_or(F.when(old, w)).alias(f"_frail_{k}") for k, w in enumerate(frail)])


def risk_rows(df: DataFrame, id: str, code: str, second_weights: dict[str, float], age: str | None = None, min_age: int | None = None,
              second_label: str = "Second weights") -> DataFrame:
    """``risk_table`` of Charlson and two Elixhauser weightings with frailty and disability, from one aggregate and without a
    join: a patient's bits are unfolded into one row per scheme. Conditions of other schemes are 0, and so are frailty and
    disability of patients below the frailty age."""
    bits = len(R.CHARLSON_CODES)
    schemes = {"Charlson": (R.CHARLSON_CODES, 0, R.CHARLSON_QUAN_WEIGHTS, R.CHARLSON_BEATEN_BY),
               "Van Walraven": (R.ELIXHAUSER_CODES, bits, R.ELIXHAUSER_VW_WEIGHTS, R.ELIXHAUSER_BEATEN_BY),
               second_label: (R.ELIXHAUSER_CODES, bits, second_weights, R.ELIXHAUSER_BEATEN_BY)}
    names = list(dict.fromkeys([*R.CHARLSON_CODES, *R.ELIXHAUSER_CODES]))
    rows = []
    for label, spec in schemes.items():
        flags, score = _scheme(*spec)
        adjusted = [age_adjust(score, F.col(age)).alias("age_adj_comorbidity_score")] if age else []
        rows.append(F.struct(*[flags.get(c, F.lit(0)).alias(c) for c in names], score.alias("comorbidity_score"), *adjusted, F.lit(label).alias("weight")))
    first = bits + len(R.ELIXHAUSER_CODES)
    impaired = [F.when(F.col("_old"), _flag("_bits", first + i)).otherwise(0).alias(c) for i, c in enumerate(R.DISABILITY_CODES)]
    frailty = F.when(F.col("_old"), _frailty_points("_frail")).otherwise(0.0).alias("hfrs")
    made = profile(df, id, code, age, min_age)
    return made.select(id, *([age] if age else []), F.inline(F.array(*rows)), frailty, *impaired).fillna(0)


def episode_scores(df: DataFrame, id: str, code: str) -> DataFrame:
    """Charlson and Elixhauser flags and scores side by side, names that both have with the scheme's name, and frailty."""
    charlson_flags, charlson_score = _scheme(R.CHARLSON_CODES, 0, R.CHARLSON_QUAN_WEIGHTS, R.CHARLSON_BEATEN_BY)
    elix_flags, elix_score = _scheme(R.ELIXHAUSER_CODES, len(R.CHARLSON_CODES), R.ELIXHAUSER_VW_WEIGHTS, R.ELIXHAUSER_BEATEN_BY)
    left, right = {**charlson_flags, "comorbidity_score": charlson_score}, {**elix_flags, "comorbidity_score": elix_score}
    cols = [x.alias(f"{c}_{name}" if c in other else c) for mine, other, name in ((left, right, "charlson"), (right, left, "elixhauser")) for c, x in mine.items()]
    return profile(df, id, code).select(id, *cols, _frailty_points("_frail").alias("hfrs"))


def frailty_tier(score: Column) -> Column:
    return F.when(score < 5, "low").when(score <= 15, "intermediate").when(score > 15, "high")


def risk_table(scores: dict[str, DataFrame], frailty: DataFrame, impairments: DataFrame, id: str) -> DataFrame:
    """Stacked schemes with a ``weight`` label, outer-joined with frailty and impairments, 0-filled."""
    stacked = None
    for label, s in scores.items():
        s = s.withColumn("weight", F.lit(label))
        stacked = s if stacked is None else stacked.unionByName(s, allowMissingColumns=True)
    both = frailty.join(impairments, id)
    return stacked.join(both, id, "full_outer").fillna(0)


def frailty_by_disability(df: DataFrame, flags: list[str], score: str = "hfrs") -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("disability"), F.col(f).alias("presence")) for f in flags])
    return df.select(score, F.inline(pairs)).groupBy("disability", "presence").agg(
        F.avg(score).alias("mean_score"), F.count("*").alias("n"))


def attach_episode_scores(df: DataFrame, scores: list[DataFrame], on: str) -> DataFrame:
    """Left-join every score table on its own, so an episode missing from one keeps the others."""
    out = df
    for s in scores:
        out = out.join(s, on, "left").fillna(0, subset=[c for c in s.columns if c != on])
    return out
