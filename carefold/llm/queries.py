"""The contract queries over the given tables; each goes through its operator and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from carefold.llm import collocations, decontaminate, htmltext, licences, lmscore, negatives, packing, quality, rules, secrets, simhash, topk, toxicity


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's 3-word SimHash fingerprint and component."""
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five best other vectors of every fiftieth."""
    return topk.top_k(_table(spark, folder, "embeddings"), 5, F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op3_lmscore(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's stupid-backoff score under the trigram model of all documents."""
    found = lmscore.score(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


def _classified(spark: SparkSession, folder: str, kind, folds: int, held: int) -> DataFrame:
    docs = _table(spark, folder, "documents")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    model = kind.train(docs, _table(spark, folder, "labels").filter(part != held))
    scored = kind.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (part == held).alias("held_out"), "score", (F.col("score") >= kind.THRESHOLD).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity; a fifth of the labels is held out."""
    return _classified(spark, folder, toxicity, 5, 0)


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality; a third of the labels is held out."""
    return _classified(spark, folder, quality, 3, 1)


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's secrets; an owner is a source, a repository a document."""
    found = secrets.scan(_table(spark, folder, "documents"))
    return found.select("doc_id", *secrets.digest(found))


def op7_html(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's article text."""
    found = htmltext.extract(_table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's words inside benchmark windows, and the items they come from."""
    found = decontaminate.matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP8_SQL = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
        FROM item, unnest(generate_series(1, greatest(1, len(w) - 9))) AS t(s) WHERE len(w) > 0),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
run AS (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS g
        FROM doc, (SELECT DISTINCT k FROM win), unnest(generate_series(1, len(w) - k + 1)) AS t(p)),
hit AS (SELECT doc_id, p, k, item_id FROM run JOIN win USING (k, g)),
word AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM (SELECT DISTINCT doc_id, p, k FROM hit), unnest(generate_series(0, k - 1)) AS t(o) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
"""

def op9_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's licences, their number and the best coefficient."""
    found = licences.scan(_table(spark, folder, "documents"))
    return found.select("doc_id", F.size("licences").cast("long").alias("n_licences"), F.array_join("licences.licence", ",").alias("licences"),
                        F.round(F.array_max("licences.dice"), 6).alias("best_dice"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place in the packed sequences."""
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


OP3_SQL = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
word AS (SELECT doc_id, p, w[p] AS w3, CASE WHEN p > 1 THEN w[p - 1] END AS w2, CASE WHEN p > 2 THEN w[p - 2] END AS w1
         FROM doc, unnest(generate_series(1, len(w))) AS t(p)),
one AS (SELECT w3 AS a, count(*) AS n FROM word GROUP BY 1),
two AS (SELECT w2 AS a, w3 AS b, count(*) AS n FROM word WHERE w2 IS NOT NULL GROUP BY 1, 2),
three AS (SELECT w1 AS a, w2 AS b, w3 AS c, count(*) AS n FROM word WHERE w1 IS NOT NULL GROUP BY 1, 2, 3),
total AS (SELECT count(*) AS t FROM word),
every AS (SELECT doc_id, CASE
    WHEN three.n >= 2 THEN ln(three.n) - ln(before.n)
    WHEN two.n >= 2 THEN ln(two.n) - ln(first.n) + CASE WHEN w1 IS NULL THEN 0 ELSE ln(0.4) END
    ELSE ln(one.n) - ln(t) + ln(0.4) * (CASE WHEN w1 IS NOT NULL THEN 2 WHEN w2 IS NOT NULL THEN 1 ELSE 0 END) END AS s
  FROM word CROSS JOIN total JOIN one ON one.a = w3 LEFT JOIN one first ON first.a = w2
  LEFT JOIN two ON two.a = w2 AND two.b = w3 LEFT JOIN two before ON before.a = w1 AND before.b = w2
  LEFT JOIN three ON three.a = w1 AND three.b = w2 AND three.c = w3)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(round(s, 4), 0) AS log_score
FROM doc LEFT JOIN (SELECT doc_id, sum(s) AS s FROM every GROUP BY doc_id) USING (doc_id)
"""

def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Three hard negatives for each of the five positives of every fiftieth vector; every seventh label is moved on by one."""
    rows = _table(spark, folder, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(moved, F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score
        FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
neg AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
               row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
        FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""

def op12_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's base measures, its distances from its language and the verdict."""
    found = rules.judge(_table(spark, folder, "documents"))
    return found.withColumn("class_distance", F.round("class_distance", 6)).withColumn("word_distance", F.round("word_distance", 6))


def _rules_sql() -> str:
    """The same in SQL: windows, lines, classes and words as rows, references as grouped rows."""
    rest, counts = "t", []
    for pattern in rules.CLASSES.values():
        pattern = pattern.replace("'", "''")
        counts.append(f"length({rest}) - length(regexp_replace({rest}, '{pattern}', '', 'g'))")
        rest = f"regexp_replace({rest}, '{pattern}', '', 'g')"
    counts.append(f"length({rest})")
    term = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / (p + q)) ELSE 0 END"
    part = f"{term('p')} + {term('q')}"
    return f"""
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS id, *, length(t) AS chars, [{', '.join(counts)}] AS c FROM (
         SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents)),
win AS (SELECT id, s, array_to_string(w[s:s + 2], ' ') AS g FROM doc, unnest(generate_series(1, len(w) - 2)) AS x(s)),
rep AS (SELECT id, count(DISTINCT s + o) AS n FROM (SELECT *, count(*) OVER (PARTITION BY id, g) AS times FROM win), unnest([0, 1, 2]) AS x(o) WHERE times > 1 GROUP BY id),
base AS (SELECT id, doc_id, lang, chars, c, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM doc LEFT JOIN rep USING (id)),
fit AS (SELECT * FROM base WHERE n_words >= {rules.BASE_WORDS}),
med AS (SELECT lang, kind, quantile_cont(share, 0.5) AS m, count(*) AS docs FROM (SELECT lang, kind, c[kind] * 1000 // chars AS share FROM fit, unnest(generate_series(1, len(c))) AS x(kind)) GROUP BY ALL),
cls AS (SELECT lang, kind, m / sum(m) OVER (PARTITION BY lang) AS q FROM med WHERE docs >= {rules.LEAST_DOCS}),
tok AS (SELECT lang, v, sum(unit) AS weight FROM (SELECT lang, unnest(w) AS v, {2**30} // len(w) AS unit FROM fit) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, v) AS bin FROM tok),
ref AS (SELECT lang, v, bin, weight / sum(weight) OVER (PARTITION BY lang) AS q FROM top),
com AS (SELECT lang, v, bin, q FROM ref WHERE bin <= {rules.COMMON}),
oth AS (SELECT lang, sum(q) FILTER (bin > {rules.COMMON}) AS q FROM ref GROUP BY lang),
cd AS (SELECT id, sqrt(greatest(0, sum({part}) / 2)) AS d FROM (SELECT id, q, c[kind] / chars AS p FROM base JOIN cls USING (lang) WHERE chars >= {rules.LEAST_CHARS}) GROUP BY id),
bins AS (SELECT id, lang, len(w) AS total, coalesce(bin, 0) AS bin, coalesce(com.q, oth.q) AS q
         FROM (SELECT id, lang, w, unnest(w) AS v FROM base WHERE len(w) >= {rules.LEAST_WORDS}) JOIN (SELECT DISTINCT lang FROM cls) USING (lang) LEFT JOIN com USING (lang, v) LEFT JOIN oth USING (lang)),
wd AS (SELECT id, sqrt(greatest(0, (sum({part}) + 1 - sum(q)) / 2)) AS d FROM (SELECT id, bin, q, count(*) / any_value(total) AS p FROM bins GROUP BY id, bin, q) GROUP BY id),
out AS (SELECT *, cd.d AS class_distance, wd.d AS word_distance, n_words < {rules.BASE_WORDS} OR 100 * n_repeat_words > {rules.BASE_REPEATED} * n_words AS base_failed
        FROM base LEFT JOIN cd USING (id) LEFT JOIN wd USING (id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance,
       NOT base_failed AND coalesce(class_distance, 0) <= {rules.MAX_CLASS_DISTANCE} AND coalesce(word_distance, 0) <= {rules.MAX_WORD_DISTANCE} AS kept FROM out
"""


OP12_SQL = _rules_sql()


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 best phrases of two or three words of every language."""
    return collocations.mine(_table(spark, folder, "documents"))


OP13_SQL = f"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
run AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM piece),
gram AS (SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS g, count(*)::HUGEINT AS f
         FROM run, (SELECT unnest([1, 2, 3]) AS k), unnest(generate_series(1, len(w) - k + 1)) AS t(s) GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM gram WHERE k = 1 GROUP BY 1),
cand AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM gram WHERE k > 1 AND f >= 10),
cut AS (SELECT c.lang, c.k, c.g, a, j, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score
        FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM cand) c
        JOIN gram x ON x.lang = c.lang AND x.g = array_to_string(w[:j], ' ') JOIN gram y ON y.lang = c.lang AND y.g = array_to_string(w[j + 1:], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(w[:2], ' ') AS g, a FROM cand WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:], ' '), a FROM cand WHERE k = 3),
kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = low.lang AND i.g = low.g AND low.k = 2 AND 100 * i.a >= 50 * low.a)),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, g AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best JOIN total USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op1_simhash": op1_simhash, "op2_topk": op2_topk, "op3_lmscore": op3_lmscore, "op4_toxicity": op4_toxicity, "op5_quality": op5_quality, "op6_secrets": op6_secrets, "op7_html": op7_html, "op8_decontaminate": op8_decontaminate, "op9_licences": op9_licences, "op10_packing": op10_packing,
           "op11_hard_negatives": op11_hard_negatives,
           "op12_rules": op12_rules, "op13_collocations": op13_collocations}
ORACLES: dict[str, str] = {"op3_lmscore": OP3_SQL, "op2_topk": OP2_SQL, "op8_decontaminate": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op12_rules": OP12_SQL,
                           "op13_collocations": OP13_SQL}
