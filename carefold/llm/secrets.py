"""Secret scan with corpus-wide ownership frequency, in built-in functions only.

Matches and their places come from one pass over the whole texts. Every matched value is counted over the corpus by distinct
owners and distinct repositories: a value that few owners have is taken for a live credential, a value that many share for a
copied example. Counting is combined before every shuffle, values travel as hashes, and the counts go back to the rows by a
salted join, so a value that a third of all rows holds is spread over several tasks. Texts are never shuffled by the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from carefold.session import cut_lineage

#: (kind, pattern, group that is the value, least length of the value). The last kind is only kept where its value is live.
KINDS = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),  # the same matches as AKIA[A-Z0-9]+ of 20 characters or more
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # likewise
    ("other", r"-----BEGIN [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9][A-Za-z0-9+/_-]{19,}", 0, 20),
)
BASE = 3
#: A value that more owners than this have is a copied example.
MAX_OWNERS = 2
#: Each value's counts are copied so many times for the join back to the rows.
SALT = 8

_FOUND = "array<struct<start: bigint, kind: int, end: bigint, value: string>>"


def _matches(text: Column, kind: int) -> Column:
    """Leftmost matches of one kind that do not overlap, with code-point places, as _FOUND."""
    name, pattern, group, least = KINDS[kind]
    regex = F.lit(pattern)
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, regex, F.lit(0))
    values = F.regexp_extract_all(text, regex, F.lit(group)) if group else whole
    rows = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), values.alias("value"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_FOUND).alias("out"))

    def add(state, row):
        begin = state["at"] + F.length(row["gap"])
        end = begin + F.length(F.coalesce(row["whole"], F.lit("")))
        hit = F.struct(begin.cast("long").alias("start"), F.lit(kind).alias("kind"), end.cast("long").alias("end"), row["value"].alias("value"))
        good = row["value"].isNotNull() & (F.length(row["value"]) >= least)
        if name == "other":
            good &= row["value"].rlike("PRIVATE KEY|[0-9]") & row["value"].rlike("[A-Za-z]")
        return F.struct(end.cast("long").alias("at"), F.when(good, F.concat(state["out"], F.array(hit))).otherwise(state["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(rows, start, add, lambda s: s["out"])).otherwise(F.array().cast(_FOUND))


def _joined(spans: Column) -> Column:
    """kind:start:end of spans in their order, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """``docs`` as struct ``_doc`` with ``_base`` and ``_extra`` matches in order, ``_owner`` and ``_repo``. A null text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.struct(*docs.columns).alias("_doc"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("_owner"),
                        F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("_repo"),
                        *[_matches(text, k).alias(f"_k{k}") for k in range(len(KINDS))])
    base = F.array_sort(F.concat(*[F.col(f"_k{k}") for k in range(BASE)]))
    extra = F.filter("_k3", lambda e: ~F.exists("_base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    return found.select("_doc", "_owner", "_repo", base.alias("_base"), "_k3").select("_doc", "_owner", "_repo", "_base", extra.alias("_extra"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repos, uses) of every matched value of the corpus."""
    return found.groupBy("hash").agg(F.countDistinct("_owner").alias("owners"), F.countDistinct("_repo").alias("repos"), F.count("*").alias("uses"))


def scan(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", carry: tuple[str, ...] = ("doc_id",),
         max_owners: int = MAX_OWNERS) -> DataFrame:
    """The ``carry`` columns of every row with its secrets:

    base, spans (start, kind, end, hash, owners, repos, live): all matches of the three base kinds; these and
    the live ones of the further kind, by start, then kind. Places are code points, end exclusive; hash is the SHA-256 of the
    value; live says that at most ``max_owners`` owners have the value anywhere.

    Null texts are empty ones, null owners and repositories count as one unnamed one. Repeated rows are scanned each. A row
    without secrets has empty lists. No rows, no rows. ``carry`` may name the text, which then is written once to the shared folder."""
    slim = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("_t"), F.col(owner_col).alias("_o"), F.col(repo_col).alias("_r"))
    rows = candidates(slim, "_t", "_o", "_r").withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_doc", F.struct(*[F.col(f"_doc._c{i}").alias(f"_c{i}") for i in range(len(carry))]))
    hashed = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))
    rows = cut_lineage(rows.select("_row", "_doc", "_owner", "_repo", hashed(F.col("_base")).alias("_base"), hashed(F.col("_extra")).alias("_extra")))
    some = F.size("_base") + F.size("_extra") > 0
    each = rows.filter(some).select("_row", "_owner", "_repo", F.explode(F.concat("_base", "_extra")).alias("s")).select("_row", "_owner", "_repo", "s.*")
    counts = ownership(each).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    judged = each.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALT)).cast("int")).join(counts, ["hash", "_salt"])
    judged = judged.withColumn("live", F.col("owners") <= max_owners)
    span = F.struct("start", "kind", "end", "hash", "owners", "repos", "live")
    spans = judged.filter((F.col("kind") < BASE) | F.col("live")).groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    kind = spans.schema["spans"].dataType.simpleString()
    known = rows.filter(some).select("_row", "_doc", "_base").join(spans, "_row", "left").select("_doc", "_base", F.coalesce("spans", F.array().cast(kind)).alias("spans"))
    none = rows.filter(~some).select("_doc", "_base", F.array().cast(kind).alias("spans"))
    out = known.unionByName(none)
    return out.select(*[F.col(f"_doc._c{i}").alias(c) for i, c in enumerate(carry)], F.col("_base").alias("base"), "spans")


def digest(found: DataFrame) -> list[Column]:
    """Counts of the base kinds, digest of the base matches and text of all spans of a ``scan``."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind][0]}")

    return [*map(count, range(BASE)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")]


def redact(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", mark: str = "[secret]", max_owners: int = MAX_OWNERS) -> DataFrame:
    """``docs`` with every span of ``scan`` that is live replaced by ``mark``; copied examples, all rows and all columns stay,
    whatever the columns are called. Null texts stay null; repeated rows come out each; spans that overlap become one mark; an empty table stays empty."""
    own = {c: f"_r{i}" for i, c in enumerate(docs.columns)}  # free of names that the scan adds
    found = scan(docs.toDF(*own.values()), own[text_col], own[owner_col], own[repo_col], tuple(own.values()), max_owners)
    live = F.filter("_spans", lambda s: s["live"])
    text = F.col("_text")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def cut(s, span):
        fresh = span["start"] >= s["at"]
        out = F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (span["start"] - s["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(s["at"], span["end"]).alias("at"), F.when(fresh, out).otherwise(s["out"]).alias("out"))

    clean = F.aggregate(live, state, cut, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    held = found.select(*own.values(), F.col("spans").alias("_spans"), F.col(own[text_col]).cast("string").alias("_text"))
    held = held.withColumn("_clean", F.when(F.size(live) > 0, clean).otherwise(text))
    return held.select(*[F.col("_clean" if c == text_col else own[c]).alias(c) for c in docs.columns])
