"""Quality rules by distribution divergence, in built-in functions only.

Two histograms describe a text: its characters by class, and its words by the most common words of its language. Their references
come from the corpus: of every class the median share over a language's documents, which a third of odd documents cannot move far, and
the common words with their mean shares. A text whose Jensen-Shannon distance from a reference is too large is rejected. Short
texts are noisy, so each distance has a least length below which it says nothing, and a language with few documents has no
reference. Shares are added up as whole numbers, so references do not depend on the order of rows. Texts are read twice, for the
common words and for all measures, and never shuffled: word counts are combined before the shuffle, the common words, one row a
language, are joined back to the texts, and the median shares come from the measures, which are written without the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from carefold.session import cut_lineage

#: Character classes (fixed values), each taken from what the ones before it leave; what is left over at the end is the last class, signs.
CLASSES = {"lower": r"\p{Ll}+", "space": r"[\x20\x09-\x0D]+", "upper": r"[\p{Lu}\p{Lt}]+", "letters": r"[\p{L}\p{M}]+", "digits": r"\p{N}+",
           "marks": r"""[.,;:!?'"()\[\]\-–—…“”„‘’«»¿¡。、，]+"""}
#: Words of a language that its word histogram tells apart; all others share a bin.
COMMON = 32
#: Slots, a power of two, that tell most words apart from the common ones by hash.
SLOTS = 256
#: Hashes that are looked up one by one in every window of a text.
FEW = 64
#: Largest distances that a kept text has, 0 to 1. The chance of the draw alone puts a text of LEAST_WORDS words at about 0.24.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.35
#: Least characters and words for which a distance counts, and least documents of a language with a reference.
LEAST_CHARS, LEAST_WORDS, LEAST_DOCS = 200, 100, 20
#: The base rule: least words, and the largest share of words in repeated windows.
BASE_WORDS, BASE_REPEATED = 50, 50

_UNIT = 2**30


def _split(text: Column, between: str) -> Column:
    """Runs of what ``between`` does not match; splitting is quicker than matching them."""
    return F.array_remove(F.split(text, between, -1), "")


def _words(text: Column) -> Column:
    return _split(text, r"[\x20\x09-\x0D]+")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once a row, however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hashes(keys: Column) -> Column:
    """64-bit hashes of all three-word windows from the words' own hashes, which are worked out once a word."""
    some = F.transform(F.slice(keys, 1, F.greatest(F.lit(0), F.size(keys) - 2)), lambda x, i: F.xxhash64(x, F.get(keys, i + 1), F.get(keys, i + 2)))
    return F.when(F.size(keys) >= 4, some).otherwise(F.array().cast("array<bigint>"))


def _repeated(h: Column) -> Column:
    """Words inside windows whose hash occurs twice or more. Up to ``FEW`` such hashes are looked up for every window; more of
    them are found by sorting the windows with their places, which takes longer for short lists and no square of long ones."""
    def sorted_pairs(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def places(again: Column) -> Column:
        looked_up = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i)), lambda i: i.isNotNull())
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(again) <= FEW, looked_up).otherwise(_let(pairs, sorted_pairs))

    again = _let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1) == x, F.lit(False)))))
    start = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(_let(again, places), start, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")), lambda a: a["n"])


def _classes(df: DataFrame) -> DataFrame:
    """``df (text, ...)`` with ``classes``, the number of characters of each class, and ``signs``, the characters of the last. What a
    class takes is removed before the next looks, so only the first pattern meets the whole text."""
    rest = df.withColumn("_r0", F.col("text"))
    for k, pattern in enumerate(CLASSES.values()):
        rest = rest.withColumn(f"_r{k + 1}", F.regexp_replace(f"_r{k}", pattern, ""))
    n = len(CLASSES)
    counts = [F.length(f"_r{k}") - F.length(f"_r{k + 1}") for k in range(n)] + [F.length(f"_r{n}")]
    return rest.select(*df.columns, F.array(*counts).alias("classes"), F.col(f"_r{n}").alias("signs"))


def word_references(texts: DataFrame, common: int = COMMON) -> DataFrame:
    """(lang, common, word_shares, slots) of ``texts (lang, text)``: the ``common`` words with the largest mean share, ties to the
    smaller word; the share of all other words, then of these; for every value of a word's hash modulo SLOTS whether a
    common word has it, 1 or 0. Texts with fewer words than the base rule asks for are left out."""
    words = texts.select("lang", _words(F.col("text")).alias("words")).filter(F.size("words") >= BASE_WORDS)
    each = words.select("lang", F.expr(f"{_UNIT} div size(words)").alias("unit"), F.explode("words").alias("word"))
    counts = cut_lineage(each.groupBy("lang", "word").agg(F.sum("unit").alias("weight")))
    total = counts.groupBy("lang").agg(F.sum("weight").alias("total"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("weight"), "word"))).filter(F.col("rank") <= common)
    best = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "weight"))).alias("b")).join(total, "lang")
    own = F.transform("b", lambda x: x["weight"] / F.col("total"))
    other = (F.col("total") - F.aggregate("b", F.lit(0).cast("long"), lambda s, x: s + x["weight"])) / F.col("total")
    taken = lambda i: F.exists("b", lambda x: _slot(x["word"]) == i).cast("int")
    return cut_lineage(best.select("lang", F.col("b.word").alias("common"), F.concat(F.array(other), own).alias("word_shares"), F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), taken).alias("slots")))


def class_references(measured: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, class_shares) of ``measured (lang, n_words, classes)``: the median share (in thousandths, cut) of every class over texts
    of the base rule's length, brought to a sum of one. Languages with fewer than ``least_docs`` such texts have no row."""
    chars = F.aggregate("classes", F.lit(0), lambda a, x: a + x)
    shares = measured.filter(F.col("n_words") >= BASE_WORDS).withColumn("chars", chars).select(
        "lang", F.posexplode(F.transform("classes", lambda c: (c.cast("long") * 1000 / F.col("chars")).cast("int"))).alias("kind", "share"))
    counts = shares.groupBy("lang", "kind", "share").agg(F.count("*").alias("n"))  # at most 1,001 shares a class
    median = counts.groupBy("lang", "kind").agg(F.percentile("share", F.lit(0.5), F.col("n")).alias("m"), F.sum("n").alias("docs"))
    whole = lambda a: F.transform(a, lambda x: x["m"] / F.aggregate(a, F.lit(0.0), lambda s, y: s + y["m"]))
    found = median.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("kind", "m"))).alias("a"), F.max("docs").alias("docs"))
    return found.filter(F.col("docs") >= least_docs).select("lang", whole(F.col("a")).alias("class_shares"))


def _part(p: Column, q: Column) -> Column:
    """What a bin adds to twice the Jensen-Shannon divergence in bits."""
    term = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return term(p) + term(q)


def class_distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance (0 to 1) of counts and reference shares of the same bins."""
    both = _let(F.aggregate(counts, F.lit(0), lambda a, x: a + x), lambda n: F.aggregate(F.zip_with(counts, shares, lambda c, q: _part(c / n, q)), F.lit(0.0), lambda a, x: a + x))
    return F.sqrt(F.greatest(F.lit(0.0), both / 2))


def _slot(word: Column) -> Column:
    return _low(F.xxhash64(word))


def _low(key: Column) -> Column:
    return key.bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def _places(words: Column, keys: Column, common: Column, slots: Column) -> Column:
    """The sorted places, from 1, of those words that are common ones. Most words are not and have an empty slot; only the others
    are looked for."""
    some = F.filter(words, lambda w, i: F.get(slots, _low(F.get(keys, i))) != 0)
    return F.sort_array(F.filter(F.transform(some, lambda w: F.array_position(common, w).cast("int")), lambda k: k > 0))


def word_distance(places: Column, n: Column, shares: Column) -> Column:
    """Jensen-Shannon distance (0 to 1) of a text of ``n`` words from reference shares, by the sorted places of its common words. Their
    runs are found one by one; what is left of the text are other words; common words that it lacks add half their share."""
    def of(s: Column) -> Column:
        others, size = n - F.size(s), F.size(s)

        def runs(r: Column) -> Column:
            part = lambda count, k: _let(F.get(shares, k), lambda q: F.struct(_part(count / n, q).alias("d"), q.alias("q")))
            each = F.concat(F.when(others > 0, F.array(part(others, F.lit(0)))).otherwise(F.array()),
                            F.transform(r, lambda i, j: part(F.coalesce(F.get(r, j + 1), size) - i, F.get(s, i))))
            start = F.struct(F.lit(0.0).alias("d"), F.lit(1.0).alias("q"))
            return F.aggregate(each, start, lambda a, x: F.struct((a["d"] + x["d"]).alias("d"), (a["q"] - x["q"]).alias("q")), lambda a: a["d"] + a["q"])
        first = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
        return _let(first, runs)

    return F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), _let(places, of) / 2)))


def judge(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", lang_col: str = "lang", common: int = COMMON,
          max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, least_chars: int = LEAST_CHARS,
          least_words: int = LEAST_WORDS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The ``carry`` columns of every row with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, word_distance and kept.

    Words are runs without white space, as they stand. A distance is null where the text is too
    short for it or its language has too few documents, and then rejects nothing. A null text is empty and fails the base
    rule; a null language is ``und``; repeated rows are judged each and count each in the references. ``carry`` may name any
    columns, which are written once to the shared folder. Windows are told apart by 64-bit hashes within a text. No rows, no rows."""
    slim = docs.select(F.struct(*[F.col(c) for c in carry]).alias("doc"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = slim.join(word_references(slim.select("lang", "text"), common), "lang", "left")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = _classes(rows.withColumn("words", _words(F.col("text"))).withColumn("lines", lines))
    rows = rows.withColumn("keys", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("hashes", _hashes(F.col("keys"))).withColumn("places", _places(F.col("words"), F.col("keys"), F.col("common"), F.col("slots")))
    spaces = F.get("classes", F.lit(list(CLASSES).index("space")))
    long = lambda c: c.cast("long")
    again = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), _repeated(F.col("hashes"))).otherwise(long(F.lit(0)))
    measured = cut_lineage(rows.select(
        "doc", "lang", "classes", F.length("text").alias("chars"), long(F.size("words")).alias("n_words"), long(F.length("text") - spaces).alias("word_chars"),
        long(F.length("signs") - F.length(F.translate("signs", "#*$%&|<>", ""))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), again.alias("n_repeat_words"),
        F.when((F.size("words") >= least_words) & F.col("word_shares").isNotNull(), word_distance(F.col("places"), F.size("words"), F.col("word_shares"))).alias("word_distance")))
    measured = measured.join(class_references(measured, least_docs), "lang", "left")
    known = F.col("class_shares").isNotNull()
    measured = measured.withColumn("class_distance", F.when(known & (F.col("chars") >= least_chars), class_distance(F.col("classes"), F.col("class_shares")))) \
        .withColumn("word_distance", F.when(known, F.col("word_distance")))
    failed = (F.col("n_words") < BASE_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * BASE_REPEATED)
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    measured = measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~far)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")
    return measured.select(*[F.col(f"doc.`{c}`").alias(c) for c in carry], *names)
