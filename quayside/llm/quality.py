"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of common words are compared with those of its language by the
Jensen-Shannon distance (base 2, so from 0 to 1). All other words are one more bin, so that a long text without common
words is far from every language. The reference of a language is the mean histogram of its documents that pass the base
rules, so it covers the whole table and is one row per language listed below. Documents that are too short for a
histogram to mean anything pass it unchecked: below ``least_chars`` characters, or ``least_words`` words of any kind.

The limits lie below the distances between references: on the test tables words of a language's own documents of 80 or
more are within 0.28 of it in 99 of 100 cases, and the two nearest references (es, fr) are 0.32 apart.

Null and empty texts have no words and fail the base rules. A document of a null or unlisted language is judged by
the base rules alone, and so is one of a language whose reference is empty. Rows are judged one by one: repeated rows
and ties need no rule. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.session import materialize, scratch_path

# Common words of each language.
COMMON_WORDS = {
    "de": "der die und das den des ist ein eine nicht mit von zu auf für sich dem im".split(),
    "en": "the of and to in a is that it for on was be with as by this are from at".split(),
    "es": "de la que el en y a los se del las un por con no una su para".split(),
    "fr": "de la le et les des en un du une que est pour dans qui pas sur par".split(),
}
SYMBOLS = r"[#*$%&|<>]"
# The character classes that are told apart; all other characters form one more class.
CLASSES = {
    "upper": r"\p{Lu}",
    "digit": r"\p{N}",
    "space": r"[\x20\x09-\x0D]",
    "stop": r"[.,;:'\"()?-]",
    "sign": r"[!#*$%&|<>=+~^@/\\_{}\[\]]",
}
LOWER = r"\p{Ll}+"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
LEAST_WORDS, MOST_REPEATED = 50, 50
MAX_CLASS_DISTANCE = 0.145
MAX_WORD_DISTANCE = 0.28
LEAST_CHARS, LEAST_COMPARED = 200, 80

VOCABULARY = sorted({word for words in COMMON_WORDS.values() for word in words})
SPELLINGS = {s: w for w in VOCABULARY for s in (w, w.capitalize(), w.upper())}


def _code(index: int) -> str:
    """One letter that stands for a common word."""
    return chr(0x100 + index)


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds the words of every text as ``__words`` and the five base counts.

    n_repeat_words compares 64-bit hashes of the three-word windows of one text.
    """
    trimmed = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(BLANKS))
    line = F.filter(F.split(F.col("text"), "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    words = F.col("__words")
    size = F.size(words)
    hashes, places = F.col("__hashes"), F.col("__places")
    window = F.transform(
        F.slice(words, 1, size - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    )

    def twice(x: Column, i: Column) -> Column:
        before, behind = F.get(places, i - 1)["h"], F.get(places, i + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(behind == x["h"], F.lit(False))

    covered = F.aggregate(
        F.sort_array(F.transform(F.filter(places, twice), lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    return (
        docs.withColumn("__words", F.split(trimmed, r"[\x20\x09-\x0D]+"))
        .withColumn("__words", F.when(F.get(words, F.lit(0)) == "", F.array().cast("array<string>")).otherwise(words))
        .withColumn("__lines", F.coalesce(line, F.array().cast("array<string>")))
        .withColumn("__hashes", F.when(size >= 3, window))
        .withColumn(
            "__places",
            F.when(
                F.size(F.array_distinct(hashes)) < F.size(hashes),
                F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        )
        .withColumn("n_words", size.cast("long"))
        .withColumn("word_chars", F.length(F.array_join(words, "")).cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("__lines", "__hashes", "__places")
    )


def profile(docs: DataFrame) -> DataFrame:
    """base_counts, n_symbols, base_failed, and the two histograms as arrays of counts: ``__classes`` and ``__common``,
    whose last bin is that of all other words. ``__words`` is dropped."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = F.col("__rest")
    counts = [F.regexp_count(rest, F.lit(p)) for p in CLASSES.values()]
    lower = F.length(text) - F.length(rest)
    codes = F.create_map(
        *[x for s, w in SPELLINGS.items() for x in (F.lit(s), F.lit(_code(VOCABULARY.index(w))))]
    )
    common = F.filter("__words", lambda w: w.isin(list(SPELLINGS)))
    coded = F.col("__coded")
    every = F.array(*[F.lit(_code(i)) for i in range(len(VOCABULARY))])
    return (
        base_counts(docs)
        .withColumn("__rest", F.regexp_replace(text, LOWER, ""))
        .withColumn("n_symbols", F.regexp_count(rest, F.lit(SYMBOLS)).cast("long"))
        .withColumn("__classes", F.array(lower, *counts))
        .withColumn(
            "__classes",
            F.concat(
                F.col("__classes"),
                F.array(F.length(text) - F.aggregate("__classes", F.lit(0), lambda a, x: a + x)),
            ),
        )
        .withColumn("__coded", F.array_join(F.transform(common, lambda w: codes[w]), ""))
        .withColumn("__common", F.transform(every, lambda c: F.length(coded) - F.length(F.replace(coded, c))))
        .withColumn("__common", F.concat("__common", F.array(F.size("__words") - F.length(coded))))
        .withColumn(
            "base_failed",
            (F.col("n_words") < LEAST_WORDS)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED),
        )
        .drop("__words", "__rest", "__coded")
    )


def references(profiles: DataFrame) -> DataFrame:
    """One row per listed language: the sum of its documents' histograms, each brought to a million, so that a long
    document weighs no more than a short one. Only documents that pass the base rules count."""
    passed = profiles.where(~F.col("base_failed") & F.col("lang").isin(list(COMMON_WORDS)))
    def equal(name: str) -> Column:
        return F.transform(name, lambda x: F.coalesce(F.floor(F.try_divide(x * 1e6, F.col(f"{name}_sum"))), F.lit(0)))

    bins = passed.select("lang", F.posexplode(F.concat(equal("__classes"), equal("__common"))).alias("bin", "n"))
    summed = bins.groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"])
    size = len(CLASSES) + 2
    return (
        summed.groupBy(F.col("lang").alias("__lang"))
        .agg(ordered.alias("__bins"))
        .select(
            "__lang",
            F.slice("__bins", 1, size).alias("__ref_classes"),
            F.slice("__bins", size + 1, len(VOCABULARY) + 1).alias("__ref_common"),
        )
    )


def _total(counts: str) -> Column:
    return F.aggregate(F.col(counts), F.lit(0).cast("double"), lambda a, x: a + x)


def distance(counts: str, reference: str) -> Column:
    """Jensen-Shannon distance of two histograms whose sums are in columns of the same names with ``_sum``; null where
    either is empty."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    shares = F.zip_with(
        F.transform(counts, lambda x: x / F.col(f"{counts}_sum")),
        F.transform(reference, lambda x: x / F.col(f"{reference}_sum")),
        lambda a, b: term(a, b) + term(b, a),
    )
    half = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / 2
    return F.when(
        (F.col(f"{counts}_sum") > 0) & (F.col(f"{reference}_sum") > 0), F.sqrt(F.greatest(half, F.lit(0.0)))
    )


def judge(
    docs: DataFrame,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    least_chars: int = LEAST_CHARS,
    least_words: int = LEAST_COMPARED,
    with_text: bool = True,
) -> DataFrame:
    """All columns of ``docs`` (``text`` only if asked for), the base counts, base_failed, class_distance,
    word_distance and kept.

    The profiles are written to the shared folder once: the references need all of them before the first verdict.
    """
    spark = docs.sparkSession
    found = profile(docs)
    for name in ("__classes", "__common"):
        found = found.withColumn(f"{name}_sum", _total(name))
    held, _ = materialize(found if with_text else found.drop("text"), scratch_path(spark, "profiles"))
    known = references(held)
    for name in ("__ref_classes", "__ref_common"):
        known = known.withColumn(f"{name}_sum", _total(name))
    known, _ = materialize(known, scratch_path(spark, "references"))
    joined = held.join(
        F.broadcast(known),  # as many rows as COMMON_WORDS has languages, at most
        F.col("lang") == F.col("__lang"),
        "left",
    )
    far = joined.withColumn(
        "class_distance", F.when(F.col("__classes_sum") >= least_chars, distance("__classes", "__ref_classes"))
    ).withColumn("word_distance", F.when(F.col("n_words") >= least_words, distance("__common", "__ref_common")))
    divergent = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | (
        F.coalesce("word_distance", F.lit(0.0)) > max_word_distance
    )
    own = ["__lang", "__classes", "__common", "__ref_classes", "__ref_common"]
    return far.withColumn("kept", ~F.col("base_failed") & ~divergent).drop(*own, *[f"{name}_sum" for name in own])
