"""Quality rules: counts of whole texts, and divergence from the document's language.

Every text gets a histogram of character classes and one of its language's common
words.  Both are compared with the sums over all documents of that language by
Jensen-Shannon distance (0 to 1).  Short texts have noisy histograms, so a test
applies from a least length on.  DataFrame functions only.

A null text has no words; a null language is a language of its own.  A language
with too few words in all makes no reference, and its texts pass that test.
Repeated rows are judged one by one; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.let import let
from leadloom.llm.shared import SPACE, WORD, Staged, bounded, take

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Classes in the order of the histogram; what none of them takes is the last bin.
CLASSES = ("[a-z]+", "[A-Z]+", SPACE, "[0-9]+", "[!-/:-@\\[-`{-~]+")

#: A word is common if it makes up this share of its language's words.
COMMON_SHARE = 0.008
#: Items that a sketch follows.  Its error is below a thousandth of all words, so no common word is missed.
SKETCH_ITEMS = 8192
CANDIDATES = 128
PARTIAL_SKETCHES = 64
#: Longer words go through the sketch by their digest, so that its size is bounded.
PLAIN_LENGTH = 64
#: Languages up to which their references are broadcast (some KB each); beyond, they are joined by shuffle.
MAX_LANGUAGES = 1000

MIN_CHARS, MAX_CLASS_DISTANCE = 200, 0.28
MIN_WORDS, MAX_WORD_DISTANCE = 50, 0.36
MIN_REFERENCE_WORDS = 2000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeat_words(words: Column, n: int = WINDOW) -> Column:
    """Words inside ``n``-word windows that the array holds twice or more."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(n), F.coalesce(F.get(places, k + 1) - p, F.lit(n))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def places(pairs: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(pairs, k)["g"] == e["g"], F.lit(False))
        flagged = F.transform(pairs, lambda e, k: F.when(same(e, k - 1) | same(e, k + 1), e["k"]))
        return let(F.sort_array(F.array_compact(flagged)), covered)

    def repeated(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, k: F.struct(g.alias("g"), k.alias("k"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(pairs, places))

    def of(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - n)
        grams = F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(n))))
        return F.when(F.size(hashes) <= n, F.lit(0)).otherwise(let(grams, repeated))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; 0 if one of them is empty."""

    def shares(h: Column) -> Column:
        return let(F.aggregate(h, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(h, lambda x: F.try_divide(x, total)))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(shares(p), shares(q), lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2))


def common_words(docs: DataFrame, staged: Staged) -> DataFrame:
    """``lang`` and ``vocabulary``: all words that can be common, by a frequent-items sketch over every word.

    A language has at most ``CANDIDATES`` of them, as each makes up ``COMMON_SHARE`` of its words.
    """
    words = docs.select("lang", F.explode(words_of(F.lower("text"))).alias("word"))
    # no word holds a space, so no word is taken for a digest
    is_long = F.length("word") > PLAIN_LENGTH
    digest = F.concat(F.lit(" "), F.sha2("word", 256))
    part = F.pmod(F.spark_partition_id(), F.lit(PARTIAL_SKETCHES)).alias("part")
    items = words.select("lang", part, F.when(is_long, digest).otherwise(F.col("word")).alias("item"))
    sketches = items.groupBy("lang", "part").agg(F.expr(f"approx_top_k_accumulate(item, {SKETCH_ITEMS})").alias("sketch"), F.count("*").alias("n"))
    whole = sketches.groupBy("lang").agg(F.expr(f"approx_top_k_combine(sketch, {SKETCH_ITEMS})").alias("sketch"), F.sum("n").alias("n"))
    # a sketch never counts too few, so no common word is left out here; measures() counts exactly
    likely = F.filter(F.expr(f"approx_top_k_estimate(sketch, {CANDIDATES})"), lambda x: x["count"] >= COMMON_SHARE * F.col("n"))
    found, _ = staged.write(whole.select("lang", F.explode_outer(F.transform(likely, lambda x: x["item"])).alias("item")))
    # one text for each common digest; without any, the texts are not read again
    wanted = bounded(found.where(F.col("item").startswith(" ")), staged, MAX_LANGUAGES * CANDIDATES)
    texts = words.where(is_long).select("lang", digest.alias("item"), "word").join(wanted, ["lang", "item"])
    texts = texts.groupBy("lang", "item").agg(F.min("word").alias("word"))
    named = found.join(texts, ["lang", "item"], "left").select("lang", F.coalesce("word", "item").alias("word"))
    return named.groupBy("lang").agg(F.sort_array(F.collect_list("word")).alias("vocabulary"))


def _class_counts(text: Column) -> Column:
    """Characters of each class and of none, from what is left as one class after the other goes."""

    def left(s: Column, k: int) -> Column:
        here = F.array(F.char_length(s))
        return let(F.regexp_replace(s, CLASSES[k], ""), lambda rest: F.concat(here, left(rest, k + 1))) if k < len(CLASSES) else here

    return let(left(text, 0), lambda n: F.transform(n, lambda x, k: x - F.coalesce(F.get(n, k + 1), F.lit(0))))


def measures(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Counts of each text, and its two histograms."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.join(vocabulary, "lang", "left").withColumn("words", words_of(F.col("text")))
    spaced = F.concat(F.lit(" "), F.lower(F.array_join("words", "  ")), F.lit(" "))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))

    def times(s: Column, word: Column) -> Column:
        gone = F.octet_length(s) - F.octet_length(F.replace(s, F.concat(F.lit(" "), word, F.lit(" ")), F.lit("")))
        return (gone / (F.octet_length(word) + 2)).cast("long")

    return rows.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(text).cast("long").alias("n_chars"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _class_counts(text).alias("classes"),
        let(spaced, lambda s: F.transform(F.coalesce("vocabulary", F.array().cast("array<string>")), lambda w: times(s, w))).alias("counted"),
    )


def references(measured: DataFrame) -> DataFrame:
    """Sums over all documents of a language, and which of its words are common."""
    sums = [F.sum(F.get("classes", F.lit(i))) for i in range(len(CLASSES) + 1)]
    classes = measured.groupBy("lang").agg(F.sum("n_words").alias("all_words"), F.array(*sums).alias("all_classes"))
    counts = measured.select("lang", F.posexplode("counted")).groupBy("lang", "pos").agg(F.sum("col").alias("n"))
    counts = counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("all_counted"))
    return classes.join(counts, "lang", "left").select(
        "lang", "all_words", "all_classes", F.coalesce(F.col("all_counted")["n"], F.array().cast("array<bigint>")).alias("all_counted")
    )


def judge(docs: DataFrame) -> DataFrame:
    """Counts, distances and verdict of each document; see the module's text for the rules."""
    rows = take(docs, "doc_id", "text", "lang").withColumn("lang", F.coalesce("lang", F.lit("")))
    staged = Staged(docs.sparkSession, "rules")
    measured, _ = staged.write(measures(rows, bounded(common_words(rows, staged), staged, MAX_LANGUAGES)))
    rows = measured.join(bounded(references(measured), staged, MAX_LANGUAGES), "lang", "left")

    def histogram(counted: Column, total: Column) -> Column:
        """Counts of the common words, then all other words."""
        common = F.filter(counted, lambda x, k: F.get("all_counted", k) >= COMMON_SHARE * F.col("all_words"))
        return let(common, lambda c: F.concat(c, F.array(total - F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b))))

    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far_classes = (F.col("n_chars") >= MIN_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)
    far_words = (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    strange = (F.col("all_words") >= MIN_REFERENCE_WORDS) & (far_classes | far_words)
    judged = rows.select(
        "*",
        distance(F.col("classes"), F.col("all_classes")).alias("class_distance"),
        distance(histogram(F.col("counted"), F.col("n_words")), histogram(F.col("all_counted"), F.col("all_words"))).alias("word_distance"),
        failed.alias("base_failed"),
    )
    return judged.select(
        "doc_id",
        "n_words",
        (F.col("n_chars") - F.get("classes", F.lit(2))).alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~F.coalesce(strange, F.lit(False))).alias("kept"),
        "class_distance",
        "word_distance",
    )
