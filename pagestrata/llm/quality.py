"""Quality rules: base counts of a text, and its distance from what its language looks like.

The method compares two histograms of a document with those of its language over all documents:
characters of words by class (vowels, other letters, digits, punctuation, rest) and the language's
commonest words plus everything else. Each pair is compared by the Jensen-Shannon distance (base 2,
0 to 1). A document farther than ``MAX_CLASS`` or ``MAX_WORDS`` from the reference fails. Documents
below ``MIN_WORDS`` words are too short for a histogram and only the base rules judge them.

All of it is DataFrame functions inside one row: windows of eight words are hashed, sorted and
compared in an array, so no text is shuffled. References are sums over all documents. They are
broadcast: one row for each of the ``LANGUAGES`` largest languages, with ``COMMON`` words each; every
other language is held against the reference over all documents. Only their words, at most so many each, pass
the driver.

Defined cases: a null text has no words and fails the base rules; a null language is held against
the reference over all documents; repeated rows are judged alike; an empty table gives no rows.
Other columns may have any name that does not begin with ``_q``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.llm.common import BLANKS, pin, words, written

MIN_WORDS = 50
COMMON = 24
LANGUAGES = 256
MAX_CLASS = 0.35
MAX_WORDS = 0.45
SYMBOLS = r"[#*$%&|<>]"
VOWELS = "[aeiouyàáâäèéêëìíîïòóôöùúûüAEIOUYÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ]"
CLASSES = {"vowels": VOWELS, "letters": r"\p{L}", "digits": r"\p{Nd}", "points": r"[.,;:!?'\"()\-]"}


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"(?:{pattern})+", ""))


def _classes(joined: Column) -> Column:
    """Counts of vowels, other letters, digits, punctuation, rest among the characters of words.

    One class after the other is taken out, so that each pattern reads only what those before it left.
    Lambdas hold what is left, as it would else be worked out again wherever it is named.
    """
    patterns = list(CLASSES.values())

    def counted(left: Column, done: list[Column]) -> Column:
        lengths = [*done, F.length(left)]
        if len(done) == len(patterns):
            differences = [a - b for a, b in zip(lengths, lengths[1:])]
            return F.array(*[c.cast("long") for c in (*differences, lengths[-1])])
        rest = F.array(F.regexp_replace(left, f"{patterns[len(done)]}+", ""))
        return F.get(F.transform(rest, lambda text: counted(text, lengths)), F.lit(0))

    return counted(joined, [])


def _joined_hashes(hashes: Column, reach: int) -> Column:
    """Every hash joined with the one ``reach`` places on; the lambda holds the array, so it is made once."""
    def joined(held: Column) -> Column:
        return F.transform(held, lambda h, i: F.xxhash64(h, F.get(held, i + reach)))

    return F.get(F.transform(F.array(hashes), joined), F.lit(0))


def _repeats(df: DataFrame) -> DataFrame:
    """Adds ``_q_repeat``: words in windows of eight that occur twice or more in the text."""
    # Hashes of one word, then of two, four and eight: each from two of the ones before.
    windows = F.transform("_q_words", lambda w: F.xxhash64(w))
    for reach in (1, 2, 4):
        windows = _joined_hashes(windows, reach)
    df = pin(df, _q_windows=F.when(F.size("_q_words") >= 8, F.slice(windows, F.lit(1), F.size("_q_words") - 7)).otherwise(F.array().cast("array<bigint>")))
    some = F.size(F.array_distinct("_q_windows")) < F.size("_q_windows")
    df = pin(df, _q_sorted=F.when(some, F.array_sort(F.transform("_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_q_sorted", lambda s, j: (
        ((j > 0) & (s["h"] == F.get("_q_sorted", j - 1)["h"]))
        | ((j < F.size("_q_sorted") - 1) & (s["h"] == F.get("_q_sorted", j + 1)["h"]))
    ))
    df = pin(df, _q_places=F.array_sort(F.transform(twice, lambda s: s["i"])))
    covered = F.aggregate(
        "_q_places", F.struct(F.lit(-8).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(8), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return df.withColumn("_q_repeat", F.coalesce(covered, F.lit(0)).cast("long")).drop("_q_windows", "_q_sorted", "_q_places")


def _base(docs: DataFrame, symbols: str = SYMBOLS) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    df = pin(docs, _q_words=words(F.col("text")),
             _q_lines=F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""))
    df = pin(df, _q_joined=F.array_join("_q_words", ""))
    df = _repeats(df)
    n_words = F.size("_q_words")
    return df.select(
        *docs.columns, "_q_words", "_q_joined", n_words.cast("long").alias("_q_n"),
        F.length("_q_joined").cast("long").alias("_q_chars"),
        (F.length(text) - _without(text, symbols)).cast("long").alias("_q_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("_q_dup_lines"),
        "_q_repeat",
        ((n_words < 20) | (F.col("_q_repeat") * 100 > n_words * 30)).alias("_q_base_failed"),
    )


def references(docs: DataFrame, common: int = COMMON, languages: int = LANGUAGES) -> DataFrame:
    """Per language, and once over all (``_q_lang`` null): class counts, common words and their counts."""
    tokens = docs.select(F.col("lang").alias("_q_lang"), F.explode(words(F.col("text"))).alias("_q_token"))
    tokens = written(tokens.groupBy("_q_lang", "_q_token").agg(F.count(F.lit(1)).alias("_q_count")))
    every = F.explode(F.array_distinct(F.array(F.col("_q_lang"), F.lit(None).cast("string")))).alias("_q_lang")
    counts = tokens.select("_q_lang", F.lower("_q_token").alias("_q_word"), "_q_count")
    counts = counts.select(every, "_q_word", "_q_count").groupBy("_q_lang", "_q_word").agg(F.sum("_q_count").alias("_q_count"))
    # First inside slices of the words, so that one language is not ranked by one task alone.
    order = [F.col("_q_count").desc(), F.col("_q_word")]
    counts = counts.withColumn("_q_slice", F.pmod(F.xxhash64("_q_word"), F.lit(64)))
    in_slice = Window.partitionBy("_q_lang", "_q_slice").orderBy(*order)
    overall = Window.partitionBy("_q_lang").orderBy(*order)
    top = (
        counts.withColumn("_q_rank", F.row_number().over(in_slice)).where(F.col("_q_rank") <= common)
        .withColumn("_q_rank", F.row_number().over(overall)).where(F.col("_q_rank") <= common)
    )
    commonest = top.groupBy("_q_lang").agg(F.array_sort(F.collect_list(F.struct("_q_rank", "_q_word", "_q_count"))).alias("_q_top"))
    # Class counts of the different words, times how often each occurs, are those of all texts.
    per_word = pin(tokens, _q_c=_classes(F.col("_q_token")))
    numbers = [f"_q_c{i}" for i in range(5)] + ["_q_total"]
    sums = [F.sum(F.get("_q_c", F.lit(i)) * F.col("_q_count")).alias(f"_q_c{i}") for i in range(5)] + [F.sum("_q_count").alias("_q_total")]
    classes = per_word.groupBy("_q_lang").agg(*sums)
    classes = classes.select(every, *numbers).groupBy("_q_lang").agg(*[F.sum(n).alias(n) for n in numbers])
    classes = classes.select(F.col("_q_lang").alias("_q_lang2"), "_q_total", F.array(*numbers[:5]).alias("_q_ref_classes"))
    both = commonest.join(classes, commonest["_q_lang"].eqNullSafe(classes["_q_lang2"]))
    largest = both.orderBy(F.col("_q_lang").isNull().desc(), F.col("_q_total").desc(), "_q_lang").limit(languages + 1)
    return largest.select(
        "_q_lang", "_q_ref_classes", F.col("_q_top._q_word").alias("_q_ref_words"),
        F.concat(F.col("_q_top._q_count"), F.array(F.col("_q_total") - F.aggregate("_q_top", F.lit(0).cast("long"), lambda a, t: a + t["_q_count"]))).alias("_q_ref_counts"),
    )


def js_distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; 0 where either is empty."""
    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def term(p, m):
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def divergence(p, q):
        m = (p + q) / 2
        return (term(p, m) + term(q, m)) / 2

    sums = F.array(F.struct(total(left).alias("l"), total(right).alias("r")))
    parts = F.flatten(F.transform(sums, lambda s: F.zip_with(left, right, lambda x, y: divergence(x / s["l"], y / s["r"]))))
    value = F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))
    return F.when((total(left) > 0) & (total(right) > 0), value).otherwise(F.lit(0.0))


def _held(df: DataFrame, refs: DataFrame, min_words: int, max_class: float, max_words: float) -> DataFrame:
    """Adds ``_q_kept``."""
    parts = ["_q_ref_classes", "_q_ref_words", "_q_ref_counts"]
    own = F.broadcast(refs.where(F.col("_q_lang").isNotNull()))
    pooled = refs.where(F.col("_q_lang").isNull()).select(F.struct(*parts)).scalar()
    df = df.join(own, df["lang"] == own["_q_lang"], "left")
    df = pin(df, _q_ref=F.coalesce(F.when(F.col("_q_lang").isNotNull(), F.struct(*parts)), pooled),
             _q_own=_classes(F.col("_q_joined")))
    # Places of a text's words among the common ones; what taking one out shortens the list by is its count.
    # Most words are common in no language: one look into a set of all common words spares them the search.
    common = [r[0] for r in refs.select(F.explode("_q_ref_words")).distinct().collect()]
    found = F.filter(F.transform("_q_words", F.lower), lambda w: w.isin(common))
    places = F.transform(found, lambda w: F.array_position("_q_ref._q_ref_words", w))
    df = pin(df, _q_at=F.when(F.col("_q_n") >= min_words, F.filter(places, lambda p: p > 0)))

    def times(_: Column, i: Column) -> Column:
        return (F.size("_q_at") - F.size(F.array_remove("_q_at", (i + 1).cast("long")))).cast("long")

    df = pin(df, _q_times=F.when(F.col("_q_n") >= min_words, F.transform("_q_ref._q_ref_words", times)))
    others = F.col("_q_n") - F.aggregate("_q_times", F.lit(0).cast("long"), lambda a, x: a + x)
    df = pin(df, _q_hist=F.concat(F.col("_q_times"), F.array(others)))
    close = (js_distance(F.col("_q_own"), F.col("_q_ref._q_ref_classes")) <= max_class) & (js_distance(F.col("_q_hist"), F.col("_q_ref._q_ref_counts")) <= max_words)
    judged = F.coalesce(F.when(F.col("_q_n") >= min_words, close), F.lit(True))
    return df.withColumn("_q_kept", ~F.col("_q_base_failed") & judged)


def judged(docs: DataFrame, min_words: int = MIN_WORDS, max_class: float = MAX_CLASS, max_words: float = MAX_WORDS,
           common: int = COMMON, languages: int = LANGUAGES) -> DataFrame:
    """``docs`` with ``_q_n``, ``_q_chars``, ``_q_symbols``, ``_q_dup_lines``, ``_q_repeat``, ``_q_base_failed``, ``_q_kept``."""
    refs = written(references(docs, common, languages))
    out = _held(_base(docs), refs, min_words, max_class, max_words)
    return out.select(*docs.columns, "_q_n", "_q_chars", "_q_symbols", "_q_dup_lines", "_q_repeat", "_q_base_failed", "_q_kept")
