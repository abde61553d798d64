"""Quality rules: counting rules plus distance from what a language usually looks like.

``assess`` keeps a document unless a counting rule rejects it, or its histogram of character classes
or of common words lies too far (Jensen-Shannon distance, base 2, 0 to 1) from that of its
language. The references are counted over all documents:

* character classes: the shares of ``CLASSES`` among the characters of a language's words; "more"
  counts the bytes beyond one per character, what is left are mostly lower-case ASCII letters;
* common words: every word, as written, that makes up at least one in ``COMMON`` of a language's
  words, and one class for all others.

Guards: a language needs ``MIN_REFERENCE`` words for a reference; without one, or without a language,
only the counting rules apply. The class test needs ``MIN_WORDS_CLASSES`` words, the word test
``MIN_WORDS_COMMON``; shorter documents differ too much by chance.

Everything is a column expression. Texts are read twice (words of the languages, then all counts of
each document) and never shuffled; what the second pass finds is stored and the class references
are sums of it. A null text has no words. Repeated rows are judged alike. Further columns, whatever
their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import cut

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
COMMON = 200
MIN_REFERENCE = 2000
MIN_WORDS_CLASSES = 50
MIN_WORDS_COMMON = 100
MAX_DISTANCE_CLASSES = 0.34
MAX_DISTANCE_COMMON = 0.30
MANY_LANGUAGES = 2000
SALTS = 64

SPACE = r"[ \t-\r]+"
COMMON_LETTERS = "[a-z]+"
# Each class by the characters that are not in it, the form that removing takes.
CLASSES = {"upper": r"[^A-Z]+", "digit": r"[^0-9]+", "mark": r"[^.,;:!?'\"()-]+", "symbol": r"[^#*$%&|<>]+"}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _left(text: Column, pattern: str) -> Column:
    """Characters that stay when those matching ``pattern`` go."""
    return F.length(F.regexp_replace(text, F.lit(pattern), F.lit(""))).cast("long")


def common_words(docs: DataFrame) -> DataFrame:
    """(lang, word, share): the common words of each language, ascending, and their shares."""
    words = docs.where("lang is not null").select("lang", F.explode(_words(F.col("text"))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = cut(counts)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= MIN_REFERENCE)
    common = counts.join(F.broadcast(totals) if _small(totals) else totals, "lang")
    # a language has at most COMMON words of that share
    common = common.where(F.col("n") * COMMON >= F.col("total")).groupBy("lang")
    common = common.agg(F.sort_array(F.collect_list(F.struct("word", (F.col("n") / F.col("total")).alias("share")))).alias("c"))
    return totals.join(common, "lang", "left").select("lang", "c.word", "c.share")


def _class_shares() -> Column:
    """Shares of the counts in ``own`` among ``word_chars``, then that of all other characters."""
    shares = F.transform("own", lambda n: F.try_divide(n, F.col("word_chars")))
    return F.array_append(shares, _others(shares))


def _small(languages: DataFrame) -> bool:
    return languages.limit(MANY_LANGUAGES + 1).count() <= MANY_LANGUAGES


def _with_languages(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Join with one row per language: sent to all while there are few, else with the rows salted."""
    refs = cut(refs)
    if _small(refs):
        return rows.join(F.broadcast(refs), "lang", "left")
    salted = refs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row.doc_id"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, ["lang", "salt"], "left").drop("salt")


def _part(p: Column, q: Column) -> Column:
    """What one class adds to twice the divergence."""
    def side(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    return side(p, q) + side(q, p)


def _others(shares: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x))


def _distance(parts: Column) -> Column:
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)) / 2)


def _counted(docs: DataFrame) -> DataFrame:
    """All counts of each document; ``times`` are those of its language's common words."""
    rows = _with_languages(docs, common_words(docs)).select(
        "row", "lang", "word", "share", F.coalesce("text", F.lit("")).alias("text"), _words(F.col("text")).alias("w")
    )
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    windows = F.when(
        F.size("w") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("w") - 3),
            lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    known = F.filter("w", lambda w: F.array_contains(F.col("word"), w))
    rows = rows.select(
        "row", "lang", "word", "share", "w", F.array_join("w", "").alias("packed"), lines.alias("lines"), windows.alias("h"),
        F.when(F.size("w") >= MIN_WORDS_COMMON, known).alias("known"),
    )
    rows = rows.withColumn("rare", F.regexp_replace("packed", COMMON_LETTERS, ""))
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    counts = [_left(F.col("rare"), pattern) for pattern in CLASSES.values()]
    more = (F.octet_length("packed") - F.length("packed")).cast("long")
    rows = rows.select(
        "row", "lang", "share",
        F.size("w").cast("long").alias("n_words"),
        F.length("packed").cast("long").alias("word_chars"),
        _left(F.col("rare"), CLASSES["symbol"]).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, placed).alias("placed"),
        F.array(*counts, more).alias("own"),
        F.transform("word", lambda c: F.size(F.filter("known", lambda w: w == c))).alias("times"),
        F.col("known").isNotNull().alias("tested"),
    )
    again = F.filter(
        "placed",
        lambda x, i: F.coalesce(x["h"] == F.get("placed", i - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get("placed", i + 1)["h"], F.lit(False)),
    )
    rows = rows.select("*", F.sort_array(F.transform(again, lambda x: x["i"])).alias("at"))
    covered = F.transform("at", lambda p, i: F.coalesce(F.least(F.lit(3), F.get("at", i + 1) - p), F.lit(3)))
    repeated = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return rows.withColumn("n_repeat_words", repeated).drop("placed", "at")


def _judged(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``row`` (``columns`` of ``docs``), counts, base_failed, class_distance, word_distance, kept."""
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    rows = cut(_counted(docs.select(row, F.col("lang").cast("string"), F.col("text").cast("string"))))
    sums = rows.where("lang is not null").groupBy("lang").agg(
        F.sum("n_words").alias("words"),
        F.sum("word_chars").alias("word_chars"),
        F.array(*[F.sum(F.get("own", F.lit(i))) for i in range(len(CLASSES) + 1)]).alias("own"),
    )
    classes = sums.where(F.col("words") >= MIN_REFERENCE).select("lang", _class_shares().alias("classes"))
    rows = _with_languages(rows, classes)
    mine = F.transform("times", lambda n: F.try_divide(n, F.col("n_words")))
    rows = rows.withColumns({"mine": mine, "own": _class_shares()})
    by_word = F.array_append(F.zip_with("mine", "share", _part), _part(_others(F.col("mine")), _others(F.col("share"))))
    enough = (F.col("n_words") >= MIN_WORDS_CLASSES) & F.col("classes").isNotNull()
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(enough, _distance(F.zip_with("own", "classes", _part))).alias("class_distance"),
        F.when(F.col("tested") & F.col("share").isNotNull(), _distance(by_word)).alias("word_distance"),
    )
    usual = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_DISTANCE_CLASSES) & (
        F.coalesce("word_distance", F.lit(0.0)) <= MAX_DISTANCE_COMMON
    )
    return rows.withColumn("kept", ~F.col("base_failed") & usual)


def assess(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts, base_failed, class_distance, word_distance (null where not tested), kept."""
    return _judged(docs, ["doc_id"]).select("row.doc_id", "*").drop("row")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with all their columns."""
    return _judged(docs, docs.columns).where("kept").select("row.*")
