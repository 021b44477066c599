"""Text statistics as DataFrame expressions: what the quality operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SQL


def words(text: Column) -> Column:
    """All words; an empty array for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD_SQL), F.lit(0)), F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def repeated_words(keys: Column, size: int = 8) -> Column:
    """Words in windows of ``size`` words that the text has twice or more, the first included; ``keys`` are the words
    or 64-bit hashes of them.

    Windows are compared by 64-bit hashes. Only a text with an equal pair sorts them; the places of equal ones, in
    order, then cover min(size, distance to the next place) words each, and ``size`` words at the end.
    """

    def windows(k: Column) -> Column:
        return F.slice(F.transform(k, lambda x, i: F.xxhash64(x, *[F.get(k, i + j) for j in range(1, size)])), F.lit(1), F.size(k) - (size - 1))

    def again(tagged: Column) -> Column:
        same = F.filter(tagged, lambda x, j: F.coalesce(F.get(tagged, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(tagged, j + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.least(F.coalesce(F.get(places, j + 1) - p, F.lit(size)), F.lit(size)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    def count(w: Column) -> Column:
        tagged = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(let(tagged, again), covered))

    return F.when(F.size(keys) <= size, F.lit(0).cast("long")).otherwise(let(windows(keys), count))


def repeated_lines(text: Column) -> Column:
    """Lines (cut at line feeds) with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda l: l.rlike(WORD_SQL))
    return F.coalesce(F.transform(F.array(lines), lambda a: F.size(a) - F.size(F.array_distinct(a)))[0], F.lit(0)).cast("long")


def counted(text: Column, pattern: str) -> Column:
    """Characters of a class, given as the class of all others."""
    return F.coalesce(F.char_length(F.regexp_replace(text, pattern, "")), F.lit(0)).cast("long")


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` and the struct ``stat`` of counts over the whole text, all 0 for a null text.

    The text is read three times: for its words, its lines, and what it has besides small letters and spaces; all
    characters that are counted are in the last, which is short. ``stat`` is the output of a generator (of one row),
    so a filter or projection over it is never put in place of the counts below it: they are worked out once a text.
    """
    text = F.col(text_col)
    w, keys, rare = F.col("_words"), F.col("_keys"), F.col("_rare")
    ready = df.withColumns({"_words": words(text), "_rare": F.coalesce(F.regexp_replace(text, r"[a-z ]+", ""), F.lit(""))})
    ready = ready.withColumn("_keys", F.transform("_words", lambda x: F.xxhash64(x)))
    stat = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.coalesce(F.char_length(F.concat_ws("", w)), F.lit(0)).cast("long").alias("word_chars"),
        counted(rare, "[^#*$%&|<>]+").alias("n_symbols"),
        repeated_lines(text).alias("n_dup_lines"),
        repeated_words(keys).alias("n_repeat_words"),
        F.size(F.array_distinct(keys)).cast("long").alias("n_distinct"),
        counted(rare, r"\P{Lu}+").alias("n_upper"),
        counted(rare, "[^!?]+").alias("n_marks"),
        counted(rare, "[^.,;:]+").alias("n_points"),
        counted(rare, "[^0-9]+").alias("n_digits"),
        (counted(rare, "[^\n]+") + F.when(F.char_length(text) > 0, 1).otherwise(0)).cast("long").alias("n_lines"),
        counted(rare, "[^/@]+").alias("n_links"),
    )
    return ready.select(*df.columns, F.explode(F.array(stat)).alias("stat"))


def rates(stat: Column) -> dict[str, Column]:
    """Ratios of the counts, 0 where there is nothing to divide by."""
    per = lambda a, b: F.when(stat[b] > 0, stat[a] / stat[b]).otherwise(F.lit(0.0))
    return {
        "log_words": F.log1p(stat["n_words"].cast("double")), "mean_word": per("word_chars", "n_words"), "symbols": per("n_symbols", "word_chars"),
        "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "distinct": per("n_distinct", "n_words"),
        "upper": per("n_upper", "word_chars"), "marks": per("n_marks", "n_words"),
        "points": per("n_points", "n_words"), "digits": per("n_digits", "word_chars"), "line_words": per("n_words", "n_lines"), "links": per("n_links", "n_words"),
    }
