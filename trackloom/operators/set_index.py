"""Similarity join of word sets: rarest words first, prefixes, sizes and positions; whole records never take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.similarity import token_jaccard


def word_set(c: Column) -> Column:
    """The distinct lower-case words of a text, sorted; none for null."""
    return F.sort_array(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda w: w != "")))


def prefixes(sets: DataFrame, frequency: DataFrame, least: float) -> DataFrame:
    """(set, word, n, place): of each set the words that a set of overlap ``least`` must meet, rarest first.

    Two sets of sizes n and m with Jaccard overlap t share ceil(t * n) words of the first at least, so one of its
    n - ceil(t * n) + 1 rarest.
    """
    words = sets.select("set", F.size("set").alias("n"), F.explode("set").alias("word")).join(frequency, "word")
    place = F.row_number().over(Window.partitionBy("set").orderBy("frequency", "word"))
    return words.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("set", "word", "n", "place")


def jaccard_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(l, r, overlap) of all pairs of distinct sets of ``left`` and ``right`` (set: sorted arrays) from ``least`` > 0 on.

    Empty and null sets meet nothing. A pair meets at each prefix word that it shares; at the first of them the words
    that may follow on both sides must suffice.
    """
    left, right = (x.select("set").where(F.size("set") > 0).distinct() for x in (left, right))
    frequency = left.unionByName(right).select(F.explode("set").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))
    one, two = prefixes(left, frequency, least), prefixes(right, frequency, least)
    one = one.select(F.col("set").alias("l"), "word", F.col("n").alias("ln"), F.col("place").alias("lp"))
    two = two.select(F.col("set").alias("r"), "word", F.col("n").alias("rn"), F.col("place").alias("rp"))
    sizes = (F.col("rn") >= F.col("ln") * least - 1e-9) & (F.col("ln") >= F.col("rn") * least - 1e-9)
    needed = (F.col("ln") + F.col("rn")) * (least / (1 + least)) - 1e-9
    enough = F.least(F.col("ln") - F.col("lp"), F.col("rn") - F.col("rp")) + 1 >= needed
    # either order of the shared words is the same, so the first shared one passes ``enough`` if the pair does
    pairs = one.join(two, "word").where(sizes & enough).select("l", "r").distinct()
    return pairs.withColumn("overlap", token_jaccard(F.col("l"), F.col("r"))).where(F.col("overlap") >= least - 1e-9)
