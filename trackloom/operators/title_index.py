"""Similarity join of titles: signatures of letters and words bound the title score, so that few pairs reach the kernel.

Titles meet where they share a blocking key (a token of the artist). Before two titles are scored, what their score can
be at most is told by numbers that stand beside each: common letters from two masks of bits, and the words that both
have. Blocks with many titles are dealt into salted parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import similarity as S
from trackloom.operators.shared import materialise, spread

#: Titles of one block and side in a salted part, about.
PART = 500
#: Letters whose first two occurrences have a bit each; those that may have two more; other characters with their limits.
TWICE, FOUR_TIMES, OTHERS = "abcdefghijklmnopqrstuvwxyz", "aeilnorst", {" ": 8, **dict.fromkeys("0123456789", 2)}


def letter_mask(column: str, bits: list[tuple[str, int, int]]) -> str:
    """SQL of a long with ``n`` bits for each (letter, skipped, n): the occurrences after the skipped ones."""
    at, parts = 0, []
    for letter, skipped, n in bits:
        parts.append(f"named_struct('x', '{letter}', 'skipped', {skipped}, 'n', {n}, 'at', {at})")
        at += n
    count = f"length({column}) - length(replace({column}, b.x, '')) - b.skipped"
    return f"aggregate(array({', '.join(parts)}), 0L, (mask, b) -> mask + shiftleft(shiftleft(1L, least(greatest({count}, 0), b.n)) - 1L, b.at))"


def masked(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with length and letters of column ``text``: two masks, and how many characters they don't hold.

    Two texts have at most as many characters in common as bits in common and the lesser number of others.
    """
    one, two = F.expr(letter_mask(text, [(x, 0, 2) for x in TWICE])), F.expr(letter_mask(text, [(x, 2, 2) for x in FOUR_TIMES] + [(x, 0, n) for x, n in OTHERS.items()]))
    rows = rows.withColumns({f"{name}_length": F.length(text), f"{name}_one": one, f"{name}_two": two})
    return rows.withColumn(f"{name}_rest", F.col(f"{name}_length") - F.bit_count(f"{name}_one") - F.bit_count(f"{name}_two"))


def signed(titles: DataFrame, title: str, name: str) -> DataFrame:
    """``titles`` with what bounds need of column ``title``: length, masks and distinct words of the words in order."""
    split = F.filter(F.split(F.col(title), r"(?U)\s+"), lambda w: w != "")
    own = titles.withColumn("__words", F.sort_array(split)).withColumn("__sorted", F.array_join("__words", " "))
    distinct = F.array_distinct("__words")
    own = masked(own, "__sorted", name).withColumns({f"{name}_words": distinct, f"{name}_repeats": F.size(distinct) < F.size("__words")})
    return own.drop("__words", "__sorted")


def most_common(a: str, b: str) -> Column:
    """At most so many letters do the titles of both signatures share, in any order."""
    c = lambda n, k: F.col(f"{n}_{k}")
    return F.bit_count(c(a, "one").bitwiseAND(c(b, "one"))) + F.bit_count(c(a, "two").bitwiseAND(c(b, "two"))) + F.least(c(a, "rest"), c(b, "rest"))


def title_bound(a: str, b: str) -> Column:
    """The highest title score that the signatures allow, without the premium of near equal titles.

    The ratio of words in order is at most what common letters allow, that of the best window what they allow against
    the shorter title. The ratio of word sets is that of words in order, or shared words against the shorter title.
    """
    la, lb = F.col(f"{a}_length"), F.col(f"{b}_length")
    common = F.least(most_common(a, b), la, lb)
    ordered = 2 * common / F.greatest(la + lb, F.lit(1))
    short = F.least(la, lb)
    window = 2 * common / F.greatest(short + common, F.lit(1))
    shared = F.array_intersect(f"{a}_words", f"{b}_words")
    held = F.length(F.array_join(shared, " "))
    sets = F.when(F.size(shared) > 0, F.greatest(ordered, 2 * held / (held + short))).otherwise(ordered)
    inside = (F.size(shared) > 0) & ((F.size(shared) == F.size(f"{a}_words")) | (F.size(shared) == F.size(f"{b}_words")))
    sets = F.when(inside | F.col(f"{a}_repeats") | F.col(f"{b}_repeats"), 1.0).otherwise(sets)
    return F.least(F.lit(1.0), 0.4 * sets + 0.4 * ordered + 0.2 * window)


def quick_bound(a: str, b: str) -> Column:
    """A looser bound from numbers alone, for the condition of a join."""
    la, lb = F.col(f"{a}_length"), F.col(f"{b}_length")
    return 0.6 + 0.8 * F.least(most_common(a, b), la, lb) / F.greatest(la + lb, F.lit(1))


def similar_titles(s: DataFrame, t: DataFrame, least: float, strict: bool, keys: list[str]) -> DataFrame:
    """(keys, s_nt, t_nt, title) of all pairs that share ``keys`` and whose title score is at least ``least``, up to 0.85.

    ``s``: keys, s_nt; ``t``: keys, t_nt; repeated rows don't matter. Keys with many titles on the left are dealt into
    parts by the hash of the title, and titles on the right go to each of the parts.
    """
    s, t = s.distinct(), t.distinct()
    sizes = s.groupBy(*keys).agg((F.count(F.lit(1)) / PART + 1).cast("long").alias("__parts"))
    left = signed(s.select("s_nt").distinct(), "s_nt", "a").join(s, "s_nt").join(sizes, keys).withColumn("__part", F.pmod(F.xxhash64("s_nt"), "__parts"))
    right = signed(t.select("t_nt").distinct(), "t_nt", "b").join(t, "t_nt").join(sizes, keys)
    right = right.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)))
    left, right = (spread(x.drop("__parts"), *keys, "__part") for x in (left, right))
    near = left.join(right, [*keys, "__part"]).where(quick_bound("a", "b") >= least - 1e-9)
    # read twice: for the distinct pairs that are scored, and for the keys that they share
    near = materialise(near.where(title_bound("a", "b") >= least - 1e-9).select(*keys, "s_nt", "t_nt"), "near-titles")
    scores = spread(near.select("s_nt", "t_nt").distinct(), "s_nt", "t_nt")
    scores = scores.withColumn("title", S.title_similarity(F.col("s_nt"), F.col("t_nt"), strict, least=least)).where(F.col("title") >= least - 1e-9)
    return near.join(scores, ["s_nt", "t_nt"])
