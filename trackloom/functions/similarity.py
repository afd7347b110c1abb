"""Similarity of titles, artists, albums and durations, and the two confidence scores.

What sets and numbers can tell is Column expressions. Edit-based ratios are kernels in Python, applied to distinct
pairs of strings in Arrow batches; ``scorer="equality"`` replaces them by equality, which is fully relational.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.normalize import dedup_key, strip, text

# Fixed values of the two scores.
WEIGHTS = {"title": 0.45, "artist": 0.35, "album": 0.10, "duration": 0.05}
TOLERANCE = {True: 7, False: 9}
SOFT_LIMIT = {True: 0.08, False: 0.12}
ACCEPT_FUZZY = {True: 0.80, False: 0.72}
ACCEPT_BASE = {True: 0.82, False: 0.75}
ACCEPT_B = {True: 0.85, False: 0.75}


def places_of(a: str) -> dict[str, int]:
    """For each letter of ``a`` the bits of its places."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    return places


def common(a: str, b: str, places: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence: one bit for each letter of ``a``, one step for each of ``b``."""
    if not a or not b:
        return 0
    places = places_of(a) if places is None else places
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths, 0 to 100."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words and the shared words with either side's own."""
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    both, left, right = sorted(one & two), sorted(one - two), sorted(two - one)
    if both and (not left or not right):
        return 100.0
    shared = " ".join(both)
    with_left, with_right = " ".join([*both, *left]), " ".join([*both, *right])
    best = ratio(with_left, with_right)
    return max(best, ratio(shared, with_left), ratio(shared, with_right)) if both else best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer; windows may overhang either end."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    most = common(short, long)

    def best(s: str, t: str) -> float:
        n, top, places = len(s), 0.0, places_of(s)
        for i in sorted(range(1 - n, len(t)), key=lambda i: not 0 <= i <= len(t) - n):  # whole windows first
            window = t[max(0, i) : i + n]
            # a window has no more in common than the whole text has
            if 200.0 * min(most, len(window)) / (n + len(window)) > top:
                top = max(top, 200.0 * common(s, window, places) / (n + len(window)))
        return top

    return max(best(short, long), best(long, short)) if len(short) == len(long) else best(short, long)


def title_kernel(a: str | None, b: str | None, strict: bool, least: float = 0.0) -> float:
    """The title score; 0 where it can't reach ``least`` (up to 0.85) without the windows, which cost most."""
    if not a or not b:
        return 0.0
    words = 0.4 * token_set_ratio(a, b) / 100 + 0.4 * token_sort_ratio(a, b) / 100
    if least and words + 0.2 < least:
        return 0.0
    short, most = min(len(a), len(b)), common(a, b)
    if least and words + 0.4 * min(most, short) / (short + min(most, short)) < least - 1e-9:
        return 0.0
    score = words + 0.2 * partial_ratio(a, b) / 100
    few = max(len(a.split()), len(b.split())) < 3
    premium = (0.96 if few else 0.92) if strict else (0.92 if few else 0.85)
    return min(1.0, score * 1.02) if score >= premium else score


def lcs_share(a: str | None, b: str | None) -> float:
    """Common subsequence over the longer length, the plain form of the second matcher's ratio."""
    a, b = (a or "").lower().strip(), (b or "").lower().strip()
    return 1.0 if a == b and a else common(a, b) / max(len(a), len(b)) if a and b else 0.0


def _pairs(kernel):
    """A column function of two strings; a pair that recurs in a batch is computed once."""

    @F.pandas_udf("double")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in known:
                known[pair] = kernel(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return udf


def title_similarity(a: Column, b: Column, strict: bool = True, scorer: str = "fuzzy", least: float = 0.0) -> Column:
    """The title score, exact from ``least`` on and 0 or exact below."""
    if scorer == "equality":
        return F.when((a != "") & (F.lower(a) == F.lower(b)), 1.0).otherwise(0.0)
    return _pairs(lambda x, y: title_kernel(x, y, strict, least))(a, b)


def cached_ratio(a: Column, b: Column, scorer: str = "fuzzy") -> Column:
    x, y = F.lower(strip(text(a))), F.lower(strip(text(b)))
    other = F.lit(0.0) if scorer == "equality" else _pairs(lambda p, q: ratio(p, q) / 100)(x, y)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(other)


def token_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def artist_similarity(tokens_a: Column, tokens_b: Column, name_a: Column, name_b: Column, scorer: str = "fuzzy") -> Column:
    """Jaccard of artist tokens, and 0.3 more if one set holds the other; names where a side has no token."""
    inside = (F.size(F.array_except(tokens_a, tokens_b)) == 0) | (F.size(F.array_except(tokens_b, tokens_a)) == 0)
    sets = F.least(F.lit(1.0), token_jaccard(tokens_a, tokens_b) + F.when(inside, 0.3).otherwise(0.0))
    bare = (F.size(tokens_a) == 0) | (F.size(tokens_b) == 0)
    return F.when(bare, cached_ratio(name_a, name_b, scorer)).otherwise(sets)


def album_similarity(a: Column, b: Column, scorer: str = "fuzzy") -> Column:
    x, y = F.lower(text(a)), F.lower(text(b))
    if scorer == "equality":
        score = F.when(x == y, 1.0).otherwise(0.0)
    else:
        raw = _pairs(lambda p, q: token_sort_ratio(p, q) / 100)(x, y)
        score = F.when(raw >= 0.8, raw).otherwise(0.0)
    return F.when((x == "") | (y == ""), 0.5).otherwise(score)


def duration_similarity(a: Column, b: Column, strict: bool = True) -> Column:
    """1 within the tolerance, then falling to 0.6 at the soft limit, 0 beyond; 0.5 where a side is missing or 0."""
    gap, longer, limit = F.abs(a - b), F.greatest(a, b), F.lit(SOFT_LIMIT[strict])
    share = gap / F.nullif(longer, F.lit(0))
    near = F.greatest(F.lit(0.6), F.lit(1.0) - share / limit * 0.4)
    missing = (F.coalesce(a, F.lit(0)) == 0) | (F.coalesce(b, F.lit(0)) == 0)
    return F.when(missing, 0.5).when(gap <= TOLERANCE[strict], 1.0).when(share <= limit, near).otherwise(0.0)


def same_isrc(a: Column, b: Column) -> Column:
    x, y = F.lower(strip(text(a))), F.lower(strip(text(b)))
    return (x != "") & (x == y)


def confidence(s: str, t: str, strict: bool = True, use_duration: bool = True, use_album: bool = False, scorer: str = "fuzzy", known: dict[str, Column] | None = None) -> Column:
    """Score of the first matcher between the track columns prefixed ``s`` and ``t``: weighted mean, or 1 by ISRC.

    ``scorer="fuzzy_known"`` takes the title's similarity from the column ``__title``; so does ``"fuzzy_tokens"``, for
    pairs that both have artist tokens. ``known``: parts that are at hand (title, artist, album, same).
    """
    c = lambda side, name: F.col(f"{side}_{name}")
    known = known or {}
    title = known["title"] if "title" in known else F.col("__title") if scorer in ("fuzzy_known", "fuzzy_tokens") else title_similarity(c(s, "nt"), c(t, "nt"), strict, scorer)
    artist = known.get("artist")
    if artist is None:
        artist = artist_similarity(c(s, "tokens"), c(t, "tokens"), c(s, "na"), c(t, "na"), "equality" if scorer == "fuzzy_tokens" else scorer)
    album = (known["album"] if "album" in known else album_similarity(c(s, "album"), c(t, "album"), scorer)) if use_album else F.lit(0.5)
    length = duration_similarity(c(s, "duration"), c(t, "duration"), strict) if use_duration else F.lit(0.5)
    w = WEIGHTS
    total = title * w["title"] + artist * w["artist"] + album * w["album"] + length * w["duration"]
    same = known["same"] if "same" in known else same_isrc(c(s, "isrc"), c(t, "isrc"))
    return F.when(same, 1.0).otherwise(total / (w["title"] + w["artist"] + w["album"] + w["duration"]))


def ratio_b(a: Column, b: Column, plain: bool = False) -> Column:
    """The second matcher's ratio; ``plain``: the common-subsequence share, as where no fuzzy library is at hand."""
    return _pairs(lcs_share if plain else lambda a, b: 1.0 if (a or "").lower().strip() == (b or "").lower().strip() and a else ratio((a or "").lower().strip(), (b or "").lower().strip()) / 100 if a and b else 0.0)(a, b)


def closeness_b(a: Column, b: Column, tolerance: int = 5) -> Column:
    """1 for equal durations, falling to 0 at the tolerance; null beyond it and where a side is missing or 0."""
    gap = F.abs(a - b)
    known = (F.coalesce(a, F.lit(0)) != 0) & (F.coalesce(b, F.lit(0)) != 0)
    return F.when(known & (gap <= tolerance), 1 - gap / tolerance)


def score_b(s: str, t: str, use_duration: bool = True, use_album: bool = False, plain: bool = False, tolerance: int = 5, known: bool = False) -> dict[str, Column]:
    """Parts and result of the second matcher: title, artist, duration, album and confidence (null: no match).

    ``known``: the ratios of titles and of artist names stand in the columns ``__title`` and ``__name``.
    """
    c = lambda side, name: F.col(f"{side}_{name}")
    kernel = lambda a, b: ratio_b(a, b, plain)
    title, name = (F.col("__title"), F.col("__name")) if known else (kernel(c(s, "nt"), c(t, "nt")), kernel(c(s, "na"), c(t, "na")))
    bare = (F.size(c(s, "tokens")) == 0) | (F.size(c(t, "tokens")) == 0)
    artist = F.when(bare, name).otherwise(F.greatest(token_jaccard(c(s, "tokens"), c(t, "tokens")), name))
    length = closeness_b(c(s, "duration"), c(t, "duration"), tolerance) if use_duration else F.lit(None).cast("double")
    likeness = kernel(c(s, "album"), c(t, "album")) if use_album else F.lit(0.0)
    album = F.when(likeness > 0.7, likeness)
    base = title * 0.6 + artist * 0.4
    total = F.least(F.lit(1.0), base + F.coalesce(length * 0.1, F.lit(0.0)) + F.coalesce(album * 0.05, F.lit(0.0)))
    isrc = same_isrc(c(s, "isrc"), c(t, "isrc"))
    out = F.when(isrc, 1.0).when((title >= 0.6) & (artist >= 0.5), total)
    kind = F.when(isrc, "isrc").when(out >= 0.98, "exact").when(out.isNotNull(), "fuzzy")
    return {"title": title, "artist": artist, "base": base, "duration": length, "album": album, "confidence": out, "match_type": kind}


def word_jaccard(a: Column, b: Column) -> Column:
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(text(x)), r"(?U)\s+"), lambda w: w != ""))
    one, two = words(a), words(b)
    return F.when((F.size(one) == 0) | (F.size(two) == 0), 0.0).otherwise(token_jaccard(one, two))


def recording_score(recording: str, title: Column, artist: Column, album: Column | None = None) -> Column:
    """Word overlap of title (0.6) and joined artists (0.4), and 0.1 once if a release has the album's name."""
    r = lambda name: F.col(f"{recording}.{name}")
    names = F.array_join(F.transform(r("artists"), lambda a: F.lower(F.coalesce(a["name"], F.lit("")))), " ")
    score = word_jaccard(r("title"), title) * 0.6 + word_jaccard(names, artist) * 0.4
    if album is not None:
        score = score + F.when((text(album) != "") & F.exists(r("releases"), lambda x: word_jaccard(x["title"], album) > 0.8), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def matcher_ratio(a: Column, b: Column) -> Column:
    """The block-matching ratio of difflib between two values in dedup form."""
    return _pairs(lambda x, y: difflib.SequenceMatcher(None, x, y).ratio())(dedup_key(a), dedup_key(b))
