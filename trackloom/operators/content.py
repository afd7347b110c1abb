"""Predicates and validation rules over tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.normalize import text

# One hit of any pattern in "title artist" says that it is not music.
NOT_MUSIC = (
    r"\b(podcast|interview|talk|discussion)\b",
    r"\b(episode|ep\.|chapter)\s*\d+",
    r"\b(youtube\s+shorts?|shorts?)\b",
    r"\b(vlog|tutorial|review|reaction)\b",
    r"\b(behind\s+the\s+scenes|making\s+of)\b",
    r"\b(audiobook|meditation|sleep|rain|nature)\b",
    r"\b(comedy|stand\-?up|funny)\b",
    r"\b(live\s+from|recorded\s+live)\b",
    r"\b(concert\s+recording|bootleg)\b",
    r"\b(explicit|nsfw|adult)\b",
)
LONGEST_TITLE = 150


def is_music(title: Column, artist: Column) -> Column:
    both = F.lower(F.concat_ws(" ", text(title), text(artist)))
    some = (text(title) != "") | (text(artist) != "")
    return some & ~both.rlike("(?U)" + "|".join(NOT_MUSIC)) & (F.length(text(title)) <= LONGEST_TITLE)


def required(tracks: DataFrame) -> DataFrame:
    """Rows with a title and an artist; the text "nan" of a blank cell counts as missing."""
    has = lambda c: ~F.lower(F.trim(text(F.col(c)))).isin("", "nan")
    return tracks.where(has("title") & has("artist"))


def _named(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def track_issues(title: str = "title", artist: str = "artist", duration: str = "duration", year: str = "year", track_number: str = "track_number") -> Column:
    """Names of the rules that a row breaks; numbers may be text."""
    n = lambda c: F.col(c).cast("string").try_cast("double")
    given = lambda c: F.col(c).isNotNull()
    return _named(
        [
            ("Missing or empty title", text(F.col(title)) == ""),
            ("Missing or empty artist", text(F.col(artist)) == ""),
            ("Duration cannot be negative", n(duration) < 0),
            ("Duration seems unreasonably long (>2 hours)", n(duration) > 7200),
            ("Duration must be a number", given(duration) & n(duration).isNull()),
            ("Year seems unreasonable", (n(year) < 1900) | (n(year) > 2030)),
            ("Year must be a number", given(year) & n(year).isNull()),
            ("Track number must be positive", n(track_number) < 1),
            ("Track number must be a number", given(track_number) & n(track_number).isNull()),
        ]
    )


def library_report(tracks: DataFrame) -> DataFrame:
    """One row for each library: tracks, rows with issues, copies by (nt, na), and the verdict with its reasons."""
    marked = tracks.withColumn("bad", (F.size(track_issues()) > 0).cast("int"))
    out = marked.groupBy("library").agg(
        F.count(F.lit(1)).alias("total_tracks"), F.sum("bad").alias("tracks_with_issues"), (F.count(F.lit(1)) - F.count_distinct("nt", "na")).alias("duplicate_tracks")
    )
    share = F.col("tracks_with_issues") * 100.0 / F.col("total_tracks")
    copies = F.col("duplicate_tracks") * 100.0 / F.col("total_tracks")
    return out.withColumns(
        {"issue_percent": F.round(share, 2), "is_valid": share <= 10, "issue_warning": (share > 0) & (share <= 10), "duplicate_percent": F.round(copies, 2), "duplicate_warning": copies > 5}
    )


def playlist_issues() -> Column:
    blank = lambda c: F.trim(text(F.col(c))) == ""
    return _named([("Missing title", blank("title")), ("Missing artist", blank("artist")), ("Non-music content detected", ~F.col("is_music"))])


def playlist_validation(tracks: DataFrame) -> DataFrame:
    """With issues, valid, and warning where a title has over 100 characters."""
    issues = playlist_issues()
    return tracks.withColumns({"issues": issues, "valid": F.size(issues) == 0, "warning": F.length(text(F.col("title"))) > 100})


# Names, weights and words of the rules.
def risk_rules() -> list[tuple[str, int, Column]]:
    title, low = text(F.col("title")), F.lower(text(F.col("title")))
    any_of = lambda c, *words: F.greatest(*[c.contains(w).cast("int") for w in words]) == 1
    seconds = F.coalesce(F.col("duration"), F.lit(0))
    return [
        ("Version/Remaster", 3, any_of(low, "remaster", "remastered", "- 20", "deluxe", "extended")),
        ("Live/Special Version", 4, any_of(low, "live", "en vivo", "concert", "acoustic")),
        ("Featuring Artists", 2, any_of(low, "feat.", "ft.", "featuring", "with ")),
        ("Special Characters", 1, title.rlike(r"[/()\-&#]")),
        ("Non-English Characters", 2, title.rlike(r"[^\x00-\x7F]")),
        ("Long Title", 1, F.length(title) > 60),
        ("No Album Info", 1, text(F.col("album")) == ""),
        ("Very Short (<1min)", 3, (seconds != 0) & (seconds < 60)),
        ("Very Long (>10min)", 2, seconds > 600),
    ]


def risk_scores(tracks: DataFrame) -> DataFrame:
    """Rows with at least one issue, their issues, score, and tier: high from 5, medium from 2, else low."""
    rules = risk_rules()
    score = sum((F.when(rule, weight).otherwise(0) for _, weight, rule in rules), F.lit(0))
    out = tracks.withColumns({"issues": _named([(n, r) for n, _, r in rules]), "risk_score": score})
    tier = F.when(F.col("risk_score") >= 5, "high").when(F.col("risk_score") >= 2, "medium").otherwise("low")
    return out.where(F.size("issues") > 0).withColumn("tier", tier)


def top_risks(risky: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` rows most likely to fail, in order; ties by pos."""
    return risky.orderBy(F.col("risk_score").desc(), "pos").limit(n)


def issue_frequency(risky: DataFrame, total: int | Column) -> DataFrame:
    counted = risky.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("tracks"))
    return counted.withColumn("percent", F.round(F.col("tracks") * 100.0 / total, 1))
