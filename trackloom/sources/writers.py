"""Reports as projections of result tables, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from trackloom.functions.normalize import text
from trackloom.functions.parsing import percent, time_text
from trackloom.operators.shared import shared_remove


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _number(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit(0)).cast("string"), F.lit(""))


def matches_report(matches: DataFrame, source_platform: str = "", target_platform: str = "") -> DataFrame:
    side = lambda s, n: [_blank(f"{s}_title").alias(f"{n}_title"), _blank(f"{s}_artist").alias(f"{n}_artist"), _blank(f"{s}_album").alias(f"{n}_album"), _number(f"{s}_duration").alias(f"{n}_duration")]
    return matches.select(
        *side("s", "source"), *side("t", "target"), percent(F.col("confidence")).alias("confidence"), "match_type", F.lit(source_platform).alias("source_platform"), F.lit(target_platform).alias("target_platform")
    )


def missing_report(missing: DataFrame) -> DataFrame:
    texts = ("title", "artist", "album", "duration", "isrc", "platform", "track_id", "url", "year", "genre")
    return missing.select(*[(_number(c) if c in ("duration", "year") else _blank(c)).alias(c) for c in texts if c in missing.columns])


def summary_report(stats: DataFrame) -> DataFrame:
    return stats.withColumns({"match_rate": percent(F.col("match_rate")), "avg_confidence": percent(F.col("avg_confidence"))})


def transfer_report(tracks: DataFrame) -> DataFrame:
    """The five columns that transfer services read."""
    return tracks.select(_blank("title").alias("Title"), _blank("artist").alias("Artist"), _blank("album").alias("Album"), _blank("isrc").alias("ISRC"), _blank("duration").alias("Duration"))


def player_report(tracks: DataFrame) -> DataFrame:
    return tracks.select(_blank("title").alias("Name"), _blank("artist").alias("Artist"), _blank("album").alias("Album"), time_text(F.nullif(F.col("duration"), F.lit(0))).alias("Time"))


def playlist_report(songs: DataFrame) -> DataFrame:
    """title, joined artists, album name, duration, video_id from nested songs."""
    names = F.concat_ws(", ", F.filter(F.col("artists.name"), lambda n: text(n) != ""))
    return songs.select("title", names.alias("artist"), F.coalesce("album.name", F.lit("")).alias("album"), "duration", F.col("videoId").alias("video_id"))


def dedup_report(ranked: DataFrame) -> DataFrame:
    """One row for each group with its ranked songs nested."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "pos", "title", "album", "source", "quality", "quality_score", "duration", "explicit")))
    return ranked.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), rows.alias("duplicates"))


def selection_report(picked: DataFrame) -> DataFrame:
    """The fourteen columns of winners and losers, one row for each song of a group (pos is the song's id)."""
    # The names of the columns and the forms of the addresses.
    lead = Window.partitionBy("group_id").orderBy("rank")
    number = F.col("pos").cast("string")
    return picked.select(
        F.col("group_id").alias("Group ID"),
        F.first("title").over(lead).alias("Group Title"),
        F.first("artist").over(lead).alias("Group Artist"),
        F.col("winner").alias("Preferred"),
        _blank("title").alias("Title"),
        _blank("artist").alias("Artists"),
        _blank("album").alias("Album"),
        _number("duration").alias("Duration"),
        F.coalesce("explicit", F.lit(False)).alias("Explicit"),
        F.col("quality").alias("Quality"),
        F.col("quality_score").alias("Quality Score"),
        F.coalesce(number, F.lit("")).alias("Video ID"),
        F.coalesce(F.concat(F.lit("https://img.youtube.com/vi/"), number, F.lit("/mqdefault.jpg")), F.lit("")).alias("Thumbnail"),
        F.coalesce(F.concat(F.lit("https://music.youtube.com/watch?v="), number), F.lit("")).alias("URL"),
    )


def risk_report(risky: DataFrame) -> DataFrame:
    """The eight columns of tracks that may fail, the riskiest first."""
    # The names of the columns.
    platform = F.col("platform") if "platform" in risky.columns else F.lit("")
    return risky.orderBy(F.col("risk_score").desc(), "pos").select(
        F.col("title").alias("Title"),
        F.col("artist").alias("Artist"),
        _blank("album").alias("Album"),
        _number("duration").alias("Duration"),
        F.col("risk_score").alias("Risk_Score"),
        F.array_join("issues", ", ").alias("Issues"),
        F.coalesce(platform, F.lit("")).alias("Platform"),
        _blank("isrc").alias("ISRC"),
    )


def json_lines(rows: DataFrame, **parts: list[str]) -> DataFrame:
    """One JSON text for each row (column value): an object for each part, of the columns it names."""
    options = {"ignoreNullFields": "false"}
    return rows.select(F.to_json(F.struct(*[F.struct(*columns).alias(name) for name, columns in parts.items()]), options).alias("value"))


def failed_report(failed: DataFrame) -> DataFrame:
    """Tracks that could not be added, and why, as JSON."""
    rows = failed.select(F.to_json(F.struct(F.struct("title", "artist", "album", "duration").alias("track"), "reason"), {"ignoreNullFields": "false"}).alias("value"))
    return rows


def metrics_lines(totals: DataFrame, prefix: str) -> DataFrame:
    """Exposition text, one line for each (name, total)."""
    name = F.regexp_replace("name", r"[|=\-]", "_")
    return totals.select(F.concat(F.lit(f"{prefix}_"), name, F.lit("_total "), F.col("total").cast("string")).alias("value"))


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8", one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").options(header=True, sep=sep, encoding=encoding, emptyValue="").csv(path)


def write_json(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)


def library_file_name(name: str) -> str:
    """``normalize.library_slug`` of one name."""
    return name.lower().replace(" ", "_").replace("-", "_")


def write_csv_unless_empty(df: DataFrame, path: str) -> int:
    """``write_csv`` that counts rows while it writes them, so that ``df`` runs once; without rows the folder is removed."""
    seen = Observation()
    write_csv(df.observe(seen, F.count(F.lit(1)).alias("rows")), path)
    rows = seen.get.get("rows", 0)
    if not rows:
        shared_remove(df.sparkSession, path)
    return rows


def save_comparison(path: str, source: str, target: str, matches: DataFrame, missing: DataFrame, stats: DataFrame) -> dict[str, str]:
    """Matched, missing and summary files under ``path``; each table runs once. Empty ones leave no file, nor an older one."""
    other = library_file_name(target)
    base, made = f"{path}/{library_file_name(source)}_vs_{other}", {}
    for name, report, file in (("matches", matches_report(matches), f"{base}_matched.csv"), ("missing", missing_report(missing), f"{base}_missing_from_{other}.csv")):
        if write_csv_unless_empty(report, file):
            made[name] = file
    write_json(summary_report(stats), made.setdefault("summary", f"{base}_summary.json"), one_file=True)
    return made


def save_audit(audited: DataFrame, path: str) -> None:
    audited.write.mode("overwrite").partitionBy("status").option("header", True).csv(path)
