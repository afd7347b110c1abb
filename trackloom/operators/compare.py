"""Statistics of a comparison, and set analysis over any number of libraries in one DataFrame with ``library``."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.matching import match_pairs

KINDS = ("exact", "fuzzy", "isrc")


def library_stats(tracks: DataFrame, by: str = "library") -> DataFrame:
    music = F.col("is_music")
    return tracks.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_tracks"),
        F.count_if(music).alias("music_tracks"),
        F.count_if(~music).alias("non_music_tracks"),
        F.count_distinct(F.when(music, F.col("na"))).alias("unique_artists"),
    )


def artist_counts(tracks: DataFrame, by: str = "library") -> DataFrame:
    return tracks.where("is_music").groupBy(by, "na").agg(F.count(F.lit(1)).alias("tracks"), F.min("pos").alias("first_pos"))


def top_artists(tracks: DataFrame, n: int = 10, by: str = "library") -> DataFrame:
    """The ``n`` artists with most tracks for each library; ties go to the artist seen first."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col("tracks").desc(), "first_pos"))
    return artist_counts(tracks, by).withColumn("rank", rank).where(F.col("rank") <= n)


def overview(tracks: DataFrame) -> DataFrame:
    """Totals for each library and, with a null library, over all: one pass by grouping sets."""
    music = F.col("is_music")
    return tracks.rollup("library").agg(
        F.count(F.lit(1)).alias("total_tracks"), F.count_if(music).alias("music_tracks"), F.count_distinct(F.when(music, F.col("na"))).alias("unique_artists")
    )


def match_counts() -> list[Column]:
    kinds = [F.count_if(F.col("match_type") == k).alias(f"{k}_matches") for k in KINDS]
    return [F.count(F.lit(1)).alias("total_matches"), *kinds, F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence")]


def with_rates(counted: DataFrame) -> DataFrame:
    rate = F.when(F.col("source_music_tracks") > 0, F.col("total_matches") / F.col("source_music_tracks")).otherwise(0.0)
    return counted.withColumns({"match_rate": rate, "missing_tracks": F.col("source_music_tracks") - F.col("total_matches")})


def comparison_stats(source: DataFrame, target: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: music tracks of both sides, matches by kind, mean confidence, match rate and missing tracks."""
    sizes = lambda df, name: df.where("is_music").agg(F.count(F.lit(1)).alias(name))
    # three single rows side by side
    return with_rates(matches.agg(*match_counts()).join(sizes(source, "source_music_tracks")).join(sizes(target, "target_music_tracks")))


def pairwise_stats(tracks: DataFrame, names: list[str], **options) -> DataFrame:
    """Comparison statistics of every pair of libraries by ``match_pairs``; pairs without a match and empty libraries too."""
    if len(names) < 2:
        raise ValueError("at least two libraries are needed")
    if len(set(names)) < len(names):
        raise ValueError("each library is to be named once")
    pairs = tracks.sparkSession.createDataFrame(list(combinations(names, 2)), "source string, target string")
    sizes = tracks.where(F.col("is_music") & F.col("library").isin(names)).groupBy("library").agg(F.count(F.lit(1)).alias("n"))
    counted = match_pairs(tracks, names, **options).groupBy("source", "target").agg(*match_counts())
    out = pairs.join(counted, ["source", "target"], "left")
    for name in ("source", "target"):
        out = out.join(sizes.select(F.col("library").alias(name), F.col("n").alias(f"{name}_music_tracks")), name, "left")
    return with_rates(out.fillna(0))


def universal_tracks(tracks: DataFrame, n_libraries: int, first: str) -> DataFrame:
    """Pairs (nt, na) in all libraries, represented by the first such track of library ``first``; by artist and title."""
    music = tracks.where("is_music")
    own = F.when(F.col("library") == first, F.struct("pos", "title", "artist"))
    found = music.groupBy("nt", "na").agg(F.count_distinct("library").alias("appears_in"), F.min(own).alias("x"))
    found = found.where(F.col("appears_in") == n_libraries).select(F.col("x.title").alias("title"), F.col("x.artist").alias("artist"), "nt", "na", "appears_in")
    return found.orderBy("artist", "title")


def unique_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks whose pair is in no other library, by artist and title; copies inside a library stay. No pairs of libraries."""
    music = tracks.where("is_music")
    only = Window.partitionBy("nt", "na")
    return music.withColumn("__n", F.size(F.collect_set("library").over(only))).where("__n = 1").drop("__n").orderBy("artist", "title", "library", "pos")


def distinct_artists(tracks: DataFrame) -> DataFrame:
    """The artists of music tracks, each once, in order."""
    return tracks.where("is_music").select("artist").where("artist <> ''").distinct().orderBy("artist")


def artist_overlap(tracks: DataFrame) -> DataFrame:
    """Each artist with the number of libraries and of tracks over all."""
    return tracks.where("is_music").groupBy("na").agg(F.count_distinct("library").alias("libraries"), F.count(F.lit(1)).alias("tracks"), F.min(F.struct("library", "pos")).alias("first"))


def universal_artists(tracks: DataFrame, n_libraries: int) -> DataFrame:
    return artist_overlap(tracks).where(F.col("libraries") == n_libraries).select("na", "tracks")


def top_overlap_artists(tracks: DataFrame, n: int = 20) -> DataFrame:
    return artist_overlap(tracks).orderBy(F.col("tracks").desc(), "first").limit(n).select("na", "libraries", "tracks")


def confidence_histogram(matches: DataFrame, bins: int = 20) -> DataFrame:
    """Matches by kind and bin of confidence on [0, 1]; 1 falls into the last bin."""
    cell = F.least(F.floor(F.round(F.col("confidence") * bins, 6)), F.lit(bins - 1)).cast("int")
    return matches.groupBy("match_type", cell.alias("bin")).agg(F.count(F.lit(1)).alias("matches"))
