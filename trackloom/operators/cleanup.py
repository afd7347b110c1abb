"""Playlist clean-up as plan tables. Nothing is written to a service; a plan and its inverse are DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.shared import dealt


def basic_cleanup(playlist: DataFrame, liked: DataFrame, library: DataFrame, key: str) -> DataFrame:
    """Playlist rows with reason: liked before library, null where the row stays."""
    marks = playlist.join(liked.select(key).distinct().withColumn("__liked", F.lit(True)), key, "left").join(library.select(key).distinct().withColumn("__library", F.lit(True)), key, "left")
    reason = F.when(F.col("__liked"), "liked").when(F.col("__library"), "library")
    return marks.withColumn("reason", reason).drop("__liked", "__library")


def internal_duplicates(playlist: DataFrame, signature: list[str], position: str) -> DataFrame:
    """Rows of signatures that occur more than once, with the number of copies and whether a row is the first."""
    same = Window.partitionBy(*signature)
    out = playlist.withColumns({"copies": F.count(F.lit(1)).over(same), "keep": F.row_number().over(same.orderBy(position)) == 1})
    return out.where("copies > 1")


def cleanup_plan(items: DataFrame, selected: DataFrame, rows: int | None = None) -> DataFrame:
    """(playlist_id, op, video_id): remove losers of each playlist, add their winner where it lacks it.

    ``items``: playlist_id, video_id. ``selected``: group_id, video_id, winner. ``rows``: about how many items there are
    at most, if known. Items are dealt by video once, over partitions that grow with their number; of those only what
    winners have is compared with what is to be added.
    """
    rows = items.count() if rows is None else rows
    items = dealt(items.select("playlist_id", "video_id"), rows, "video_id")
    won = selected.where("winner").select("group_id", F.col("video_id").alias("winner_id"))
    lost = selected.where("not winner").select("group_id", "video_id").join(won, "group_id").select("video_id", "winner_id")
    hit = items.join(lost.hint("merge"), "video_id")
    remove = hit.select("playlist_id", F.lit("remove").alias("op"), "video_id").distinct()
    add = dealt(hit.select("playlist_id", F.col("winner_id").alias("video_id")), rows, "playlist_id", "video_id").distinct()
    there = items.join(won.select(F.col("winner_id").alias("video_id")).hint("merge"), "video_id", "left_semi")
    add = add.join(there.hint("merge"), ["playlist_id", "video_id"], "left_anti").select("playlist_id", F.lit("add").alias("op"), "video_id")
    return remove.unionByName(add)


def rollback(plan: DataFrame) -> DataFrame:
    return plan.withColumn("op", F.when(F.col("op") == "remove", "add").otherwise("remove"))


def apply_plan(items: DataFrame, plan: DataFrame) -> DataFrame:
    keys = ["playlist_id", "video_id"]
    kept = items.join(plan.where("op = 'remove'").select(*keys), keys, "left_anti")
    return kept.select(*keys).unionByName(plan.where("op = 'add'").select(*keys))


def bucket(similarity: Column, high: float = 0.95) -> Column:
    return F.when(similarity > high, "high_confidence").otherwise("needs_review")


def library_duplicates(playlist: DataFrame, library: DataFrame, similarity: Column, high: float = 0.95, least: float = 0.8, on: list[str] | None = None) -> DataFrame:
    """Playlist rows with their library matches: high_confidence or needs_review. Both sides carry the columns ``on``
    (artist unless given): only rows equal in them are compared."""
    same = [F.col(f"s.{c}") == F.col(f"t.{c}") for c in on or ["na"]]
    pairs = playlist.alias("s").join(library.alias("t"), same).withColumn("similarity", similarity).where(F.col("similarity") >= least)
    return pairs.withColumn("bucket", bucket(F.col("similarity"), high))


def cleanup_summary(marked: DataFrame, signature: list[str], position: str) -> DataFrame:
    """One row: original, removed as liked or in the library, removed as copies, and what stays."""
    free = marked.withColumn("__nth", F.row_number().over(Window.partitionBy(F.col("reason").isNull(), *signature).orderBy(position)))
    gone, copy = F.col("reason").isNotNull(), F.col("reason").isNull() & (F.col("__nth") > 1)
    return free.agg(F.count(F.lit(1)).alias("original"), F.count_if(gone).alias("removed_liked"), F.count_if(copy).alias("removed_duplicates"), F.count_if(~gone & ~copy).alias("final"))


def playlist_batches(tracks: DataFrame, confidence: str = "confidence", least: float = 0.7, size: int = 50) -> DataFrame:
    """Tracks in order with a batch number, and added or the reason why not. Numbered in one ordered exchange."""
    found = F.col(confidence)
    reason = F.when(found.isNull(), "No matches found").when(found < least, "Low confidence match")
    spread = tracks.withColumn("__chunk", F.floor(F.col("pos") / 100_000))
    counts = spread.groupBy("__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__first", F.coalesce(F.sum("__n").over(Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    nth = F.row_number().over(Window.partitionBy("__chunk").orderBy("pos")) - 1
    out = spread.withColumn("__nth", nth).join(before, "__chunk").withColumn("batch", F.floor((F.col("__nth") + F.col("__first")) / size))
    return out.withColumns({"reason": reason, "added": reason.isNull()}).drop("__chunk", "__nth", "__first")


def playlist_potential(confidences: DataFrame, sample: int = 10, good: float = 0.8) -> DataFrame:
    """Of the first ``sample`` tracks: rate of good matches, mean confidence, and the advice that follows."""
    first = confidences.orderBy("pos").limit(sample).select(F.coalesce("confidence", F.lit(0.0)).alias("c"))
    out = first.agg(F.count(F.lit(1)).alias("sample_size"), F.count_if(F.col("c") >= good).alias("good_matches"), F.avg("c").alias("avg_confidence"))
    rate, mean = F.col("good_matches") / F.col("sample_size"), F.col("avg_confidence")
    advice = F.when((rate >= 0.8) & (mean >= 0.8), "excellent").when((rate >= 0.6) & (mean >= 0.7), "good").when((rate >= 0.4) & (mean >= 0.6), "moderate").otherwise("low")
    return out.withColumns({"good_match_rate": rate, "recommendation": advice})
