"""Metadata enrichment from a table of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.normalize import text
from trackloom.functions.similarity import recording_score, token_jaccard
from trackloom.operators.matching import first_by
from trackloom.operators.set_index import jaccard_pairs, word_set
from trackloom.operators.shared import materialise, spread


def top_tags(tags: Column, n: int = 3) -> Column:
    """The names of the ``n`` most frequent tags, joined; ties stay in order."""
    placed = F.transform(tags, lambda t, i: F.struct((-F.coalesce(t["count"], F.lit(0))).alias("c"), i.alias("i"), t["name"].alias("name")))
    return F.array_join(F.transform(F.slice(F.array_sort(placed), 1, n), lambda t: t["name"]), ", ")


def shared_word_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    words = lambda df, k: df.select(k, F.explode("t").alias("w"))
    return words(left, "pos").join(words(right, "id"), "w").select("pos", "id")


def by_titles(left: DataFrame, right: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """``left`` with each similar title set of ``right`` (``r``) and their overlap, and ``right`` with its set as ``r``."""
    near = jaccard_pairs(left.select(F.col("t").alias("set")), right.select(F.col("t").alias("set")), least)
    return left.join(near.withColumnRenamed("l", "t"), "t"), right.withColumnRenamed("t", "r")


def plain_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(pos, id, score) that reach ``least`` > 0.6 by words alone: without a common artist word a title counts 0.6 at most."""
    left, right = by_titles(left, right, (least - 0.4) / 0.6)
    word = lambda df: df.withColumn("v", F.explode("a"))
    right = word(right).select("id", "r", "v", F.col("a").alias("b"))
    pairs = spread(word(left).drop("t", "name"), "r", "v").join(spread(right, "r", "v"), ["r", "v"])
    score = F.least(F.lit(1.0), F.col("overlap") * 0.6 + token_jaccard(F.col("a"), F.col("b")) * 0.4)
    return pairs.select("pos", "id", score.alias("score")).where(F.col("score") >= least)


def lifted_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(pos, id, score) that reach ``least`` > 0.5 with the 0.1 of a release whose words overlap with the album's by over 0.8."""
    left, right = by_titles(left.where(F.size("name") > 0), right.withColumn("other", F.explode("names")), (least - 0.5) / 0.6)
    albums = jaccard_pairs(left.select(F.col("name").alias("set")), right.select(F.col("other").alias("set")), 0.8).where("overlap > 0.8")
    named = left.join(albums.drop("overlap").withColumnsRenamed({"l": "name", "r": "other"}), "name").drop("t", "name")
    pairs = spread(named, "r", "other").join(spread(right.select("id", "r", "other", F.col("a").alias("b")), "r", "other"), ["r", "other"])
    score = F.least(F.lit(1.0), F.col("overlap") * 0.6 + F.when((F.size("a") == 0) | (F.size("b") == 0), 0.0).otherwise(token_jaccard(F.col("a"), F.col("b"))) * 0.4 + 0.1)
    return pairs.select("pos", "id", score.alias("score")).where(F.col("score") >= least)


def look_up(tracks: DataFrame, recordings: DataFrame, least: float = 0.7) -> DataFrame:
    """Each track (pos, title, artist, album, isrc) with its best recording and score: by identifier, else by name.

    ``recordings``: id, title, length, artists, releases, isrcs, tags. Names meet by a shared word of the title; the
    first best of at least ``least`` counts. Equal (nt, na) are looked up once. Title word sets are joined as distinct
    sets; rows then meet by a similar set and an artist word, or, where only a release with the album's name can lift a
    pair to ``least``, by a similar set and the rarest words of that name. Records are joined to the best pairs alone.
    """
    r = recordings.select(F.struct(*recordings.columns).alias("r"))
    by_isrc = r.select("r", F.explode("r.isrcs").alias("__isrc"))
    code = F.lower(F.trim("isrc"))
    exact = first_by(tracks.where(text(F.col("isrc")) != "").join(by_isrc, code == F.lower(F.trim("__isrc"))), "pos", F.col("r.id")).withColumn("score", F.lit(1.0))
    exact = materialise(exact.select("pos", "r", "score"), "by-code")
    rest = materialise(tracks.join(exact, "pos", "left_anti").select("pos", "nt", "na", "title", "artist", "album"), "rest")
    asked = rest.groupBy("nt", "na").agg(F.min(F.struct("pos", "title", "artist", "album")).alias("q")).select("nt", "na", "q.*")
    names = F.array_join(F.transform("artists", lambda a: F.coalesce(a["name"], F.lit(""))), " ")
    left = asked.select("pos", word_set(F.col("title")).alias("t"), word_set(F.col("artist")).alias("a"), word_set(F.col("album")).alias("name"))
    right = recordings.select("id", word_set(F.col("title")).alias("t"), word_set(names).alias("a"), F.transform("releases", lambda x: word_set(x["title"])).alias("names"))
    if least >= 0.7:  # a pair of both kinds counts with its higher score
        # records of equal words score alike, and the least id of them wins
        right = right.groupBy("t", "a", "names").agg(F.min("id").alias("id"))
        scored = lifted_pairs(left, right, least).unionByName(plain_pairs(left, right, least)).join(asked.select("pos", "nt", "na"), "pos")
    else:
        pairs = shared_word_pairs(left, right).distinct().join(asked, "pos").join(recordings.select("id", F.struct("title", "artists", "releases").alias("r")), "id")
        scored = pairs.withColumn("score", recording_score("r", F.col("title"), F.col("artist"), F.col("album"))).where(F.col("score") >= least)
    best = first_by(scored, "pos", F.col("score").desc(), F.col("id")).select("nt", "na", "id", "score")
    best = best.join(r.withColumn("id", F.col("r.id")), "id").drop("id")
    return exact.unionByName(rest.join(best, ["nt", "na"]).select("pos", "r", "score"))


def apply_enrichment(tracks: DataFrame, found: DataFrame) -> DataFrame:
    """Missing duration, isrc and genre filled from the recording; what a track has stays."""
    r = F.col("r")
    out = tracks.join(found, "pos", "left")
    filled = {
        "duration": F.coalesce(F.nullif("duration", F.lit(0)), F.floor(r["length"] / 1000).cast("int")),
        "isrc": F.coalesce(F.nullif("isrc", F.lit("")), F.get(r["isrcs"], F.lit(0))),
        "genre": F.coalesce(F.nullif("genre", F.lit("")), F.nullif(top_tags(r["tags"]), F.lit(""))),
    }
    return out.withColumns(filled | {"enriched": r.isNotNull()}).drop("r", "score")


def success(enriched: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return enriched.agg(n.alias("tracks"), F.count_if("enriched").alias("enriched"), F.count_if(text(F.col("isrc")) == "").alias("missing_isrc"), F.round(F.count_if("enriched") * 100.0 / n, 2).alias("success_rate"))
