"""Queries over files: exports of ``part`` are written to the shared folder in the shapes of other services and read back.

Also reports that end a workflow: ordered lists, selections, and JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import similarity as S
from trackloom.operators import cleanup, compare, content, dedup, enrich, matching, usage
from trackloom.operators.classes import best_targets, class_pairs
from trackloom.operators.shared import shared_path
from trackloom.plans import adapters as A
from trackloom.plans import catalogue as C
from trackloom.plans import oracles as O
from trackloom.plans.catalogue import query, r6
from trackloom.sources import readers, writers
from trackloom.streaming import samples

RAW = f"WITH raw AS ({A.TRACKS_SQL})"
CLOCK = "concat(CAST(CAST(floor(duration / 60) AS INT) AS STRING), ':', lpad(CAST(duration % 60 AS STRING), 2, '0'))"


def raw(spark, d) -> DataFrame:
    return A.table(spark, d, "part").selectExpr(*[f"{v} AS {k}" for k, v in A.TRACKS.items()])


def csv_of(spark, rows: DataFrame, name: str, sep: str = ",") -> str:
    path = f"{shared_path(spark, name)}.csv"
    rows.write.options(header=True, sep=sep, escape='"').csv(path)
    return path


def json_of(spark, rows: DataFrame, name: str, key: str) -> str:
    """One document for each thousand tracks, each a file of its own."""
    path = f"{shared_path(spark, name)}.json"
    held = rows.groupBy(F.floor(F.col("pos") / 1000).alias("part")).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "pos"])).alias(key))
    held.select(F.to_json(F.struct(key))).write.option("maxRecordsPerFile", 1).text(path)
    return path


def plist_of(spark, rows: DataFrame) -> str:
    """A property list for each thousand tracks, each a file of its own, with a playlist that refers to the tracks."""
    path = f"{shared_path(spark, 'plist')}.xml"
    # one mark of text in three spellings
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.when(F.col("pos") % 2 == 0, "&amp;").otherwise("&#38;")), F.lit("<"), F.lit("&lt;")), F.lit("ü"), F.lit("&#xFC;")), F.lit("♪"), F.lit("&#9834;"))
    entry = lambda key, kind, c: F.when(c.isNotNull(), F.concat(F.lit(f"<key>{key}</key><{kind}>"), safe(c.cast("string")), F.lit(f"</{kind}>\n"))).otherwise("")
    texts = [entry(k, "string", F.col(c)) for k, c in (("Name", "title"), ("Artist", "artist"), ("Album", "album"), ("ISRC", "isrc"))]
    track = F.concat(F.lit("<key>"), F.col("pos").cast("string"), F.lit("</key>\n<dict>\n"), entry("Track ID", "integer", F.col("pos")), *texts, entry("Total Time", "integer", F.col("duration") * 1000 + 7), entry("Year", "integer", F.col("year")), F.lit("<key>Compilation</key><true/></dict>\n"))
    item = F.concat(F.lit("<dict><key>Track ID</key><integer>"), F.col("pos").cast("string"), F.lit("</integer></dict>"))
    held = rows.groupBy(F.floor(F.col("pos") / 1000).alias("part")).agg(F.array_join(F.collect_list(track), "").alias("tracks"), F.array_join(F.collect_list(item), "").alias("items"))
    start = '<?xml version="1.0" encoding="UTF-8"?>\n<plist version="1.0"><dict><key>Major Version</key><integer>1</integer><key>Tracks</key><dict>\n'
    text = F.concat(F.lit(start), "tracks", F.lit("</dict><key>Playlists</key><array><dict><key>Name</key><string>All</string><key>Playlist Items</key><array>"), "items", F.lit("</array></dict></array></dict></plist>"))
    held.select(text).write.option("maxRecordsPerFile", 1).text(path)
    return path


# Readers


@query(f"{RAW} SELECT title || ' <ü> ♪ &lt;' AS title, artist, album, duration, isrc, year, CAST(pos AS VARCHAR) AS track_id, 'apple_music' AS platform FROM raw")
def read_plist_library(spark, d):
    rows = raw(spark, d).withColumn("title", F.concat("title", F.lit(" <ü> ♪ &lt;")))
    return readers.read_library(spark, plist_of(spark, rows)).select("title", "artist", "album", "duration", "isrc", "year", "track_id", "platform")


@query(f"{RAW} SELECT 'ISO-8859-1' AS encoding, title || ' é' AS title, artist, album, duration FROM raw UNION ALL SELECT 'UTF-16', title || ' é♪', artist, album, duration FROM raw")
def read_encodings(spark, d):
    """The files that players read, written in two encodings and told apart by their first bytes."""
    out = None
    for encoding, mark in (("ISO-8859-1", " é"), ("UTF-16", " é♪")):
        path = f"{shared_path(spark, 'encoded')}.txt"
        writers.write_csv(writers.player_report(raw(spark, d).withColumn("title", F.concat("title", F.lit(mark)))), path, "\t", encoding)
        back = readers.read_playlist(spark, path).select(F.lit(encoding).alias("encoding"), "title", "artist", F.nullif("album", F.lit("")).alias("album"), "duration")
        out = back if out is None else out.unionByName(back)
    return out


@query(f"{RAW} SELECT title, artist, album, duration, isrc, 'spotify' AS platform FROM raw")
def read_spotify_csv(spark, d):
    names = {"title": "Track Name", "artist": "Artist Name(s)", "album": "Album Name", "isrc": "ISRC"}
    rows = raw(spark, d).select(*[F.col(c).alias(n) for c, n in names.items()], (F.col("duration") * 1000).alias("Duration (ms)"))
    return readers.read_library(spark, csv_of(spark, rows, "spotify")).select("title", "artist", "album", "duration", "isrc", "platform")


@query(f"{RAW} SELECT title, artist, album, duration, isrc, year, 'apple_music' AS platform FROM raw")
def read_apple_csv(spark, d):
    rows = raw(spark, d).selectExpr("title AS Name", "artist AS Artist", "album AS Album", f"{CLOCK} AS Time", "isrc AS ISRC", "year AS Year")
    return readers.read_library(spark, csv_of(spark, rows, "apple", ";")).select("title", "artist", "album", "duration", "isrc", "year", "platform")


@query(rf"{RAW} SELECT regexp_replace(trim(title), '(?i)\s*[\(\[]\s*official.*?[\)\]]', '', 'g') AS title, artist, duration, 'v' || pos AS track_id, 'youtube_music' AS platform FROM raw")
def read_youtube_csv(spark, d):
    length = "concat('PT', CAST(CAST(floor(duration / 60) AS INT) AS STRING), 'M', CAST(duration % 60 AS STRING), 'S')"
    rows = raw(spark, d).selectExpr("title AS Title", "artist AS Channel", "concat('v', pos) AS `Video ID`", f"{length} AS Duration")
    return readers.read_library(spark, csv_of(spark, rows, "youtube")).select("title", "artist", "duration", "track_id", "platform")


@query(f"{RAW} SELECT title, artist, album, duration * 3 AS duration, isrc, 'spotify' AS platform FROM raw")
def read_spotify_json(spark, d):
    """Seconds as text, also such over 1000, which stay seconds."""
    rows = raw(spark, d).selectExpr("pos", "'spotify' AS platform", "title", "artist", "album", "CAST(duration * 3 AS STRING) AS duration", "isrc")
    return readers.read_library(spark, json_of(spark, rows, "spotify", "tracks")).select("title", "artist", "album", "duration", "isrc", "platform")


@query(rf"{RAW} SELECT regexp_replace(trim(title), '(?i)\s*[\(\[]\s*official.*?[\)\]]', '', 'g') AS title, artist, album, duration, 'v' || pos AS track_id FROM raw")
def read_youtube_json(spark, d):
    length = "concat('PT', CAST(CAST(floor(duration / 60) AS INT) AS STRING), 'M', CAST(duration % 60 AS STRING), 'S')"
    rows = raw(spark, d).selectExpr("pos", "title", "artist AS channel", "album", "concat('v', pos) AS videoId", f"{length} AS duration")
    return readers.read_library(spark, json_of(spark, rows, "youtube", "items")).select("title", "artist", "album", "duration", "track_id")


@query(f"{RAW} SELECT title, artist, album, duration FROM raw")
def read_playlist_table(spark, d):
    rows = raw(spark, d).selectExpr("title AS Name", "artist AS Artist", "album AS Album", f"{CLOCK} AS Time")
    return readers.read_playlist(spark, csv_of(spark, rows, "playlist", "\t")).select("title", "artist", "album", "duration")


@query(f"{RAW} SELECT title, artist FROM raw")
def read_playlist_lines(spark, d):
    path = f"{shared_path(spark, 'lines')}.txt"
    raw(spark, d).select(F.concat_ws(" - ", "artist", "title")).write.text(path)
    return readers.read_playlist(spark, path).select("title", "artist")


@query(f"{RAW} SELECT title, artist, coalesce(album, '') AS album, coalesce(isrc, '') AS isrc, coalesce(CAST(duration AS VARCHAR), '') AS duration FROM raw")
def read_missing_list(spark, d):
    rows = raw(spark, d).selectExpr("title AS playlist_title", "artist AS playlist_artist", "album AS playlist_album", "isrc", "duration AS playlist_duration")
    return readers.read_missing(spark, csv_of(spark, rows, "missing")).select("title", "artist", "album", "isrc", "duration")


@query(f"{RAW}, liked AS (SELECT * FROM raw WHERE library = 'A'), uploads AS (SELECT * FROM raw WHERE library = 'B') SELECT 'liked' AS library, pos, title FROM liked UNION ALL SELECT 'uploads', pos, title FROM uploads")
def liked_and_uploads(spark, d):
    from trackloom.schema import libraries

    rows = raw(spark, d)
    return libraries({"liked": rows.where("library = 'A'"), "uploads": rows.where("library = 'B'")}).select("library", "pos", "title")


def broken_of(spark, rows: DataFrame) -> str:
    """CSV files of a thousand tracks each: of seven rows one has two cells, one seven, and one has a title alone."""
    path = f"{shared_path(spark, 'broken')}.csv"
    held = rows.selectExpr("pos", f"{BROKEN} AS line").groupBy(F.floor(F.col("pos") / 1000).alias("part"))
    lines = held.agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "line")))["line"], "\n").alias("lines"))
    lines.select(F.concat(F.lit("Name,Artist,Album,ISRC\n"), "lines")).write.option("maxRecordsPerFile", 1).text(path)
    return path


QUOTED = "concat('\"', title, ', \"\"', pos, '\"\"\"')"
BROKEN = f"CASE pos % 7 WHEN 1 THEN concat({QUOTED}, ',', artist) WHEN 2 THEN concat({QUOTED}, ',', artist, ',x,y,\"z,z\",,') WHEN 3 THEN {QUOTED} ELSE concat({QUOTED}, ',', artist, ',', coalesce(album, ''), ',', coalesce(isrc, '')) END"


@query(f"""{RAW} SELECT {BROKEN} AS record, CASE pos % 7 WHEN 1 THEN 2 WHEN 2 THEN 7 ELSE 1 END AS cells, 4 AS columns, CASE pos % 7 WHEN 3 THEN 'rejected' ELSE 'repaired' END AS status,
    CASE WHEN pos % 7 <> 3 THEN title || ', "' || pos || '"' END AS title, CASE WHEN pos % 7 <> 3 THEN artist END AS artist, CASE WHEN pos % 7 = 2 THEN 'x' END AS album, CASE WHEN pos % 7 = 2 THEN 'y' END AS isrc
    FROM raw WHERE pos % 7 IN (1, 2, 3)""")
def read_broken_rows(spark, d):
    """Rows of the wrong width, and the tracks that the reader has of them."""
    path = broken_of(spark, raw(spark, d))
    tracks = readers.read_library(spark, path, "apple").select("pos", "title", "artist", "album", "isrc")
    return readers.broken_rows(spark, path, "apple_music").join(tracks, "pos", "left").drop("pos")


# Ordered lists


@query(f"{O.LIB} SELECT DISTINCT artist FROM lib WHERE is_music AND artist <> ''")
def distinct_artists(spark, d):
    return compare.distinct_artists(A.tracks(spark, d))


@query(f"{C.RISKY} SELECT pos, risk_score, tier FROM risky ORDER BY risk_score DESC, pos LIMIT 20")
def top_risks(spark, d):
    return content.top_risks(content.risk_scores(C.gone(spark, d))).select("pos", "risk_score", "tier")


@query(f"""{O.LIB}, c AS (SELECT s.pos AS s_pos, t.pos AS t_pos, {O.confidence()} AS confidence FROM lib s JOIN lib t ON s.base = t.base WHERE s.library = 'A' AND t.library = 'B'),
    p AS (SELECT *, row_number() OVER (PARTITION BY s_pos ORDER BY confidence DESC, t_pos) AS place FROM c) SELECT s_pos, t_pos, place, round(confidence, 6) AS confidence FROM p WHERE place <= 10""")
def search_results(spark, d):
    a, b = A.two(spark, d)
    return best_targets(matching.side(a, "s"), matching.side(b, "t"), "base", 10).select("s_pos", "t_pos", "place", r6("confidence").alias("confidence"))


# Reports


def selected_sql(keep: str) -> str:
    return f"""{C.SONGS}, named AS (SELECT *, first_value(title) OVER g AS gt, first_value(artist) OVER g AS ga FROM chosen WINDOW g AS (PARTITION BY group_id ORDER BY rank))
    SELECT group_id AS "Group ID", gt AS "Group Title", ga AS "Group Artist", winner AS "Preferred", title AS "Title", artist AS "Artists", album AS "Album",
    coalesce(CAST(nullif(duration, 0) AS VARCHAR), '') AS "Duration", explicit AS "Explicit", quality AS "Quality", quality_score AS "Quality Score", CAST(pos AS VARCHAR) AS "Video ID",
    'https://img.youtube.com/vi/' || pos || '/mqdefault.jpg' AS "Thumbnail", 'https://music.youtube.com/watch?v=' || pos AS "URL" FROM named WHERE {keep}"""


@query(selected_sql("winner"))
def winners_report(spark, d):
    return writers.selection_report(C.chosen(spark, d)).where("Preferred")


@query(selected_sql("NOT winner"))
def losers_report(spark, d):
    return writers.selection_report(C.chosen(spark, d)).where("not Preferred")


@query(f"{C.SONGS} SELECT group_id, pos, winner FROM chosen WHERE group_id IN ('Brand#11', 'Brand#12') OR NOT winner AND group_id LIKE 'Brand#1%'")
def picked_groups(spark, d):
    rows = C.chosen(spark, d)
    some = dedup.picked(rows, "all", ["Brand#11", "Brand#12"])
    return some.union(dedup.picked(rows, "losers").where("group_id like 'Brand#1%'")).select("group_id", "pos", "winner")


@query(f"""{C.RISKY} SELECT title AS "Title", artist AS "Artist", coalesce(album, '') AS "Album", coalesce(CAST(nullif(duration, 0) AS VARCHAR), '') AS "Duration", risk_score AS "Risk_Score",
    array_to_string(issues, ', ') AS "Issues", '' AS "Platform", coalesce(isrc, '') AS "ISRC" FROM risky""")
def risk_report(spark, d):
    return writers.risk_report(content.risk_scores(C.gone(spark, d)))


@query(f"""{O.COMPARED} SELECT pos, title, artist, CASE WHEN confidence IS NULL THEN 'No matches found' ELSE 'Low confidence match' END AS reason FROM s LEFT JOIN matches ON s_pos = pos WHERE confidence IS NULL OR confidence < 0.7e0""")
def failed_tracks(spark, d):
    """The JSON of failed tracks, written and read back."""
    rows = C.two(spark, d)[0].where("is_music").join(matching.by_rows(C.equal_matches(spark, d).select(F.col("s_pos").alias("pos"), "confidence")), "pos", "left")
    failed = cleanup.playlist_batches(rows).where("reason is not null")
    path = shared_path(spark, "failed")
    writers.failed_report(failed.withColumn("album", F.col("pos").cast("string"))).write.text(path)
    back = spark.read.schema("track struct<title: string, artist: string, album: string>, reason string").json(path)
    return back.select(F.col("track.album").cast("long").alias("pos"), "track.title", "track.artist", "reason")


@query(f"{O.COMPARED} SELECT total_matches, missing_tracks, round(match_rate, 6) AS match_rate, 'A' AS source, 'B' AS target FROM ({O.stats()})")
def analysis_report(spark, d):
    """The JSON of an analysis, written and read back."""
    a, b = C.two(spark, d)
    stats = compare.comparison_stats(a, b, C.equal_matches(spark, d)).withColumns({"source": F.lit("A"), "target": F.lit("B")})
    path = shared_path(spark, "analysis")
    writers.json_lines(stats, libraries=["source", "target"], stats=["total_matches", "missing_tracks", "match_rate"]).write.text(path)
    back = spark.read.schema("libraries struct<source: string, target: string>, stats struct<total_matches: bigint, missing_tracks: bigint, match_rate: double>").json(path)
    return back.select("libraries.*", "stats.total_matches", "stats.missing_tracks", r6("stats.match_rate").alias("match_rate"))


@query(f"""{C.ENRICHED} SELECT w.pos, w.duration AS before, coalesce(nullif(w.duration, 0), r.secs) AS after, r.id IS NOT NULL AS enriched FROM w LEFT JOIN found f ON f.pos = w.pos LEFT JOIN rec r ON r.id = f.id""")
def enrichment_report(spark, d):
    """The JSON of enriched tracks beside the original ones, written and read back."""
    rows = C.wanted(spark, d)
    done = enrich.apply_enrichment(rows.withColumn("before", F.col("duration")), enrich.look_up(rows, A.recordings(spark, d)))
    path = shared_path(spark, "enriched")
    writers.json_lines(done, original=["pos", "before"], enhanced=["duration"], enrichment=["enriched"]).write.text(path)
    back = spark.read.schema("original struct<pos: bigint, before: int>, enhanced struct<duration: int>, enrichment struct<enriched: boolean>").json(path)
    return back.select("original.pos", "original.before", F.col("enhanced.duration").alias("after"), "enrichment.enriched")


@query("SELECT event_type AS name, count(*) AS total FROM events GROUP BY event_type")
def metrics_json(spark, d):
    totals = usage.counters(C.events(spark, d), ["event_type"]).withColumnRenamed("event_type", "name")
    path = shared_path(spark, "metrics")
    writers.json_lines(totals, counter=["name", "total"]).write.text(path)
    return spark.read.schema("counter struct<name: string, total: bigint>").json(path).select("counter.*")


@query(f"""{O.LIB}, s AS (SELECT * FROM lib WHERE library = 'A'), t AS (SELECT * FROM lib WHERE library = 'B'),
    c AS (SELECT s.pos AS s_pos, t.pos AS t_pos, CASE WHEN s.nt = t.nt THEN 1e0 WHEN s.base = t.base THEN 0.9e0 ELSE 0e0 END AS similarity FROM s JOIN t USING (na, base))
    SELECT s_pos, t_pos, similarity, CASE WHEN similarity > 0.95e0 THEN 'high_confidence' ELSE 'needs_review' END AS bucket FROM c WHERE similarity >= 0.8e0""")
def library_duplicates(spark, d):
    a, b = C.two(spark, d)
    # each pair of titles is compared once; lists of rows are then unfolded
    score = F.when(F.col("s_nt") == F.col("t_nt"), 1.0).otherwise(0.9)
    found = class_pairs(matching.side(a, "s"), matching.side(b, "t"), ["na", "base"], ["nt"], ["pos"], {"similarity": score, "bucket": cleanup.bucket(score)})
    return found.select("s_pos", "t_pos", "similarity", "bucket")


@query(f"""{O.COMPARED} SELECT 'matched' AS file, coalesce(title, '') AS title, coalesce(artist, '') AS artist, round(confidence * 100, 2) AS figure FROM matches JOIN s ON s_pos = pos
    UNION ALL SELECT 'missing', coalesce(title, ''), coalesce(artist, ''), coalesce(CAST(duration AS DOUBLE), 0) FROM s WHERE pos NOT IN (SELECT s_pos FROM matches)
    UNION ALL SELECT 'summary', CAST(source_music_tracks AS VARCHAR), CAST(target_music_tracks AS VARCHAR), CAST(total_matches AS DOUBLE) FROM ({O.stats()})""")
def comparison_files(spark, d):
    """The three files of a comparison, written and read back."""
    source, target = A.two(spark, d)
    matches = C.equal_matches(spark, d)
    stats = compare.comparison_stats(source, target, matches)
    made = writers.save_comparison(shared_path(spark, "comparison"), "Library A", "Library-B", matches, matching.missing(source, matches), stats)
    # a report without rows leaves no file
    texts = {"matches": "source_title string, source_artist string, confidence string", "missing": "title string, artist string, duration string"}
    cells = lambda name: spark.read.option("header", True).csv(made[name]).fillna("") if name in made else spark.createDataFrame([], texts[name])
    matched = cells("matches").select(F.lit("matched").alias("file"), F.col("source_title").alias("title"), F.col("source_artist").alias("artist"), F.col("confidence").cast("double").alias("figure"))
    missing = cells("missing").select(F.lit("missing"), "title", "artist", F.coalesce(F.expr("try_cast(nullif(duration, '') AS double)"), F.lit(0.0)))
    summary = spark.read.schema("source_music_tracks string, target_music_tracks string, total_matches double").json(made["summary"])
    return matched.union(missing).union(summary.select(F.lit("summary"), "source_music_tracks", "target_music_tracks", "total_matches"))


@query(C.ORACLES["timer_stats_last_n"])
def timer_stats_stream(spark, d):
    """``timer_stats_last_n`` by a stream over the events, in micro-batches that add to what state holds."""
    events = A.table(spark, d, "events").select("event_id", "event_type", "value")
    files = shared_path(spark, "events")
    events.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(files)
    several = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", several).parquet(files)
    found = shared_path(spark, "samples")
    samples.run_to_table(samples.sample_stats(stream, "event_type", "value", "event_id"), found, shared_path(spark, "samples-state"))
    out = samples.latest(spark.read.parquet(found), "event_type")
    return out.withColumns({"avg": r6("avg"), "sum": F.round("sum", 4)})
