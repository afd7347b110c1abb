"""Functions, sources, sinks, streams and shared plan helpers on small rows worked out by hand."""

from __future__ import annotations

import json
import plistlib
import random

import pytest
from pyspark.sql import functions as F

from trackloom.functions import normalize as N
from trackloom.functions import parsing as P
from trackloom.functions import similarity as S
from trackloom.operators import dedup, matching, usage
from trackloom.operators.components import connected_components
from trackloom.operators.content import is_music
from trackloom.operators.shared import meet_all, with_prefix
from trackloom.sources import readers, writers
from trackloom.streaming import metrics, samples


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("function", "given", "expected"),
    [
        (N.normalize_title, "The Song (feat. X) [Live]", "song"),
        (N.normalize_title, "Song (2011 Remaster)", "song 2011 remaster"),
        (N.normalize_title, "Song - Remastered", "song remastered"),
        (N.normalize_title, None, ""),
        (N.normalize_artist, "Artist feat. Someone", "artist"),
        (N.normalize_artist, "Artist & Friends", "artist & friends"),
        (N.normalize_artist, "Daft Punk", "da"),
        (N.artist_tokens, "A One & B Two, C", ["a one", "b two"]),
        (N.strip_versions, "song 2011 remaster", "song 2011"),
        (N.strip_versions, "song radio edit", "song radio"),
        (N.clean_filename, "a/b:c", "a_b_c"),
        (N.clean_filename, " . ", "untitled"),
        (P.duration, "3:30", 210),
        (P.duration, "1:05:30", 3930),
        (P.duration, "180", 180),
        (P.duration, "180000", 180),
        (P.duration, "1200", 1),
        (P.duration, "2.5", 2),
        (P.duration, "invalid", None),
        (P.iso_duration, "PT3M45S", 225),
        (P.iso_duration, "PT0S", None),
    ],
)
def test_scalars(spark, function, given, expected):
    assert value(spark, function(F.lit(given).cast("string"))) == expected


@pytest.mark.parametrize(
    "title",
    ["a podcast", "Episode 3", "chapter  12", "YouTube Shorts", "short", "my vlog", "reaction", "Behind the  Scenes", "making of x", "Audiobook", "Purple Rain", "Nature", "Stand-up", "standup", "funny", "live from y", "Recorded Live", "concert recording", "bootleg", "explicit", "x" * 151],
)
def test_what_is_not_music(spark, title):
    assert not value(spark, is_music(F.lit(title), F.lit("Artist")))


@pytest.mark.parametrize("title", ["Song", "Rainbow", "Chapters", "Alive", "Talking Heads", "x" * 150])
def test_what_is_music(spark, title):
    assert value(spark, is_music(F.lit(title), F.lit("Artist")))


def test_words_that_are_no_artists_or_titles(spark):
    assert value(spark, N.artist_tokens(F.lit("Various Artists, OST & Soundtrack and VA with Real One"), False)) == ["real one"]
    words = "song remastered remix version live"
    assert value(spark, N.strip_versions(F.lit(words))) == "song"


def test_times(spark):
    rows = [value(spark, P.time_text(F.lit(s).cast("int"))) for s in (65, 3661, None)]
    assert rows == ["1:05", "1:01:01", ""]


def test_duration_similarity(spark):
    score = lambda a, b: value(spark, S.duration_similarity(F.lit(a), F.lit(b), True))
    assert score(200, 207) == 1.0
    assert score(200, 210) == pytest.approx(1 - (10 / 210) / 0.08 * 0.4)
    assert score(200, 300) == 0.0
    assert score(0, 300) == 0.5


def test_string_kernels():
    assert S.ratio("abc", "abc") == 100.0
    assert S.ratio("abcd", "bcde") == pytest.approx(75.0)
    assert S.token_sort_ratio("b a", "a b") == 100.0
    assert S.token_set_ratio("a b", "a b c") == 100.0
    assert S.partial_ratio("abc", "xxabcxx") == 100.0
    assert S.common("abcbdab", "bdcaba") == 4


def test_csv_json_plist(spark, tmp_path):
    one = tmp_path / "s.csv"
    one.write_text("Track Name,Artist Name(s),Album Name,Duration (ms),ISRC\nSong,Artist,Album,180000,X1\nOther,,Album,1,\n")
    rows = readers.read_library(spark, str(one)).collect()
    assert [(r.title, r.artist, r.duration, r.isrc, r.platform) for r in rows] == [("Song", "Artist", 180, "X1", "spotify")]
    two = tmp_path / "y.json"
    two.write_text(json.dumps({"tracks": [{"title": "T (Official Video)", "artist": "A", "duration": "PT3M45S", "videoId": "v"}]}))
    row = readers.read_library(spark, str(two)).first()
    assert (row.title, row.artist, row.duration, row.track_id) == ("T", "A", 225, "v")
    three = tmp_path / "i.xml"
    three.write_bytes(plistlib.dumps({"Tracks": {"1": {"Name": "N", "Artist": "A", "Total Time": 200000, "Track ID": 7}, "2": {"Name": "no artist"}}}))
    row = readers.read_library(spark, str(three)).collect()
    assert [(r.title, r.duration, r.track_id) for r in row] == [("N", 200, "7")]
    broken = tmp_path / "b.xml"
    broken.write_text("no list")
    assert readers.read_library(spark, str(broken)).count() == 0


def test_spotify_json_has_seconds(spark, tmp_path):
    one = tmp_path / "s.json"
    one.write_text(json.dumps([{"platform": "spotify", "title": "T", "artist": "A", "duration": d} for d in (1200, "180", "999", None)]))
    assert [r.duration for r in readers.read_library(spark, str(one)).orderBy("pos").collect()] == [1200, 180, 999, None]


def test_a_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)not.*(exist|found)"):
        readers.read_library(spark, str(tmp_path / "none.json"))


def test_first_bytes_of_files_and_folders(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "_meta").write_text("no")
    (tmp_path / "d" / "b.csv").write_text("second")
    (tmp_path / "d" / "a.csv").write_text("first file")
    assert readers.head(spark, str(tmp_path / "d"), 5) == b"first" and readers.head(spark, str(tmp_path / "d" / "b.csv")) == b"second"


def test_all_of_a_stated_set(spark):
    asked, rows = spark.range(7).withColumnRenamed("id", "a"), spark.range(11).withColumnRenamed("id", "b")
    found = [(r.a, r.b) for r in meet_all(asked, rows, 2).collect()]
    assert sorted(found) == [(a, b) for a in range(7) for b in range(11)]


def test_selections(spark):
    rows = spark.createDataFrame([("g", 1, True), ("g", 2, False), ("h", 3, True)], "group_id string, pos long, winner boolean")
    ids = lambda *a: sorted(r.pos for r in dedup.picked(rows, *a).collect())
    assert (ids(), ids("winners"), ids("losers"), ids("all", ["g"]), ids("winners", ["h"])) == ([1, 2, 3], [1, 3], [2], [1, 2], [3])


def test_playlist_text(spark, tmp_path):
    lines = tmp_path / "p.txt"
    lines.write_text("Artist - Title - Live\nno separator\n")
    assert [(r.artist, r.title) for r in readers.read_playlist(spark, str(lines)).collect()] == [("Artist", "Title - Live")]
    table = tmp_path / "q.txt"
    table.write_bytes("Name\tArtist\tAlbum\tTime\nN\tA\tB\t3:05\n".encode("utf-16"))
    assert [(r.artist, r.title, r.duration) for r in readers.read_playlist(spark, str(table)).collect()] == [("A", "N", 185)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), (None, 2)], "x string, y int")
    writers.write_csv(rows, str(tmp_path / "c"), sep=";")
    assert spark.read.options(header=True, sep=";").csv(str(tmp_path / "c")).count() == 2
    writers.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_stream_counts_as_batch(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "e")).schema).parquet(str(tmp_path / "e"))
    metrics.drain(metrics.counters(stream), "totals", "complete")
    batch = spark.read.parquet(str(tmp_path / "e")).groupBy("event_type").count()
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, batch.collect()))


def test_last_samples_over_a_restart(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, rng.random()])) for i in range(300)] + [(400, "null only", None), (None, "a", 9.0)]
    schema = "event_id long, name string, value double"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    late = sorted(rows[:300], key=lambda r: r[0] % 3)  # rows come out of order
    for run in (late[:90], late[90:] + rows[300:]):
        spark.createDataFrame(run, schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        samples.run_to_table(samples.sample_stats(stream, "name", "value", "event_id", n=40), str(tmp_path / "out"), str(tmp_path / "state"))
    found = samples.latest(spark.read.parquet(str(tmp_path / "out")), "name").collect()
    batch = usage.sample_stats(spark.createDataFrame(rows, schema).where("event_id IS NOT NULL"), ["name"], "value", [F.col("event_id").desc()], n=40).collect()
    assert {r.name: pytest.approx(tuple(r)[1:]) for r in batch} == {r.name: tuple(r)[1:] for r in found} and len(found) == len(batch) == 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (40, 40), (None, 1)]
    out = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {out[i] for i in range(21)} == {0}
    assert out[31] == 30
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_of_a_hot_key(spark):
    rows = spark.createDataFrame([(None if i % 3 else "k", i, i % 5) for i in range(500)], "k string, id long, v long")
    out = with_prefix(rows, ["k"], [F.col("id")], F.col("id"), F.col("v"), rows_per_bucket=20, before="at").toPandas()
    for _, part in out.groupby("k", dropna=False):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(len(part)))
        assert part["at"].tolist() == [0, *part["v"].cumsum().tolist()[:-1]]


def plist_rows(df):
    return [tuple(r) for r in df.select("title", "artist", "album", "duration", "isrc", "year", "track_id", "url", "track_number").orderBy("pos").collect()]


def test_plist_by_record(spark, tmp_path):
    """Cut files give what whole ones give: references, playlists, missing keys, blanks, many small splits."""
    tracks = {str(i): {"Track ID": i, "Name": f"T{i} <&lt;> 'ü\n♪\"", "Artist": "A & B", "Total Time": 1000 * i + 999, "Year": 1990, "Rating": 5, "Loved": True, "Album": ""} for i in range(300)}
    tracks |= {"a": {"Name": "no artist", "Track ID": 9000}, "b": {"Name": "N", "Artist": "A", "Persistent ID": "FF", "Track ID": 9001, "Track Number": 3, "Location": "file://x"}, "c": {}}
    whole = {"Major Version": 1, "Features": {}, "Tracks": tracks, "Playlists": [{"Name": "Mine", "Artist": "X", "Playlist Items": [{"Track ID": 1}, {"Track ID": 2, "Name": "n", "Artist": "a"}]}]}
    path, binary = tmp_path / "a.xml", tmp_path / "b.xml"
    path.write_bytes(plistlib.dumps(whole, sort_keys=False))
    binary.write_bytes(plistlib.dumps(whole, sort_keys=False, fmt=plistlib.FMT_BINARY))
    expected = plist_rows(readers.read_plist_whole(spark, str(path)))
    assert len(expected) == 301 and expected[0][0] == "T0 <&lt;> 'ü\n♪\""
    assert plist_rows(readers.read_plist(spark, str(binary))) == expected
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        rows = readers.read_plist(spark, str(path))
        assert rows.rdd.getNumPartitions() > 8
        assert plist_rows(rows) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    iso = tmp_path / "c.xml"
    iso.write_text("<plist><dict><key>Tracks</key><dict><key>1</key><dict><key>Name</key><string>a&#38;#60;&#x1F3B5;&amp;amp;</string><key>Artist</key><string>b</string></dict><key>2</key><dict><key>Name</key><string>cut o")
    assert [r[0] for r in plist_rows(readers.read_plist(spark, str(iso)))] == ["a&#60;\U0001f3b5&amp;"]


def test_broken_rows(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('Name;Artist;Album\nA;B;C\n"x;""y""";B\n\nT;B;C;D;E\nonly\n;B;;\n"A\nB";C;D\n')
    rows = [(r.record, r.cells, r.columns, r.status) for r in readers.broken_rows(spark, str(path), "apple_music").orderBy("pos").collect()]
    assert rows == [('"x;""y""";B', 2, 3, "repaired"), ("T;B;C;D;E", 5, 3, "repaired"), ("only", 1, 3, "rejected"), (";B;;", 4, 3, "rejected")]
    tracks = [(r.title, r.artist, r.album) for r in readers.read_library(spark, str(path), "apple").orderBy("pos").collect()]
    assert tracks == [("A", "B", "C"), ('x;"y"', "B", None), ("T", "B", "C"), ("A\nB", "C", "D")]
    path.write_text("Name;Artist;Album\nA;B;C\n")
    assert readers.broken_rows(spark, str(path), "apple_music").count() == 0


def test_options_are_checked(spark):
    assert matching.option_issues(strict=True, use_album=False) == []
    assert matching.option_issues(strict="yes", use_duration=None, use_album=1) == ["strict must be a boolean", "use_duration must be a boolean", "use_album must be a boolean"]
    with pytest.raises(ValueError, match="use_album must be a boolean"):
        matching.match_libraries(spark.range(1), spark.range(1), use_album="no")
