"""Files and reports that are written and read back: comparisons, missing tracks, summaries, duplicates, playlists, file facts."""

from __future__ import annotations

import csv
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trackloom.functions.normalize import header_map, library_slug
from trackloom.sources import readers, writers

TRACK = "title string, artist string, album string, duration int, isrc string, platform string, track_id string, url string, year int, genre string"
MATCH = "s_title string, s_artist string, s_album string, s_duration int, t_title string, t_artist string, t_album string, t_duration int, confidence double, match_type string"


@pytest.fixture()
def tables(spark):
    missing = spark.createDataFrame([('A "quoted", title', "B", None, None, None, "p", "1", None, 0, "pop"), ("Ü", "", "C", 61, "US1", None, None, "u", 1999, None)], TRACK)
    matches = spark.createDataFrame([("a", "b", None, 60, "a", "b", "c", None, 0.98765, "exact")], MATCH)
    stats = spark.createDataFrame([(3, 1, 0.98765, 1 / 3)], "source_music_tracks int, total_matches int, avg_confidence double, match_rate double")
    return matches, missing, stats


def csv_rows(path):
    rows = []
    for f in sorted(Path(path).glob("part-*.csv")):
        with open(f, newline="", encoding="utf-8") as lines:
            rows += list(csv.DictReader(lines, escapechar="\\"))
    return rows


def test_save_comparison(tables, tmp_path):
    matches, missing, stats = tables
    made = writers.save_comparison(str(tmp_path), "My Lib-1", "Other", matches, missing, stats)
    assert {k: Path(v).name for k, v in made.items()} == {"matches": "my_lib_1_vs_other_matched.csv", "missing": "my_lib_1_vs_other_missing_from_other.csv", "summary": "my_lib_1_vs_other_summary.json"}
    assert [r["source_title"] for r in csv_rows(made["matches"])] == ["a"]
    assert sorted(r["title"] for r in csv_rows(made["missing"])) == ['A "quoted", title', "Ü"]
    told = [json.loads(x) for f in Path(made["summary"]).glob("part-*.json") for x in f.read_text().splitlines()]
    assert len(told) == 1 and told[0]["source_music_tracks"] == 3


def test_save_comparison_of_empty_tables(tables, tmp_path):
    matches, missing, stats = tables
    made = writers.save_comparison(str(tmp_path), "A", "B", matches.where("false"), missing.where("false"), stats)
    assert set(made) == {"summary"} and len(list(tmp_path.iterdir())) == 1


def test_save_comparison_runs_each_table_once(spark, tables, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def counted(part):
        for rows in part:
            runs.add(len(rows))
            yield rows

    matches, missing, stats = (t.mapInPandas(counted, t.schema) for t in tables)
    made = writers.save_comparison(str(tmp_path), "A", "B", matches, missing, stats)
    assert set(made) == {"matches", "missing", "summary"} and runs.value == 1 + 2 + 1


def test_save_comparison_again_without_rows(spark, tables, tmp_path):
    matches, missing, stats = tables
    first = writers.save_comparison(str(tmp_path), "A", "B", matches, missing, stats)
    none = spark.createDataFrame([], TRACK)
    made = writers.save_comparison(str(tmp_path), "A", "B", matches, none, stats)
    assert set(made) == {"matches", "summary"} and not Path(first["missing"]).exists()


def test_library_file_name(spark):
    names = ["My Lib-1", "", "a  b", "É-x"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in rows.select(library_slug(F.col("n"))).collect()] == [writers.library_file_name(n) for n in names]


def test_missing_report(tables):
    rows = writers.missing_report(tables[1]).collect()
    assert rows[0].asDict().keys() == {"title", "artist", "album", "duration", "isrc", "platform", "track_id", "url", "year", "genre"}
    assert [r.album for r in rows] == ["", "C"] and [r.genre for r in rows] == ["pop", ""]
    assert "duration" not in writers.missing_report(tables[1].drop("duration")).columns


def test_summary_report(tables):
    row = writers.summary_report(tables[2]).first()
    assert (float(row.match_rate), float(row.avg_confidence)) == pytest.approx((33.3, 98.8), abs=0.05)


def test_dedup_report(spark):
    rows = [(1, r, 10 - r, f"t{r}", "al", "Album", "High", 20, 60, False) for r in (2, 1, 3)] + [(2, 1, 50, None, None, None, None, 0, None, None)]
    names = "group_id int, rank int, pos int, title string, album string, source string, quality string, quality_score int, duration int, explicit boolean"
    found = {r.group_id: r for r in writers.dedup_report(spark.createDataFrame(rows, names)).collect()}
    assert found[1]["size"] == 3 and [x["rank"] for x in found[1].duplicates] == [1, 2, 3] and found[1].duplicates[0].title == "t1"
    assert found[2]["size"] == 1 and found[2].duplicates[0].title is None


def test_playlist_report(spark):
    songs = spark.createDataFrame(
        [("t", [("x",), (None,), ("y",)], ("al",), 9, "v"), ("u", [], None, None, None)], "title string, artists array<struct<name: string>>, album struct<name: string>, duration int, videoId string"
    )
    assert [tuple(r) for r in writers.playlist_report(songs).collect()] == [("t", "x, y", "al", 9, "v"), ("u", "", "", None, None)]


def test_file_info(spark, tmp_path):
    (tmp_path / "a.b.csv").write_bytes(b"12345")
    (tmp_path / "bare").write_bytes(b"1")
    (tmp_path / "empty.csv").write_bytes(b"")  # has no row, see the docstring
    found = {r.name: (r.stem, r.suffix, r.length, r.accepted) for r in readers.file_info(spark, str(tmp_path)).collect()}
    assert found == {"a.b.csv": ("a.b", ".csv", 5, True), "bare": ("bare", "", 1, True)}


def test_header_map(spark):
    lines = ["GET / HTTP/1.1\r\nAccept: */*\r\nCookie: a=b: c\nAccept: text", "", None]
    found = [r.h for r in spark.createDataFrame([(x,) for x in lines], "x string").select(header_map(F.col("x")).alias("h")).collect()]
    assert found == [{"cookie": "a=b: c", "accept": "text"}, {}, {}]
