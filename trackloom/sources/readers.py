"""Library exports as track rows: CSV, JSON, property lists, playlist text.

Paths are read by Spark alone, so any store it knows will do. Column names are resolved once from the header, then a
file is one projection; rows that lack a title or an artist go. ``pos`` is the order in the file.
"""

from __future__ import annotations

import plistlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions import parsing as P
from trackloom.functions.normalize import clean_uploader_title, text
from trackloom.operators.content import required
from trackloom.schema import conform

# For each field the header texts that mean it, tried in this order, as part of a header.
HEADERS = {
    "apple_music": {
        "title": ["title", "song", "track", "name", "track name"],
        "artist": ["artist", "artist name", "artists", "performer"],
        "album": ["album", "album name", "release"],
        "duration": ["duration", "time", "length", "track time"],
        "isrc": ["isrc", "isrc code"],
        "year": ["year", "release year", "album year"],
        "genre": ["genre", "genres", "primary genre"],
        "track_number": ["track number", "track #", "#"],
        "track_id": ["track id", "id", "apple id"],
        "url": ["url", "link", "apple music url"],
    },
    "spotify": {
        "title": ["track name", "song", "title", "name"],
        "artist": ["artist name(s)", "artist", "artists", "artist name"],
        "album": ["album name", "album", "release name"],
        "duration": ["duration (ms)", "duration_ms", "duration", "track duration (ms)"],
        "isrc": ["isrc", "isrc code"],
        "year": ["release year", "year", "album year"],
        "track_id": ["track id", "spotify id", "id"],
        "url": ["track url", "spotify url", "external urls", "url"],
    },
    "youtube_music": {
        "title": ["title", "song", "track", "name"],
        "artist": ["artist", "artists", "channel", "uploader"],
        "album": ["album", "playlist", "release"],
        "duration": ["duration", "length"],
        "track_id": ["id", "video id", "youtube id"],
        "url": ["url", "link", "video url"],
    },
}
# JSON keys of each field, first that is not blank.
JSON_KEYS = {
    "spotify": {
        "title": ["title", "name", "trackName"],
        "artist": ["artist", "artistName", "artists"],
        "album": ["album", "albumName"],
        "isrc": ["isrc", "isrcCode"],
        "track_id": ["id", "trackId", "spotifyId"],
        "url": ["trackLink", "url", "trackUrl"],
        "year": ["year", "releaseYear", "albumYear"],
        "duration": ["duration"],
    },
    "youtube_music": {
        "title": ["title", "name", "song"],
        "artist": ["artist", "channel", "uploader"],
        "album": ["album", "playlist"],
        "track_id": ["id", "videoId", "video_id"],
        "url": ["url", "link"],
        "duration": ["duration"],
    },
}
# Keys of a track in a property list.
PLIST_KEYS = {"title": "Name", "artist": "Artist", "album": "Album", "isrc": "ISRC", "genre": "Genre", "url": "Location", "year": "Year", "track_number": "Track Number"}
CONTAINERS = ("tracks", "items", "data", "library", "songs")
MOST_BYTES = 100 << 20


def header_fields(columns: list[str], platform: str) -> dict[str, str]:
    """{field: column}. A column serves one field: a field resolved later takes a column from an earlier one."""
    by_column: dict[str, str] = {}
    for field, variants in HEADERS[platform].items():
        found = next((c for v in variants for c in columns if v in c.lower()), None)
        if found is not None:
            by_column[found] = field
    return {field: column for column, field in by_column.items()}


def head(spark: SparkSession, path: str, n: int = 2048) -> bytes:
    """The first bytes of a file, or of the first file of a folder; no more is read."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(context._jsc.hadoopConfiguration())
    if store.getFileStatus(at).isDirectory():
        files = [x.getPath() for x in store.listStatus(at) if x.isFile() and x.getPath().getName()[0] not in "._"]
        if not files:
            return b""
        at = min(files, key=lambda x: x.getName())
    stream = store.open(at)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def encoding_of(start: bytes) -> str:
    for mark, name in ((b"\xff\xfe", "UTF-16"), (b"\xfe\xff", "UTF-16"), (b"\xef\xbb\xbf", "UTF-8")):
        if start.startswith(mark):
            return name
    for cut in range(min(4, len(start) + 1)):
        try:
            start[: len(start) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    return "ISO-8859-1"


def delimiter_of(line: str) -> str:
    return ";" if line.count(";") > line.count(",") else "\t" if "\t" in line and "," not in line else ","


def detect_platform(spark: SparkSession, path: str) -> str:
    name = path.lower()
    if name.endswith(".xml"):
        return "apple_music_xml"
    low = head(spark, path).decode("utf-8", "replace").lower()
    if name.endswith(".json"):
        if "spotify" in low:
            return "spotify"
        if "youtube.com" in low or '"videoid"' in low or '"video_id"' in low:
            return "youtube_music"
        return "apple_music" if "apple.com" in low or "itunes" in low else "youtube_music"
    line = low.split("\n", 1)[0]
    if "duration (ms)" in line or "artist name(s)" in line or ("track name" in line and "album name" in line):
        return "spotify"
    if "isrc" in line or "apple" in line:
        return "apple_music"
    return "youtube_music" if "channel" in line or "video" in line else "apple_music"


def _cell(column: Column) -> Column:
    """Blank cells and the text "nan" of other tools are null."""
    x = F.trim(column.cast("string"))
    return F.when(F.lower(x).isin("", "nan"), None).otherwise(x)


def _typed(rows: DataFrame, platform: str, length_of: Callable[[Column], Column]) -> DataFrame:
    c = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
    length = length_of(c("duration"))
    title = clean_uploader_title(c("title")) if platform == "youtube_music" else c("title")
    out = rows.withColumns({"title": title, "duration": length, "year": P.year(c("year")), "track_number": P.whole(c("track_number"))})
    return conform(required(out), platform=platform)


def _csv(spark: SparkSession, path: str, platform: str, multiline: bool, record: bool = False) -> tuple[DataFrame, str, int]:
    """Cells by field with ``pos``, the delimiter and the number of columns; with ``record`` the text of broken rows."""
    start = head(spark, path)
    charset = encoding_of(start)
    line = start.decode("utf-16" if charset == "UTF-16" else charset, "ignore").split("\n", 1)[0]
    sep = delimiter_of(line)
    reader = lambda: spark.read.options(header=True, encoding=charset, sep=sep, multiLine=multiline or charset == "UTF-16", escape='"', mode="PERMISSIVE")
    raw = reader().csv(path)
    columns = raw.columns
    if record:
        named = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "__record"]])
        raw = reader().options(columnNameOfCorruptRecord="__record").schema(named).csv(path)
        # always true: Spark refuses plans that read nothing besides the record, such as a count of broken rows
        raw = raw.where(F.coalesce(F.length(F.col(f"`{columns[0]}`")), F.lit(0)) >= 0)
    cells = [_cell(F.col(f"`{column}`")).alias(field) for field, column in header_fields(columns, platform).items()]
    return raw.select(*cells, F.monotonically_increasing_id().alias("pos"), *(["__record"] if record else [])), sep, len(columns)


def read_csv(spark: SparkSession, path: str, platform: str, multiline: bool = True) -> DataFrame:
    """A CSV export. Without ``multiline`` large files are split among tasks; quoted line breaks then end a row.

    Rows with too few cells lack the last ones, cells beyond the header are left out: see ``broken_rows``.
    """
    rows, _, _ = _csv(spark, path, platform, multiline)
    return _typed(rows, platform, {"spotify": P.milliseconds, "youtube_music": P.iso_duration}.get(platform, P.duration))


def broken_rows(spark: SparkSession, path: str, platform: str, multiline: bool = True) -> DataFrame:
    """(pos, record, cells, columns, status) of the rows of a CSV export that don't have the header's number of cells.

    ``record`` is the row as it stands in the file. ``status`` is "repaired" where title and artist are there, so that
    ``read_csv`` has a track of the same ``pos``, and else "rejected". A blank line is no row.
    """
    rows, sep, columns = _csv(spark, path, platform, multiline, record=True)
    bare = F.regexp_replace("__record", r'"[^"]*+"', "")
    cells = F.length(bare) - F.length(F.replace(bare, F.lit(sep))) + 1
    here = lambda c: F.col(c).isNotNull() if c in rows.columns else F.lit(False)
    status = F.when(here("title") & here("artist"), "repaired").otherwise("rejected")
    return rows.where(F.col("__record").isNotNull()).select("pos", F.col("__record").alias("record"), cells.alias("cells"), F.lit(columns).alias("columns"), status.alias("status"))


def read_json(spark: SparkSession, path: str, platform: str) -> DataFrame:
    """A list of tracks, an object with a list under a known key, or one track; keys are looked up in a variant."""
    doc = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("v"))
    inner = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "array<variant>") for k in CONTAINERS], F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    items = doc.select(F.posexplode(inner).alias("pos", "t"))

    def first(keys: list[str]) -> Column:
        found = []
        for k in keys:
            found.append(F.when(F.schema_of_variant(F.try_variant_get("t", f"$.{k}", "variant")).startswith("ARRAY"), F.concat_ws(", ", F.try_variant_get("t", f"$.{k}", "array<string>"))).otherwise(F.try_variant_get("t", f"$.{k}", "string")))
        return F.coalesce(*[_cell(x) for x in found])

    rows = items.select("pos", *[first(keys).alias(field) for field, keys in JSON_KEYS["youtube_music" if platform == "youtube_music" else "spotify"].items()])
    # numbers are seconds here, in every range
    return _typed(rows, platform, P.iso_duration if platform == "youtube_music" else P.whole)


def _unescaped(c: Column) -> Column:
    """References of XML resolved: numbers and names first, the ampersand last, so that no text is resolved twice."""
    # The names that XML knows without a declaration.
    names = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
    ampersand = r"&(?:amp|#0*38|#[xX]0*26);"
    numbers = F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(r"(&#(?:[0-9]+|[xX][0-9a-fA-F]+);)")), lambda x: ~x.rlike(ampersand)))

    def letter(reference: Column) -> Column:
        hexadecimal = F.regexp_extract(reference, r"^&#[xX]([0-9a-fA-F]+)", 1)
        digits = F.when(hexadecimal != "", hexadecimal).otherwise(F.hex(F.try_to_number(F.regexp_extract(reference, r"^&#([0-9]+)", 1), F.lit("9999999999")).cast("long")))
        return F.decode(F.unhex(F.lpad(F.ltrim(digits, F.lit("0")), 8, "0")), "UTF-32")

    out = F.aggregate(numbers, c, lambda whole, x: F.replace(whole, x, letter(x)))
    for name, char in names.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.regexp_replace(out, ampersand, "&")


def read_plist(spark: SparkSession, path: str) -> DataFrame:
    """Property lists by record: a file is split among tasks at the ends of its ``dict`` elements.

    A track is a ``dict`` under a key that holds no other ``dict``; entries of playlists stand in arrays and are none.
    Of a file that breaks off, the tracks before the break stay; a file without such records is an empty library.
    Binary lists and texts in UTF-16 can't be cut at that mark: each is read whole, by one task.
    """
    start = head(spark, path)
    if start.startswith(b"bplist") or encoding_of(start) == "UTF-16":
        return read_plist_whole(spark, path)
    cut = spark.read.option("lineSep", "</dict>").text(path).select("value", F.monotonically_increasing_id().alias("pos"))
    track = F.regexp_extract("value", r"(?s)<key>[^<]*</key>\s*<dict>((?:(?!<dict>).)*+)$", 1)
    get = lambda key: _unescaped(F.get(F.regexp_extract_all("track", F.lit(rf"(?s)<key>\s*{key}\s*</key>\s*<(?:string|integer|real|date)>(.*?)</")), F.lit(0)))
    rows = cut.withColumn("track", track).where("track <> ''")
    whole = F.floor(F.nullif(get("Total Time").try_cast("long"), F.lit(0)) / 1000).cast("string")
    own = F.coalesce(F.nullif(get("Persistent ID"), F.lit("")), get("Track ID"))
    return _plist_tracks(rows.select("pos", *[get(key).alias(field) for field, key in PLIST_KEYS.items()], whole.alias("duration"), own.alias("track_id")))


def _plist_tracks(rows: DataFrame) -> DataFrame:
    return conform(required(rows.withColumns({"duration": P.whole(F.col("duration")), "year": P.year(F.col("year")), "track_number": P.whole(F.col("track_number"))})), platform="apple_music")


def read_plist_whole(spark: SparkSession, path: str) -> DataFrame:
    """Property lists of any form, one task for each file; an invalid file is an empty library."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "artist", "album", "isrc", "genre", "track_id", "url", "duration", "year", "track_number")] + [T.StructField("pos", T.LongType())])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                try:
                    tracks = plistlib.loads(bytes(content)).get("Tracks", {}).values()
                except Exception:
                    continue
                rows = []
                for i, t in enumerate(tracks):
                    row = {field: str(t[key]) if t.get(key) is not None else None for field, key in PLIST_KEYS.items()}
                    ms, own = t.get("Total Time"), t.get("Persistent ID") or t.get("Track ID")
                    rows.append(row | {"duration": str(ms // 1000) if ms else None, "track_id": str(own) if own is not None else None, "pos": i})
                yield pd.DataFrame(rows, columns=schema.names)

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)
    return _plist_tracks(rows)


def read_library(spark: SparkSession, path: str, platform: str | None = None) -> DataFrame:
    """Any export; the platform is told from the file unless given (``apple``, ``spotify``, ``yt`` and the like)."""
    name = (platform or detect_platform(spark, path)).lower().replace("_", " ").replace("-", " ")
    if "xml" in name:
        return read_plist(spark, path)
    known = "spotify" if "spotify" in name else "apple_music" if "apple" in name or name == "am" else "youtube_music" if "youtube" in name or "ytm" in name or name == "yt" else None
    if known is None:
        raise ValueError(f"unknown platform: {platform}")
    return (read_json if path.lower().endswith(".json") else read_csv)(spark, path, known)


def read_playlist(spark: SparkSession, path: str) -> DataFrame:
    """(pos, title, artist, album, duration): tab-separated with a Name column, or lines "artist - title"."""
    start = head(spark, path)
    charset = encoding_of(start)
    first = start.decode("utf-16" if charset == "UTF-16" else charset, "ignore").lstrip("﻿").split("\n", 1)[0]
    names = [x.strip().lower() for x in first.split("\t")]
    wide = charset == "UTF-16"  # line ends of two bytes are found only where a file is read as one
    if "name" in names:
        raw = spark.read.options(header=True, sep="\t", encoding=charset, multiLine=wide).csv(path)
        column = {c.strip().lower(): c for c in raw.columns}
        get = lambda n: F.col(f"`{column[n]}`") if n in column else F.lit(None).cast("string")
        rows = raw.select(F.monotonically_increasing_id().alias("pos"), get("name").alias("title"), get("artist").alias("artist"), get("album").alias("album"), P.playlist_time(get("time")).alias("duration"))
        return rows.where(F.trim(text(F.col("title"))) != "")
    lines = spark.read.options(sep="\u0001", encoding=charset, quote="", multiLine=wide).schema("value string").csv(path).select("value", F.monotonically_increasing_id().alias("pos"))
    parts = F.split("value", " - ", 2)
    rows = lines.where(F.col("value").contains(" - ")).select("pos", F.trim(F.get(parts, F.lit(1))).alias("title"), F.trim(F.get(parts, F.lit(0))).alias("artist"))
    return rows.withColumns({"album": F.lit(None).cast("string"), "duration": F.lit(None).cast("int")})


def read_missing(spark: SparkSession, path: str) -> DataFrame:
    """title, artist, album, isrc, duration from a list of missing tracks, whatever its header is called."""
    raw = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    pick = lambda *names: F.coalesce(*[_cell(F.col(f"`{n}`")) for n in names if n in raw.columns], F.lit(""))
    return raw.select(
        F.monotonically_increasing_id().alias("pos"),
        pick("playlist_title", "title", "Title", "Name").alias("title"),
        pick("playlist_artist", "artist", "Artist").alias("artist"),
        pick("playlist_album", "album", "Album").alias("album"),
        pick("isrc", "ISRC").alias("isrc"),
        pick("playlist_duration", "duration", "Duration", "Time").alias("duration"),
    )


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """Name, stem, suffix, length and whether it is small enough of each file. Empty files have no row: Spark skips them."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("suffix"), "length", (F.col("length") <= MOST_BYTES).alias("accepted"))
