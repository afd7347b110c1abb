"""Titles, artists and names in comparable form, as Column expressions that stay inside generated code.

Patterns use ``(?U)`` so that white space, words and digits are Unicode's. Null counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order matters, each works on what the one before has left.
VERSION_WORDS = ("remix", "version", "remaster", "live", "acoustic", "instrumental", "deluxe", "extended")
FEATURING = (
    r"(?iU)\s*\(\s*feat\.?\s+.*?\)",
    r"(?iU)\s*\(\s*ft\.?\s+.*?\)",
    r"(?iU)\s*\(\s*with\s+.*?\)",
    r"(?iU)\s*\(\s*&\s+.*?\)",
    r"(?iU)\s*feat\.?\s+.*",
    r"(?iU)\s*ft\.?\s+.*",
)
BOUNDED_FEATURING = FEATURING[:4] + (r"(?iU)\s*\bfeat\b\.?\s+.*", r"(?iU)\s*\bft\b\.?\s+.*")
GENERATION = r"(?iU)\s+(jr\.?|sr\.?|iii?|iv)$"
ARTIST_SEPARATORS = (",", "&", " and ", " with ", " feat ", " ft ", " featuring ")
NOT_ARTISTS = ("various artists", "ost", "soundtrack", "va")
VERSION_TOKENS = (
    r"remaster(?:ed)?",
    r"remix",
    r"version",
    r"live",
    r"acoustic",
    r"instrumental",
    r"deluxe",
    r"extended",
    r"edit",
    r"radio\s+edit",
    r"demo",
    r"mono",
    r"stereo",
    r"explicit",
    r"clean",
    r"\d{2,4}\s+remaster(?:ed)?",
)
UPLOADER_NOTE = r"(?iU)\s*[\(\[]\s*official.*?[\)\]]"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def without(c: Column, patterns: Iterable[str], by: str = "") -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, by), patterns, c)


def normalize_title(title: Column) -> Column:
    """Lower case, brackets dropped but for version notes, which move to the end; no outer "the", no punctuation."""
    x, notes = collapse(F.lower(strip(text(title)))), []
    for word in VERSION_WORDS:
        note = rf"\([^)]*{word}[^)]*\)"
        notes.append(F.regexp_extract_all(x, F.lit(note), F.lit(0)))
        x = F.regexp_replace(x, note, "")
    found = F.flatten(F.array(*notes))
    x = without(x, (r"\([^)]*\)", r"\[[^\]]*\]"))
    x = F.when(F.size(found) > 0, F.concat_ws(" ", x, F.array_join(found, " "))).otherwise(x)
    x = without(x, (r"(?U)^(the\s+)", r"(?U)\s+(the)$"))
    return strip(collapse(F.regexp_replace(x, r"(?U)[^\w\s]", " ")))


def normalize_artist(artist: Column, bounded: bool = False) -> Column:
    """Lower case without featured artists and generation suffixes.

    The open-ended "ft" form has no word boundary, so "daft punk" becomes "da"; ``bounded`` asks for whole words.
    """
    x = without(F.lower(strip(text(artist))), BOUNDED_FEATURING if bounded else FEATURING)
    return strip(collapse(F.regexp_replace(x, GENERATION, "")))


def _split_at(separator: str):
    return lambda t: F.transform(F.split(t, rf"\Q{separator}\E"), lambda x: strip(x))


def artist_tokens(artist: Column, bounded: bool = False) -> Column:
    """The single artists of a credit, sorted and distinct, without one-letter and collective names."""
    tokens = F.array(normalize_artist(artist, bounded))
    for separator in ARTIST_SEPARATORS:
        tokens = F.flatten(F.transform(tokens, _split_at(separator)))
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*NOT_ARTISTS))))


def strip_versions(title: Column) -> Column:
    """Without version words, deleted one after the other ("radio edit" leaves "radio", since "edit" goes first)."""
    return strip(collapse(without(text(title), (rf"(?iU)\b{p}\b" for p in VERSION_TOKENS), " ")))


def clean_uploader_title(title: Column) -> Column:
    return F.regexp_replace(strip(text(title)), UPLOADER_NOTE, "")


def dedup_key(value: Column) -> Column:
    """Lower case without punctuation (deleted, not replaced); white space collapsed but not stripped again."""
    return collapse(F.regexp_replace(strip(F.lower(text(value))), r"(?U)[^\w\s]", ""))


def clean_search_term(value: Column) -> Column:
    return strip(collapse(F.regexp_replace(text(value), r"(?U)[^\w\s\-']", " ")))


def exact_hash(normal_title: Column, normal_artist: Column) -> Column:
    none = (text(normal_title) == "") | (text(normal_artist) == "")
    return F.when(none, F.lit("")).otherwise(F.md5(F.concat_ws("|", F.lower(normal_title), F.lower(normal_artist))))


def clean_filename(name: Column) -> Column:
    x = F.regexp_replace(F.translate(text(name), '<>:"/\\|?*', "_" * 9), r"^[ .]+|[ .]+$", "")
    return F.when(x == "", F.lit("untitled")).otherwise(x)


def library_slug(name: Column) -> Column:
    return F.translate(F.lower(text(name)), " -", "__")


def search_query(title: Column, artist: Column, album: Column | None = None) -> Column:
    parts = [title, artist] + ([] if album is None else [album])
    return F.concat_ws(" ", *[F.when(text(p) != "", p) for p in parts])


def artist_credit(names: Column) -> Column:
    return F.concat_ws(", ", F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""))


def playlist_id(url: Column) -> Column:
    """The id in an address's ``list`` parameter, or the value itself."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"[?&]list=([^&#]*)", 1), F.lit("")), url)


def video_id(track_id: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(text(track_id), F.lit("")), F.nullif(F.regexp_extract(text(url), r"watch\?v=([^&]*)", 1), F.lit("")))


def thumbnail_url(platform: Column, track_id: Column, url: Column) -> Column:
    picture = F.concat(F.lit("https://img.youtube.com/vi/"), video_id(track_id, url), F.lit("/mqdefault.jpg"))
    return F.when(platform == "youtube_music", picture)


def explicit_hint(title: Column) -> Column:
    return F.lower(text(title)).contains("explicit")


def header_map(lines: Column) -> Column:
    """``key: value`` lines as a map; lines without a colon, such as a request line, are skipped; the last key wins."""
    pairs = F.filter(F.split(text(lines), r"\r?\n"), lambda x: x.contains(": "))
    keys = F.transform(pairs, lambda x: F.lower(F.trim(F.substring_index(x, ": ", 1))))
    values = F.transform(pairs, lambda x: F.trim(F.regexp_extract(x, r"^[^:]*: (.*)$", 1)))
    last = F.filter(F.sequence(F.lit(1), F.greatest(F.size(keys), F.lit(1))), lambda i: (i <= F.size(keys)) & ~F.array_contains(F.slice(keys, i + 1, F.greatest(F.size(keys) - i, F.lit(0))), F.get(keys, i - 1)))
    return F.map_from_arrays(F.transform(last, lambda i: F.get(keys, i - 1)), F.transform(last, lambda i: F.get(values, i - 1)))
