"""Shared parts of the oracles, in DuckDB's SQL: derived tracks, scores and the cascade."""

from __future__ import annotations

from trackloom.functions.normalize import NOT_ARTISTS, VERSION_TOKENS, VERSION_WORDS
from trackloom.operators.content import NOT_MUSIC
from trackloom.plans.adapters import TRACKS_SQL


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lib() -> str:
    """CTEs that end in ``lib``: tracks with nt, na, tokens, base and is_music."""
    parts = [f"raw AS ({TRACKS_SQL})", r"t0 AS (SELECT *, regexp_replace(lower(trim(title)), '\s+', ' ', 'g') AS x, [] :: VARCHAR[] AS notes FROM raw)"]
    for i, word in enumerate(VERSION_WORDS, 1):
        note = quoted(rf"\([^)]*{word}[^)]*\)")
        parts.append(f"t{i} AS (SELECT * REPLACE (regexp_replace(x, {note}, '', 'g') AS x, list_concat(notes, regexp_extract_all(x, {note})) AS notes) FROM t{i - 1})")
    n = len(VERSION_WORDS)
    parts.append(rf"u0 AS (SELECT * REPLACE (regexp_replace(regexp_replace(x, '\([^)]*\)', '', 'g'), '\[[^\]]*\]', '', 'g') || CASE WHEN len(notes) > 0 THEN ' ' || array_to_string(notes, ' ') ELSE '' END AS x) FROM t{n})")
    parts.append(r"u1 AS (SELECT * EXCLUDE (x, notes), trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^(the\s+)', ''), '\s+(the)$', ''), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS nt FROM u0)")
    artist = "lower(trim(artist))"
    for p in (r"\s*\(\s*feat\.?\s+.*?\)", r"\s*\(\s*ft\.?\s+.*?\)", r"\s*\(\s*with\s+.*?\)", r"\s*\(\s*&\s+.*?\)", r"\s*feat\.?\s+.*", r"\s*ft\.?\s+.*", r"\s+(jr\.?|sr\.?|iii?|iv)$"):
        artist = f"regexp_replace({artist}, {quoted(p)}, '', 'g')"
    parts.append(rf"u2 AS (SELECT *, trim(regexp_replace({artist}, '\s+', ' ', 'g')) AS na FROM u1)")
    out = ", ".join(map(quoted, NOT_ARTISTS))
    parts.append(rf"u3 AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(na, ',|&| and | with | feat | ft | featuring '), lambda v: trim(v)), lambda v: length(v) > 1 AND v NOT IN ({out})))) AS tokens FROM u2)")
    base = "nt"
    for p in VERSION_TOKENS:
        base = f"regexp_replace({base}, {quoted(rf'(?i)\b{p}\b')}, ' ', 'g')"
    music = " AND ".join(f"NOT regexp_matches(lower(title || ' ' || artist), {quoted(p)})" for p in NOT_MUSIC)
    parts.append(rf"lib AS (SELECT *, trim(regexp_replace({base}, '\s+', ' ', 'g')) AS base, ({music}) AND length(title) <= 150 AS is_music FROM u3)")
    return ", ".join(parts)


LIB = "WITH " + _lib()
SAME_ISRC = "coalesce(s.isrc <> '' AND lower(s.isrc) = lower(t.isrc), false)"
TITLE = "(CASE WHEN s.nt <> '' AND s.nt = t.nt THEN 1e0 ELSE 0e0 END)"
COMMON = "len(list_intersect(s.tokens, t.tokens))"
ARTIST = f"""(CASE WHEN len(s.tokens) = 0 OR len(t.tokens) = 0 THEN CASE WHEN s.na <> '' AND s.na = t.na THEN 1e0 ELSE 0e0 END
    ELSE least(1e0, {COMMON} / CAST(len(s.tokens) + len(t.tokens) - {COMMON} AS DOUBLE) + CASE WHEN {COMMON} IN (len(s.tokens), len(t.tokens)) THEN 0.3e0 ELSE 0e0 END) END)"""
ALBUM = "(CASE WHEN coalesce(s.album, '') = '' OR coalesce(t.album, '') = '' THEN 0.5e0 WHEN lower(s.album) = lower(t.album) THEN 1e0 ELSE 0e0 END)"


def length(strict: bool = True) -> str:
    tolerance, limit = (7, "0.08e0") if strict else (9, "0.12e0")
    gap, longer = "abs(s.duration - t.duration)", "CAST(greatest(s.duration, t.duration) AS DOUBLE)"
    return f"""(CASE WHEN coalesce(s.duration, 0) = 0 OR coalesce(t.duration, 0) = 0 THEN 0.5e0 WHEN {gap} <= {tolerance} THEN 1e0
        WHEN {gap} / {longer} <= {limit} THEN greatest(0.6e0, 1e0 - {gap} / {longer} / {limit} * 0.4e0) ELSE 0e0 END)"""


def confidence(strict: bool = True, album: bool = False) -> str:
    return f"(CASE WHEN {SAME_ISRC} THEN 1e0 ELSE ({TITLE} * 0.45e0 + {ARTIST} * 0.35e0 + {ALBUM if album else '0.5e0'} * 0.10e0 + {length(strict)} * 0.05e0) / (0.45e0 + 0.35e0 + 0.10e0 + 0.05e0) END)"


def words(side: str) -> str:
    return f"""SELECT pos, 't:' || w AS word FROM (SELECT pos, unnest(list_distinct(string_split(nt, ' '))) AS w FROM {side}) WHERE length(w) > 2
        UNION ALL SELECT pos, 'a:' || w FROM (SELECT pos, unnest(list_distinct(string_split(na, ' '))) AS w FROM {side}) WHERE length(w) > 2"""


def cascade(source: str, target: str, tag: str = "") -> str:
    """CTEs that end in ``matches`` + tag: s_pos, t_pos, confidence, match_type, by equality and without albums."""
    c = confidence()
    k = tag
    return f"""
    s{k} AS (SELECT * FROM ({source}) WHERE is_music), t{k} AS (SELECT * FROM ({target}) WHERE is_music),
    last{k} AS (SELECT * FROM t{k} WHERE isrc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(isrc) ORDER BY pos DESC) = 1),
    m1{k} AS (SELECT s.pos AS s_pos, t.pos AS t_pos, 1e0 AS confidence, 'isrc' AS match_type FROM s{k} s JOIN last{k} t ON lower(s.isrc) = lower(t.isrc)),
    r1{k} AS (SELECT * FROM s{k} WHERE pos NOT IN (SELECT s_pos FROM m1{k})),
    e{k} AS (SELECT s.pos AS s_pos, t.pos AS t_pos, {c} AS c, count(*) OVER (PARTITION BY s.pos) AS n FROM r1{k} s JOIN t{k} t ON s.nt = t.nt AND s.na = t.na),
    e2{k} AS (SELECT s_pos, t_pos, CASE WHEN n > 1 AND c > 0.95e0 THEN c ELSE 0.95e0 END AS confidence FROM e{k}),
    m2{k} AS (SELECT s_pos, t_pos, confidence, 'exact' AS match_type FROM e2{k} QUALIFY row_number() OVER (PARTITION BY s_pos ORDER BY confidence DESC, t_pos) = 1),
    r2{k} AS (SELECT * FROM r1{k} WHERE pos NOT IN (SELECT s_pos FROM m2{k})),
    b{k} AS (SELECT s.pos AS s_pos, t.pos AS t_pos, {c} AS confidence FROM r2{k} s JOIN t{k} t ON s.base = t.base AND s.na = t.na),
    m3{k} AS (SELECT s_pos, t_pos, confidence, 'fuzzy' AS match_type FROM (SELECT * FROM b{k} QUALIFY row_number() OVER (PARTITION BY s_pos ORDER BY confidence DESC, t_pos) = 1) WHERE confidence >= 0.82e0),
    r3{k} AS (SELECT * FROM r2{k} WHERE pos NOT IN (SELECT s_pos FROM m3{k})),
    w{k} AS (SELECT DISTINCT a.pos AS s_pos, b.pos AS t_pos FROM ({words('r3' + k)}) a JOIN ({words('t' + k)}) b USING (word)),
    f{k} AS (SELECT s_pos, t_pos FROM w{k} UNION ALL SELECT s.pos, t.pos FROM r3{k} s, (SELECT pos FROM t{k} ORDER BY pos LIMIT 50) t WHERE s.pos NOT IN (SELECT s_pos FROM w{k})),
    g{k} AS (SELECT s.pos AS s_pos, t.pos AS t_pos, {c} AS confidence FROM f{k} f JOIN r3{k} s ON f.s_pos = s.pos JOIN t{k} t ON f.t_pos = t.pos),
    m4{k} AS (SELECT s_pos, t_pos, confidence, 'fuzzy' AS match_type FROM (SELECT * FROM g{k} QUALIFY row_number() OVER (PARTITION BY s_pos ORDER BY confidence >= 0.98e0 DESC, CASE WHEN confidence >= 0.98e0 THEN t_pos END, confidence DESC, t_pos) = 1) WHERE confidence >= 0.80e0),
    matches{k} AS (SELECT * FROM m1{k} UNION ALL SELECT * FROM m2{k} UNION ALL SELECT * FROM m3{k} UNION ALL SELECT * FROM m4{k})"""


A, B = "SELECT * FROM lib WHERE library = 'A'", "SELECT * FROM lib WHERE library = 'B'"
COMPARED = LIB + ", " + cascade(A, B)


def stats(tag: str = "") -> str:
    """One row of comparison statistics of a cascade."""
    return f"""SELECT *, CASE WHEN source_music_tracks > 0 THEN total_matches / CAST(source_music_tracks AS DOUBLE) ELSE 0 END AS match_rate, source_music_tracks - total_matches AS missing_tracks FROM (
        SELECT count(*) AS total_matches, count(*) FILTER (match_type = 'exact') AS exact_matches, count(*) FILTER (match_type = 'fuzzy') AS fuzzy_matches, count(*) FILTER (match_type = 'isrc') AS isrc_matches,
        coalesce(avg(confidence), 0) AS avg_confidence, (SELECT count(*) FROM s{tag}) AS source_music_tracks, (SELECT count(*) FROM t{tag}) AS target_music_tracks FROM matches{tag})"""
