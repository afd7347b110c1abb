"""The supplied tables in the shapes that the operators read: ``part`` as track libraries, and the like.

The projections are SQL text that Spark and DuckDB both run, so that a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.shared import spread
from trackloom.schema import derive

TRACKS = {
    "pos": "p_partkey",
    "library": "CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END",
    "library3": "CASE p_partkey % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE 'Z' END",
    "title": """p_name || CASE p_partkey % 7 WHEN 1 THEN ' (Remastered)' WHEN 2 THEN ' (Live Version)' WHEN 3 THEN ' (feat. Z)'
        WHEN 4 THEN ' [Official Video]' WHEN 5 THEN ' - Radio  Edit' ELSE '' END
        || CASE WHEN p_partkey % 29 = 5 THEN ' Podcast' WHEN p_partkey % 31 = 7 THEN ' Episode 12' ELSE '' END""",
    "artist": """p_brand || CASE p_partkey % 5 WHEN 1 THEN ' & Guest ' || CAST(p_partkey % 3 AS STRING)
        WHEN 2 THEN ' feat. Other' ELSE '' END""",
    "album": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END",
    "duration": "CAST(CASE WHEN p_partkey % 23 = 2 THEN NULL ELSE 20 + 14 * p_size END AS INT)",
    "isrc": "CASE WHEN p_partkey % 11 IN (3, 4) THEN 'US' || CAST(CAST(floor(p_partkey / 22) AS BIGINT) AS STRING) END",
    "year": "CAST(1890 + p_partkey % 150 AS INT)",
    "track_number": "CAST(p_partkey % 20 AS INT)",
    "url": "CASE WHEN p_partkey % 4 = 0 THEN 'https://music.youtube.com/watch?v=v' || CAST(p_partkey AS STRING) || '&list=PL' || CAST(p_partkey % 10 AS STRING) END",
    "explicit": "p_partkey % 6 = 1",
    "video_type": "CASE WHEN p_partkey % 8 = 3 THEN 'MUSIC_VIDEO_TYPE_ATV' ELSE 'MUSIC_VIDEO_TYPE_OMV' END",
}
TRACKS_SQL = "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in TRACKS.items()) + " FROM part"

SECONDS_TEXT = """CASE l_orderkey % 8 WHEN 0 THEN CAST(l_partkey AS STRING) WHEN 1 THEN CAST(l_partkey % 60 AS STRING) || ':' || CAST(l_suppkey % 60 AS STRING)
    WHEN 2 THEN '1:' || CAST(l_partkey % 60 AS STRING) || ':07' WHEN 3 THEN CAST(l_partkey % 500 AS STRING) || '.5' WHEN 4 THEN 'abc'
    WHEN 5 THEN '' WHEN 6 THEN CAST(l_partkey * 1000 AS STRING) ELSE NULL END"""
ISO_TEXT = """CASE l_orderkey % 5 WHEN 0 THEN 'PT' || CAST(l_partkey % 59 AS STRING) || 'M' || CAST(l_suppkey % 59 AS STRING) || 'S' WHEN 1 THEN 'PT1H' || CAST(l_suppkey % 59 AS STRING) || 'S'
    WHEN 2 THEN 'PT0S' WHEN 3 THEN CAST(l_partkey % 900 AS STRING) ELSE '3:0' || CAST(l_linenumber AS STRING) END"""
YEAR_TEXT = """CASE o_orderkey % 5 WHEN 0 THEN CAST(year(o_orderdate) AS STRING) || '-05-01' WHEN 1 THEN 'Released ' || CAST(1900 + o_custkey % 120 AS STRING)
    WHEN 2 THEN CAST(o_custkey % 3000 AS STRING) WHEN 3 THEN 'unknown' ELSE '77.5' END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str, library: str = "library") -> DataFrame:
    """``part`` as derived tracks; ``library``: two (A, B) by default, or three with ``library3``."""
    # one small file is one task, and normalising costs far more than reading
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").selectExpr(*[f"{expr} AS {name}" for name, expr in TRACKS.items()])
    return derive(rows.withColumn("library", F.col(library)).drop("library3"))


def two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = tracks(spark, sf_dir)
    return rows.where("library = 'A'"), rows.where("library = 'B'")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording for each part, with releases, identifiers and tags."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id",
        "p_name AS title",
        "CAST(180000 + p_size * 1000 AS BIGINT) AS length",
        "array(named_struct('name', p_brand)) AS artists",
        "array(named_struct('title', p_type)) AS releases",
        "CASE WHEN p_partkey % 2 = 0 THEN array('RC' || CAST(p_partkey AS STRING)) ELSE array('US' || CAST(p_partkey AS STRING)) END AS isrcs",
        "array(named_struct('name', p_type, 'count', p_size), named_struct('name', 'pop', 'count', 10), named_struct('name', 'rock', 'count', 10), named_struct('name', p_brand, 'count', p_size % 20)) AS tags",
    )
