"""The canonical track row, derived columns, and libraries as one DataFrame with a library column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions import normalize as N
from trackloom.operators.content import is_music

TRACK = T.StructType(
    [
        T.StructField("library", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("artist", T.StringType()),
        T.StructField("album", T.StringType()),
        T.StructField("duration", T.IntegerType()),
        T.StructField("isrc", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("track_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("genre", T.StringType()),
        T.StructField("track_number", T.IntegerType()),
    ]
)


def conform(df: DataFrame, **given) -> DataFrame:
    """All columns of TRACK in order; ``given`` literals first, then those of ``df``, then null."""
    pick = lambda f: F.lit(given[f.name]) if f.name in given else F.col(f.name) if f.name in df.columns else F.lit(None)
    return df.select(*[pick(f).cast(f.dataType).alias(f.name) for f in TRACK])


def derive(tracks: DataFrame, bounded: bool = False) -> DataFrame:
    """With nt, na (normalised title and artist), tokens, base (title without version words) and is_music."""
    out = tracks.withColumns({"nt": N.normalize_title(F.col("title")), "na": N.normalize_artist(F.col("artist"), bounded), "tokens": N.artist_tokens(F.col("artist"), bounded)})
    return out.withColumns({"base": N.strip_versions(F.col("nt")), "is_music": is_music(F.col("title"), F.col("artist"))})


def libraries(named: dict[str, DataFrame]) -> DataFrame:
    """The union of libraries; each keeps its name in ``library``, which also becomes the platform of its tracks if none."""
    parts = [conform(df, library=name) for name, df in named.items()]
    return reduce(DataFrame.unionByName, parts)
