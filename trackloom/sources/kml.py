"""KML tracks (``gx:Track``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.sources.files import in_file_order, options

TRACK_SCHEMA = "_id string, when array<string>, `gx:coord` array<string>"


def kml_coord(text) -> Column:
    """``lon lat [alt]`` to a struct; NULL unless longitude and latitude, and a given altitude, are numbers."""
    parts = F.split(F.trim(S.col(text)), r"\s+")
    lon, lat = (F.get(parts, F.lit(i)).try_cast("double") for i in (0, 1))
    alt_text = F.get(parts, F.lit(2))
    alt = alt_text.try_cast("double")
    sound = lon.isNotNull() & lat.isNotNull() & (alt_text.isNull() | alt.isNotNull())
    return F.when(sound, F.struct(lon.alias("lon"), lat.alias("lat"), alt.alias("alt")))


def points_from_tracks(tracks: DataFrame) -> DataFrame:
    """Track elements with ``when`` and ``coord`` lists to rows; lists of unequal length drop the element."""
    keep = [c for c in ("track_id", "source_file") if c in tracks.columns]
    pairs = (
        tracks.where(F.size("when") == F.size("coord"))
        .select(*keep, "line_no", F.posexplode(F.arrays_zip("when", "coord")).alias("_at", "_p"))
        .withColumn("_c", kml_coord("_p.coord"))
    )
    none = F.lit(None).cast("double")
    return pairs.select(
        *keep,
        # place of the element, then place in its lists
        F.struct("line_no", "_at").alias("_place"),
        S.iso_time("_p.when").alias("ts"),
        F.col("_c.lat").alias("lat"),
        F.col("_c.lon").alias("lon"),
        F.col("_c.alt").alias("alt"),
        none.alias("speed_kmh"),
        none.alias("speed_knots"),
        none.alias("hdop"),
    ).dropna(subset=["lat", "lon", "ts"]).withColumn("seq", F.col("_place.line_no") * (1 << 24) + F.col("_place._at")).drop("_place")


def read_kml(spark: SparkSession, path, glob: str | None = "*.kml", named: bool = False) -> DataFrame:
    """All points of all ``gx:Track`` elements below ``path``; files with only lines or points give no rows.

    A file is a track; where files are ``named``, the elements of one ``id`` are, and they are in one file.
    """
    scan = spark.read.format("xml").options(rowTag="gx:Track", **options(glob)).schema(TRACK_SCHEMA).load(path)
    scan = in_file_order(scan, F.col("_metadata.file_path"), "kml", F.col("_id") if named else None)
    return points_from_tracks(scan.withColumnRenamed("gx:coord", "coord"))
