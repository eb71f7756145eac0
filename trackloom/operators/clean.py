"""Filters on the sentence table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.plans.skew import attach_track, skew_join

# Fix qualities and fix types that are not used.
EXCLUDED_GGA_QUALITIES = [0, 5]
EXCLUDED_GSA_FIX_TYPES = [1]


def _is(sentence: str):
    return F.col("sentence_type") == sentence


def drop_before_first_fix(df: DataFrame) -> DataFrame:
    """Keep rows from the first valid RMC on, and rows without a time; no valid RMC keeps everything."""
    first = df.groupBy("track_id").agg(F.min(F.when(_is("RMC") & (F.col("rmc_status") == "A"), F.col("ts"))).alias("_first"))
    kept = attach_track(df, first).where(
        F.col("_first").isNull() | F.col("ts").isNull() | (F.col("ts") >= F.col("_first"))
    )
    return kept.drop("_first")


def _bad_gga():
    return _is("GGA") & F.coalesce(F.col("gga_gps_quality").isin(EXCLUDED_GGA_QUALITIES), F.lit(False))


def drop_bad_gga(df: DataFrame) -> DataFrame:
    return df.where(~_bad_gga())


def anchor_join(df: DataFrame) -> DataFrame:
    """RMC and VTG rows whose time is the time of a usable GGA of the track."""
    anchors = df.where(_is("GGA") & ~_bad_gga() & F.col("ts").isNotNull()).select("track_id", "ts").distinct()
    return skew_join(df.where(F.col("sentence_type").isin("RMC", "VTG")), anchors, ["track_id", "ts"], "left_semi", within_track=True)


def drop_unanchored(df: DataFrame) -> DataFrame:
    """Drop RMC and VTG rows without a usable GGA of the same time."""
    anchors = (
        df.where(_is("GGA") & ~_bad_gga() & F.col("ts").isNotNull())
        .select("track_id", "ts")
        .distinct()
        .withColumn("_anchored", F.lit(True))
    )
    joined = skew_join(df, anchors, ["track_id", "ts"], within_track=True)
    return joined.where(~F.col("sentence_type").isin("RMC", "VTG") | F.col("_anchored").isNotNull()).drop("_anchored")


def drop_no_fix_gsa(df: DataFrame) -> DataFrame:
    bad = _is("GSA") & F.coalesce(F.col("gsa_fix_type").isin(EXCLUDED_GSA_FIX_TYPES), F.lit(False))
    return df.where(~bad)


def filter_invalid(df: DataFrame) -> DataFrame:
    """All four filters in order."""
    return drop_no_fix_gsa(drop_unanchored(drop_bad_gga(drop_before_first_fix(df))))


def valid_points(df: DataFrame) -> DataFrame:
    """Rows that have latitude, longitude and time."""
    return df.dropna(subset=["lat", "lon", "ts"])


def _keep(df: DataFrame, keys: list[str], order: str, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def dedup_first(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The first row of each key."""
    return _keep(df, keys, order, F.min_by)


def dedup_last(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last row of each key."""
    return _keep(df, keys, order, F.max_by)


def duplicate_times(df: DataFrame) -> DataFrame:
    """Rows whose time repeats an earlier one, as count and percent per track."""
    per_time = df.groupBy("track_id", "ts").agg(F.count(F.lit(1)).alias("_n"))
    return per_time.groupBy("track_id").agg(
        F.sum("_n").alias("n_points"),
        F.sum(F.col("_n") - 1).alias("n_duplicates"),
        (F.sum(F.col("_n") - 1) * 100.0 / F.sum("_n")).alias("percent"),
    )


def same_timestamp_group(df: DataFrame) -> DataFrame:
    """Mark each row with the number of rows of its track at the same time."""
    per_time = df.groupBy("track_id", "ts").agg(F.count(F.lit(1)).alias("n_same_ts"))
    return skew_join(df, per_time, ["track_id", "ts"], within_track=True)
