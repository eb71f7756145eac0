"""Per-track aggregates. All are plain aggregations with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.operators.quantiles import exact_quantiles
from trackloom.plans.sequence import TRACK
from trackloom.plans.skew import Keys

FLIGHT_MEDIAN_AGL_M = 100.0


def track_bounds(df: DataFrame, padding_deg: float = 0.0, key: Keys = TRACK) -> DataFrame:
    pad = S.number(padding_deg)
    return df.groupBy(*key).agg(
        (F.min("lon") - pad).alias("lon_min"),
        (F.min("lat") - pad).alias("lat_min"),
        (F.max("lon") + pad).alias("lon_max"),
        (F.max("lat") + pad).alias("lat_max"),
    )


def comparison_bounds(df: DataFrame, padding_deg: float = 0.0, group: Keys = ("comparison_id",)) -> DataFrame:
    """Bounds over all tracks of a comparison."""
    return track_bounds(df, padding_deg, group)


def distance_stats(df: DataFrame, key: Keys = TRACK) -> DataFrame:
    return df.groupBy(*key).agg(
        F.coalesce(F.sum("distance_m"), S.number(0)).alias("total_distance_m"),
        F.max("speed_geodesic_kmh").alias("max_geodesic_kmh"),
    )


def _median(df: DataFrame, value: str, name: str, key: Keys) -> DataFrame:
    return exact_quantiles(df, value, [0.5], key).select(*key, F.col("q")[0].alias(name))


def track_mode(df: DataFrame, above: str = "above_terrain", key: Keys = TRACK) -> DataFrame:
    """``flight`` if the median height above terrain exceeds 100 m, else ``ground``."""
    medians = df.select(*key).distinct().join(_median(df, above, "median_agl", key), list(key), "left")
    mode = F.when(F.col("median_agl") > FLIGHT_MEDIAN_AGL_M, "flight").otherwise("ground")
    return medians.select(*key, mode.alias("track_mode"))


def agl_stats(df: DataFrame, above: str = "above_terrain", key: Keys = TRACK) -> DataFrame:
    """Known count, minimum, median and maximum height above terrain."""
    simple = df.groupBy(*key).agg(
        F.count(above).alias("n_valid"), F.min(above).alias("min_agl"), F.max(above).alias("max_agl")
    )
    return simple.join(_median(df, above, "median_agl", key), list(key), "left")


def track_summary(df: DataFrame, key: Keys = TRACK) -> DataFrame:
    """Points, distance, duration, start, end, bounds, and which optional values exist."""
    duration = S.seconds_between(F.min("ts"), F.max("ts"))
    aggs: list[Column] = [
        F.count(F.lit(1)).alias("n_points"),
        F.coalesce(F.sum("distance_m"), S.number(0)).alias("total_distance_m"),
        duration.alias("duration_s"),
        F.min("ts").alias("ts_start"),
        F.max("ts").alias("ts_end"),
        F.min("lon").alias("lon_min"),
        F.min("lat").alias("lat_min"),
        F.max("lon").alias("lon_max"),
        F.max("lat").alias("lat_max"),
    ]
    if "terrain_elev" in df.columns:
        aggs.append((F.count("terrain_elev") > 0).alias("has_terrain"))
    return df.groupBy(*key).agg(*aggs)


def min_altitude(df: DataFrame, key: Keys = TRACK) -> DataFrame:
    """Lowest altitude of the track, 0 if unknown."""
    return df.groupBy(*key).agg(F.coalesce(F.min("alt"), S.number(0)).alias("alt_base"))


def talkers(gsv: DataFrame, key: Keys = TRACK) -> DataFrame:
    """Sorted constellations; the set of two-letter codes is small by nature."""
    return gsv.groupBy(*key).agg(F.array_sort(F.collect_set("talker_id")).alias("talkers"))


def reference_point(df: DataFrame, key: Keys = TRACK) -> DataFrame:
    return df.groupBy(*key).agg(F.avg("lat").alias("ref_lat"), F.avg("lon").alias("ref_lon"))


def extents(df: DataFrame, z_exaggeration: float = 1.0, key: Keys = TRACK) -> DataFrame:
    """Spans in metres around the mean point, and the aspect ratio with floors of one metre."""
    ref = reference_point(df, key)
    spans = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("lon").alias("_w"), F.max("lon").alias("_e"),
        F.min("lat").alias("_s"), F.max("lat").alias("_nn"),
        (F.max("alt") - F.min("alt")).alias("_z"),
    ).join(ref, list(key))
    k = S.number(S.METRES_PER_DEGREE)
    one = S.number(1)
    many = F.col("_n") > 1
    x = F.when(many, (F.col("_e") - F.col("_w")) * (k * F.cos(F.radians("ref_lat")))).otherwise(one)
    y = F.when(many, (F.col("_nn") - F.col("_s")) * k).otherwise(one)
    z = F.when(many, F.col("_z")).otherwise(one)
    out = spans.select(*key, "ref_lat", "ref_lon", x.alias("x_range_m"), y.alias("y_range_m"), z.alias("z_range_m"))
    wide = F.greatest(F.col("x_range_m"), F.col("y_range_m"), one)
    return out.withColumns(
        {
            "aspect_x": F.col("x_range_m") / wide,
            "aspect_y": F.col("y_range_m") / wide,
            "aspect_z": F.greatest(F.col("z_range_m"), one) / wide * S.number(z_exaggeration),
        }
    )


def neighbourhood_speed(df: DataFrame, ranges: DataFrame, n: int = 10, key: Keys = TRACK) -> DataFrame:
    """Mean speed of up to ``n`` points on either side of index ranges.

    ``ranges`` has ``(track_id, cut_id, start, end)``. Without speeds there, the track's median; without any,
    50 km/h.
    """
    key = list(key)
    # the 2 n positions around a range; a position of the track is one row, so no key of the join is hot
    around = F.concat(F.sequence(F.col("start") - n, F.col("start") - 1), F.sequence(F.col("end") + 1, F.col("end") + n))
    wanted = ranges.select(*key, "cut_id", F.explode(around.cast("array<bigint>")).alias("idx"))
    rows = df.select(*key, "idx", "speed_kmh").join(wanted, [*key, "idx"])
    near = rows.groupBy(*key, "cut_id").agg(F.avg("speed_kmh").alias("_near"))
    median = _median(df, "speed_kmh", "_median", key)
    return (
        ranges.join(near, [*key, "cut_id"], "left")
        .join(median, key, "left")
        .withColumn("avg_speed_kmh", F.coalesce("_near", "_median", S.number(50)))
        .drop("_near", "_median")
    )
