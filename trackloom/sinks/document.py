"""Columnar JSON documents per track.

The point table in Parquet is the primary output. A document holds at most ``PART_POINTS`` points, so it is
always one bounded row; a longer track becomes several parts whose arrays follow one another. Nothing is left
out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.operators.kinematics import decompose_acceleration, energy_profile
from trackloom.operators.quantiles import (
    DEFAULT_CLASSES,
    breaks_of,
    class_of,
    even_probabilities,
    exact_quantiles_of,
    pooled_scale,
    scale_of,
)
from trackloom.operators.satellites import burst_index, burst_lookup
from trackloom.operators.summary import FLIGHT_MEDIAN_AGL_M, track_summary
from trackloom.plans.session import settle
from trackloom.plans.skew import attach_track

PART_POINTS = 100_000
#: Rows of a terrain level in one document.
BAND_ROWS = 256

# Exported name -> (column, decimals); None keeps the value as it is.
POINT_COLUMNS = {
    "lat": ("lat", 7),
    "lon": ("lon", 7),
    "alt": ("alt", 1),
    "terrain_elev": ("terrain_elev", 1),
    "above_terrain": ("above_terrain", 1),
    "speed_kmh": ("speed_kmh", 2),
    "distance_m": ("distance_m", 1),
    "accel_mps2": ("accel_mps2", 3),
    "energy_height_m": ("energy_height_m", 1),
    "energy_rate_mps": ("energy_rate_mps", 3),
    "accel_long_mps2": ("accel_long_mps2", 3),
    "accel_lateral_mps2": ("accel_lateral_mps2", 3),
    "accel_vertical_mps2": ("accel_vertical_mps2", 3),
    "accel_heading_e": ("heading_e", 4),
    "accel_heading_n": ("heading_n", 4),
    "timestamp_ms": ("timestamp_ms", None),
    "speed_q_idx": ("speed_q_idx", None),
    "alt_q_idx": ("alt_q_idx", None),
    "fix_quality": ("gps_quality", None),
    "num_sats": ("num_sats", None),
    "hdop": ("hdop", 1),
    "vdop": ("vdop", 1),
    "is_bridged": ("is_bridged", None),
}
BREAK_COLUMNS = {
    "speed_kmh": "speed_kmh",
    "altitude_m": "alt",
    "altitude_gnd_m": "above_terrain",
    "energy_height_m": "energy_height_m",
    "hdop": "hdop",
}
VECTORS = ["accel_long_mps2", "accel_lateral_mps2", "accel_vertical_mps2"]
_OPTIONAL = {
    "terrain_elev": "double",
    "speed_kmh": "double",
    "distance_m": "double",
    "alt": "double",
    "hdop": "double",
    "vdop": "double",
    "gps_quality": "int",
    "num_sats": "int",
    "is_bridged": "boolean",
}


def with_export_columns(points: DataFrame) -> DataFrame:
    """Track rows with every column that a document shows."""
    df = points.withColumns(
        {c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in points.columns}
    )
    df = df.withColumns(
        {
            "above_terrain": F.col("alt") - F.col("terrain_elev"),
            "timestamp_ms": S.epoch_ms("ts"),
            "is_bridged": F.coalesce("is_bridged", F.lit(False)),
        }
    )
    order = ("idx",)
    return decompose_acceleration(energy_profile(df, order=order), smooth_window=3, order=order)


def track_quantiles(df: DataFrame, n: int = DEFAULT_CLASSES) -> DataFrame:
    """Quantiles of every shown value and of the magnitudes behind the scales, one row per track."""
    shown = {f"q_{name}": F.col(c) for name, c in BREAK_COLUMNS.items()}
    q = exact_quantiles_of(df, shown, [*even_probabilities(n), 0.5])
    sizes = {"s_accel": F.abs("accel_mps2"), "s_energy": F.abs("energy_rate_mps")}
    scales = exact_quantiles_of(df, sizes, [0.98])
    return q.join(scales, "track_id", "full").join(pooled_scale(df, VECTORS, "s_gvec"), "track_id", "full")


def with_classes(df: DataFrame, quantiles: DataFrame, n: int = DEFAULT_CLASSES) -> DataFrame:
    """Add the speed and altitude classes."""

    def classed(name: str, value: str) -> Column:
        q = F.col(f"q_{name}")
        bins = F.array_distinct(F.slice(q["q"], 1, n + 1))
        return F.when(F.coalesce(q["lo"] < q["hi"], F.lit(False)), class_of(F.col(value), bins)).otherwise(F.lit(0))

    joined = attach_track(df, quantiles.select("track_id", "q_speed_kmh", "q_altitude_m"))
    return joined.withColumns(
        {"speed_q_idx": classed("speed_kmh", "speed_kmh"), "alt_q_idx": classed("altitude_m", "alt")}
    ).drop("q_speed_kmh", "q_altitude_m")


def track_metadata(df: DataFrame, quantiles: DataFrame, n: int = DEFAULT_CLASSES) -> DataFrame:
    """One row per track with the ``meta``, ``quantile_breaks`` and ``scales`` structs."""
    median = F.col("q_altitude_gnd_m.q")[n + 1]
    mode = F.when(median > FLIGHT_MEDIAN_AGL_M, "flight").otherwise("ground")
    told = {
        "suggested_z_offset_m": F.round(F.max("suggested_z_offset_m"), 2),
        "source_file": F.min("source_file"),
        "source_type": F.min("source_type"),
    }
    absent = {"suggested_z_offset_m": S.number(0), "source_file": F.lit(None).cast("string"), "source_type": F.lit(None).cast("string")}
    named = [c for c in told if c in df.columns]
    meta = track_summary(df).join(quantiles, "track_id", "left").withColumn("track_mode", mode)
    if named:
        meta = meta.join(df.groupBy("track_id").agg(*[told[c].alias(c) for c in named]), "track_id")
    meta = meta.withColumns({c: v for c, v in absent.items() if c not in named})
    bounds = F.struct(*[F.round(c, 6).alias(c) for c in ("lon_min", "lat_min", "lon_max", "lat_max")])
    breaks = [
        breaks_of(
            F.slice(F.col(f"q_{name}.q"), 1, n + 1), F.col(f"q_{name}.lo"), F.col(f"q_{name}.hi"), n
        ).alias(name)
        for name in BREAK_COLUMNS
    ]

    def scale(name: str) -> Column:
        return scale_of(F.col(f"{name}.q")[0], F.col(f"{name}.hi"))

    return meta.select(
        "track_id",
        F.struct(
            F.col("track_id").alias("name"),
            "n_points",
            F.round("total_distance_m", 1).alias("total_distance_m"),
            F.round("duration_s", 1).alias("duration_s"),
            iso_text("ts_start").alias("timestamp_start_utc"),
            iso_text("ts_end").alias("timestamp_end_utc"),
            bounds.alias("bounds"),
            "track_mode",
            "has_terrain",
            "suggested_z_offset_m",
            "source_file",
            "source_type",
        ).alias("meta"),
        F.struct(*breaks, F.lit(n).alias("n_quantiles")).alias("quantile_breaks"),
        F.struct(
            F.round(scale("s_accel"), 4).alias("accel_mps2"),
            F.round(scale("s_energy"), 4).alias("energy_rate_mps"),
            F.round(F.coalesce("s_gvec", S.number(1)), 4).alias("gvec_mps2"),
        ).alias("scales"),
    )


def iso_text(ts) -> Column:
    """ISO-8601 in UTC; a fraction only if there is one."""
    base = F.date_format(S.col(ts), "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(S.micros(ts), F.lit(1_000_000))
    fraction = F.when(micros == 0, F.lit("")).otherwise(F.format_string(".%06d", micros))
    return F.concat(base, fraction, F.lit("Z"))


def _part(idx: str) -> Column:
    return F.floor(F.col(idx) / F.lit(PART_POINTS)).cast("bigint")


def point_arrays(df: DataFrame) -> DataFrame:
    """``(track_id, part, points)`` where ``points`` is a struct of arrays in point order."""
    shown = [
        (S.round_or_null(c, d) if d is not None else F.col(c)).alias(name) for name, (c, d) in POINT_COLUMNS.items()
    ]
    # a part has at most PART_POINTS rows
    listed = df.select("track_id", _part("idx").alias("part"), F.struct("idx", *shown).alias("p")).groupBy(
        "track_id", "part"
    ).agg(F.sort_array(F.collect_list("p")).alias("_p"))
    arrays = [F.col("_p").getField(name).alias(name) for name in POINT_COLUMNS]
    return listed.select("track_id", "part", F.struct(*arrays).alias("points"))


def track_documents(
    points: DataFrame, derivations: DataFrame | None = None, source_type: str = "nmea", aligned: DataFrame | None = None
) -> DataFrame:
    """``(track_id, part, document)`` with one JSON text per part of a track.

    ``source_type`` is told where the points have no column of that name, ``has_satellites`` for tracks in ``aligned``.
    The derived columns are written once; quantiles, summary and arrays read what they need from there.
    """
    df = settle(with_export_columns(points), "export")
    quantiles = settle(track_quantiles(df), "quantiles")
    meta = track_metadata(df, quantiles)
    derived = F.lit(None).cast("string")
    if derivations is not None:
        packed = derivations.select(
            "track_id", F.struct(*[c for c in derivations.columns if c != "track_id"]).alias("_derivation")
        )
        meta = meta.join(packed, "track_id", "left")
        derived = F.col("_derivation")
    has_satellites = F.lit(False)
    if aligned is not None:
        seen = aligned.select("track_id").distinct().withColumn("_seen", F.lit(True))
        meta = meta.join(seen, "track_id", "left")
        has_satellites = F.coalesce("_seen", F.lit(False))
    meta = meta.withColumn(
        "meta",
        F.struct(
            F.col("meta").dropFields("source_type").alias("m"),
            F.coalesce("meta.source_type", F.lit(source_type)).alias("source_type"),
            has_satellites.alias("has_satellites"),
            derived.alias("derivation"),
        ),
    ).withColumn("meta", F.struct("meta.m.*", "meta.source_type", "meta.has_satellites", "meta.derivation"))
    parts = point_arrays(with_classes(df, quantiles))
    body = F.struct("meta", "quantile_breaks", "scales", "points")
    return parts.join(meta, "track_id").select(
        "track_id", "part", F.to_json(body, {"ignoreNullFields": "false"}).alias("document")
    )


def satellite_documents(points: DataFrame, aligned: DataFrame) -> DataFrame:
    """``(track_id, part, document)``: reports by constellation and the report number of each point.

    Part k holds reports and points number k * PART_POINTS and following.
    """
    numbered = burst_index(aligned)
    reports = aligned.groupBy("track_id", "talker_id", "burst_ts").agg(F.first("satellites").alias("sats"))
    reports = reports.join(numbered, ["track_id", "talker_id", "burst_ts"])
    compact = F.transform("sats", lambda s: F.array(s["prn"], s["elevation"], s["azimuth"], s["snr"]))
    by_talker = (
        reports.groupBy("track_id", _part("burst_idx").alias("part"), "talker_id")
        .agg(F.sort_array(F.collect_list(F.struct("burst_idx", S.epoch_ms("burst_ts").alias("ts_ms"), compact.alias("sats")))).alias("b"))
        .groupBy("track_id", "part")
        .agg(
            F.map_from_entries(
                F.sort_array(F.collect_list(F.struct("talker_id", F.transform("b", lambda x: F.struct(x["ts_ms"].alias("ts_ms"), x["sats"].alias("sats"))))))
            ).alias("bursts_by_talker")
        )
    )
    lookup = burst_lookup(points, aligned)
    by_track = (
        lookup.groupBy("track_id", _part("idx").alias("part"), "talker_id")
        .agg(F.sort_array(F.collect_list(F.struct("idx", "burst_idx"))).getField("burst_idx").alias("i"))
        .groupBy("track_id", "part")
        .agg(
            F.array_sort(F.collect_set("talker_id")).alias("talkers"),
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("talker_id", "i")))).alias("burst_idx_by_track"),
        )
    )
    return by_track.join(by_talker, ["track_id", "part"], "left").select(
        "track_id",
        "part",
        F.to_json(F.struct("talkers", "bursts_by_talker", "burst_idx_by_track")).alias("document"),
    )


def dem_documents(levels: DataFrame, bounds: DataFrame) -> DataFrame:
    """``(track_id, lod, part, document)``: elevations row by row from the south, one decimal, null for gaps.

    A document is a band of BAND_ROWS rows at most; ``first_row`` is its first one, counted from the south.
    """
    key = ["track_id", "lod"]
    line = F.transform(
        F.sequence(F.lit(0), F.col("height") - 1), lambda i: F.slice("values", (i * F.col("width") + 1).cast("int"), F.col("width"))
    )
    south = F.col("lat0") - (F.col("n_rows") - 1) * F.col("dlat")
    east = F.col("lon0") + (F.col("n_cols") - 1) * F.col("dlon")
    edges = {"lat_min": south, "lat_max": F.col("lat0"), "lon_min": F.col("lon0"), "lon_max": east}
    frame = ["n_rows", "n_cols", *edges]
    rows = levels.withColumns({n: F.round(c, 6) for n, c in edges.items()}).select(
        *key, *frame, "r0", "bcol", F.posexplode(line).alias("_i", "line")
    )
    rows = rows.withColumn("row", F.col("n_rows") - 1 - F.col("r0") - F.col("_i"))
    bands = rows.groupBy(*key, *frame, F.floor(F.col("row") / BAND_ROWS).cast("int").alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("row", "bcol", F.transform("line", lambda e: F.round(e, 1)).alias("line")))).alias("_l")
    )
    grid = F.struct(
        "n_rows", "n_cols", F.get("_l.row", F.lit(0)).alias("first_row"), *edges, F.flatten("_l.line").alias("elevations")
    )
    box = bounds.select("track_id", F.struct(*[c for c in bounds.columns if c != "track_id"]).alias("bounds"))
    return bands.select(*key, "part", grid.alias("grid")).join(box, "track_id").select(
        *key, "part", F.to_json(F.struct("lod", "part", "bounds", "grid"), {"ignoreNullFields": "false"}).alias("document")
    )


def overlay_documents(overlays: DataFrame) -> DataFrame:
    """One JSON text per overlay, corners rounded to 7 decimals."""
    corners = [
        F.array(F.round(f"corner_{c}.lon", 7), F.round(f"corner_{c}.lat", 7)).alias(f"corner_{c}")
        for c in ("tl", "tr", "bl", "br")
    ]
    entry = F.struct(
        "name",
        F.concat(F.lit("charts/"), F.col("name"), F.lit(".png")).alias("image"),
        *corners,
        F.round("elevation_m", 2).alias("elevation_m"),
        "subdivision",
    )
    return overlays.select("name", F.to_json(entry).alias("document"))


def write_documents(documents: DataFrame, path: str, by: str = "track_id") -> None:
    """One folder per track with one line of JSON per part."""
    documents.select(by, "document").write.mode("errorifexists").partitionBy(by).text(path)
