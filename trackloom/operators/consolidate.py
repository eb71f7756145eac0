"""One row per time from the sentence table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.plans.sequence import ORDER, TRACK, carry, row_index
from trackloom.plans.skew import Keys, split_hot_tracks


def merge_sentences(schema_a: DataFrame) -> DataFrame:
    """First GGA of each time with the first RMC, VTG and GSA of that time.

    One aggregation with one shuffle instead of four joins.
    """

    def first_of(sentence: str, fields: list[str]) -> Column:
        is_type = F.col("sentence_type") == sentence
        return F.min_by(F.struct(*fields), F.when(is_type, F.col("seq"))).alias(sentence.lower())

    ticks = (
        schema_a.where(F.col("sentence_type").isin("GGA", "RMC", "VTG", "GSA"))
        .groupBy("track_id", "ts")
        .agg(
            first_of("GGA", ["seq", "lat", "lon", "gga_altitude", "gga_gps_quality", "gga_num_sats", "gga_hdop"]),
            first_of("RMC", ["rmc_speed_knots"]),
            first_of("VTG", ["vtg_speed_knots", "vtg_speed_kmh"]),
            first_of("GSA", ["gsa_vdop", "gsa_fix_type"]),
        )
        .where(F.col("gga").isNotNull())
    )
    knots, kmh = S.unify_speed("rmc.rmc_speed_knots", "vtg.vtg_speed_knots", "vtg.vtg_speed_kmh")
    return ticks.select(
        "track_id",
        F.col("gga.seq").alias("seq"),
        "ts",
        F.col("gga.lat").alias("lat"),
        F.col("gga.lon").alias("lon"),
        F.col("gga.gga_altitude").alias("alt"),
        kmh.alias("speed_kmh"),
        knots.alias("speed_knots"),
        F.col("gga.gga_gps_quality").alias("gps_quality"),
        F.col("gga.gga_num_sats").alias("num_sats"),
        F.col("gga.gga_hdop").alias("hdop"),
        F.col("gsa.gsa_vdop").alias("vdop"),
        F.col("gsa.gsa_fix_type").alias("fix_type"),
    )


def interpolate_linear(
    df: DataFrame, columns: list[str], by: str = "position", key: Keys = TRACK, order: Keys = ORDER
) -> DataFrame:
    """Fill gaps on the straight line between the values before and after; ends take the nearest value.

    ``by="position"`` counts rows, ``by="time"`` uses the timestamps.
    """
    df = row_index(df, key, order, "_i")
    place = F.col("_i") if by == "position" else S.micros("ts")
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), place.alias("i"))) for c in columns}
    df = carry(df, {f"_prev_{c}": known[c] for c in columns}, key, order)
    df = carry(df, {f"_next_{c}": known[c] for c in columns}, key, order, backward=True)

    def filled(c: str) -> Column:
        p, n = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        step = (place - p["i"]) / F.nullif(n["i"] - p["i"], F.lit(0))
        line = p["v"] + (n["v"] - p["v"]) * F.coalesce(step, S.number(0))
        return (
            F.when(F.col(c).isNotNull(), F.col(c)).when(p.isNull(), n["v"]).when(n.isNull(), p["v"]).otherwise(line)
        )

    helpers = [f"_{side}_{c}" for side in ("prev", "next") for c in columns]
    return df.withColumns({c: filled(c) for c in columns}).drop("_i", *helpers)


def consolidate(schema_a: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """Sentence table to track table: one row per GGA time, gaps in altitude and speed filled.

    ``bound`` is a written table that holds all these sentences, by which long tracks are told.
    """
    merged = split_hot_tracks(merge_sentences(schema_a), bound=bound)
    return interpolate_linear(merged, ["alt", "speed_kmh", "speed_knots"])
