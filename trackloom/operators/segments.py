"""Segments between consecutive points: pairs, subdivision of long ones, wall heights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.operators.summary import min_altitude
from trackloom.plans.sequence import ORDER, TRACK, with_neighbours
from trackloom.plans.skew import CHUNK, Keys, attach_track

# Fixed values.
LONG_SEGMENT_DEG = 0.0009
MAX_PARTS = 200


def null_mean(a: Column, b: Column) -> Column:
    """Mean of the known ones of two values."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise((a + b) / 2)


def segment_pairs(
    df: DataFrame, position: str | None = None, signed: str | None = None, key: Keys = TRACK, order: Keys = ORDER
) -> DataFrame:
    """One row per pair of consecutive points, with columns ``*_a`` and ``*_b`` and the means of the shown values."""
    fields = [c for c in ("idx", "lon", "lat", "alt", "terrain_elev") if c in df.columns]
    values = [c for c in (position, signed) if c]
    paired, row = with_neighbours(df, [*fields, *values], 1, key, order)
    here, after = F.col(row[0]), F.col(row[1])
    out = [F.col(f"{row[0]}.{c}").alias(f"{c}_a") for c in fields] + [after[c].alias(f"{c}_b") for c in fields]
    if position:
        out.append(null_mean(here[position], after[position]).alias("t"))
    if signed:
        out.append(null_mean(here[signed], after[signed]).alias("signed"))
    chunk = [CHUNK] if CHUNK in df.columns else []
    return paired.where(after.isNotNull()).select(*key, *chunk, *out)


def part_count(dlon: Column, dlat: Column) -> Column:
    span = F.sqrt(dlon * dlon + dlat * dlat)
    n = F.least(F.lit(MAX_PARTS), F.greatest(F.lit(2), F.ceil(span / S.number(LONG_SEGMENT_DEG)).cast("int")))
    return F.when(span > LONG_SEGMENT_DEG, n).otherwise(F.lit(1))


def densify_segments(pairs: DataFrame, bases: DataFrame) -> DataFrame:
    """Split long segments into equal parts on the straight line; at most 200 rows per segment.

    ``bases`` has ``(track_id, alt_base)``, which stands in for unknown altitudes.
    """
    df = attach_track(pairs, bases)
    df = df.withColumns(
        {
            "alt_a": F.coalesce("alt_a", "alt_base"),
            "alt_b": F.coalesce("alt_b", "alt_base"),
            "n_parts": part_count(F.col("lon_b") - F.col("lon_a"), F.col("lat_b") - F.col("lat_a")),
        }
    ).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    both = F.lit(False)
    terrain = "terrain_elev_a" in pairs.columns
    if terrain:
        both = F.col("terrain_elev_a").isNotNull() & F.col("terrain_elev_b").isNotNull()

    def on_line(c: str, share: Column) -> Column:
        return F.col(f"{c}_a") + (F.col(f"{c}_b") - F.col(f"{c}_a")) * share

    lo, hi = F.col("part") / F.col("n_parts"), (F.col("part") + 1) / F.col("n_parts")
    cut = {f"{c}_{e}": on_line(c, s) for c in ("lon", "lat", "alt") for e, s in (("a", lo), ("b", hi))}
    if terrain:
        for e, s in (("a", lo), ("b", hi)):
            cut[f"terrain_elev_{e}"] = F.when(both, on_line("terrain_elev", s)).otherwise(F.col(f"terrain_elev_{e}"))
    whole = F.col("n_parts") == 1
    return df.withColumns({c: F.when(whole, F.col(c)).otherwise(v) for c, v in cut.items()})


def segment_heights(parts: DataFrame, z_offset: float = 0.0, z_scale: float = 1.0) -> DataFrame:
    """Mean heights of each part and the wall between track and terrain: its foot and its height."""
    base = F.col("alt_base")

    def drawn(h: Column, offset: float) -> Column:
        return base + ((h + S.number(offset)) - base) * S.number(z_scale)

    both = F.col("terrain_elev_a").isNotNull() & F.col("terrain_elev_b").isNotNull()
    ground = (F.col("terrain_elev_a") + F.col("terrain_elev_b")) / 2
    msl = (F.col("alt_a") + F.col("alt_b")) / 2
    top = (drawn(F.col("alt_a"), z_offset) + drawn(F.col("alt_b"), z_offset)) / 2
    bottom = F.when(both, drawn(ground, 0.0)).otherwise(S.number(0))
    return parts.withColumns(
        {
            "alt_msl": msl,
            "alt_agl": F.when(both, msl - ground),
            "wall_base": F.least(top, bottom),
            "wall_height": F.abs(top - bottom),
        }
    )


def wall_segments(df: DataFrame, position: str | None = None, z_offset: float = 0.0, z_scale: float = 1.0) -> DataFrame:
    """Pairs, subdivision and heights in one step."""
    pairs = segment_pairs(df, position)
    return segment_heights(densify_segments(pairs, min_altitude(df)), z_offset, z_scale)
