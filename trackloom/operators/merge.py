"""Put tracks one after another.

Input rows carry ``merge_id`` and ``part_no`` (the wanted order) besides ``idx``, ``ts``, ``lat``, ``lon`` and
``speed_kmh``. Everything that decides the shifts lives in one row per part; the rows are touched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.operators.edit import MIN_SPEED_MPS, NEIGHBOURS
from trackloom.operators.quantiles import exact_quantiles
from trackloom.plans.skew import CHUNK, attach_track

JOIN_MODES = ("gap", "bridge")
PART = ("merge_id", "part_no")


def _seam_speeds(rows: DataFrame, parts: DataFrame, n: int) -> DataFrame:
    """Mean speed of the ``n`` rows on either side of each seam; else the median so far; else 50 km/h."""
    seams = parts.where(F.col("offset") > 0).select("merge_id", F.col("part_no").alias("seam_part"), F.col("offset").alias("seam"))
    per_merge = seams.groupBy("merge_id").agg(F.collect_list(F.struct("seam_part", "seam")).alias("_seams"))
    per_part = parts.select(*PART, "offset").join(per_merge, "merge_id")
    placed = attach_track(rows.where(F.col("speed_kmh").isNotNull()), per_part, PART, "inner").withColumn(
        "_g", F.col("offset") + F.col("idx")
    )
    g = F.col("_g")
    close = F.filter("_seams", lambda s: g.between(s["seam"] - n, s["seam"] + n - 1))
    near = (
        placed.select("merge_id", "speed_kmh", F.explode(close).alias("s"))
        .groupBy("merge_id", F.col("s.seam_part").alias("part_no"))
        .agg(F.avg("speed_kmh").alias("_near"))
    )
    # only seams without any speed nearby look at the whole of what lies before and behind them
    lacking = (
        seams.select("merge_id", F.col("seam_part").alias("part_no"))
        .join(near, list(PART), "left_anti")
        .groupBy("merge_id")
        .agg(F.collect_list("part_no").alias("_lacking"))
    )
    row_part = F.col("part_no")
    wide = (
        attach_track(rows.where(F.col("speed_kmh").isNotNull()), parts.select(*PART).join(lacking, "merge_id"), PART, "inner")
        .select("merge_id", "speed_kmh", F.explode(F.filter("_lacking", lambda k: k >= row_part)).alias("part_no"))
    )
    median = exact_quantiles(wide, "speed_kmh", [0.5], PART, large=CHUNK in rows.columns).select(*PART, F.col("q")[0].alias("_median"))
    return (
        seams.select("merge_id", F.col("seam_part").alias("part_no"))
        .join(near, list(PART), "left")
        .join(median, list(PART), "left")
        .select(*PART, F.coalesce("_near", "_median", S.number(50)).alias("avg_speed_kmh"))
    )


def merge_plan(rows: DataFrame, mode: str = "gap", n: int = NEIGHBOURS) -> DataFrame:
    """One row per part: its place, effective mode and the seconds it moves back.

    ``gap`` keeps the times unless a part starts before the end of what precedes it; then, and always with
    ``bridge``, it starts when the way across the seam is done at the speed around the seam.
    """
    if mode not in JOIN_MODES:
        raise ValueError(f"unknown merge mode {mode!r}, expected one of {JOIN_MODES}")
    end_point = F.struct(S.micros("ts").alias("us"), "lat", "lon")
    parts = rows.groupBy(*PART).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min_by(end_point, "idx").alias("first"),
        F.max_by(end_point, "idx").alias("last"),
    )
    w = Window.partitionBy("merge_id").orderBy("part_no")
    before = F.lag("last").over(w)
    parts = parts.withColumns(
        {
            "offset": F.coalesce(F.sum("n_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "segment_no": F.row_number().over(w) - 1,
            "seam_m": S.geodesic_m(before["lat"], before["lon"], F.col("first.lat"), F.col("first.lon")),
            "pause_s": (F.col("first.us") - before["us"]) / S.number(1e6),
        }
    )
    pace = F.greatest(S.kmh_to_mps("avg_speed_kmh"), S.number(MIN_SPEED_MPS))
    parts = parts.join(_seam_speeds(rows, parts, n), list(PART), "left").withColumn("bridge_s", F.col("seam_m") / pace)

    step = F.struct("part_no", "pause_s", "bridge_s")
    start = F.struct(
        S.number(0).alias("shift"),
        F.expr("cast(array() as array<struct<part_no:bigint,shift_s:double,effective_mode:string>>)").alias("out"),
    )

    def follow(state: Column, p: Column) -> Column:
        # the pause left after the part before has moved
        gap = p["pause_s"] + state["shift"]
        bridged = F.coalesce((gap <= 0) | F.lit(mode == "bridge"), F.lit(False)) & p["pause_s"].isNotNull()
        shift = F.when(bridged, gap - p["bridge_s"]).otherwise(S.number(0))
        shown = F.when(bridged, "bridge").otherwise(mode)
        entry = F.struct(p["part_no"].cast("bigint").alias("part_no"), shift.alias("shift_s"), shown.alias("effective_mode"))
        return F.struct(shift.alias("shift"), F.concat(state["out"], F.array(entry)).alias("out"))

    # the parts of one merge are named by hand, so this list is short
    moves = (
        parts.groupBy("merge_id")
        .agg(F.array_sort(F.collect_list(step)).alias("steps"))
        .select("merge_id", F.explode(F.aggregate("steps", start, follow, lambda s: s["out"])).alias("m"))
        .select("merge_id", "m.*")
    )
    return parts.join(moves, list(PART)).select(
        *PART, "segment_no", "n_rows", "offset", "seam_m", "avg_speed_kmh", "effective_mode", "shift_s",
        F.round("shift_s", 1).alias("shift_shown_s"),
    )


def merge_tracks(rows: DataFrame, mode: str = "gap", n: int = NEIGHBOURS) -> DataFrame:
    """The parts as one track: ``merged_idx``, ``segment_no`` and shifted times."""
    plan = merge_plan(rows, mode, n).select(*PART, "segment_no", "offset", "effective_mode", "shift_s")
    dtype = rows.schema["ts"].dataType
    moved = F.when(F.col("shift_s") != 0, S.shift_back("ts", F.col("shift_s"), dtype)).otherwise(F.col("ts"))
    return (
        attach_track(rows, plan, PART, "inner")
        .withColumns({"ts": moved, "merged_idx": F.col("offset") + F.col("idx")})
        .drop("offset")
    )
