"""Quantiles, classes, ranks and scales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import kinematics, quantiles, summary
from trackloom.registry import query
from trackloom.registry.fixtures import Q_IDX, Q_TRACK, track, with_
from trackloom.registry.points import E_SQL, V_SQL, Q_ENERGY, _fast, rounded

T = with_(Q_TRACK)
PROBS = "[0.0, 0.2, 0.4, 0.6, 0.8, 1.0]"
COMPARED = "compared AS (SELECT *, track_id % 3 AS comparison_id FROM track)"

# whole-number values, so that both engines place every limit on the same side of every value
Q_WHOLE = "whole AS (SELECT *, CASE WHEN seq % 13 <> 0 THEN CAST(floor(speed_kmh) AS BIGINT) END AS v FROM track)"


def _whole(spark, sf) -> DataFrame:
    return track(spark, sf).withColumn("v", F.when(F.col("seq") % 13 != 0, F.floor("speed_kmh")))


def _at(array: str, n: int) -> list:
    return [F.round(F.get(array, F.lit(i)), 6).alias(f"b{i}") for i in range(n)]


@query(
    "quantile_boundaries",
    T + f"SELECT track_id, {', '.join(f'round(coalesce(b[{i + 1}], [0, 1][{i + 1}]), 6) AS b{i}' for i in range(6))} FROM (SELECT track_id, quantile_cont(speed_kmh, {PROBS}) AS b FROM track GROUP BY track_id)",
)
def quantile_boundaries(spark, sf):
    return quantiles.quantile_boundaries(track(spark, sf), "speed_kmh").select("track_id", *_at("boundaries", 6))


_BREAKS = f"""SELECT track_id, list_distinct_ordered AS d, lo, hi FROM (
  SELECT track_id, list_filter(q, lambda x, i: i = 1 OR x <> q[i - 1]) AS list_distinct_ordered, lo, hi
  FROM (SELECT track_id, quantile_cont(v, {PROBS}) AS q, min(v) AS lo, max(v) AS hi FROM whole GROUP BY track_id))"""


@query(
    "quantile_breaks",
    with_(Q_TRACK, Q_WHOLE) + f"""SELECT track_id, {', '.join(f'CASE WHEN lo < hi THEN round(d[least({i + 1}, len(d))], 3) ELSE 0 END AS b{i}' for i in range(6))} FROM ({_BREAKS})""",
)
def quantile_breaks(spark, sf):
    return quantiles.quantile_breaks(_whole(spark, sf), "v").select("track_id", *_at("breaks", 6))


_CLASS = f"""SELECT w.track_id, w.seq, w.v, CASE WHEN NOT coalesce(lo < hi, FALSE) THEN 0 WHEN v IS NULL THEN -1
  ELSE greatest(len(list_filter(d, lambda z: z < w.v)) - 1, 0) END AS c FROM whole w JOIN ({_BREAKS}) USING (track_id)"""


@query("quantile_class", with_(Q_TRACK, Q_WHOLE) + f"SELECT track_id, seq, CAST(c AS INTEGER) AS q_class FROM ({_CLASS})")
def quantile_class(spark, sf):
    return quantiles.quantile_class(_whole(spark, sf), "v").select("track_id", "seq", "q_class")


@query(
    "quantile_class_norm",
    with_(Q_TRACK, Q_WHOLE) + f"""SELECT track_id, seq, round(CASE WHEN top <= 0 THEN 0 WHEN v IS NOT NULL THEN c / top::DOUBLE END, 9) AS q_norm
FROM (SELECT *, max(c) OVER (PARTITION BY track_id) AS top FROM ({_CLASS}))""",
)
def quantile_class_norm(spark, sf):
    return rounded(quantiles.quantile_class_norm(_whole(spark, sf), "v"), ["track_id", "seq"], q_norm=9)


@query(
    "quantile_position",
    T + """SELECT track_id, seq, round(CASE WHEN v IS NULL THEN NULL WHEN v <= 5 THEN 0 WHEN v >= 60 THEN 1 ELSE (i + CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0.5 END) / 5 END, 9) AS t
FROM (SELECT *, b[i + 1] AS lo, b[i + 2] AS hi FROM (SELECT track_id, seq, speed_kmh AS v, [5, 10, 10, 20, 40, 60]::DOUBLE[] AS b,
  len(list_filter([10, 10, 20, 40], lambda x: x < speed_kmh)) AS i FROM track))""",
)
def quantile_position(spark, sf):
    breaks = F.array(*[F.lit(float(x)) for x in (5, 10, 10, 20, 40, 60)])
    return track(spark, sf).select("track_id", "seq", F.round(quantiles.quantile_position("speed_kmh", breaks), 9).alias("t"))


@query(
    "rank_position",
    with_(Q_TRACK, Q_WHOLE) + """SELECT track_id, seq, round(CASE WHEN v IS NULL THEN NULL WHEN n <= 1 THEN 0.5 ELSE (r - 1 + (ties - 1) / 2) / (n - 1) END, 9) AS rank_pos
FROM (SELECT track_id, seq, v, rank() OVER (PARTITION BY track_id, v IS NULL ORDER BY v) AS r, count(*) OVER (PARTITION BY track_id, v) AS ties,
  count(v) OVER (PARTITION BY track_id) AS n FROM whole)""",
)
def rank_position(spark, sf):
    return rounded(quantiles.rank_position(_whole(spark, sf), "v"), ["track_id", "seq"], rank_pos=9)


_SCALE = "CASE WHEN q > 0 THEN q WHEN m > 0 THEN m ELSE 1 END"


@query(
    "robust_scale",
    E_SQL + f"SELECT track_id, round({_SCALE}, 8) AS scale FROM (SELECT track_id, quantile_cont(abs(accel), 0.98) AS q, max(abs(accel)) AS m FROM k5 GROUP BY track_id)",
)
def robust_scale(spark, sf):
    return rounded(quantiles.robust_scale(kinematics.energy_profile(track(spark, sf)), "accel_mps2"), ["track_id"], scale=8)


@query(
    "pooled_scale",
    V_SQL + f"""SELECT track_id, round({_SCALE}, 5) AS scale FROM (SELECT track_id, quantile_cont(abs(x), 0.98) AS q, max(abs(x)) AS m
  FROM (SELECT track_id, unnest([ae * he + an * hn, he * an - hn * ae, CASE WHEN n >= 3 THEN az END]) AS x FROM v7) GROUP BY track_id)""",
)
def pooled_scale(spark, sf):
    df = kinematics.decompose_acceleration(_fast(spark, sf))
    return rounded(quantiles.pooled_scale(df, ["accel_long_mps2", "accel_lateral_mps2", "accel_vertical_mps2"]), ["track_id"], scale=5)


@query("signed_norm", T + "SELECT track_id, seq, round(greatest(-1, least(1, (alt - 450) / 60)), 9) AS signed FROM track WHERE alt IS NOT NULL UNION ALL SELECT track_id, seq, NULL FROM track WHERE alt IS NULL")
def signed_norm(spark, sf):
    signed = quantiles.signed_norm(F.col("alt") - 450, F.lit(60.0))
    return track(spark, sf).select("track_id", "seq", F.round(signed, 9).alias("signed"))


@query(
    "global_boundaries",
    with_(Q_TRACK, COMPARED) + f"SELECT comparison_id, {', '.join(f'round(b[{i + 1}], 6) AS b{i}' for i in range(6))} FROM (SELECT comparison_id, quantile_cont(speed_kmh, {PROBS}) AS b FROM compared GROUP BY comparison_id)",
)
def global_boundaries(spark, sf):
    df = track(spark, sf).withColumn("comparison_id", F.col("track_id") % 3)
    return quantiles.global_boundaries(df, "speed_kmh").select("comparison_id", *_at("boundaries", 6))


@query(
    "comparison_bounds",
    with_(Q_TRACK, COMPARED) + "SELECT comparison_id, round(min(lon), 7) AS lon_min, round(min(lat), 7) AS lat_min, round(max(lon), 7) AS lon_max, round(max(lat), 7) AS lat_max FROM compared GROUP BY comparison_id",
)
def comparison_bounds(spark, sf):
    df = track(spark, sf).withColumn("comparison_id", F.col("track_id") % 3)
    return rounded(summary.comparison_bounds(df), ["comparison_id"], lon_min=7, lat_min=7, lon_max=7, lat_max=7)


@query(
    "compare_tracks",
    with_(Q_TRACK, Q_WHOLE, "compared AS (SELECT *, track_id % 3 AS comparison_id FROM whole)") + f"""SELECT track_id, seq, CAST(CASE WHEN v IS NULL THEN -1
  ELSE greatest(len(list_filter(d, lambda z: z < c.v)) - 1, 0) END AS INTEGER) AS q_class
FROM compared c JOIN (SELECT comparison_id, list_filter(q, lambda x, i: i = 1 OR x <> q[i - 1]) AS d FROM (SELECT comparison_id, quantile_cont(v, {PROBS}) AS q FROM compared GROUP BY comparison_id)) USING (comparison_id)""",
)
def compare_tracks(spark, sf):
    from trackloom.plans.pipelines import compare_tracks as compare

    rows, _ = compare(_whole(spark, sf).withColumn("comparison_id", F.col("track_id") % 3), "v")
    return rows.select("track_id", "seq", "q_class")


Q_ABOVE = "above AS (SELECT *, alt - 330 - 20 * (track_id % 7) AS above_terrain FROM track)"


def _above(spark, sf) -> DataFrame:
    return track(spark, sf).withColumn("above_terrain", F.col("alt") - 330 - 20 * (F.col("track_id") % 7))


@query("track_mode", with_(Q_TRACK, Q_ABOVE) + "SELECT track_id, CASE WHEN median(above_terrain) > 100 THEN 'flight' ELSE 'ground' END AS track_mode FROM above GROUP BY track_id")
def track_mode(spark, sf):
    return summary.track_mode(_above(spark, sf))


@query(
    "agl_stats",
    with_(Q_TRACK, Q_ABOVE) + "SELECT track_id, count(above_terrain) AS n_valid, round(min(above_terrain), 6) AS min_agl, round(max(above_terrain), 6) AS max_agl, round(median(above_terrain), 6) AS median_agl FROM above GROUP BY track_id",
)
def agl_stats(spark, sf):
    return rounded(summary.agl_stats(_above(spark, sf)), ["track_id", "n_valid"], min_agl=6, max_agl=6, median_agl=6)
