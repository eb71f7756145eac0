"""Cutting and merging tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.scalar import geodesic_sql
from trackloom.operators import edit, merge, summary
from trackloom.plans.sequence import row_index, running_sum
from trackloom.plans.skew import split_hot_tracks
from trackloom.registry import query
from trackloom.registry.fixtures import Q_CUTS, Q_IDX, Q_TRACK, cuts, track, with_
from trackloom.registry.points import rounded

Q_COUNTS = "counts AS (SELECT track_id, count(*) AS n_points FROM track GROUP BY track_id)"
Q_FORCED = """forced AS (SELECT track_id, cut_id, "start" AS s, "end" AS e, n_points, CASE WHEN "start" <= 0 OR "end" >= n_points - 1 THEN 'trim' ELSE mode END AS mode FROM cuts JOIN counts USING (track_id))"""
Q_CLAMPED = "clamped AS (SELECT *, greatest(0, s) AS lo, least(n_points - 1, e) AS hi FROM forced WHERE greatest(0, s) <= least(n_points - 1, e))"
Q_NEAR = """near AS (SELECT c.track_id, c.cut_id, coalesce(avg(p.speed_kmh), max(m.med), 50) AS avg_speed_kmh FROM clamped c
  LEFT JOIN pts p ON p.track_id = c.track_id AND (p.idx BETWEEN c.lo - 10 AND c.lo - 1 OR p.idx BETWEEN c.hi + 1 AND c.hi + 10)
  LEFT JOIN (SELECT track_id, median(speed_kmh) AS med FROM track GROUP BY track_id) m ON m.track_id = c.track_id GROUP BY c.track_id, c.cut_id)"""
Q_SHIFTS = f"""anchored AS (SELECT c.*, a.ts AS ts_1, b.ts AS ts_2, avg_speed_kmh, (epoch_us(b.ts) - epoch_us(a.ts)) / 1000000::DOUBLE AS pause_s,
  {geodesic_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS bridge_m FROM clamped c JOIN near USING (track_id, cut_id)
  JOIN pts a ON a.track_id = c.track_id AND a.idx = c.lo - 1 JOIN pts b ON b.track_id = c.track_id AND b.idx = c.hi + 1
  WHERE mode = 'bridge' AND lo > 0 AND hi < n_points - 1),
shifts AS (SELECT *, pause_s - bridge_m / greatest(avg_speed_kmh / 3.6::DOUBLE, 0.1::DOUBLE) AS shift_s FROM anchored)"""
Q_MARKED = """marked AS (SELECT p.*, EXISTS (SELECT 1 FROM clamped c WHERE c.track_id = p.track_id AND p.idx BETWEEN c.lo AND c.hi) AS in_cut,
  coalesce((SELECT sum(shift_s) FROM shifts s WHERE s.track_id = p.track_id AND s.hi < p.idx), 0) AS shift_s,
  EXISTS (SELECT 1 FROM shifts s WHERE s.track_id = p.track_id AND s.hi < p.idx) AS is_bridged FROM pts p)"""
CUT_SQL = with_(Q_TRACK, Q_IDX, Q_CUTS, Q_COUNTS, Q_FORCED, Q_CLAMPED)
FULL_SQL = with_(Q_TRACK, Q_IDX, Q_CUTS, Q_COUNTS, Q_FORCED, Q_CLAMPED, Q_NEAR, Q_SHIFTS, Q_MARKED)
_MOVED = "CASE WHEN shift_s <> 0 THEN ts - to_microseconds(CAST(round(shift_s * 1000000) AS BIGINT)) ELSE ts END"


def _points(spark, sf) -> DataFrame:
    return row_index(track(spark, sf))


@query(
    "validate_cut",
    with_(Q_CUTS) + """SELECT track_id, cut_id, CASE WHEN s < 0 OR e < 0 THEN 'negative index' WHEN s > e THEN 'start after end' WHEN m NOT IN ('trim', 'gap', 'bridge') THEN 'unknown mode' END AS reason
FROM (SELECT track_id, cut_id, "start" - CASE WHEN track_id % 4 = 0 THEN 5 ELSE 0 END AS s, "end" - CASE WHEN track_id % 5 = 0 THEN 12 ELSE 0 END AS e, CASE WHEN track_id % 6 = 0 THEN 'synthetic' ELSE mode END AS m FROM cuts)""",
)
def validate_cut(spark, sf):
    t = F.col("track_id")
    odd = cuts(spark, sf).withColumns(
        {
            "start": F.col("start") - F.when(t % 4 == 0, 5).otherwise(0),
            "end": F.col("end") - F.when(t % 5 == 0, 12).otherwise(0),
            "mode": F.when(t % 6 == 0, "synthetic").otherwise(F.col("mode")),
        }
    )
    return edit.validate_cuts(odd).select("track_id", "cut_id", "reason")


@query(
    "has_directive",
    with_(Q_TRACK) + "SELECT track_id, (track_id % 3 > 0 OR coalesce(CASE WHEN track_id % 2 = 0 THEN track_id % 4 END, 0) <> 0) AS has_directive FROM track GROUP BY track_id",
)
def has_directive(spark, sf):
    t = F.col("track_id")
    df = track(spark, sf).select("track_id").distinct().withColumns({"n": t % 3, "z": F.when(t % 2 == 0, (t % 4).cast("double"))})
    return df.select("track_id", edit.has_directive("n", "z").alias("has_directive"))


@query("force_edge_trim", CUT_SQL + "SELECT track_id, cut_id, mode FROM forced")
def force_edge_trim(spark, sf):
    return edit.force_edge_trim(cuts(spark, sf), edit.point_counts(track(spark, sf))).select("track_id", "cut_id", "mode")


@query("check_reference_count", with_(Q_TRACK, Q_COUNTS) + "SELECT track_id, n_points, track_id % 3 > 0 AND n_points <> 65 AS count_differs FROM counts")
def check_reference_count(spark, sf):
    counts = edit.point_counts(track(spark, sf))
    made = counts.select("track_id", F.when(F.col("track_id") % 3 > 0, F.lit(65)).alias("n_points_reference"))
    return edit.check_reference_count(made, counts).select("track_id", "n_points", "count_differs")


@query("neighbourhood_speed", with_(Q_TRACK, Q_IDX, Q_CUTS, Q_COUNTS, Q_FORCED, Q_CLAMPED, Q_NEAR) + "SELECT track_id, cut_id, round(avg_speed_kmh, 6) AS avg_speed_kmh FROM near")
def neighbourhood_speed(spark, sf):
    df = _points(spark, sf)
    ranges = edit.clamp_cuts(cuts(spark, sf), edit.point_counts(df)).select("track_id", "cut_id", F.col("lo").alias("start"), F.col("hi").alias("end"))
    return rounded(summary.neighbourhood_speed(df, ranges), ["track_id", "cut_id"], avg_speed_kmh=6)


@query("bridge_shift", FULL_SQL + "SELECT track_id, cut_id, round(pause_s, 6) AS pause_s, round(bridge_m, 3) AS bridge_m, round(shift_s, 3) AS shift_s FROM shifts")
def bridge_shift(spark, sf):
    df = _points(spark, sf)
    clamped = edit.clamp_cuts(cuts(spark, sf), edit.point_counts(df))
    return rounded(edit.bridge_shift(df, clamped), ["track_id", "cut_id"], pause_s=6, bridge_m=3, shift_s=3)


@query("cut_range_join", FULL_SQL + "SELECT track_id, idx, in_cut, round(shift_s, 3) AS shift_s FROM marked")
def cut_range_join(spark, sf):
    df = _points(spark, sf)
    marked = edit.mark_cuts(df, edit.effective_cuts(df, cuts(spark, sf)))
    return marked.select("track_id", "idx", "in_cut", F.round("shift_s", 3).alias("shift_s"))


@query("cut_points", CUT_SQL + "SELECT p.track_id, cut_id, idx, mode FROM pts p JOIN clamped c ON p.track_id = c.track_id AND idx BETWEEN lo AND hi")
def cut_points(spark, sf):
    df = _points(spark, sf)
    return edit.cut_points(df, edit.effective_cuts(df, cuts(spark, sf))).select("track_id", "cut_id", "idx", "mode")


@query(
    "apply_cuts_track",
    FULL_SQL + f"""SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS idx, idx AS idx_original, date_trunc('milliseconds', {_MOVED}) AS ts, is_bridged FROM marked WHERE NOT in_cut""",
)
def apply_cuts_track(spark, sf):
    df = edit.apply_cuts_track(_points(spark, sf), cuts(spark, sf))
    return df.select("track_id", "idx", "idx_original", F.date_trunc("millisecond", "ts").cast("timestamp_ntz").alias("ts"), "is_bridged")


Q_RAW = "raw AS (SELECT track_id, seq, CASE WHEN seq % 15 <> 0 THEN ts END AS ts FROM track)"
Q_GONE = """gone AS (SELECT c.track_id, a.ts AS ts_lo, b.ts AS ts_hi FROM clamped c JOIN pts a ON a.track_id = c.track_id AND a.idx = c.lo JOIN pts b ON b.track_id = c.track_id AND b.idx = c.hi),
kept AS (SELECT r.* FROM raw r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.track_id = r.track_id AND r.ts BETWEEN g.ts_lo AND g.ts_hi))"""
RAW_SQL = with_(Q_TRACK, Q_IDX, Q_CUTS, Q_COUNTS, Q_FORCED, Q_CLAMPED, Q_NEAR, Q_SHIFTS, Q_RAW, Q_GONE)
_RAW_SHIFT = "coalesce((SELECT sum(shift_s) FROM shifts s WHERE s.track_id = k.track_id AND s.ts_2 <= k.ts), 0)"


def _raw(spark, sf) -> DataFrame:
    return track(spark, sf).select("*", F.when(F.col("seq") % 15 != 0, F.col("ts")).alias("t")).drop("ts").withColumnRenamed("t", "ts").select(
        "track_id", "seq", "ts", *[c for c in ("chunk",) if c in track(spark, sf).columns]
    )


@query("cut_time_anti_join", RAW_SQL + "SELECT track_id, seq, ts FROM kept")
def cut_time_anti_join(spark, sf):
    df = _points(spark, sf)
    effective = edit.effective_cuts(df, cuts(spark, sf))
    return edit.drop_intervals(_raw(spark, sf), edit.cut_intervals(df, effective)).select("track_id", "seq", "ts")


@query("shift_breakpoints", RAW_SQL + f"SELECT track_id, seq, round({_RAW_SHIFT}, 3) AS shift_s FROM raw k")
def shift_breakpoints(spark, sf):
    df = _points(spark, sf)
    effective = edit.effective_cuts(df, cuts(spark, sf)).where(F.col("ts_after").isNotNull())
    marks = effective.select("track_id", F.col("ts_after").alias("ts"), "shift_s")
    return rounded(edit.shift_by_breakpoints(_raw(spark, sf), marks), ["track_id", "seq"], shift_s=3)


@query("apply_cuts_raw", RAW_SQL + f"SELECT track_id, seq, date_trunc('milliseconds', {_MOVED}) AS ts FROM (SELECT *, {_RAW_SHIFT} AS shift_s FROM kept k)")
def apply_cuts_raw(spark, sf):
    df = edit.apply_cuts_raw(_raw(spark, sf), _points(spark, sf), cuts(spark, sf))
    return df.select("track_id", "seq", F.date_trunc("millisecond", "ts").cast("timestamp_ntz").alias("ts"))


@query("cumulative_shift", with_(Q_TRACK, Q_IDX) + "SELECT track_id, idx, round(sum(CASE WHEN seq % 20 = 0 THEN hdop ELSE 0 END) OVER (PARTITION BY track_id ORDER BY idx), 6) AS shift_s FROM pts")
def cumulative_shift(spark, sf):
    step = F.when(F.col("seq") % 20 == 0, F.col("hdop")).otherwise(F.lit(0.0))
    df = running_sum(_points(spark, sf), step, "shift_s")
    return rounded(df, ["track_id", "idx"], shift_s=6)


_COUNTED = """SELECT track_id, CAST(count_if(mode = 'trim') AS BIGINT) AS n_trim_cuts, CAST(count_if(mode = 'gap') AS BIGINT) AS n_gap_cuts, CAST(count_if(mode = 'bridge') AS BIGINT) AS n_bridge_cuts FROM clamped GROUP BY track_id"""
_DERIVED = f"""SELECT track_id, n_points AS n_points_before, n_points - CAST(removed AS BIGINT) AS n_points_after, CAST(removed AS BIGINT) AS n_points_removed, n_trim_cuts, n_gap_cuts, n_bridge_cuts,
  CASE WHEN n_bridge_cuts > 0 THEN 'warn' WHEN n_gap_cuts > 0 THEN 'info' END AS severity, round(coalesce(total, 0), 3) AS total_time_shift_s
FROM ({_COUNTED}) JOIN counts USING (track_id) JOIN (SELECT track_id, count_if(in_cut) AS removed FROM marked GROUP BY track_id) USING (track_id)
LEFT JOIN (SELECT track_id, sum(shift_s) AS total FROM shifts GROUP BY track_id) USING (track_id)"""


@query("derivation", FULL_SQL + _DERIVED)
def derivation(spark, sf):
    df = edit.derivation(_points(spark, sf), cuts(spark, sf))
    keep = ["track_id", "n_points_before", "n_points_after", "n_points_removed", "n_trim_cuts", "n_gap_cuts", "n_bridge_cuts", "severity"]
    return rounded(df, keep, total_time_shift_s=3)


@query(
    "derivation_z_offset",
    FULL_SQL + f"""SELECT track_id, z AS z_offset_m, CASE WHEN z <> 0 AND severity IS NULL THEN 'info' ELSE severity END AS severity,
  CASE WHEN z <> 0 AND severity IS NULL THEN 'z_offset' WHEN severity = 'warn' THEN 'bridge' WHEN severity = 'info' THEN 'gap' END AS type
FROM (SELECT track_id, CAST(track_id % 3 AS DOUBLE) AS z, CASE WHEN track_id % 7 <> 0 THEN severity END AS severity FROM ({_DERIVED}))""",
)
def derivation_z_offset(spark, sf):
    t = F.col("track_id")
    made = edit.derivation(_points(spark, sf), cuts(spark, sf)).where(t % 7 != 0)
    instructions = track(spark, sf).select("track_id").distinct().withColumn("z_offset_m", (t % 3).cast("double"))
    return edit.add_z_offset(made, instructions).select("track_id", "z_offset_m", "severity", "type")


@query(
    "apply_sidecar_cuts",
    FULL_SQL + f"""SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS idx, seq, date_trunc('milliseconds', {_MOVED}) AS ts, is_bridged, z AS suggested_z_offset_m FROM (
  SELECT track_id, idx, seq, ts, in_cut AND track_id % 3 <> 0 AS in_cut, CASE WHEN track_id % 3 <> 0 THEN shift_s ELSE 0 END AS shift_s, CASE WHEN track_id % 3 <> 0 THEN is_bridged END AS is_bridged,
  CASE WHEN track_id % 3 <> 0 THEN 1.5::DOUBLE ELSE 0 END AS z FROM marked) WHERE NOT in_cut""",
)
def apply_sidecar_cuts(spark, sf):
    listed = cuts(spark, sf).where(F.col("track_id") % 3 != 0).groupBy("track_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "mode"))).alias("cut_ranges")
    )
    df = edit.apply_sidecar_cuts(_points(spark, sf), listed.withColumn("z_offset_m", F.lit(1.5)))
    ts = F.date_trunc("millisecond", "ts").cast("timestamp_ntz").alias("ts")
    return df.select("track_id", "idx", "seq", ts, "is_bridged", "suggested_z_offset_m")


@query(
    "cut_free_gap",
    CUT_SQL + """SELECT track_id, lo, hi FROM (SELECT track_id, coalesce(max("end") OVER (PARTITION BY track_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 AS lo, "start" - 1 AS hi FROM cuts
  UNION ALL SELECT track_id, coalesce((SELECT max("end") FROM cuts c WHERE c.track_id = n.track_id), -1) + 1, n_points - 1 FROM counts n) WHERE lo <= hi""",
)
def cut_free_gap(spark, sf):
    return edit.cut_free_gaps(cuts(spark, sf), edit.point_counts(track(spark, sf)))


@query(
    "clamp_to_neighbours",
    CUT_SQL + """SELECT track_id, cut_id, CASE WHEN s > e AND moved THEN e ELSE s END AS new_start, CASE WHEN s > e AND NOT moved THEN s ELSE e END AS new_end,
  CASE WHEN CASE WHEN s > e AND moved THEN e ELSE s END <= 0 OR CASE WHEN s > e AND NOT moved THEN s ELSE e END >= n - 1 THEN 'trim' WHEN mode = 'trim' THEN 'gap' ELSE mode END AS mode
FROM (SELECT track_id, cut_id, mode, n_points AS n, greatest(greatest(0, least(n_points - 1, ns)), coalesce(lag("end") OVER w + 1, 0)) AS s,
  least(greatest(0, least(n_points - 1, ne)), coalesce(lead("start") OVER w - 1, n_points - 1)) AS e, ns <> "start" AS moved
  FROM (SELECT *, "start" - track_id % 9 AS ns, "end" + track_id % 30 AS ne FROM cuts JOIN counts USING (track_id)) WINDOW w AS (PARTITION BY track_id ORDER BY "start"))""",
)
def clamp_to_neighbours(spark, sf):
    t = F.col("track_id")
    wanted = cuts(spark, sf).withColumns({"new_start": F.col("start") - t % 9, "new_end": F.col("end") + t % 30})
    out = edit.clamp_to_neighbours(wanted, edit.point_counts(track(spark, sf)))
    return out.select("track_id", "cut_id", "new_start", "new_end", "mode")


@query(
    "cut_label",
    CUT_SQL + """SELECT track_id, cut_id, CASE WHEN a AND b THEN 'Trim Alles' WHEN a THEN 'Trim Start' WHEN b THEN 'Trim Ende'
  ELSE CASE mode WHEN 'trim' THEN 'Trim ' WHEN 'gap' THEN 'Gap ' ELSE 'Brücke ' END || CAST(sum(CASE WHEN a OR b THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY "start", cut_id) AS BIGINT) END AS label
FROM (SELECT *, "start" = 0 AS a, "end" = n_points - 1 AS b FROM cuts JOIN counts USING (track_id))""",
)
def cut_label(spark, sf):
    return edit.cut_labels(cuts(spark, sf), edit.point_counts(track(spark, sf))).select("track_id", "cut_id", "label")


@query(
    "write_cuts",
    CUT_SQL + """SELECT track_id, '{"source":"t' || track_id || '.txt","n_points_reference":' || n_points || ',"cut_ranges":[' ||
  (SELECT string_agg('{"start":' || "start" || ',"end":' || "end" || ',"mode":"' || mode || '"}', ',' ORDER BY "start") FROM cuts c WHERE c.track_id = n.track_id) || '],"created_at":"2024-02-01T00:00:00Z"' ||
  CASE WHEN track_id % 3 > 0 THEN ',"z_offset_m":' || floor((track_id % 3) / 4::DOUBLE * 10 + 0.5::DOUBLE) / 10 ELSE '' END || '}' AS document FROM counts n""",
)
def write_cuts(spark, sf):
    t = F.col("track_id")
    sources = track(spark, sf).select("track_id").distinct().withColumns(
        {
            "source": F.concat(F.lit("t"), t.cast("string"), F.lit(".txt")),
            "z_offset_m": (t % 3) / F.lit(4.0),
            "created_at": F.lit("2024-02-01T00:00:00Z"),
        }
    )
    return edit.write_cuts(cuts(spark, sf), sources, edit.point_counts(track(spark, sf))).select("track_id", "document")


# --- merging --------------------------------------------------------------------------------

# two tracks each; in every other pair the second one starts two months later
Q_PAIRED = """paired AS (SELECT *, CAST(floor(track_id / 2) AS BIGINT) AS merge_id, track_id % 2 AS part_no, CASE WHEN track_id % 4 = 3 THEN ts + INTERVAL 60 DAY ELSE ts END AS t FROM pts)"""
Q_SEAMS = f"""ends AS (SELECT merge_id, part_no, count(*) AS n, arg_min({{'t': t, 'lat': lat, 'lon': lon}}, idx) AS f, arg_max({{'t': t, 'lat': lat, 'lon': lon}}, idx) AS l FROM paired GROUP BY merge_id, part_no),
seam AS (SELECT a.merge_id, a.n AS n_first, a.l.t AS end_1, b.f.t AS start_2, {geodesic_sql('a.l.lat', 'a.l.lon', 'b.f.lat', 'b.f.lon')} AS seam_m FROM ends a JOIN ends b ON a.merge_id = b.merge_id AND a.part_no = 0 AND b.part_no = 1),
pace AS (SELECT s.merge_id, coalesce(avg(CASE WHEN (part_no = 0 AND idx >= n_first - 10) OR (part_no = 1 AND idx < 10) THEN speed_kmh END), median(speed_kmh), 50) AS kmh FROM paired JOIN seam s USING (merge_id) GROUP BY s.merge_id)"""


def _plan_sql(always: str) -> str:
    return f"""planned AS (SELECT merge_id, n_first, CASE WHEN bridged THEN 'bridge' ELSE 'gap' END AS effective_mode, CASE WHEN bridged THEN (epoch_us(start_2) - epoch_us(end_1)) / 1000000::DOUBLE - seam_m / greatest(kmh / 3.6::DOUBLE, 0.1::DOUBLE) ELSE 0 END AS shift_s
  FROM (SELECT *, {always} OR start_2 <= end_1 AS bridged FROM seam JOIN pace USING (merge_id)))"""


def _merge_sql(always: str) -> str:
    return with_(Q_TRACK, Q_IDX, Q_PAIRED, Q_SEAMS, _plan_sql(always)) + f"""SELECT merge_id, CAST(part_no AS INTEGER) AS segment_no, idx + CASE WHEN part_no = 1 THEN coalesce(n_first, 0) ELSE 0 END AS merged_idx,
  date_trunc('milliseconds', CASE WHEN shift_s <> 0 THEN t - to_microseconds(CAST(round(shift_s * 1000000) AS BIGINT)) ELSE t END) AS ts
FROM (SELECT p.*, s.n_first, CASE WHEN part_no = 1 THEN coalesce(s.shift_s, 0) ELSE 0 END AS shift_s FROM paired p LEFT JOIN planned s USING (merge_id))"""


def paired(spark, sf) -> DataFrame:
    t = F.col("track_id")
    later = F.expr("ts + INTERVAL '60' DAY")
    return _points(spark, sf).withColumns(
        {"merge_id": F.floor(t / 2), "part_no": t % 2, "ts": F.when(t % 4 == 3, later).otherwise(F.col("ts"))}
    )


def _merged(spark, sf, mode: str) -> DataFrame:
    df = merge.merge_tracks(paired(spark, sf), mode)
    # a merge of one part counts as its own first segment
    return df.select(
        "merge_id", F.when(F.col("part_no") == 1, F.lit(1)).otherwise(F.lit(0)).alias("segment_no"), "merged_idx",
        F.date_trunc("millisecond", "ts").cast("timestamp_ntz").alias("ts"),
    )


@query("merge_tracks_gap", _merge_sql("FALSE"))
def merge_tracks_gap(spark, sf):
    return _merged(spark, sf, "gap")


@query("merge_tracks_bridge", _merge_sql("TRUE"))
def merge_tracks_bridge(spark, sf):
    return _merged(spark, sf, "bridge")


@query(
    "merge_plan",
    with_(Q_TRACK, Q_IDX, Q_PAIRED, Q_SEAMS, _plan_sql("FALSE")) + "SELECT merge_id, effective_mode, round(shift_s, 3) AS shift_s FROM planned",
)
def merge_plan(spark, sf):
    df = merge.merge_plan(paired(spark, sf)).where(F.col("segment_no") > 0)
    return rounded(df, ["merge_id", "effective_mode"], shift_s=3)


@query("union_tracks", with_(Q_TRACK, Q_IDX, Q_PAIRED) + "SELECT merge_id, part_no, count(*) AS n FROM paired GROUP BY merge_id, part_no")
def union_tracks(spark, sf):
    df = paired(spark, sf).drop("chunk")
    both = df.where(F.col("part_no") == 0).unionByName(df.where(F.col("part_no") == 1))
    return split_hot_tracks(both).groupBy("merge_id", "part_no").agg(F.count(F.lit(1)).alias("n"))
