"""Cut instructions: trim, gap and bridge on tracks and on the sentence table.

Cuts are ``(track_id, cut_id, start, end, mode)`` with inclusive point indices; they may overlap. They are swept: their ends
become events in the order of the rows, and running sums over both tell whether a row lies in a cut and what the bridges
before it add up to. So the work grows with rows plus cuts, and no row carries the cuts of its track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.operators.summary import neighbourhood_speed
from trackloom.plans.sequence import TRACK, row_index, running_sum, running_sums
from trackloom.plans.skew import CHUNK, attach_track, skew_join, split_hot_tracks

# Fixed values.
MODES = ("trim", "gap", "bridge")
NEIGHBOURS = 10
MIN_SPEED_MPS = 0.1
MIN_SHOWN_OFFSET_M = 0.05
CELL_POINTS = 1024
MODE_LABELS = {"trim": "Trim", "gap": "Gap", "bridge": "Brücke"}


def cut_error(start, end, mode) -> Column:
    """Why a cut is invalid, or NULL."""
    s, e, m = S.col(start), S.col(end), S.col(mode)
    return (
        F.when(s.isNull() | e.isNull(), "missing index")
        .when((s < 0) | (e < 0), "negative index")
        .when(s > e, "start after end")
        .when(~m.isin(*MODES), "unknown mode")
    )


def validate_cuts(cuts: DataFrame) -> DataFrame:
    return cuts.withColumn("reason", cut_error("start", "end", "mode"))


def has_directive(n_cuts, z_offset_m) -> Column:
    """True if an instruction changes anything: it has cuts or a height offset."""
    return (S.col(n_cuts) > 0) | (F.coalesce(S.col(z_offset_m), S.number(0)) != 0)


def point_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_points"))


def force_edge_trim(cuts: DataFrame, counts: DataFrame) -> DataFrame:
    """A cut that touches the first or last point can only trim."""
    edge = (F.col("start") <= 0) | (F.col("end") >= F.col("n_points") - 1)
    joined = cuts.join(counts, "track_id")
    return joined.withColumn("mode", F.when(edge, "trim").otherwise(F.col("mode")))


def check_reference_count(instructions: DataFrame, counts: DataFrame) -> DataFrame:
    """Flag instructions made for a track of another length."""
    differs = F.col("n_points_reference").isNotNull() & (F.col("n_points_reference") != F.col("n_points"))
    return instructions.join(counts, "track_id").withColumn("count_differs", differs)


def clamp_cuts(cuts: DataFrame, counts: DataFrame) -> DataFrame:
    """Effective cuts: edges trimmed, limits inside the track, empty cuts dropped; adds ``lo`` and ``hi``."""
    lo, hi = F.greatest(F.lit(0), F.col("start")), F.least(F.col("n_points") - 1, F.col("end"))
    return force_edge_trim(cuts, counts).withColumns({"lo": lo, "hi": hi}).where(F.col("lo") <= F.col("hi"))


def _at_positions(points: DataFrame, cuts: DataFrame, positions: dict[str, Column], fields: list[str]) -> DataFrame:
    """``(track_id, cut_id, side, fields)``: the points at positions that belong to each cut; one equi-join on the place."""
    places = F.array(*[F.struct(F.lit(n).alias("side"), p.cast("bigint").alias("idx")) for n, p in positions.items()])
    wanted = cuts.select("track_id", "cut_id", F.inline(places))
    return points.select("track_id", "idx", *fields).join(wanted, ["track_id", "idx"]).drop("idx")


def bridge_shift(points: DataFrame, cuts: DataFrame, n: int = NEIGHBOURS) -> DataFrame:
    """Seconds by which a bridge cut moves what follows: the pause minus the time to cross the gap.

    ``cuts`` are effective cuts. The result has one row per inner bridge cut, with pause, distance and speed.
    """
    bridges = cuts.where(
        (F.col("mode") == "bridge") & (F.col("lo") > 0) & (F.col("hi") < F.col("n_points") - 1)
    ).select("track_id", "cut_id", "lo", "hi")
    rows = _at_positions(points, bridges, {"before": F.col("lo") - 1, "after": F.col("hi") + 1}, ["ts", "lat", "lon"])

    def anchor(name: str, side: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name)))

    anchors = rows.groupBy("track_id", "cut_id").agg(
        *[anchor(c, "before").alias(f"{c}_1") for c in ("ts", "lat", "lon")],
        *[anchor(c, "after").alias(f"{c}_2") for c in ("ts", "lat", "lon")],
    )
    ranges = bridges.withColumnsRenamed({"lo": "start", "hi": "end"})
    speeds = neighbourhood_speed(points, ranges, n).select("track_id", "cut_id", "avg_speed_kmh")
    pace = F.greatest(S.kmh_to_mps("avg_speed_kmh"), S.number(MIN_SPEED_MPS))
    return (
        bridges.join(anchors, ["track_id", "cut_id"])
        .join(speeds, ["track_id", "cut_id"])
        .withColumn("pause_s", S.seconds_between("ts_1", "ts_2"))
        .withColumn("bridge_m", S.geodesic_m("lat_1", "lon_1", "lat_2", "lon_2"))
        .withColumn("shift_s", F.col("pause_s") - F.col("bridge_m") / pace)
        .select("track_id", "cut_id", "lo", "hi", "pause_s", "bridge_m", "avg_speed_kmh", "shift_s", F.col("ts_2").alias("ts_after"))
    )


def effective_cuts(points: DataFrame, cuts: DataFrame, n: int = NEIGHBOURS) -> DataFrame:
    """Clamped cuts with ``shift_s`` and ``ts_after`` for inner bridges."""
    clamped = clamp_cuts(cuts, point_counts(points))
    shifts = bridge_shift(points, clamped, n).select("track_id", "cut_id", "shift_s", "ts_after")
    return clamped.join(shifts, ["track_id", "cut_id"], "left")


def _merged(rows: DataFrame, events: DataFrame, order: str) -> DataFrame:
    """Rows and events in one table, split anew where a track is long; ``_row`` is 1 for rows."""
    timeline = rows.drop(CHUNK).withColumn("_row", F.lit(1)).unionByName(events, allowMissingColumns=True)
    return split_hot_tracks(timeline, order=order) if CHUNK in rows.columns else timeline


def mark_cuts(points: DataFrame, effective: DataFrame) -> DataFrame:
    """Add whether a point lies in a cut, the seconds it moves, and whether a bridge comes before it."""
    bridge = F.col("shift_s").isNotNull()
    ends = F.array(
        F.struct(F.col("lo").cast("bigint").alias("idx"), F.lit(1).alias("_open"), S.number(0).alias("_shift"), F.lit(0).alias("_bridge")),
        F.struct(
            (F.col("hi") + 1).cast("bigint").alias("idx"), F.lit(-1).alias("_open"), F.coalesce("shift_s", S.number(0)).alias("_shift"), bridge.cast("int").alias("_bridge")
        ),
    )
    # an event stands before the point of its place; several of one place are one
    events = effective.select("track_id", F.inline(ends)).groupBy("track_id", "idx").agg(*[F.sum(c).alias(c) for c in ("_open", "_shift", "_bridge")])
    timeline = _merged(points, events.withColumn("_row", F.lit(0)), "idx")
    sums = {n: F.coalesce(F.col(n), F.lit(0)) for n in ("_open", "_shift", "_bridge")}
    swept = running_sums(timeline, {f"{n}_sum": v for n, v in sums.items()}, order=("idx", "_row")).where("_row = 1")
    has_cuts = effective.select("track_id").distinct().withColumn("has_cuts", F.lit(True))
    marked = attach_track(swept, has_cuts).withColumns(
        {
            "in_cut": F.col("_open_sum") > 0,
            "shift_s": F.when(F.col("_bridge_sum") > 0, F.col("_shift_sum")).otherwise(S.number(0)),
            "is_bridged": F.col("_bridge_sum") > 0,
            "has_cuts": F.coalesce("has_cuts", F.lit(False)),
        }
    )
    return marked.drop("_row", *sums, *[f"{n}_sum" for n in sums])


def cut_points(points: DataFrame, effective: DataFrame) -> DataFrame:
    """The points inside each cut, one row per point and cut; both meet in cells of the index."""
    cell = lambda i: F.floor(F.col(i) / CELL_POINTS)
    spread = effective.select("track_id", "cut_id", "mode", "lo", "hi", F.explode(F.sequence(cell("lo"), cell("hi"))).alias("_cell"))
    rows = skew_join(points.withColumn("_cell", cell("idx")), spread, ["track_id", "_cell"], "inner")
    return rows.where(F.col("idx").between(F.col("lo"), F.col("hi"))).drop("_cell", "lo", "hi")


def apply_cuts_track(points: DataFrame, cuts: DataFrame, n: int = NEIGHBOURS, effective: DataFrame | None = None) -> DataFrame:
    """Drop the cut points, move what follows a bridge, renumber, and flag bridged points.

    ``is_bridged`` is NULL for tracks without cuts, which pass unchanged. ``effective`` are the effective cuts where
    they are at hand.
    """
    if effective is None:
        effective = effective_cuts(points, cuts, n)
    marked = mark_cuts(points, effective).where(~F.col("in_cut"))
    dtype = points.schema["ts"].dataType
    moved = marked.withColumns(
        {
            "idx_original": F.col("idx"),
            "ts": F.when(F.col("shift_s") != 0, S.shift_back("ts", F.col("shift_s"), dtype)).otherwise(F.col("ts")),
            "is_bridged": F.when(F.col("has_cuts"), F.col("is_bridged")),
        }
    ).drop("in_cut", "has_cuts")
    return row_index(moved, TRACK, ("idx_original",))


def cut_intervals(points: DataFrame, effective: DataFrame) -> DataFrame:
    """Time limits of the cuts: the times of their first and last points."""
    rows = _at_positions(points, effective, {"lo": F.col("lo"), "hi": F.col("hi")}, ["ts"])
    return (
        rows.groupBy("track_id", "cut_id")
        .agg(*[F.max(F.when(F.col("side") == x, F.col("ts"))).alias(f"ts_{x}") for x in ("lo", "hi")])
        .where(F.col("ts_lo").isNotNull() & F.col("ts_hi").isNotNull())
    )


def drop_intervals(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Remove rows whose time lies in an interval of their track, limits included; rows without time stay."""
    # an interval opens before the rows of its first time and closes after those of its last
    ends = F.array(
        F.struct(F.col("ts_lo").alias("ts"), F.lit(0).alias("_row"), F.lit(1).alias("_open")),
        F.struct(F.col("ts_hi").alias("ts"), F.lit(2).alias("_row"), F.lit(-1).alias("_open")),
    )
    events = intervals.where("ts_lo <= ts_hi").select("track_id", F.inline(ends))
    events = events.groupBy("track_id", "ts", "_row").agg(F.sum("_open").alias("_open"))
    swept = running_sum(_merged(rows, events, "ts"), F.coalesce("_open", F.lit(0)), "_inside", order=("ts", "_row"))
    return swept.where((F.col("_row") == 1) & (F.col("ts").isNull() | (F.col("_inside") == 0))).drop("_row", "_open", "_inside")


def shift_by_breakpoints(rows: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """Add ``shift_s``: the sum over the breakpoints ``(track_id, ts, shift_s)`` at or before the row's time.

    Breakpoints are placed in the time order of the rows and summed along it.
    """
    steps = breakpoints.select("track_id", "ts", F.col("shift_s").alias("_step"))
    rows = rows.drop(CHUNK).withColumn("_row", F.lit(1))
    timeline = rows.unionByName(steps.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    timeline = split_hot_tracks(timeline)
    order = ("ts", "_row", "seq")
    summed = running_sum(timeline, F.coalesce("_step", S.number(0)), "shift_s", order=order)
    return summed.where(F.col("_row") == 1).drop("_row", "_step", CHUNK)


def apply_cuts_raw(
    schema_a: DataFrame, points: DataFrame, cuts: DataFrame, n: int = NEIGHBOURS, effective: DataFrame | None = None
) -> DataFrame:
    """The cuts of a track applied by time to its sentences; satellite reports outside the cuts stay, moved."""
    if effective is None:
        effective = effective_cuts(points, cuts, n)
    kept = drop_intervals(schema_a, cut_intervals(points, effective))
    breakpoints = effective.where(F.col("ts_after").isNotNull() & F.col("shift_s").isNotNull()).select(
        "track_id", F.col("ts_after").alias("ts"), "shift_s"
    )
    moved = shift_by_breakpoints(kept, breakpoints)
    dtype = schema_a.schema["ts"].dataType
    ts = F.when(F.col("shift_s") != 0, S.shift_back("ts", F.col("shift_s"), dtype)).otherwise(F.col("ts"))
    return moved.withColumn("ts", F.when(F.col("ts").isNotNull(), ts)).drop("shift_s")


def derivation(points: DataFrame, cuts: DataFrame, n: int = NEIGHBOURS, effective: DataFrame | None = None) -> DataFrame:
    """What the cuts did per track: counts per mode, points before and after, total shift, severity."""
    if effective is None:
        effective = effective_cuts(points, cuts, n)
    per_mode = effective.groupBy("track_id").agg(
        *[F.count_if(F.col("mode") == m).alias(f"n_{m}_cuts") for m in MODES],
        F.coalesce(F.sum("shift_s"), S.number(0)).alias("total_time_shift_s"),
    )
    kept = (
        mark_cuts(points, effective)
        .groupBy("track_id")
        .agg(F.count(F.lit(1)).alias("n_points_before"), F.count_if(~F.col("in_cut")).alias("n_points_after"))
    )
    severity = F.when(F.col("n_bridge_cuts") > 0, "warn").when(F.col("n_gap_cuts") > 0, "info")
    kind = F.when(F.col("n_bridge_cuts") > 0, "bridge").when(F.col("n_gap_cuts") > 0, "gap")
    return (
        kept.join(per_mode, "track_id")
        .withColumn("n_points_removed", F.col("n_points_before") - F.col("n_points_after"))
        .withColumn("n_cuts", F.col("n_trim_cuts") + F.col("n_gap_cuts") + F.col("n_bridge_cuts"))
        .withColumns({"type": kind, "severity": severity})
    )


def add_z_offset(derivations: DataFrame, instructions: DataFrame) -> DataFrame:
    """Add the height offset of an instruction; one that has only an offset becomes an ``info`` record.

    The log's name and whether the instruction was made for another number of points are kept where it tells them.
    """
    z = F.round(F.coalesce(F.col("z_offset_m"), S.number(0)), 2)
    told = [c for c in ("source_name", "count_differs") if c in instructions.columns]
    joined = instructions.select("track_id", z.alias("z_offset_m"), *told).join(derivations, "track_id", "left")
    only = (F.col("z_offset_m") != 0) & F.col("severity").isNull()
    return joined.withColumns(
        {
            "type": F.when(only, "z_offset").otherwise(F.col("type")),
            "severity": F.when(only, "info").otherwise(F.col("severity")),
        }
    )


def apply_sidecar_cuts(points: DataFrame, instructions: DataFrame, effective: DataFrame | None = None) -> DataFrame:
    """Apply each track's instruction, if it has one; other tracks pass unchanged.

    ``instructions`` has ``(track_id, cut_ranges, z_offset_m)``; the offset is shown only, never applied.
    """
    cuts = instructions.select("track_id", F.posexplode("cut_ranges").alias("cut_id", "c")).select(
        "track_id", "cut_id", "c.*"
    )
    edited = apply_cuts_track(points, cuts, effective=effective)
    offsets = instructions.select("track_id", F.col("z_offset_m").alias("suggested_z_offset_m"))
    return attach_track(edited, offsets).withColumn(
        "suggested_z_offset_m", F.coalesce("suggested_z_offset_m", S.number(0))
    )


# --- cuts among themselves ------------------------------------------------------------------


def cut_free_gaps(cuts: DataFrame, counts: DataFrame) -> DataFrame:
    """Index ranges that no cut covers."""
    w = Window.partitionBy("track_id").orderBy("start", "end")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    before = cuts.select(
        "track_id", (F.coalesce(reached, F.lit(-1)) + 1).alias("lo"), (F.col("start") - 1).alias("hi")
    )
    last = counts.join(cuts.groupBy("track_id").agg(F.max("end").alias("_end")), "track_id", "left").select(
        "track_id", (F.coalesce("_end", F.lit(-1)) + 1).alias("lo"), (F.col("n_points") - 1).alias("hi")
    )
    return before.unionByName(last).where(F.col("lo") <= F.col("hi"))


def clamp_to_neighbours(cuts: DataFrame, counts: DataFrame, middle_mode: str = "gap") -> DataFrame:
    """Limit changed cuts (``new_start``, ``new_end``) to the track and to the space between the cuts beside them."""
    w = Window.partitionBy("track_id").orderBy("start")
    last = F.col("n_points") - 1

    def inside(c: str) -> Column:
        return F.greatest(F.lit(0), F.least(last, F.col(c)))

    placed = cuts.join(counts, "track_id").withColumns({"_prev": F.lag("end").over(w), "_next": F.lead("start").over(w)})
    start = F.greatest(inside("new_start"), F.coalesce(F.col("_prev") + 1, F.lit(0)))
    end = F.least(inside("new_end"), F.coalesce(F.col("_next") - 1, last))
    moved = F.col("new_start") != F.col("start")
    out = placed.withColumns({"_s": start, "_e": end}).withColumns(
        {
            "new_start": F.when((F.col("_s") > F.col("_e")) & moved, F.col("_e")).otherwise(F.col("_s")),
            "new_end": F.when((F.col("_s") > F.col("_e")) & ~moved, F.col("_s")).otherwise(F.col("_e")),
        }
    )
    edge = (F.col("new_start") <= 0) | (F.col("new_end") >= last)
    mode = F.when(edge, "trim").when(F.col("mode") == "trim", F.lit(middle_mode)).otherwise(F.col("mode"))
    return out.withColumn("mode", mode).drop("_s", "_e", "_prev", "_next")


def cut_labels(cuts: DataFrame, counts: DataFrame) -> DataFrame:
    """Name of each cut: trims by their side, the others by mode and running number."""
    joined = cuts.join(counts, "track_id")
    at_start, at_end = F.col("start") == 0, F.col("end") == F.col("n_points") - 1
    middle = (~at_start & ~at_end).cast("int")
    number = F.sum(middle).over(Window.partitionBy("track_id").orderBy("start", "cut_id"))
    mode_label = F.try_element_at(F.create_map(*[F.lit(x) for kv in MODE_LABELS.items() for x in kv]), F.col("mode"))
    label = (
        F.when(at_start & at_end, "Trim Alles")
        .when(at_start, "Trim Start")
        .when(at_end, "Trim Ende")
        .otherwise(F.concat(mode_label, F.lit(" "), number.cast("string")))
    )
    return joined.withColumn("label", label)


def write_cuts(cuts: DataFrame, sources: DataFrame, counts: DataFrame) -> DataFrame:
    """One instruction document per track as JSON text.

    ``sources`` has ``(track_id, source, z_offset_m, created_at)``. Tracks without cuts and without an offset
    of at least 5 cm have no document.
    """
    listed = cuts.groupBy("track_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "mode"))).alias("cut_ranges")
    )
    shown = F.when(F.abs("z_offset_m") >= MIN_SHOWN_OFFSET_M, F.floor(F.col("z_offset_m") * 10 + S.number(0.5)) / 10)
    return (
        sources.join(counts, "track_id")
        .join(listed, "track_id", "left")
        .withColumn("z_offset_m", shown)
        .where(F.col("cut_ranges").isNotNull() | F.col("z_offset_m").isNotNull())
        .select(
            "track_id",
            "source",
            F.to_json(
                F.struct(
                    "source",
                    F.col("n_points").alias("n_points_reference"),
                    F.coalesce("cut_ranges", F.expr("cast(array() as array<struct<start:bigint,end:bigint,mode:string>>)")).alias("cut_ranges"),
                    "created_at",
                    "z_offset_m",
                )
            ).alias("document"),
        )
    )
