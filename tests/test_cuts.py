"""Cuts swept over the rows of a track against a loop over rows and cuts; short and long tracks, overlapping cuts, many cuts."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trackloom.operators import edit
from trackloom.plans.skew import split_hot_tracks

START = datetime(2024, 1, 1, 12)
POINTS = "track_id bigint, idx bigint, seq bigint, ts timestamp, lat double, lon double, speed_kmh double"
EFFECTIVE = "track_id bigint, cut_id int, lo bigint, hi bigint, mode string, shift_s double, ts_after timestamp, n_points bigint"


def tracks(sizes):
    return [(t, i, i, START + timedelta(seconds=i), 47 + i / 1e4, 8.0, 36.0) for t, n in sizes.items() for i in range(n)]


def random_cuts(rng, sizes, count):
    out = []
    for t, n in sizes.items():
        for c in range(count if t else 0):
            lo = rng.randrange(n)
            hi = min(n - 1, lo + rng.randrange(12))
            mode = "trim" if lo == 0 or hi == n - 1 else rng.choice(["gap", "bridge"])
            bridge = mode == "bridge"
            out.append((t, c, lo, hi, mode, rng.randrange(1, 50) / 4 if bridge else None, START + timedelta(seconds=hi + 1) if bridge else None, n))
    return out


@pytest.fixture(params=["whole", "split"])
def target(request, spark):
    """The same rows in one window a track, and with long tracks cut into chunks of about 20 rows."""
    if request.param == "split":
        spark.conf.set("trackloom.targetRows", "20")
    yield request.param
    spark.conf.unset("trackloom.targetRows")


def test_marks_and_points_of_overlapping_cuts(spark, target):
    rng = random.Random(1)
    sizes = {0: 30, 1: 200, 2: 90, 3: 1}
    cuts = random_cuts(rng, sizes, 9)
    # a point is missing, a cut begins there
    rows = [r for r in tracks(sizes) if (r[0], r[1]) != (1, 50)]
    cuts.append((1, 99, 50, 53, "gap", None, None, 200))
    points = split_hot_tracks(spark.createDataFrame(rows, POINTS), order="idx")
    effective = spark.createDataFrame(cuts, EFFECTIVE)
    got = {(r["track_id"], r["idx"]): (r["in_cut"], r["shift_s"], r["is_bridged"], r["has_cuts"]) for r in edit.mark_cuts(points, effective).collect()}
    want = {}
    for t, i, *_ in rows:
        own = [c for c in cuts if c[0] == t]
        before = [c[5] for c in own if c[5] is not None and c[3] < i]
        want[t, i] = (any(c[2] <= i <= c[3] for c in own), pytest.approx(sum(before), abs=1e-9), bool(before), bool(own))
    assert got == want
    inside = sorted((r["track_id"], r["idx"], r["cut_id"], r["mode"]) for r in edit.cut_points(points, effective).collect())
    assert inside == sorted((t, i, c[1], c[4]) for t, i, *_ in rows for c in cuts if c[0] == t and c[2] <= i <= c[3])


def test_times_in_intervals(spark, target):
    """Limits belong to an interval; rows without time stay; equal times go together."""
    rng = random.Random(2)
    rows = [(t, i, i, None if i % 17 == 0 else START + timedelta(seconds=rng.randrange(120)), 0.0, 0.0, None) for t in (1, 2) for i in range(150)]
    intervals = []
    for c in range(12):
        lo = rng.randrange(110)
        intervals.append((1, c, START + timedelta(seconds=lo), START + timedelta(seconds=lo + rng.randrange(-2, 6))))
    df = split_hot_tracks(spark.createDataFrame(rows, POINTS))
    gaps = spark.createDataFrame(intervals, "track_id bigint, cut_id int, ts_lo timestamp, ts_hi timestamp")
    left = edit.drop_intervals(df, gaps)
    got = sorted((r["track_id"], r["idx"]) for r in left.collect())
    gone = lambda r: r[3] is not None and any(g[0] == r[0] and g[2] <= r[3] <= g[3] for g in intervals)
    assert got == sorted((r[0], r[1]) for r in rows if not gone(r))
    assert set(left.columns) - {"chunk"} == set(df.columns) - {"chunk"}


def test_bridges_and_intervals_of_cuts(spark, target):
    sizes = {1: 80, 2: 60}
    points = split_hot_tracks(spark.createDataFrame(tracks(sizes), POINTS), order="idx")
    cuts = spark.createDataFrame([(1, 0, 10, 19, "bridge"), (1, 1, 15, 30, "gap"), (2, 0, 0, 4, "bridge"), (2, 1, 20, 20, "bridge")], "track_id bigint, cut_id int, start bigint, end bigint, mode string")
    effective = edit.effective_cuts(points, cuts).cache()
    found = {(r["track_id"], r["cut_id"]): (r["mode"], r["ts_after"]) for r in effective.collect()}
    assert found[1, 0] == ("bridge", START + timedelta(seconds=20)) and found[2, 0] == ("trim", None)
    assert found[2, 1] == ("bridge", START + timedelta(seconds=21)) and found[1, 1] == ("gap", None)
    spans = {(r["track_id"], r["cut_id"]): (r["ts_lo"], r["ts_hi"]) for r in edit.cut_intervals(points, effective).collect()}
    assert spans[1, 1] == (START + timedelta(seconds=15), START + timedelta(seconds=30)) and len(spans) == 4
    left = edit.apply_cuts_track(points, cuts)
    assert left.where("track_id = 1").count() == 80 - 21 and left.where("track_id = 2").count() == 60 - 6
    assert [r["idx"] for r in left.where("track_id = 2").orderBy("idx").collect()] == list(range(54))


def test_cost_grows_with_cuts_not_with_rows_times_cuts(spark):
    """100 000 cuts on one track of 300 000 points: an array of cuts on each row would be looked through 3e10 times."""
    n, m = 300_000, 100_000
    points = spark.range(n).select(
        F.lit(1).cast("bigint").alias("track_id"), F.col("id").alias("idx"), F.timestamp_seconds(F.col("id")).alias("ts"), F.lit(47.0).alias("lat"), F.lit(8.0).alias("lon"), F.lit(36.0).alias("speed_kmh")
    )
    cuts = spark.range(m).select(
        F.lit(1).cast("bigint").alias("track_id"), F.col("id").cast("int").alias("cut_id"), (F.col("id") * 3 + 1).alias("start"), (F.col("id") * 3 + 1).alias("end"), F.lit("bridge").alias("mode")
    )
    begin = time.perf_counter()
    left = edit.apply_cuts_track(points, cuts).agg(F.count(F.lit(1)), F.max("idx")).first()
    assert tuple(left) == (n - m, n - m - 1)
    assert time.perf_counter() - begin < 120
