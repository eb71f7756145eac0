"""Satellite reports: alignment to points, nearest report, numbering, sky positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.operators import satellites, summary
from trackloom.plans.sequence import row_index
from trackloom.plans.skew import split_hot_tracks
from trackloom.registry import query
from trackloom.registry.fixtures import Q_TRACK, track, with_
from trackloom.sinks.document import satellite_documents

Q_POINTS = "points AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ts, seq) - 1 AS idx FROM track WHERE event_type <> 'error')"
Q_BURSTS = """bursts AS (SELECT track_id, seq, ts, CASE seq % 3 WHEN 0 THEN 'GP' WHEN 1 THEN 'GL' ELSE 'GA' END AS talker_id,
  list_transform(range(seq % 4), lambda j: {'prn': CAST((seq + j) % 32 + 1 AS INTEGER), 'elevation': CASE WHEN (seq + j) % 5 <> 0 THEN CAST((seq * 7 + j) % 91 AS INTEGER) END,
    'azimuth': CAST((seq * 11 + j * 13) % 360 AS INTEGER), 'snr': CASE WHEN (seq + j) % 4 <> 0 THEN CAST((seq + j) % 60 AS INTEGER) END}) AS s
  FROM track WHERE event_type = 'error')"""
Q_ALIGNED = """aligned AS (SELECT p.track_id, p.idx, p.ts, p.talker_id, b.ts AS burst_ts, b.s FROM
  (SELECT * FROM points JOIN (SELECT DISTINCT track_id, talker_id FROM bursts) USING (track_id)) p
  ASOF JOIN bursts b ON p.track_id = b.track_id AND p.talker_id = b.talker_id AND p.ts >= b.ts)"""
Q_NUMBERED = """numbered AS (SELECT *, dense_rank() OVER (PARTITION BY track_id, talker_id ORDER BY burst_ts) - 1 AS burst_idx FROM aligned)"""
B_SQL = with_(Q_TRACK, Q_BURSTS)
A_SQL = with_(Q_TRACK, Q_POINTS, Q_BURSTS, Q_ALIGNED, Q_NUMBERED)


def points(spark, sf) -> DataFrame:
    df = track(spark, sf).drop("chunk").where(F.col("event_type") != "error")
    return row_index(split_hot_tracks(df))


def bursts(spark, sf) -> DataFrame:
    q = F.col("seq")
    m = q % 3
    sats = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint")),
        lambda j: F.when(
            j < q % 4,
            F.struct(
                ((q + j) % 32 + 1).cast("int").alias("prn"),
                F.when((q + j) % 5 != 0, ((q * 7 + j) % 91).cast("int")).alias("elevation"),
                ((q * 11 + j * 13) % 360).cast("int").alias("azimuth"),
                F.when((q + j) % 4 != 0, ((q + j) % 60).cast("int")).alias("snr"),
            ),
        ),
    )
    return track(spark, sf).drop("chunk").where(F.col("event_type") == "error").select(
        "track_id",
        "seq",
        "ts",
        F.when(m == 0, "GP").when(m == 1, "GL").otherwise("GA").alias("talker_id"),
        F.filter(sats, lambda s: s.isNotNull()).alias("gsv_satellites"),
    )


def _aligned(spark, sf) -> DataFrame:
    return satellites.align_satellites(points(spark, sf), bursts(spark, sf))


@query(
    "align_satellites",
    A_SQL + "SELECT track_id, idx, talker_id, burst_ts, round((epoch_us(ts) - epoch_us(burst_ts)) / 1000000::DOUBLE, 6) AS age_seconds, CAST(len(s) AS INTEGER) AS n_sats FROM aligned",
)
def align_satellites(spark, sf):
    return _aligned(spark, sf).select(
        "track_id", "idx", "talker_id", "burst_ts", F.round("age_seconds", 6).alias("age_seconds"), F.size("satellites").alias("n_sats")
    )


@query("sort_by_index_and_talker", A_SQL + "SELECT track_id, idx, talker_id, row_number() OVER (PARTITION BY track_id ORDER BY idx, talker_id) - 1 AS place FROM aligned")
def sort_by_index_and_talker(spark, sf):
    df = split_hot_tracks(_aligned(spark, sf).select("track_id", "idx", "talker_id"), order="idx")
    return row_index(df, order=("idx", "talker_id"), name="place").select("track_id", "idx", "talker_id", "place")


@query("nearest_burst", B_SQL + "SELECT track_id, seq, ts, talker_id FROM bursts WHERE (track_id, ts) IN (SELECT (track_id, max(ts)) FROM bursts GROUP BY track_id)")
def nearest_burst(spark, sf):
    return satellites.nearest_burst(bursts(spark, sf)).select("track_id", "seq", "ts", "talker_id")


_NEAREST = "SELECT (track_id, arg_min(ts, {'g': abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), 't': ts})) FROM bursts GROUP BY track_id"


@query("nearest_burst_at", B_SQL + f"SELECT track_id, seq, ts, talker_id FROM bursts WHERE (track_id, ts) IN ({_NEAREST})")
def nearest_burst_at(spark, sf):
    b = bursts(spark, sf)
    at = b.select("track_id").distinct().withColumn("at", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
    return satellites.nearest_burst(b, at).select("track_id", "seq", "ts", "talker_id")


@query("burst_index", A_SQL + "SELECT DISTINCT track_id, talker_id, burst_ts, burst_idx FROM numbered")
def burst_index(spark, sf):
    return satellites.burst_index(_aligned(spark, sf)).select("track_id", "talker_id", "burst_ts", "burst_idx")


@query(
    "burst_lookup_join",
    A_SQL + """SELECT p.track_id, p.idx, t.talker_id, coalesce(n.burst_idx, -1) AS burst_idx FROM points p
JOIN (SELECT DISTINCT track_id, talker_id FROM aligned) t USING (track_id) LEFT JOIN numbered n ON n.track_id = p.track_id AND n.idx = p.idx AND n.talker_id = t.talker_id""",
)
def burst_lookup_join(spark, sf):
    return satellites.burst_lookup(points(spark, sf), _aligned(spark, sf)).select("track_id", "idx", "talker_id", "burst_idx")


@query("talkers", B_SQL + "SELECT track_id, string_agg(DISTINCT talker_id, ',' ORDER BY talker_id) AS talkers FROM bursts GROUP BY track_id")
def talkers(spark, sf):
    return summary.talkers(bursts(spark, sf)).select("track_id", F.array_join("talkers", ",").alias("talkers"))


@query("valid_satellites", B_SQL + "SELECT track_id, seq, CAST(len(list_filter(s, lambda x: x.elevation IS NOT NULL AND x.azimuth IS NOT NULL)) AS INTEGER) AS n_valid FROM bursts")
def valid_satellites(spark, sf):
    return bursts(spark, sf).select("track_id", "seq", F.size(S.valid_satellites("gsv_satellites")).alias("n_valid"))


@query(
    "sky_polar",
    B_SQL + """SELECT track_id, ts, talker_id, x.prn AS prn, round(90 - x.elevation, 6)::DOUBLE AS r, x.azimuth::DOUBLE AS theta, round(CASE WHEN x.snr > 0 THEN greatest(8, least(x.snr * 0.6::DOUBLE, 30)) ELSE 8 END, 6) AS size,
  round((90 - x.elevation) / 90 * sin(radians(x.azimuth)), 7) + 0 AS sky_x, round(-(90 - x.elevation) / 90 * cos(radians(x.azimuth)), 7) + 0 AS sky_y
FROM (SELECT *, unnest(s) AS x FROM bursts) WHERE x.elevation IS NOT NULL AND x.azimuth IS NOT NULL""",
)
def sky_polar(spark, sf):
    df = satellites.satellite_rows(bursts(spark, sf))
    return df.select(
        "track_id", "ts", "talker_id", "prn", F.col("r").cast("double").alias("r"), "theta", F.round("size", 6).alias("size"),
        (F.round("x", 7) + 0).alias("sky_x"), (F.round("y", 7) + 0).alias("sky_y"),
    )


@query(
    "write_satellite_document",
    A_SQL + """SELECT track_id, CAST(0 AS BIGINT) AS part, (SELECT string_agg(DISTINCT talker_id, ',' ORDER BY talker_id) FROM aligned a WHERE a.track_id = p.track_id) AS talkers,
  CAST((SELECT count(DISTINCT (talker_id, burst_ts)) FROM aligned a WHERE a.track_id = p.track_id) AS BIGINT) AS n_bursts, count(*) AS n_points
FROM points p WHERE track_id IN (SELECT track_id FROM aligned) GROUP BY track_id""",
)
def write_satellite_document(spark, sf):
    """The documents, read back as JSON and summed up."""
    docs = satellite_documents(points(spark, sf), _aligned(spark, sf))
    kind = "struct<talkers:array<string>,bursts_by_talker:map<string,array<struct<ts_ms:bigint>>>,burst_idx_by_track:map<string,array<bigint>>>"
    df = docs.withColumn("d", F.from_json("document", kind))
    n_bursts = F.aggregate(F.map_values("d.bursts_by_talker"), F.lit(0).cast("bigint"), lambda a, x: a + F.size(x))
    return df.select(
        "track_id", "part", F.array_join("d.talkers", ",").alias("talkers"), n_bursts.alias("n_bursts"),
        F.size(F.map_values("d.burst_idx_by_track")[0]).cast("bigint").alias("n_points"),
    )
