"""Scalar functions, windows along a track, per-track aggregates and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.operators import clean, enrich, kinematics, segments, summary
from trackloom.operators.consolidate import interpolate_linear
from trackloom.plans.sequence import row_index
from trackloom.registry import query
from trackloom.registry.fixtures import Q_IDX, Q_TRACK, table, track, with_

T = with_(Q_TRACK)
P = with_(Q_TRACK, Q_IDX)
W = "WINDOW w AS (PARTITION BY track_id ORDER BY ts, seq)"

Q_STEPS = f"""steps AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon,
  (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000::DOUBLE AS dt_s FROM pts {W})"""
Q_DIST = f"""dist AS (SELECT *, CASE WHEN dt_s > 0 THEN {S.geodesic_sql('plat', 'plon', 'lat', 'lon')} END AS distance_m FROM steps)"""
Q_SPEED = """speeds AS (SELECT *, distance_m / dt_s * 3.6::DOUBLE AS speed_geodesic_kmh,
  distance_m / dt_s * 1.94384::DOUBLE AS speed_geodesic_knots FROM dist)"""
D = with_(Q_TRACK, Q_IDX, Q_STEPS, Q_DIST, Q_SPEED)


def rounded(df: DataFrame, keep: list[str], **decimals: int) -> DataFrame:
    return df.select(*keep, *[F.round(F.col(c), n).alias(c) for c, n in decimals.items()])


# --- scalar functions -----------------------------------------------------------------------


@query("geodesic_m", T + f"SELECT track_id, seq, round({S.geodesic_sql('lat', 'lon', 'lat + hdop / 100', 'lon - hdop / 50')}, 3) AS metres FROM track")
def geodesic_m(spark, sf):
    shifted = S.geodesic_m("lat", "lon", F.col("lat") + F.col("hdop") / 100, F.col("lon") - F.col("hdop") / 50)
    return track(spark, sf).select("track_id", "seq", F.round(shifted, 3).alias("metres"))


@query(
    "signed_coord",
    T + """SELECT track_id, seq, CASE WHEN d IN ('S', 'W') THEN -lat WHEN d IS NOT NULL THEN lat END AS signed_lat
FROM (SELECT *, CASE seq % 5 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'E' WHEN 3 THEN 'W' END AS d FROM track)""",
)
def signed_coord(spark, sf):
    m = F.col("seq") % 5
    d = F.when(m == 0, "N").when(m == 1, "S").when(m == 2, "E").when(m == 3, "W")
    df = track(spark, sf).withColumn("d", d)
    return df.select("track_id", "seq", S.signed_coord("lat", "d").alias("signed_lat"))


@query(
    "dm_to_deg",
    """SELECT event_id, round(CASE WHEN event_id % 8 = 0 THEN NULL ELSE floor(v / 100) + (v - floor(v / 100) * 100) / 60 END, 9) AS deg,
  round((40 + event_id % 50) + (event_id % 60000) / 1000::DOUBLE / 60::DOUBLE, 9) AS igc_deg
FROM (SELECT event_id, CAST(CAST(event_id % 180 AS VARCHAR) || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') AS DOUBLE) AS v FROM events)""",
)
def dm_to_deg(spark, sf):
    e = F.col("event_id")

    def text(x, n):
        return F.lpad(x.cast("string"), n, "0")

    dm = F.concat((e % 180).cast("string"), text(e % 60, 2), F.lit("."), text(e % 10000, 4))
    df = table(spark, sf, "events").withColumn("dm", F.when(e % 16 == 0, "").when(e % 8 == 0, "x").otherwise(dm))
    igc = S.milli_minutes_to_deg(F.lit(40) + e % 50, e % 60000)
    return df.select("event_id", F.round(S.dm_to_deg("dm"), 9).alias("deg"), F.round(igc, 9).alias("igc_deg"))


@query(
    "unit_conversions",
    T + """SELECT track_id, seq, round(speed_kmh * 1.852::DOUBLE, 6) AS knots_as_kmh, round(speed_kmh * 3.6::DOUBLE, 6) AS mps_as_kmh,
  round(speed_kmh * 1.94384::DOUBLE, 6) AS mps_as_knots, round(speed_kmh / 3.6::DOUBLE, 6) AS kmh_as_mps FROM track""",
)
def unit_conversions(spark, sf):
    v = "speed_kmh"
    out = {"knots_as_kmh": S.knots_to_kmh(v), "mps_as_kmh": S.mps_to_kmh(v), "mps_as_knots": S.mps_to_knots(v), "kmh_as_mps": S.kmh_to_mps(v)}
    return track(spark, sf).select("track_id", "seq", *[F.round(c, 6).alias(n) for n, c in out.items()])


@query(
    "local_xy",
    T + """SELECT track_id, seq, round((lon - 8) * (111320::DOUBLE * cos(radians(47.5::DOUBLE))), 4) AS x_m,
  round((lat - 47.5::DOUBLE) * 111320::DOUBLE, 4) AS y_m FROM track""",
)
def local_xy(spark, sf):
    x, y = S.local_xy("lat", "lon", F.lit(47.5), F.lit(8.0))
    return track(spark, sf).select("track_id", "seq", F.round(x, 4).alias("x_m"), F.round(y, 4).alias("y_m"))


@query("metres_per_degree", T + "SELECT track_id, seq, round(111320::DOUBLE * cos(radians(lat)), 5) AS east_m, 110540::DOUBLE AS north_m FROM track")
def metres_per_degree(spark, sf):
    east, north = S.metres_per_degree("lat")
    return track(spark, sf).select("track_id", "seq", F.round(east, 5).alias("east_m"), north.alias("north_m"))


@query(
    "unify_speed",
    T + """SELECT track_id, seq, coalesce(a, b) AS knots, round(coalesce(c, coalesce(a, b) * 1.852::DOUBLE), 6) AS kmh
FROM (SELECT track_id, seq, CASE WHEN seq % 3 <> 0 THEN speed_kmh END AS a, CASE WHEN seq % 2 = 0 THEN hdop END AS b,
  CASE WHEN seq % 5 = 0 THEN speed_kmh * 2 END AS c FROM track)""",
)
def unify_speed(spark, sf):
    q = F.col("seq")
    df = track(spark, sf).withColumns(
        {"a": F.when(q % 3 != 0, F.col("speed_kmh")), "b": F.when(q % 2 == 0, F.col("hdop")), "c": F.when(q % 5 == 0, F.col("speed_kmh") * 2)}
    )
    knots, kmh = S.unify_speed("a", "b", "c")
    return df.select("track_id", "seq", knots.alias("knots"), F.round(kmh, 6).alias("kmh"))


@query("iso_time", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN ts - CASE WHEN event_id % 3 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END END AS ts FROM events")
def iso_time(spark, sf):
    e = F.col("event_id")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(e % 3 == 0, "+02:00").otherwise("Z"))
    df = table(spark, sf, "events").withColumn("text", F.when(e % 10 == 0, "not a time").otherwise(text))
    return df.select("event_id", S.iso_time("text").cast("timestamp_ntz").alias("ts"))


@query("epoch_ms", "SELECT event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM events")
def epoch_ms(spark, sf):
    return table(spark, sf, "events").select("event_id", S.epoch_ms("ts").alias("ms"))


@query("round_or_null", T + "SELECT track_id, seq, round(lat, 7) AS lat7, round(alt, 3) AS alt3, CASE WHEN seq % 4 = 0 THEN NULL ELSE round(hdop, 2) END AS hdop2 FROM track")
def round_or_null(spark, sf):
    odd = F.when(F.col("seq") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("hdop"))
    return track(spark, sf).select(
        "track_id", "seq", S.round_or_null("lat", 7).alias("lat7"), S.round_or_null("alt", 3).alias("alt3"), S.round_or_null(odd, 2).alias("hdop2")
    )


@query(
    "format_number",
    """SELECT event_id, regexp_replace(regexp_replace(printf('%.2f', v), '0+$', ''), '\\.$', '') AS shown,
  printf('%.0f', v2) AS whole
FROM (SELECT event_id, (event_id % 1000) / 8::DOUBLE + 1 / 64::DOUBLE AS v, CAST(event_id % 90 AS DOUBLE) AS v2 FROM events)""",
)
def format_number(spark, sf):
    e = F.col("event_id")
    v = (e % 1000) / S.number(8) + S.number(1 / 64)
    return table(spark, sf, "events").select(
        "event_id", S.format_number(v, 2).alias("shown"), S.format_number((e % 90).cast("double"), 0).alias("whole")
    )


@query("xml_escape", "SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5 FROM documents")
def xml_escape(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.xml_escape("text")).alias("escaped_md5"))


@query(
    "safe_cast",
    """SELECT event_id, try_cast(nullif(x, '') AS INTEGER) AS plain, coalesce(try_cast(nullif(x, '') AS INTEGER), 0) AS with_default,
  coalesce(try_cast(nullif(y, '') AS DOUBLE), -1) AS real
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'ab' WHEN 2 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS x,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '--' ELSE CAST(event_id % 100 AS VARCHAR) || '.5' END AS y FROM events)""",
)
def safe_cast(spark, sf):
    e = F.col("event_id")
    x = F.when(e % 4 == 0, "").when(e % 4 == 1, "ab").when(e % 4 == 3, e.cast("string"))
    y = F.when(e % 5 == 0, "").when(e % 5 == 1, "--").otherwise(F.concat((e % 100).cast("string"), F.lit(".5")))
    return table(spark, sf, "events").select(
        "event_id", S.safe_cast(x, "int").alias("plain"), S.safe_cast(x, "int", 0).alias("with_default"), S.safe_cast(y, "double", -1).alias("real")
    )


_NUM = {"lat": (6, "°"), "lon": (6, "°"), "alt": (1, " m"), "speed_kmh": (1, " km/h")}


def _sql_shown(c: str, n: int, suffix: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'N/A' ELSE printf('%.{n}f', {c}) || '{suffix}' END"


@query(
    "point_label",
    P + f"""SELECT track_id, seq, '<b>Index:</b> ' || idx || '<br><b>Zeit:</b> ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC<br><b>Position:</b> '
  || {_sql_shown('lat', 6, '°')} || ' N, ' || {_sql_shown('lon', 6, '°')} || ' E<br><b>Höhe:</b> ' || {_sql_shown('a', 1, ' m')}
  || '<br><br><b>GPS-Geschwindigkeit:</b> ' || {_sql_shown('v', 1, ' km/h')} || '<br><b>Berechnet (geodesic):</b> ' || {_sql_shown('hdop', 1, ' km/h')}
  || '<br><b>Differenz:</b> N/A<br><b>Distanz zu Vorgänger:</b> ' || {_sql_shown('hdop', 1, ' m')}
  || '<br><b>Geländehöhe:</b> ' || {_sql_shown('a', 1, ' m')} || '<br><b>Höhe über Grund:</b> N/A' AS label
FROM (SELECT *, floor(alt) + 0.2::DOUBLE AS a, floor(speed_kmh) AS v FROM pts)""",
)
def point_label(spark, sf):
    df = row_index(track(spark, sf)).withColumns({"a": F.floor("alt") + S.number(0.2), "v": F.floor("speed_kmh"), "none": F.lit(None).cast("double")})
    label = S.point_label("idx", "ts", "lat", "lon", "a", "v", "hdop", "none", "hdop", terrain="a", above="none")
    return df.select("track_id", "seq", label.alias("label"))


@query(
    "display_formats",
    T + """SELECT track_id, seq, CASE WHEN v IS NULL THEN '–' ELSE printf('%.1f', v) || ' km/h' END AS speed,
  CASE WHEN alt IS NULL THEN '–' ELSE CAST(floor(alt + 0.5::DOUBLE) AS BIGINT) || ' m' END AS altitude,
  CASE WHEN seq >= 1000 THEN printf('%.2f', seq / 1000::DOUBLE) || ' km' ELSE seq || ' m' END AS distance,
  CASE WHEN s // 3600 > 0 THEN (s // 3600) || 'h ' || ((s % 3600) // 60) || 'min' WHEN s // 60 > 0 THEN (s // 60) || 'min ' || (s % 60) || 's'
    ELSE s || 's' END AS duration,
  strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' UTC' AS utc
FROM (SELECT *, floor(speed_kmh) AS v, seq * 7 % 9000 AS s FROM track)""",
)
def display_formats(spark, sf):
    q = F.col("seq")
    df = track(spark, sf).withColumn("v", F.floor("speed_kmh"))
    return df.select(
        "track_id",
        "seq",
        S.format_speed("v").alias("speed"),
        S.format_altitude("alt").alias("altitude"),
        S.format_distance(q).alias("distance"),
        S.format_duration(q * 7 % 9000).alias("duration"),
        S.format_utc("ts").alias("utc"),
    )


@query(
    "fix_label",
    T + """SELECT track_id, seq, CASE seq % 10 WHEN 0 THEN 'Kein Fix' WHEN 1 THEN 'GPS' WHEN 2 THEN 'DGPS' WHEN 3 THEN 'PPS' WHEN 4 THEN 'RTK Fix'
  WHEN 5 THEN 'RTK Float' WHEN 6 THEN 'Geschätzt' WHEN 7 THEN 'Manuell' WHEN 8 THEN 'Simuliert' ELSE '9' END AS fix FROM track""",
)
def fix_label(spark, sf):
    return track(spark, sf).select("track_id", "seq", S.fix_label(F.col("seq") % 10).alias("fix"))


@query(
    "talker_name",
    T + """SELECT track_id, seq, CASE t WHEN 'GP' THEN 'GPS' WHEN 'GL' THEN 'GLONASS' WHEN 'GA' THEN 'Galileo' WHEN 'GB' THEN 'BeiDou' WHEN 'BD' THEN 'BeiDou'
  WHEN 'GQ' THEN 'QZSS' WHEN 'GI' THEN 'NavIC' WHEN 'GN' THEN 'Multi-GNSS' ELSE t END AS constellation
FROM (SELECT *, ['GP', 'GL', 'GA', 'GB', 'BD', 'GQ', 'GI', 'GN', 'XX'][CAST(1 + seq % 9 AS BIGINT)] AS t FROM track)""",
)
def talker_name(spark, sf):
    codes = F.array(*[F.lit(c) for c in ("GP", "GL", "GA", "GB", "BD", "GQ", "GI", "GN", "XX")])
    t = F.element_at(codes, (F.col("seq") % 9 + 1).cast("int"))
    return track(spark, sf).select("track_id", "seq", S.talker_name(t).alias("constellation"))


@query(
    "flight_class",
    T + """SELECT track_id, seq, CASE WHEN agl < 152.4 THEN 'low' WHEN agl < 304.8 THEN 'mid' WHEN msl < 1524 THEN 'transition' ELSE 'high' END AS flight
FROM (SELECT *, CASE WHEN seq % 6 <> 0 THEN seq % 500 END AS agl, CASE WHEN seq % 4 <> 0 THEN seq * 3 % 3000 END AS msl FROM track)""",
)
def flight_class(spark, sf):
    q = F.col("seq")
    df = track(spark, sf).withColumns({"agl": F.when(q % 6 != 0, q % 500), "msl": F.when(q % 4 != 0, q * 3 % 3000)})
    return df.select("track_id", "seq", S.flight_class("msl", "agl").alias("flight"))


@query("drone_class", T + "SELECT track_id, seq, CASE WHEN seq % 6 = 0 THEN 'unknown' WHEN seq % 200 <= 100 THEN 'ok' ELSE 'violation' END AS drone FROM track")
def drone_class(spark, sf):
    q = F.col("seq")
    return track(spark, sf).select("track_id", "seq", S.drone_class(F.when(q % 6 != 0, q % 200)).alias("drone"))


@query(
    "z_offset_view",
    T + """SELECT track_id, seq, round(alt + 12.5, 6) AS alt_view, round(alt + 12.5 - (380 + hdop), 6) AS above_view,
  round(base + ((coalesce(alt, base) + 12.5) - base) * 3, 6) AS alt_exaggerated
FROM (SELECT *, coalesce(min(alt) OVER (PARTITION BY track_id), 0) AS base FROM track)""",
)
def z_offset_view(spark, sf):
    from trackloom.plans.skew import attach_track

    df = track(spark, sf)
    df = attach_track(df, summary.min_altitude(df)).withColumn("terrain", F.lit(380) + F.col("hdop"))
    view = S.z_offset_view("alt", "terrain", "alt_base", 12.5, 3.0)
    return df.select("track_id", "seq", *[F.round(c, 6).alias(n) for n, c in view.items()])


@query(
    "color_channel",
    T + """SELECT track_id, seq, CASE mode WHEN 'altitude' THEN alt WHEN 'altitude_gnd' THEN alt - 390 WHEN 'energy' THEN alt + hdop WHEN 'accuracy' THEN hdop ELSE speed_kmh END AS shown
FROM (SELECT *, ['altitude', 'altitude_gnd', 'energy', 'accuracy', 'speed', 'flight'][CAST(1 + seq % 6 AS BIGINT)] AS mode FROM track)""",
)
def color_channel(spark, sf):
    modes = F.array(*[F.lit(m) for m in ("altitude", "altitude_gnd", "energy", "accuracy", "speed", "flight")])
    df = track(spark, sf).withColumns(
        {
            "mode": F.element_at(modes, (F.col("seq") % 6 + 1).cast("int")),
            "above_terrain": F.col("alt") - 390,
            "energy_height_m": F.col("alt") + F.col("hdop"),
        }
    )
    return df.select("track_id", "seq", S.color_channel("mode").alias("shown"))


# --- windows --------------------------------------------------------------------------------


@query("row_index", P + "SELECT track_id, seq, idx FROM pts")
def row_index_query(spark, sf):
    return row_index(track(spark, sf)).select("track_id", "seq", "idx")


@query("step_distance", D + "SELECT track_id, seq, round(dt_s, 6) AS dt_s, round(distance_m, 3) AS distance_m FROM dist")
def step_distance(spark, sf):
    return rounded(enrich.step_distance(track(spark, sf)), ["track_id", "seq"], dt_s=6, distance_m=3)


@query("geodesic_speed", D + "SELECT track_id, seq, round(speed_geodesic_kmh, 4) AS speed_geodesic_kmh, round(speed_geodesic_knots, 4) AS speed_geodesic_knots FROM speeds")
def geodesic_speed(spark, sf):
    df = enrich.geodesic_speed(enrich.step_distance(track(spark, sf)))
    return rounded(df, ["track_id", "seq"], speed_geodesic_kmh=4, speed_geodesic_knots=4)


@query(
    "fill_speed_if_absent",
    D + """SELECT track_id, seq, round(CASE WHEN count(v) OVER (PARTITION BY track_id) = 0 THEN speed_geodesic_kmh ELSE v END, 4) AS speed_kmh
FROM (SELECT *, CASE WHEN track_id % 3 <> 0 THEN speed_kmh END AS v FROM speeds)""",
)
def fill_speed_if_absent(spark, sf):
    df = track(spark, sf).withColumn("speed_kmh", F.when(F.col("track_id") % 3 != 0, F.col("speed_kmh")))
    df = enrich.geodesic_speed(enrich.step_distance(df.withColumn("speed_knots", F.col("speed_kmh"))))
    return rounded(enrich.fill_speed_if_absent(df), ["track_id", "seq"], speed_kmh=4)


@query(
    "speed_diff",
    D + "SELECT track_id, seq, round(speed_geodesic_kmh - speed_kmh, 4) AS speed_diff_kmh, round(speed_geodesic_knots - speed_kmh / 2, 4) AS speed_diff_knots FROM speeds",
)
def speed_diff(spark, sf):
    df = enrich.geodesic_speed(enrich.step_distance(track(spark, sf).withColumn("speed_knots", F.col("speed_kmh") / 2)))
    return rounded(enrich.speed_diff(df), ["track_id", "seq"], speed_diff_kmh=4, speed_diff_knots=4)


Q_FILL = f"""seen AS (SELECT *, last_value(CASE WHEN alt IS NOT NULL THEN {{{{'v': alt, 'i': {{i}}}}}} END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY idx) AS p,
  last_value(CASE WHEN alt IS NOT NULL THEN {{{{'v': alt, 'i': {{i}}}}}} END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY idx DESC) AS n FROM pts)"""
_FILLED = "round(CASE WHEN alt IS NOT NULL THEN alt WHEN p IS NULL THEN n.v WHEN n IS NULL THEN p.v ELSE p.v + (n.v - p.v) * ({i} - p.i) / (n.i - p.i) END, 6) AS alt"


@query("interpolate_linear", with_(Q_TRACK, Q_IDX, Q_FILL.format(i="idx")) + f"SELECT track_id, seq, {_FILLED.format(i='idx')} FROM seen")
def interpolate(spark, sf):
    return rounded(interpolate_linear(track(spark, sf), ["alt"]), ["track_id", "seq"], alt=6)


@query(
    "interpolate_by_time",
    with_(Q_TRACK, Q_IDX, Q_FILL.format(i="epoch_us(ts)")) + f"SELECT track_id, seq, {_FILLED.format(i='epoch_us(ts)')} FROM seen",
)
def interpolate_by_time(spark, sf):
    return rounded(interpolate_linear(track(spark, sf), ["alt"], by="time"), ["track_id", "seq"], alt=6)


def sql_derivative(v: str, source: str, name: str, out: str) -> str:
    """WITH item: ``source`` plus the time derivative of ``v``."""
    row = f"{{'v': {v}, 't': us}}"
    return f"""{out}_n AS (SELECT *, coalesce(lag({row}) OVER w, {row}) AS lo_{out}, coalesce(lead({row}) OVER w, {row}) AS hi_{out}
  FROM {source} WINDOW w AS (PARTITION BY track_id ORDER BY idx)),
{out} AS (SELECT *, CASE WHEN hi_{out}.t > lo_{out}.t THEN (hi_{out}.v - lo_{out}.v) / ((hi_{out}.t - lo_{out}.t) / 1000000::DOUBLE) END AS {name} FROM {out}_n)"""


Q_US = "ptu AS (SELECT *, epoch_us(ts) AS us FROM pts)"
Q_ENERGY = ",\n".join(
    [
        Q_US,
        sql_derivative("alt", "ptu", "vz0", "k1"),
        """k2 AS (SELECT *, coalesce(vz0, 0) AS vz, sqrt(speed_kmh / 3.6::DOUBLE * (speed_kmh / 3.6::DOUBLE) + coalesce(vz0, 0) * coalesce(vz0, 0)) AS v3 FROM k1)""",
        "k3 AS (SELECT *, alt + v3 * v3 / 19.6133::DOUBLE AS eh FROM k2)",
        sql_derivative("v3", "k3", "accel", "k4"),
        sql_derivative("eh", "k4", "er", "k5"),
    ]
)
E_SQL = with_(Q_TRACK, Q_IDX, Q_ENERGY)


@query("central_derivative", with_(Q_TRACK, Q_IDX, Q_US, sql_derivative("alt", "ptu", "rate", "k1")) + "SELECT track_id, seq, round(rate, 9) AS rate FROM k1")
def central_derivative(spark, sf):
    return rounded(kinematics.central_derivative(track(spark, sf), "alt", "rate"), ["track_id", "seq"], rate=9)


@query("vertical_speed", E_SQL + "SELECT track_id, seq, round(vz, 9) AS vertical_speed_mps FROM k5")
def vertical_speed(spark, sf):
    return rounded(kinematics.vertical_speed(track(spark, sf)), ["track_id", "seq"], vertical_speed_mps=9)


@query("speed_3d", E_SQL + "SELECT track_id, seq, round(v3, 7) AS speed_3d_mps FROM k5")
def speed_3d(spark, sf):
    return rounded(kinematics.energy_profile(track(spark, sf)), ["track_id", "seq"], speed_3d_mps=7)


@query("acceleration_3d", E_SQL + "SELECT track_id, seq, round(accel, 9) AS accel_mps2 FROM k5")
def acceleration_3d(spark, sf):
    return rounded(kinematics.energy_profile(track(spark, sf)), ["track_id", "seq"], accel_mps2=9)


@query("energy_height", E_SQL + "SELECT track_id, seq, round(eh, 6) AS energy_height_m FROM k5")
def energy_height(spark, sf):
    return rounded(kinematics.energy_profile(track(spark, sf)), ["track_id", "seq"], energy_height_m=6)


@query("energy_rate", E_SQL + "SELECT track_id, seq, round(er, 8) AS energy_rate_mps FROM k5")
def energy_rate(spark, sf):
    return rounded(kinematics.energy_profile(track(spark, sf)), ["track_id", "seq"], energy_rate_mps=8)


# a quicker clock, so that some tracks move fast enough to have a heading
Q_FAST = "fast AS (SELECT *, seq * 1000000 AS us, row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS idx FROM track)"
Q_VECTOR = ",\n".join(
    [
        Q_FAST,
        """v0 AS (SELECT *, lon * 111320::DOUBLE * cos(radians(avg(lat) OVER (PARTITION BY track_id))) AS east, lat * 111320::DOUBLE AS north,
  count(*) OVER (PARTITION BY track_id) AS n FROM fast)""",
        sql_derivative("east", "v0", "ve", "v1"),
        sql_derivative("north", "v1", "vn", "v2"),
        sql_derivative("alt", "v2", "vz", "v3"),
        sql_derivative("ve", "v3", "ae", "v4"),
        sql_derivative("vn", "v4", "an", "v5"),
        sql_derivative("vz", "v5", "az", "v6"),
        """v7 AS (SELECT *, CASE WHEN n >= 3 AND sqrt(ve * ve + vn * vn) > 0.5 THEN ve / sqrt(ve * ve + vn * vn) END AS he,
  CASE WHEN n >= 3 AND sqrt(ve * ve + vn * vn) > 0.5 THEN vn / sqrt(ve * ve + vn * vn) END AS hn FROM v6)""",
    ]
)
V_SQL = with_(Q_TRACK, Q_VECTOR)


def _fast(spark, sf) -> DataFrame:
    from trackloom.plans.skew import split_hot_tracks

    clock = F.timestamp_seconds(F.col("seq")).cast("timestamp_ntz")
    return split_hot_tracks(track(spark, sf).drop("chunk").withColumn("ts", clock))


@query("heading", V_SQL + "SELECT track_id, seq, round(he, 6) AS heading_e, round(hn, 6) AS heading_n FROM v7")
def heading(spark, sf):
    return rounded(kinematics.heading(_fast(spark, sf)), ["track_id", "seq"], heading_e=6, heading_n=6)


@query(
    "decompose_acceleration",
    V_SQL + """SELECT track_id, seq, round(ae * he + an * hn, 6) AS accel_long_mps2, round(he * an - hn * ae, 6) AS accel_lateral_mps2,
  round(CASE WHEN n >= 3 THEN az END, 7) AS accel_vertical_mps2 FROM v7""",
)
def decompose_acceleration(spark, sf):
    df = kinematics.decompose_acceleration(_fast(spark, sf))
    return rounded(df, ["track_id", "seq"], accel_long_mps2=6, accel_lateral_mps2=6, accel_vertical_mps2=7)


@query(
    "moving_average",
    P + """SELECT track_id, seq, round(CASE WHEN alt IS NOT NULL THEN avg(alt) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 6) AS smooth FROM pts""",
)
def moving_average(spark, sf):
    return rounded(kinematics.moving_average(track(spark, sf), "alt", "smooth", 5), ["track_id", "seq"], smooth=6)


@query("same_timestamp_group", T + "SELECT track_id, seq, count(*) OVER (PARTITION BY track_id, date_trunc('hour', ts)) AS n_same_ts FROM track")
def same_timestamp_group(spark, sf):
    df = track(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    return clean.same_timestamp_group(df).select("track_id", "seq", "n_same_ts")


@query(
    "sort_by_time",
    T + """SELECT track_id, seq, row_number() OVER (PARTITION BY track_id ORDER BY t ASC NULLS FIRST, seq) - 1 AS place
FROM (SELECT *, CASE WHEN seq % 12 <> 0 THEN date_trunc('hour', ts) END AS t FROM track)""",
)
def sort_by_time(spark, sf):
    df = track(spark, sf).drop("chunk").withColumn("ts", F.when(F.col("seq") % 12 != 0, F.date_trunc("hour", "ts")))
    from trackloom.plans.skew import split_hot_tracks

    return row_index(split_hot_tracks(df), name="place").select("track_id", "seq", "place")


# --- aggregates -----------------------------------------------------------------------------


@query("track_bounds", T + "SELECT track_id, round(min(lon) - 0.25::DOUBLE, 7) AS lon_min, round(min(lat) - 0.25::DOUBLE, 7) AS lat_min, round(max(lon) + 0.25::DOUBLE, 7) AS lon_max, round(max(lat) + 0.25::DOUBLE, 7) AS lat_max FROM track GROUP BY track_id")
def track_bounds(spark, sf):
    return rounded(summary.track_bounds(track(spark, sf), 0.25), ["track_id"], lon_min=7, lat_min=7, lon_max=7, lat_max=7)


@query(
    "track_summary",
    D + """SELECT track_id, count(*) AS n_points, round(coalesce(sum(distance_m), 0), 2) AS total_distance_m,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000::DOUBLE, 6) AS duration_s, min(ts) AS ts_start, max(ts) AS ts_end,
  round(min(lon), 7) AS lon_min, round(min(lat), 7) AS lat_min, round(max(lon), 7) AS lon_max, round(max(lat), 7) AS lat_max
FROM speeds GROUP BY track_id""",
)
def track_summary(spark, sf):
    df = summary.track_summary(enrich.step_distance(track(spark, sf)))
    return rounded(
        df, ["track_id", "n_points", "ts_start", "ts_end"], total_distance_m=2, duration_s=6, lon_min=7, lat_min=7, lon_max=7, lat_max=7
    )


@query("distance_stats", D + "SELECT track_id, round(coalesce(sum(distance_m), 0), 2) AS total_distance_m, round(max(speed_geodesic_kmh), 4) AS max_geodesic_kmh FROM speeds GROUP BY track_id")
def distance_stats(spark, sf):
    df = enrich.geodesic_speed(enrich.step_distance(track(spark, sf)))
    return rounded(summary.distance_stats(df), ["track_id"], total_distance_m=2, max_geodesic_kmh=4)


@query(
    "enrich_speed",
    D + """SELECT track_id, seq, idx, round(distance_m, 3) AS distance_m, round(speed_geodesic_kmh, 4) AS speed_geodesic_kmh,
  round(speed_geodesic_kmh - speed_kmh, 4) AS speed_diff_kmh FROM speeds""",
)
def enrich_speed(spark, sf):
    df = enrich.enrich_speed(track(spark, sf))
    return rounded(df, ["track_id", "seq", "idx"], distance_m=3, speed_geodesic_kmh=4, speed_diff_kmh=4)


@query(
    "duplicate_times",
    T + """SELECT track_id, CAST(count(*) AS BIGINT) AS n_points, CAST(count(*) - count(DISTINCT date_trunc('hour', ts)) AS BIGINT) AS n_duplicates,
  round((count(*) - count(DISTINCT date_trunc('hour', ts))) * 100::DOUBLE / count(*), 6) AS percent FROM track GROUP BY track_id""",
)
def duplicate_times(spark, sf):
    df = clean.duplicate_times(track(spark, sf).withColumn("ts", F.date_trunc("hour", "ts")))
    return rounded(df, ["track_id", "n_points", "n_duplicates"], percent=6)


@query("min_altitude", T + "SELECT track_id, coalesce(min(alt), 0) AS alt_base FROM track GROUP BY track_id")
def min_altitude(spark, sf):
    return summary.min_altitude(track(spark, sf))


@query("reference_point", T + "SELECT track_id, round(avg(lat), 8) AS ref_lat, round(avg(lon), 8) AS ref_lon FROM track GROUP BY track_id")
def reference_point(spark, sf):
    return rounded(summary.reference_point(track(spark, sf)), ["track_id"], ref_lat=8, ref_lon=8)


@query(
    "extents",
    T + """SELECT track_id, round(x, 4) AS x_range_m, round(y, 4) AS y_range_m, round(z, 4) AS z_range_m, round(x / greatest(x, y, 1), 7) AS aspect_x,
  round(y / greatest(x, y, 1), 7) AS aspect_y, round(greatest(z, 1) / greatest(x, y, 1) * 20, 7) AS aspect_z
FROM (SELECT track_id, (max(lon) - min(lon)) * (111320::DOUBLE * cos(radians(avg(lat)))) AS x, (max(lat) - min(lat)) * 111320::DOUBLE AS y, max(alt) - min(alt) AS z
  FROM track GROUP BY track_id)""",
)
def extents(spark, sf):
    df = summary.extents(track(spark, sf), 20.0)
    return rounded(df, ["track_id"], x_range_m=4, y_range_m=4, z_range_m=4, aspect_x=7, aspect_y=7, aspect_z=7)


@query("valid_points", T + "SELECT track_id, seq FROM (SELECT *, CASE WHEN seq % 5 <> 0 THEN lat END AS la, CASE WHEN seq % 7 <> 0 THEN ts END AS t FROM track) WHERE la IS NOT NULL AND lon IS NOT NULL AND t IS NOT NULL")
def valid_points(spark, sf):
    q = F.col("seq")
    df = track(spark, sf).withColumns({"lat": F.when(q % 5 != 0, F.col("lat")), "ts": F.when(q % 7 != 0, F.col("ts"))})
    return clean.valid_points(df).select("track_id", "seq")


@query("dedup_first", T + "SELECT track_id, day, arg_min(seq, seq) AS seq, arg_min(hdop, seq) AS hdop FROM (SELECT *, date_trunc('day', ts) AS day FROM track) GROUP BY track_id, day")
def dedup_first(spark, sf):
    df = track(spark, sf).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return clean.dedup_first(df, ["track_id", "day"]).select("track_id", "day", "seq", "hdop")


@query("dedup_last", T + "SELECT track_id, day, arg_max(seq, seq) AS seq, arg_max(hdop, seq) AS hdop FROM (SELECT *, date_trunc('day', ts) AS day FROM track) GROUP BY track_id, day")
def dedup_last(spark, sf):
    df = track(spark, sf).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return clean.dedup_last(df, ["track_id", "day"]).select("track_id", "day", "seq", "hdop")


# --- segments -------------------------------------------------------------------------------

Q_TERR = "tpts AS (SELECT *, CASE WHEN seq % 9 <> 0 THEN 300 + hdop END AS terrain_elev FROM pts)"
Q_PAIRS = """pairs AS (SELECT * FROM (SELECT track_id, idx AS idx_a, lead(idx) OVER w AS idx_b, lon AS lon_a, lead(lon) OVER w AS lon_b, lat AS lat_a, lead(lat) OVER w AS lat_b,
  alt AS alt_a, lead(alt) OVER w AS alt_b, terrain_elev AS terrain_elev_a, lead(terrain_elev) OVER w AS terrain_elev_b, speed_kmh AS va, lead(speed_kmh) OVER w AS vb
  FROM tpts WINDOW w AS (PARTITION BY track_id ORDER BY idx)) WHERE idx_b IS NOT NULL)"""
Q_PARTS = """sized AS (SELECT p.*, b.alt_base, coalesce(alt_a, alt_base) AS za, coalesce(alt_b, alt_base) AS zb, sqrt((lon_b - lon_a) * (lon_b - lon_a) + (lat_b - lat_a) * (lat_b - lat_a)) AS span
  FROM pairs p JOIN (SELECT track_id, coalesce(min(alt), 0) AS alt_base FROM track GROUP BY track_id) b USING (track_id)),
counted AS (SELECT *, CASE WHEN span > 0.0009::DOUBLE THEN CAST(least(200, greatest(2, ceil(span / 0.0009::DOUBLE))) AS BIGINT) ELSE 1 END AS n_parts FROM sized),
parts AS (SELECT *, part / n_parts AS s0, (part + 1) / n_parts AS s1, terrain_elev_a IS NOT NULL AND terrain_elev_b IS NOT NULL AS both_t
  FROM (SELECT *, unnest(range(n_parts)) AS part FROM counted)),
cut AS (SELECT *, CASE WHEN n_parts = 1 THEN za ELSE za + (zb - za) * s0 END AS z0, CASE WHEN n_parts = 1 THEN zb ELSE za + (zb - za) * s1 END AS z1,
  CASE WHEN both_t AND n_parts > 1 THEN terrain_elev_a + (terrain_elev_b - terrain_elev_a) * s0 ELSE terrain_elev_a END AS t0,
  CASE WHEN both_t AND n_parts > 1 THEN terrain_elev_a + (terrain_elev_b - terrain_elev_a) * s1 ELSE terrain_elev_b END AS t1 FROM parts)"""
S_SQL = with_(Q_TRACK, Q_IDX, Q_TERR, Q_PAIRS, Q_PARTS)


def _terrain_track(spark, sf) -> DataFrame:
    terrain = F.when(F.col("seq") % 9 != 0, F.lit(300) + F.col("hdop"))
    return row_index(track(spark, sf)).withColumn("terrain_elev", terrain)


@query(
    "segment_pairs",
    with_(Q_TRACK, Q_IDX, Q_TERR, Q_PAIRS) + """SELECT track_id, idx_a, idx_b, lon_a, lon_b, alt_a, alt_b,
  round(CASE WHEN va IS NULL THEN vb WHEN vb IS NULL THEN va ELSE (va + vb) / 2 END, 6) AS t FROM pairs""",
)
def segment_pairs(spark, sf):
    df = segments.segment_pairs(_terrain_track(spark, sf), "speed_kmh")
    return df.select("track_id", "idx_a", "idx_b", "lon_a", "lon_b", "alt_a", "alt_b", F.round("t", 6).alias("t"))


@query(
    "densify_segments",
    S_SQL + """SELECT track_id, idx_a, CAST(part AS INTEGER) AS part, CAST(n_parts AS INTEGER) AS n_parts, round(CASE WHEN n_parts = 1 THEN lon_a ELSE lon_a + (lon_b - lon_a) * s0 END, 8) AS lon_a,
  round(CASE WHEN n_parts = 1 THEN lat_b ELSE lat_a + (lat_b - lat_a) * s1 END, 8) AS lat_b, round(z0, 5) AS alt_a, round(t1, 5) AS terrain_elev_b FROM cut""",
)
def densify_segments(spark, sf):
    df = _terrain_track(spark, sf)
    out = segments.densify_segments(segments.segment_pairs(df), summary.min_altitude(df))
    return rounded(out, ["track_id", "idx_a", "part", "n_parts"], lon_a=8, lat_b=8, alt_a=5, terrain_elev_b=5)


@query(
    "segment_heights",
    S_SQL + """SELECT track_id, idx_a, CAST(part AS INTEGER) AS part, round((z0 + z1) / 2, 5) AS alt_msl, round(CASE WHEN both_t THEN (z0 + z1) / 2 - (t0 + t1) / 2 END, 5) AS alt_agl,
  round(least(top, bot), 5) AS wall_base, round(abs(top - bot), 5) AS wall_height
FROM (SELECT *, ((alt_base + ((z0 + 5) - alt_base) * 2) + (alt_base + ((z1 + 5) - alt_base) * 2)) / 2 AS top,
  CASE WHEN both_t THEN alt_base + ((t0 + t1) / 2 - alt_base) * 2 ELSE 0 END AS bot FROM cut)""",
)
def segment_heights(spark, sf):
    out = segments.wall_segments(_terrain_track(spark, sf), z_offset=5.0, z_scale=2.0)
    return rounded(out, ["track_id", "idx_a", "part"], alt_msl=5, alt_agl=5, wall_base=5, wall_height=5)
