"""NMEA sentences: extraction, carried clocks, satellite groups, filters, consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import clean, consolidate, nmea
from trackloom.plans.pipelines import process_nmea
from trackloom.registry import query
from trackloom.registry.fixtures import (
    Q_BODIES,
    Q_LINES,
    Q_SENTENCES,
    Q_TRACK,
    lines,
    sentences,
    with_,
)
from trackloom.registry.points import rounded

# --- extraction -----------------------------------------------------------------------------


def _f(i: int) -> str:
    return f"nullif(trim(f[{i + 1}]), '')"


def _num(i: int, kind: str = "DOUBLE") -> str:
    return f"try_cast({_f(i)} AS {kind})"


def _deg(i: int) -> str:
    return f"(floor({_num(i)} / 100) + ({_num(i)} - floor({_num(i)} / 100) * 100) / 60)"


def _signed(i: int) -> str:
    return f"CASE WHEN {_f(i + 1)} IN ('S', 'W') THEN -{_deg(i)} WHEN {_f(i + 1)} IS NOT NULL THEN {_deg(i)} END"


_TIME = "(CAST(substr(f[2], 1, 2) AS BIGINT) * 3600 + CAST(substr(f[2], 3, 2) AS BIGINT) * 60) * 1000000 + CAST(round(CAST(substr(f[2], 5) AS DOUBLE) * 1000000) AS BIGINT)"
_DATE = "CAST(epoch_us(CAST('20' || substr(f[10], 5, 2) || '-' || substr(f[10], 3, 2) || '-' || substr(f[10], 1, 2) AS TIMESTAMP)) AS BIGINT)"
Q_FIELDS = f"""fields AS (SELECT track_id, line_no, substr(f[1], 1, 2) AS talker_id, substr(f[1], 3, 3) AS st, f,
  CASE WHEN substr(f[1], 3, 3) = 'RMC' AND {_f(9)} IS NOT NULL THEN {_DATE} END AS own_date,
  CASE WHEN substr(f[1], 3, 3) IN ('RMC', 'GGA') THEN {_TIME} END AS own_time
  FROM (SELECT track_id, line_no, string_split(body, ',') AS f FROM bodies WHERE fault IN (0, 3)))"""
F_SQL = with_(Q_BODIES, Q_FIELDS)


def _tokens(spark, sf) -> DataFrame:
    return nmea.tokenize(lines(spark, sf))


def _fields(spark, sf) -> DataFrame:
    return nmea.extract_fields(_tokens(spark, sf))


def _of(spark, sf, sentence: str) -> DataFrame:
    return _fields(spark, sf).where(F.col("sentence_type") == sentence)


@query(
    "nmea_tokenize",
    with_(Q_BODIES, Q_LINES) + """SELECT track_id, line_no, CASE WHEN fault = 2 THEN NULL ELSE computed END AS computed, CASE WHEN fault IN (1, 2) THEN 'malformed' ELSE 'parsed' END AS status,
  CASE WHEN fault IN (0, 3) THEN substr(body, 1, 2) END AS talker_id, CASE WHEN fault IN (0, 3) THEN substr(body, 3, 3) END AS sentence_type,
  CASE WHEN fault IN (0, 3) THEN CAST(len(string_split(body, ',')) AS INTEGER) END AS n_fields FROM lines""",
)
def nmea_tokenize(spark, sf):
    n = F.when(F.col("fields").isNotNull(), F.size("fields")).alias("n_fields")
    return _tokens(spark, sf).select("track_id", "line_no", "computed", "status", "talker_id", "sentence_type", n)


@query(
    "extract_rmc",
    F_SQL + f"""SELECT track_id, line_no, round({_signed(3)}, 9) AS lat, round({_signed(5)}, 9) AS lon, {_f(2)} AS rmc_status, {_num(7)} AS rmc_speed_knots,
  {_num(8)} AS rmc_true_course, {_num(10)} AS rmc_mag_variation, CAST(make_timestamp(own_date) AS DATE) AS own_date, own_time FROM fields WHERE st = 'RMC'""",
)
def extract_rmc(spark, sf):
    df = _of(spark, sf, "RMC")
    return rounded(
        df, ["track_id", "line_no", "rmc_status", "rmc_speed_knots", "rmc_true_course", "rmc_mag_variation", "own_date", "own_time"], lat=9, lon=9
    )


@query(
    "extract_gga",
    F_SQL + f"""SELECT track_id, line_no, round({_signed(2)}, 9) AS lat, round({_signed(4)}, 9) AS lon, {_num(6, 'INTEGER')} AS gga_gps_quality, {_num(7, 'INTEGER')} AS gga_num_sats,
  {_num(8)} AS gga_hdop, {_num(9)} AS gga_altitude, {_num(11)} AS gga_geo_separation, own_time FROM fields WHERE st = 'GGA'""",
)
def extract_gga(spark, sf):
    keep = ["track_id", "line_no", "gga_gps_quality", "gga_num_sats", "gga_hdop", "gga_altitude", "gga_geo_separation", "own_time"]
    return rounded(_of(spark, sf, "GGA"), keep, lat=9, lon=9)


@query(
    "extract_vtg",
    F_SQL + f"SELECT track_id, line_no, {_num(5)} AS vtg_speed_knots, {_num(7)} AS vtg_speed_kmh, {_num(1)} AS vtg_true_track, {_num(3)} AS vtg_mag_track FROM fields WHERE st = 'VTG'",
)
def extract_vtg(spark, sf):
    return _of(spark, sf, "VTG").select("track_id", "line_no", "vtg_speed_knots", "vtg_speed_kmh", "vtg_true_track", "vtg_mag_track")


@query(
    "extract_gsa",
    F_SQL + f"SELECT track_id, line_no, {_num(2, 'INTEGER')} AS gsa_fix_type, {_num(15)} AS gsa_pdop, {_num(16)} AS gsa_hdop, {_num(17)} AS gsa_vdop FROM fields WHERE st = 'GSA'",
)
def extract_gsa(spark, sf):
    return _of(spark, sf, "GSA").select("track_id", "line_no", "gsa_fix_type", "gsa_pdop", "gsa_hdop", "gsa_vdop")


Q_SATS = f"""sats AS (SELECT track_id, line_no, talker_id, {_num(1, 'INTEGER')} AS nm, {_num(2, 'INTEGER')} AS mn, coalesce({_num(3, 'INTEGER')}, 0) AS iv,
  list_filter([{', '.join(f"{{'prn': {_num(b, 'INTEGER')}, 'elevation': {_num(b + 1, 'INTEGER')}, 'azimuth': {_num(b + 2, 'INTEGER')}, 'snr': {_num(b + 3, 'INTEGER')}}}" for b in (4, 8, 12, 16))}],
    lambda s: s.prn IS NOT NULL) AS s FROM fields WHERE st = 'GSV')"""


@query(
    "extract_gsv",
    with_(Q_BODIES, Q_FIELDS, Q_SATS) + "SELECT track_id, line_no, talker_id, nm, mn, iv, x.prn AS prn, x.elevation AS elevation, x.azimuth AS azimuth, x.snr AS snr FROM (SELECT *, unnest(s) AS x FROM sats)",
)
def extract_gsv(spark, sf):
    # every satellite has a number; the outer form is not preceded by a check that makes the satellites a second time
    return _of(spark, sf, "GSV").select(
        "track_id",
        "line_no",
        "talker_id",
        F.col("gsv_num_messages").alias("nm"),
        F.col("gsv_msg_num").alias("mn"),
        F.col("gsv_in_view").alias("iv"),
        F.inline_outer("gsv_satellites"),
    ).where(F.col("prn").isNotNull())


@query("parse_stats", with_(Q_BODIES) + "SELECT track_id, CAST(count_if(fault IN (0, 3)) AS BIGINT) AS n_parsed, CAST(count_if(fault IN (1, 2)) AS BIGINT) AS n_malformed, CAST(0 AS BIGINT) AS n_other FROM bodies GROUP BY track_id")
def parse_stats(spark, sf):
    return nmea.parse_stats(_tokens(spark, sf))


@query("count_types", F_SQL + "SELECT st AS sentence_type, count(*) AS n FROM fields GROUP BY st")
def count_types(spark, sf):
    return nmea.count_types(_tokens(spark, sf))


# --- carried state --------------------------------------------------------------------------

_LW = "OVER (PARTITION BY track_id ORDER BY line_no)"
Q_CLOCKED = f"""carried AS (SELECT *, last_value(own_date IGNORE NULLS) {_LW} AS date, last_value(own_time IGNORE NULLS) {_LW} AS time FROM fields),
stamped AS (SELECT *, CASE WHEN st = 'RMC' THEN own_date + own_time WHEN st = 'GGA' THEN date + own_time WHEN st IN ('VTG', 'GSA') THEN date + time END AS us FROM carried),
clocked AS (SELECT *, last_value(CASE WHEN st IN ('RMC', 'GGA') THEN us END IGNORE NULLS) {_LW} AS clock FROM stamped)"""
C_SQL = with_(Q_BODIES, Q_FIELDS, Q_CLOCKED)


def _clocked(spark, sf) -> DataFrame:
    return nmea.carry_clock(_fields(spark, sf))


def _ntz(c: str):
    return F.col(c).cast("timestamp_ntz").alias(c)


@query("carry_date", C_SQL + "SELECT track_id, line_no, CAST(make_timestamp(date) AS DATE) AS date FROM clocked")
def carry_date(spark, sf):
    return _clocked(spark, sf).select("track_id", "line_no", "date")


@query("carry_time", C_SQL + "SELECT track_id, line_no, time FROM clocked")
def carry_time(spark, sf):
    return _clocked(spark, sf).select("track_id", "line_no", "time")


@query("sentence_ts", C_SQL + "SELECT track_id, line_no, make_timestamp(us) AS ts FROM clocked")
def sentence_ts(spark, sf):
    return _clocked(spark, sf).select("track_id", "line_no", _ntz("ts"))


@query("gsv_clock", C_SQL + "SELECT track_id, line_no, make_timestamp(clock) AS clock FROM clocked")
def gsv_clock(spark, sf):
    return _clocked(spark, sf).select("track_id", "line_no", _ntz("clock"))


Q_GROUPS = """marked AS (SELECT g.*, c.clock, g.iv = 0 OR coalesce(g.mn = g.nm, FALSE) AS closed FROM sats g JOIN clocked c USING (track_id, line_no)),
near AS (SELECT *, lag({'t': talker_id, 'c': closed}) OVER w AS p, lead({'c': clock}) OVER w AS nx FROM marked WINDOW w AS (PARTITION BY track_id ORDER BY line_no)),
numbered AS (SELECT *, sum(CASE WHEN iv = 0 OR coalesce(mn = 1, FALSE) OR p IS NULL OR p.c OR p.t <> talker_id THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY line_no) AS group_no FROM near),
ends AS (SELECT track_id, arg_max(clock, line_no) AS final FROM clocked WHERE clock IS NOT NULL GROUP BY track_id),
grouped AS (SELECT track_id, CAST(group_no AS BIGINT) AS group_no, min(talker_id) AS talker_id, min(line_no) AS line_no, max(line_no) AS last_line, count(*) AS n_sentences,
  flatten(list(s ORDER BY line_no)) AS s, arg_max({'x': CASE WHEN closed THEN clock WHEN nx IS NOT NULL THEN nx.c ELSE final END}, line_no).x AS us, arg_max(iv, line_no) AS header
  FROM numbered LEFT JOIN ends USING (track_id) GROUP BY track_id, group_no)"""
G_SQL = with_(Q_BODIES, Q_FIELDS, Q_SATS, Q_CLOCKED, Q_GROUPS)


def _groups(spark, sf) -> DataFrame:
    return nmea.group_gsv(_clocked(spark, sf))


@query(
    "group_gsv",
    G_SQL + "SELECT track_id, group_no, talker_id, line_no, n_sentences, x.prn AS prn, x.snr AS snr, place FROM (SELECT *, unnest(s) AS x, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS place FROM grouped)",
)
def group_gsv(spark, sf):
    return _groups(spark, sf).select(
        "track_id", "group_no", "talker_id", "line_no", "n_sentences", F.posexplode("gsv_satellites").alias("place", "x")
    ).select("track_id", "group_no", "talker_id", "line_no", "n_sentences", "place", "x.prn", "x.snr")


@query("gsv_group_ts", G_SQL + "SELECT track_id, group_no, make_timestamp(us) AS ts FROM grouped")
def gsv_group_ts(spark, sf):
    return _groups(spark, sf).select("track_id", "group_no", _ntz("ts"))


@query("gsv_count", G_SQL + "SELECT track_id, group_no, CAST(len(s) AS INTEGER) AS num_sv_in_view, header AS header_in_view FROM grouped")
def gsv_count(spark, sf):
    return _groups(spark, sf).select("track_id", "group_no", "num_sv_in_view", "header_in_view")


_SENT_COLS = f"""CASE st WHEN 'RMC' THEN {_signed(3)} WHEN 'GGA' THEN {_signed(2)} END AS lat, CASE st WHEN 'RMC' THEN {_signed(5)} WHEN 'GGA' THEN {_signed(4)} END AS lon,
  CASE WHEN st = 'RMC' THEN {_f(2)} END AS rmc_status, CASE WHEN st = 'RMC' THEN {_num(7)} END AS rmc_speed_knots, CASE WHEN st = 'GGA' THEN {_num(6, 'INTEGER')} END AS gga_gps_quality,
  CASE WHEN st = 'GGA' THEN {_num(7, 'INTEGER')} END AS gga_num_sats, CASE WHEN st = 'GGA' THEN {_num(8)} END AS gga_hdop, CASE WHEN st = 'GGA' THEN {_num(9)} END AS gga_altitude,
  CASE WHEN st = 'VTG' THEN {_num(5)} END AS vtg_speed_knots, CASE WHEN st = 'VTG' THEN {_num(7)} END AS vtg_speed_kmh,
  CASE WHEN st = 'GSA' THEN {_num(2, 'INTEGER')} END AS gsa_fix_type, CASE WHEN st = 'GSA' THEN {_num(17)} END AS gsa_vdop"""
Q_SCHEMA_A = f"""raw_a AS (SELECT track_id, line_no, st AS sentence_type, talker_id, us, 0 AS late, {_SENT_COLS}, CAST(NULL AS BIGINT) AS n_sv FROM clocked WHERE st <> 'GSV'
  UNION ALL SELECT track_id, line_no, 'GSV', talker_id, us, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, len(s) FROM grouped),
schema_a AS (SELECT *, make_timestamp(us) AS ts, row_number() OVER (PARTITION BY track_id ORDER BY us ASC NULLS FIRST, late, line_no) - 1 AS seq FROM raw_a)"""
A_SQL = with_(Q_BODIES, Q_FIELDS, Q_SATS, Q_CLOCKED, Q_GROUPS, Q_SCHEMA_A)


@query(
    "build_schema_a",
    A_SQL + """SELECT track_id, seq, line_no, sentence_type, talker_id, ts, round(lat, 9) AS lat, round(lon, 9) AS lon, rmc_speed_knots, gga_altitude, vtg_speed_kmh, gsa_vdop, CAST(n_sv AS INTEGER) AS num_sv_in_view FROM schema_a""",
)
def build_schema_a(spark, sf):
    df = nmea.build_schema_a(_clocked(spark, sf))
    keep = ["track_id", "seq", "line_no", "sentence_type", "talker_id", "rmc_speed_knots", "gga_altitude", "vtg_speed_kmh", "gsa_vdop", "num_sv_in_view"]
    return df.select(*keep, _ntz("ts"), F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query(
    "apply_types",
    A_SQL + """SELECT track_id, seq, CAST(gga_gps_quality AS SMALLINT) AS gga_gps_quality, CAST(gga_hdop AS FLOAT) AS gga_hdop, CAST(gga_altitude AS FLOAT) AS gga_altitude,
  CAST(rmc_speed_knots AS FLOAT) AS rmc_speed_knots, CAST(n_sv AS SMALLINT) AS num_sv_in_view FROM schema_a""",
)
def apply_types(spark, sf):
    df = nmea.apply_types(nmea.build_schema_a(_clocked(spark, sf)))
    return df.select("track_id", "seq", "gga_gps_quality", "gga_hdop", "gga_altitude", "rmc_speed_knots", "num_sv_in_view")


_NAMED = ["lat", "rmc_status", "rmc_speed_knots", "gga_gps_quality", "gga_altitude", "vtg_speed_kmh", "gsa_vdop"]


@query(
    "field_names",
    A_SQL + f"""SELECT sentence_type, string_agg(DISTINCT f, ',' ORDER BY f) AS fields FROM (
  SELECT sentence_type, unnest([{', '.join(f"CASE WHEN {c} IS NOT NULL THEN '{c}' END" for c in _NAMED)}]) AS f FROM schema_a) WHERE f IS NOT NULL GROUP BY sentence_type""",
)
def field_names(spark, sf):
    df = nmea.field_names(nmea.build_schema_a(_clocked(spark, sf)), _NAMED)
    return df.select("sentence_type", F.array_join("fields", ",").alias("fields"))


_RMC_FIRST = """(SELECT track_id, ts, arg_min({'lat': lat, 'lon': lon}, seq) AS r FROM {a} WHERE sentence_type = 'RMC' AND rmc_status = 'A' AND ts IS NOT NULL GROUP BY track_id, ts)"""
_CHECK = """SELECT track_id, seq, CASE WHEN sentence_type = 'GGA' AND abs(r.lat - lat) IS NOT NULL AND abs(r.lon - lon) IS NOT NULL
    THEN abs(r.lat - lat) > 1e-6::DOUBLE OR abs(r.lon - lon) > 1e-6::DOUBLE END AS pos_mismatch,
  CASE WHEN sentence_type = 'GGA' AND r IS NOT NULL THEN FALSE END AS time_mismatch FROM {a} LEFT JOIN {first} USING (track_id, ts)"""


def _check_sql(a: str) -> str:
    return _CHECK.replace("{first}", _RMC_FIRST).replace("{a}", a)


@query("gga_rmc_check", A_SQL + _check_sql("schema_a"))
def gga_rmc_check(spark, sf):
    df = nmea.check_gga_against_rmc(nmea.build_schema_a(_clocked(spark, sf)))
    return df.select("track_id", "seq", "pos_mismatch", "time_mismatch")


# --- the same on the sentence view ----------------------------------------------------------

N_SQL = with_(Q_TRACK, Q_SENTENCES)


@query("consistency_join", N_SQL + _check_sql("sentences"))
def consistency_join(spark, sf):
    return nmea.check_gga_against_rmc(sentences(spark, sf)).select("track_id", "seq", "pos_mismatch", "time_mismatch")


_FIRST_FIX = "(SELECT track_id, min(ts) FILTER (sentence_type = 'RMC' AND rmc_status = 'A') AS f FROM sentences GROUP BY track_id)"
Q_F1 = f"f1 AS (SELECT s.* FROM sentences s JOIN {_FIRST_FIX} USING (track_id) WHERE f IS NULL OR ts IS NULL OR ts >= f)"
_BAD_GGA = "(sentence_type = 'GGA' AND coalesce(gga_gps_quality IN (0, 5), FALSE))"


def _anchored(a: str) -> str:
    return f"EXISTS (SELECT 1 FROM {a} g WHERE g.sentence_type = 'GGA' AND NOT coalesce(g.gga_gps_quality IN (0, 5), FALSE) AND g.track_id = s.track_id AND g.ts = s.ts)"


Q_F2 = f"f2 AS (SELECT * FROM f1 WHERE NOT {_BAD_GGA})"
Q_F3 = f"f3 AS (SELECT * FROM f2 s WHERE sentence_type NOT IN ('RMC', 'VTG') OR {_anchored('f2')})"
Q_F4 = "f4 AS (SELECT * FROM f3 WHERE NOT (sentence_type = 'GSA' AND coalesce(gsa_fix_type IN (1), FALSE)))"


def _ids(df: DataFrame) -> DataFrame:
    return df.select("track_id", "seq", "sentence_type")


@query("drop_before_first_fix", with_(Q_TRACK, Q_SENTENCES, Q_F1) + "SELECT track_id, seq, sentence_type FROM f1")
def drop_before_first_fix(spark, sf):
    return _ids(clean.drop_before_first_fix(sentences(spark, sf)))


@query("drop_bad_gga", N_SQL + f"SELECT track_id, seq, sentence_type FROM sentences WHERE NOT {_BAD_GGA}")
def drop_bad_gga(spark, sf):
    return _ids(clean.drop_bad_gga(sentences(spark, sf)))


@query("drop_unanchored", N_SQL + f"SELECT track_id, seq, sentence_type FROM sentences s WHERE sentence_type NOT IN ('RMC', 'VTG') OR {_anchored('sentences')}")
def drop_unanchored(spark, sf):
    return _ids(clean.drop_unanchored(sentences(spark, sf)))


@query("anchor_join", N_SQL + f"SELECT track_id, seq, sentence_type FROM sentences s WHERE sentence_type IN ('RMC', 'VTG') AND {_anchored('sentences')}")
def anchor_join(spark, sf):
    return _ids(clean.anchor_join(sentences(spark, sf)))


@query("drop_no_fix_gsa", N_SQL + "SELECT track_id, seq, sentence_type FROM sentences WHERE NOT (sentence_type = 'GSA' AND coalesce(gsa_fix_type IN (1), FALSE))")
def drop_no_fix_gsa(spark, sf):
    return _ids(clean.drop_no_fix_gsa(sentences(spark, sf)))


@query("filter_invalid", with_(Q_TRACK, Q_SENTENCES, Q_F1, Q_F2, Q_F3, Q_F4) + "SELECT track_id, seq, sentence_type FROM f4")
def filter_invalid(spark, sf):
    return _ids(clean.filter_invalid(sentences(spark, sf)))


def sql_merge(a: str) -> str:
    """WITH item ``merged``: first GGA of each time left-joined with the first RMC, VTG and GSA."""

    def first(kind: str, cols: list[str]) -> str:
        inner = ", ".join(cols)
        return f"(SELECT track_id, ts, {inner} FROM {a} WHERE sentence_type = '{kind}' QUALIFY row_number() OVER (PARTITION BY track_id, ts ORDER BY seq) = 1)"

    def on(x: str) -> str:
        return f"ON g.track_id = {x}.track_id AND g.ts IS NOT DISTINCT FROM {x}.ts"

    return f"""merged AS (SELECT g.track_id, g.seq, g.ts, g.lat, g.lon, g.gga_altitude AS alt, coalesce(v.vtg_speed_kmh, coalesce(r.rmc_speed_knots, v.vtg_speed_knots) * 1.852::DOUBLE) AS speed_kmh,
  coalesce(r.rmc_speed_knots, v.vtg_speed_knots) AS speed_knots, g.gga_gps_quality AS gps_quality, g.gga_num_sats AS num_sats, g.gga_hdop AS hdop, s.gsa_vdop AS vdop, s.gsa_fix_type AS fix_type
  FROM {first('GGA', ['seq', 'lat', 'lon', 'gga_altitude', 'gga_gps_quality', 'gga_num_sats', 'gga_hdop'])} g
  LEFT JOIN {first('RMC', ['rmc_speed_knots'])} r {on('r')} LEFT JOIN {first('VTG', ['vtg_speed_knots', 'vtg_speed_kmh'])} v {on('v')} LEFT JOIN {first('GSA', ['gsa_vdop', 'gsa_fix_type'])} s {on('s')})"""


def _fill(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN p_{c} IS NULL THEN n_{c}.v WHEN n_{c} IS NULL THEN p_{c}.v ELSE p_{c}.v + (n_{c}.v - p_{c}.v) * (i - p_{c}.i) / (n_{c}.i - p_{c}.i) END"


_FILLED = ("alt", "speed_kmh", "speed_knots")
Q_FILLED = f"""placed AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ts ASC NULLS FIRST, seq) - 1 AS i FROM merged),
seen AS (SELECT *, {', '.join(f"last_value(CASE WHEN {c} IS NOT NULL THEN {{'v': {c}, 'i': i}} END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY i) AS p_{c}, last_value(CASE WHEN {c} IS NOT NULL THEN {{'v': {c}, 'i': i}} END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY i DESC) AS n_{c}" for c in _FILLED)} FROM placed),
filled AS (SELECT track_id, i, seq, ts, lat, lon, gps_quality, num_sats, hdop, vdop, fix_type, {', '.join(f'{_fill(c)} AS {c}' for c in _FILLED)} FROM seen)"""


@query(
    "consolidate",
    with_(Q_TRACK, Q_SENTENCES, Q_F1, Q_F2, Q_F3, Q_F4, sql_merge("f4"), Q_FILLED)
    + "SELECT track_id, seq, ts, round(alt, 6) AS alt, round(speed_kmh, 6) AS speed_kmh, round(speed_knots, 6) AS speed_knots, gps_quality, num_sats, hdop, vdop, fix_type FROM filled",
)
def consolidate_query(spark, sf):
    df = consolidate.consolidate(clean.filter_invalid(sentences(spark, sf)).drop("chunk"))
    keep = ["track_id", "seq", "gps_quality", "num_sats", "hdop", "vdop", "fix_type"]
    return rounded(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), [*keep, "ts"], alt=6, speed_kmh=6, speed_knots=6)


_A4 = """f1 AS (SELECT s.* FROM schema_a s JOIN (SELECT track_id, min(ts) FILTER (sentence_type = 'RMC' AND rmc_status = 'A') AS f FROM schema_a GROUP BY track_id) USING (track_id) WHERE f IS NULL OR ts IS NULL OR ts >= f)"""


def _process_sql() -> str:
    from trackloom.functions.scalar import geodesic_sql

    steps = f"""stepped AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000::DOUBLE AS dt_s FROM filled WINDOW w AS (PARTITION BY track_id ORDER BY i)),
done AS (SELECT *, CASE WHEN dt_s > 0 THEN {geodesic_sql('plat', 'plon', 'lat', 'lon')} END AS distance_m FROM stepped)"""
    return with_(Q_BODIES, Q_FIELDS, Q_SATS, Q_CLOCKED, Q_GROUPS, Q_SCHEMA_A, _A4, Q_F2, Q_F3, Q_F4, sql_merge("f4"), Q_FILLED, steps) + (
        "SELECT track_id, CAST(i AS BIGINT) AS idx, ts, round(lat, 8) AS lat, round(lon, 8) AS lon, round(alt, 3) AS alt, round(speed_kmh, 3) AS speed_kmh, round(distance_m, 2) AS distance_m, "
        "CAST(num_sats AS SMALLINT) AS num_sats FROM done"
    )


SQL_PROCESS = _process_sql()


@query("process_nmea", SQL_PROCESS)
def process_nmea_query(spark, sf):
    _, track = process_nmea(_tokens(spark, sf))
    return track.select("track_id", "idx", _ntz("ts"), F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"),
                        F.round("alt", 3).alias("alt"), F.round("speed_kmh", 3).alias("speed_kmh"), F.round("distance_m", 2).alias("distance_m"), "num_sats")


@query("union_sentences", A_SQL + "SELECT sentence_type, count(*) AS n, count(us) AS n_timed FROM schema_a GROUP BY sentence_type")
def union_sentences(spark, sf):
    df = nmea.build_schema_a(_clocked(spark, sf))
    return df.groupBy("sentence_type").agg(F.count(F.lit(1)).alias("n"), F.count("ts").alias("n_timed"))
