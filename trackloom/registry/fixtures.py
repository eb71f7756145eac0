"""Views that make the driver's tables look like tracks, sentences, satellite reports, cuts and terrain.

Both engines run the same text where possible: only double arithmetic, integer remainders and string pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.nmea import xor_checksum
from trackloom.plans.skew import split_hot_tracks

TRACK = """SELECT user_id AS track_id, event_id AS seq, ts, event_type,
  47 + (user_id % 10) / CAST(10 AS DOUBLE) + (event_id % 997) / CAST(100000 AS DOUBLE) AS lat,
  8 + (user_id - user_id % 10) / CAST(500 AS DOUBLE) + (event_id % 1009) / CAST(100000 AS DOUBLE) AS lon,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(400 AS DOUBLE) + value END AS alt,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE value / CAST(4 AS DOUBLE) END AS speed_kmh,
  (5 + event_id % 40) / CAST(10 AS DOUBLE) AS hdop
FROM {events}"""

SENTENCES = """SELECT track_id, seq, date_trunc('day', ts) AS ts,
  CASE event_type WHEN 'view' THEN 'RMC' WHEN 'click' THEN 'GGA' WHEN 'purchase' THEN 'VTG'
                  WHEN 'signup' THEN 'GSA' ELSE 'GSV' END AS sentence_type,
  CASE seq % 3 WHEN 0 THEN 'GP' WHEN 1 THEN 'GL' ELSE 'GA' END AS talker_id,
  CASE WHEN event_type = 'view' THEN CASE WHEN seq % 11 = 0 THEN 'V' ELSE 'A' END END AS rmc_status,
  CASE WHEN event_type = 'click' THEN seq % 6 END AS gga_gps_quality,
  CASE WHEN event_type = 'click' THEN seq % 13 END AS gga_num_sats,
  CASE WHEN event_type = 'click' THEN hdop END AS gga_hdop,
  CASE WHEN event_type = 'click' THEN alt END AS gga_altitude,
  CASE WHEN event_type = 'view' THEN speed_kmh END AS rmc_speed_knots,
  CASE WHEN event_type = 'purchase' AND seq % 5 <> 0 THEN speed_kmh END AS vtg_speed_knots,
  CASE WHEN event_type = 'purchase' AND seq % 4 <> 0 THEN 2 * speed_kmh END AS vtg_speed_kmh,
  CASE WHEN event_type = 'signup' THEN 1 + seq % 3 END AS gsa_fix_type,
  CASE WHEN event_type = 'signup' THEN hdop END AS gsa_vdop,
  CASE WHEN event_type IN ('view', 'click') THEN lat END AS lat,
  CASE WHEN event_type IN ('view', 'click') THEN CASE WHEN seq % 10 = 0 THEN NULL ELSE lon END END AS lon
FROM track"""

CUTS = """SELECT DISTINCT user_id AS track_id, 0 AS cut_id, CAST(0 AS BIGINT) AS {q}start{q}, CAST(2 AS BIGINT) AS {q}end{q}, 'gap' AS mode FROM {events}
UNION ALL
SELECT DISTINCT user_id, 1, CAST(10 AS BIGINT), CAST(14 AS BIGINT), CASE user_id % 2 WHEN 0 THEN 'bridge' ELSE 'gap' END FROM {events}
UNION ALL
SELECT DISTINCT user_id, 2, CAST(25 AS BIGINT), CAST(26 + user_id % 4 AS BIGINT), CASE user_id % 3 WHEN 0 THEN 'bridge' ELSE 'trim' END FROM {events} WHERE user_id % 5 <> 0"""

_HMS = """lpad(CAST(hour(ts) AS STRING), 2, '0') || lpad(CAST(minute(ts) AS STRING), 2, '0')
  || lpad(CAST(CAST(floor(second(ts)) AS INT) AS STRING), 2, '0') || '.' || lpad(CAST(event_id % 100 AS STRING), 2, '0')"""
_LAT = """CAST(40 + user_id % 20 AS STRING) || CAST(30 + CAST(floor(event_id % 50000 / 10000) AS INT) AS STRING) || '.'
  || lpad(CAST(event_id % 10000 AS STRING), 4, '0')"""
_LON = """lpad(CAST(8 + user_id % 90 AS STRING), 3, '0') || '20.' || lpad(CAST(event_id % 9973 AS STRING), 4, '0')"""
_NS = "CASE WHEN user_id % 7 = 0 THEN 'S' ELSE 'N' END"
_EW = "CASE WHEN user_id % 4 = 0 THEN 'W' ELSE 'E' END"
_DATE = """lpad(CAST(day(ts) AS STRING), 2, '0') || lpad(CAST(month(ts) AS STRING), 2, '0') || substr(CAST(year(ts) AS STRING), 3, 2)"""
_KNOTS = "CASE WHEN event_id % 9 = 0 THEN '' ELSE CAST(event_id % 40 AS STRING) || '.' || CAST(event_id % 10 AS STRING) END"
_DOP = "CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(event_id % 4 AS STRING) || '.' || CAST(event_id % 10 AS STRING) END"


def _slot(j: int, s: int) -> str:
    prn = f"CASE WHEN {s} = 3 AND event_id % 3 = 0 THEN '' ELSE CAST((event_id + {4 * j + s}) % 32 + 1 AS STRING) END"
    elev = f"CASE WHEN (event_id + {s}) % 10 = 0 THEN '' ELSE CAST((event_id * 7 + {s}) % 91 AS STRING) END"
    azim = f"CAST((event_id * 11 + {13 * s}) % 360 AS STRING)"
    snr = f"CASE WHEN (event_id + {s}) % 4 = 0 THEN '' ELSE CAST((event_id + {s}) % 50 AS STRING) END"
    return f"',' || {prn} || ',' || {elev} || ',' || {azim} || ',' || {snr}"


def _gsv(j: int) -> tuple[int, str, str, str]:
    slots = " || ".join(_slot(j, s) for s in range(4))
    talker = "CASE event_id % 3 WHEN 0 THEN 'GP' WHEN 1 THEN 'GL' ELSE 'GA' END"
    when = f"event_type IN ('error', 'signup') AND event_id % 19 <> 0 AND {j} <= 1 + event_id % 3 AND NOT (event_id % 5 = 0 AND {j} = 1 + event_id % 3)"
    return 3 + j, when, "0", f"{talker} || 'GSV,' || CAST(1 + event_id % 3 AS STRING) || ',{j},12' || {slots}"


# Lines of one event: place, condition, what is wrong with the line (0 nothing, 1 checksum, 2 no sentence,
# 3 no checksum), and the sentence body.
LINES = [
    (
        0,
        "TRUE",
        "CASE WHEN event_id % 6 = 0 THEN 3 ELSE 0 END",
        f"""'GPRMC,' || {_HMS} || ',' || CASE WHEN event_id % 11 = 0 THEN 'V' ELSE 'A' END || ',' || {_LAT} || ',' || {_NS} || ','
  || CASE WHEN event_id % 37 = 0 THEN '' ELSE {_LON} END || ',' || {_EW} || ',' || {_KNOTS} || ',' || CAST(event_id % 360 AS STRING) || '.5,'
  || CASE WHEN event_id % 7 = 3 THEN '' ELSE {_DATE} END || ',,,A'""",
    ),
    (
        1,
        "event_id % 10 <> 9",
        "0",
        f"""'GPGGA,' || {_HMS} || ',' || CASE WHEN event_id % 23 = 0 THEN CAST(40 + user_id % 20 AS STRING) || '30.0000' ELSE {_LAT} END || ',' || {_NS} || ',' || {_LON} || ',' || {_EW} || ','
  || CAST(event_id % 6 AS STRING) || ',' || CAST(event_id % 13 AS STRING) || ',' || {_DOP} || ','
  || CASE WHEN event_id % 17 = 0 THEN '' ELSE CAST(300 + event_id % 500 AS STRING) || '.' || CAST(event_id % 10 AS STRING) END || ',M,46.9,M,,'""",
    ),
    (
        2,
        "event_type IN ('view', 'click', 'purchase')",
        "0",
        f"""'GPVTG,' || CAST(event_id % 360 AS STRING) || '.5,T,,M,' || {_KNOTS} || ',N,'
  || CASE WHEN event_id % 8 = 0 THEN '' ELSE CAST(event_id % 70 AS STRING) || '.25' END || ',K,A'""",
    ),
    (
        3,
        "event_type <> 'signup'",
        "0",
        f"""'GNGSA,A,' || CAST(1 + event_id % 3 AS STRING) || ',,,,,,,,,,,,,' || CAST(event_id % 5 AS STRING) || '.5,' || {_DOP} || ',' || CAST(event_id % 3 AS STRING) || '.75'""",
    ),
    *[_gsv(j) for j in (1, 2, 3)],
    (4, "event_type IN ('error', 'signup') AND event_id % 19 = 0", "0", "'GPGSV,1,1,00'"),
    (
        7,
        "event_id % 29 = 0",
        "CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END",
        """CASE WHEN event_id % 2 = 0 THEN 'GPRMC,000000.00,A,4500.0000,N,00800.0000,E,1.0,2.0,010124,,,A' ELSE 'no sentence ' || CAST(event_id AS STRING) END""",
    ),
]
BODIES = "\nUNION ALL\n".join(
    f"SELECT user_id AS track_id, event_id * 8 + {k} AS line_no, {fault} AS fault, {body} AS body FROM events WHERE {when}"
    for k, when, fault, body in LINES
)

# The same views for the SQL side, as WITH items.
Q_TRACK = "track AS (" + TRACK.format(events="events") + ")"
Q_SENTENCES = "sentences AS (" + SENTENCES + ")"
Q_CUTS = "cuts AS (" + CUTS.format(events="events", q='"') + ")"
Q_BODIES = "bodies AS (" + BODIES + ")"
Q_LINES = """lines AS (SELECT track_id, line_no, fault, body,
  upper(lpad(printf('%x', list_reduce(list_transform(string_split(body, ''), lambda c: ascii(c)), lambda a, b: xor(a, b))), 2, '0')) AS computed,
  CASE fault WHEN 0 THEN '$' || body || '*' || computed WHEN 1 THEN '$' || body || '*00' WHEN 2 THEN body ELSE '$' || body END AS value
  FROM bodies)"""
Q_IDX = """pts AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ts, seq) - 1 AS idx FROM track)"""


def with_(*items: str) -> str:
    return "WITH " + ",\n".join(items) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture track, split where a track is hot."""
    return split_hot_tracks(spark.sql(TRACK, events=events(spark, sf_dir)))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(TRACK, events=events(spark, sf_dir))
    return split_hot_tracks(spark.sql(SENTENCES.replace("FROM track", "FROM {track}"), track=rows))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CUTS.replace("{q}", "`"), events=events(spark, sf_dir))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each event, from one scan."""
    slots = [
        F.when(
            F.expr(when),
            F.struct(F.expr(f"event_id * 8 + {k}").alias("line_no"), F.expr(fault).alias("fault"), F.expr(body).alias("body")),
        )
        for k, when, fault, body in LINES
    ]
    # the table is small for the lines made of it, so few scan tasks would make them all
    spread = events(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism)
    # a lambda keeps this projection out of whole-stage code, where all lines would be one method too long to be compiled
    made = spread.select(F.col("user_id").alias("track_id"), F.filter(F.array(*slots), lambda x: x.isNotNull()).alias("x"))
    # each event has a line; the outer form is not preceded by a check that makes the lines a second time
    return made.select("track_id", F.inline_outer("x"))


def _line_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row with its track for each line of ``bodies``, without the line."""
    places = F.array(*[F.when(F.expr(when), F.lit(k)) for k, when, _, _ in LINES])
    made = events(spark, sf_dir).select(F.col("user_id").alias("track_id"), F.explode(places).alias("k"))
    return made.where(F.col("k").isNotNull())


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NMEA log lines, some of them faulty."""
    b, fault = F.col("body"), F.col("fault")
    value = (
        F.when(fault == 0, F.concat(F.lit("$"), b, F.lit("*"), xor_checksum(b)))
        .when(fault == 1, F.concat(F.lit("$"), b, F.lit("*00")))
        .when(fault == 2, b)
        .otherwise(F.concat(F.lit("$"), b))
    )
    made = bodies(spark, sf_dir).select("track_id", "line_no", value.alias("value"))
    return split_hot_tracks(made, order="line_no", bound=_line_places(spark, sf_dir))
