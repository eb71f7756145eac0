"""IGC flight logs: fixed-width B records, the date from HFDTE records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.operators.nmea import LINE_ORDER, date_ddmmyy
from trackloom.plans.sequence import carry, running_sum, with_neighbours
from trackloom.sources.files import read_lines

IGC_PIVOT = 80


def igc_date(line) -> Column:
    """Date of an ``HFDTE`` record: its first six digits; NULL for other lines and impossible dates."""
    digits = F.nullif(F.regexp_extract(S.col(line), r"^HFDTE.*?(\d{6})", 1), F.lit(""))
    return date_ddmmyy(digits, IGC_PIVOT)


def igc_altitude(line) -> Column:
    """Satellite altitude unless missing or 0, then pressure altitude unless missing or 0, then what is left."""
    pressure, gnss = (F.trim(F.substring(S.col(line), p, 5)) for p in (26, 31))
    p = F.nullif(pressure, F.lit("")).try_cast("int")
    g = F.nullif(gnss, F.lit("")).try_cast("int")
    readable = (p.isNotNull() | (pressure == "")) & (g.isNotNull() | (gnss == ""))
    chosen = F.coalesce(F.nullif(g, F.lit(0)), F.nullif(p, F.lit(0)), g)
    return F.when(readable, chosen.cast("double"))


def _digits(start: int, length: int) -> Column:
    return F.substring("value", start, length).try_cast("int")


def fixes(lines: DataFrame) -> DataFrame:
    """Accepted B records in file order with date, second of the day, position and altitude."""
    text = F.rtrim(F.col("value"))
    dated = carry(lines.withColumn("value", text), {"date": igc_date("value")}, order=LINE_ORDER)
    h, m, s = _digits(2, 2), _digits(4, 2), _digits(6, 2)
    lat = S.milli_minutes_to_deg(_digits(8, 2), _digits(10, 5))
    lon = S.milli_minutes_to_deg(_digits(16, 3), _digits(19, 5))
    rows = dated.where(
        F.col("value").startswith("B")
        & (F.length("value") >= 35)
        & F.col("date").isNotNull()
        & (F.substring("value", 25, 1) == "A")
    ).withColumns(
        {
            "second": h * 3600 + m * 60 + s,
            "lat": F.when(F.substring("value", 15, 1) == "S", -lat).otherwise(lat),
            "lon": F.when(F.substring("value", 24, 1) == "W", -lon).otherwise(lon),
            "alt": igc_altitude("value"),
        }
    )
    return rows.where(
        (h <= 23) & (m <= 59) & (s <= 59) & F.col("lat").isNotNull() & F.col("lon").isNotNull()
        & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    )


def day_rollover(rows: DataFrame) -> DataFrame:
    """Add ``day_offset``: one more whenever the second of the day drops, starting anew with each date record."""
    rows, near = with_neighbours(rows, ["second", "date"], 1, order=LINE_ORDER)
    before = F.col(near[-1])
    same_date = before["date"] == F.col("date")
    drops = F.coalesce(same_date & (F.col("second") < before["second"] - 1), F.lit(False)).cast("bigint")
    rows = running_sum(rows, drops, "_drops", order=LINE_ORDER)
    # drops counted before the date record now in force
    starts = F.when(before.isNull() | ~same_date, F.col("_drops"))
    rows = carry(rows, {"_base": starts}, order=LINE_ORDER)
    return rows.withColumn("day_offset", (F.col("_drops") - F.col("_base")).cast("int")).drop(
        "_drops", "_base", *near.values()
    )


def points_from_lines(lines: DataFrame) -> DataFrame:
    rows = day_rollover(fixes(lines))
    micros = (F.unix_date(F.date_add("date", F.col("day_offset"))).cast("bigint") * 86_400 + F.col("second")) * 1_000_000
    none = F.lit(None).cast("double")
    keep = [c for c in ("track_id", "source_file") if c in rows.columns]
    return rows.select(
        *keep,
        F.col("line_no").alias("seq"),
        F.timestamp_micros(micros).alias("ts"),
        "lat",
        "lon",
        "alt",
        none.alias("speed_kmh"),
        none.alias("speed_knots"),
        none.alias("hdop"),
    )


def read_igc(spark: SparkSession, path, glob: str | None = "*.igc", named: bool = False) -> DataFrame:
    """All accepted fixes of all logs below ``path``. ``named``: as in ``read_lines``."""
    return points_from_lines(read_lines(spark, path, "igc", glob, named))
