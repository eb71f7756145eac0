"""NMEA sentences: fields, carried date and time, satellite groups, one table per sentence.

Input is a line table ``(track_id, line_no, value)``; ``line_no`` gives the order in the log. All extraction is
column expressions over the split sentence.
"""

from __future__ import annotations

from functools import reduce
from operator import xor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.plans.sequence import carry, row_index, running_sum, with_neighbours
from trackloom.plans.session import computed_once, settle
from trackloom.plans.skew import CHUNK, attach_track, skew_join, split_hot_tracks

LINE_ORDER = ("line_no",)
POSITION_TOLERANCE_DEG = 1e-6
SATELLITE = "struct<prn:int,elevation:int,azimuth:int,snr:int>"
_GRAMMAR = r"^\$?([A-Za-z]{2}[A-Z]{3}(?:,[^*]*)?)(?:\*([0-9A-Fa-f]{2}))?$"


def xor_checksum(body: Column) -> Column:
    """Two hex digits: XOR of all characters."""

    def xor_of_characters(bodies: pa.Array) -> pa.Array:
        """All bytes of a batch at once, and code points where a text is not ASCII."""
        texts = bodies.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
        totals, filled = np.zeros(len(texts), np.int32), np.flatnonzero(np.diff(ends))
        if len(filled):
            # each filled text ends where the next begins
            used, starts = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends[:-1][filled] - ends[0]
            totals[filled] = np.bitwise_xor.reduceat(used, starts)
            for i in filled[np.maximum.reduceat(used, starts) > 127].tolist():
                totals[i] = reduce(xor, map(ord, texts[i].as_py().decode(errors="replace")))
        return pa.array(totals, mask=texts.is_null().to_numpy(zero_copy_only=False))

    total = F.arrow_udf(xor_of_characters, "int")(body)
    return F.lpad(F.hex(total.cast("bigint")), 2, "0")


def tokenize(lines: DataFrame) -> DataFrame:
    """Split each non-blank line and say whether it is a sound sentence.

    ``status`` is ``parsed``, ``malformed`` (no sentence, or wrong checksum) or ``other`` (undecodable bytes).
    """
    body, checksum, sound = F.col("body"), F.col("checksum"), F.col("status") == "parsed"
    texts = computed_once(lines, {"_text": F.trim(F.col("value"))}).where(F.col("_text") != "")
    parts = computed_once(
        texts, {"_body": F.regexp_extract("_text", _GRAMMAR, 1), "_checksum": F.upper(F.regexp_extract("_text", _GRAMMAR, 2))}
    ).select(
        *lines.columns,
        F.col("_text").contains("\ufffd").alias("_other"),
        F.nullif(F.col("_body"), F.lit("")).alias("body"),
        F.nullif(F.col("_checksum"), F.lit("")).alias("checksum"),
    )
    checked = computed_once(parts, {"computed": xor_checksum(body)}).withColumn(
        "status",
        F.when(F.col("_other"), "other")
        .when(body.isNull(), "malformed")
        .when(checksum.isNotNull() & (checksum != F.col("computed")), "malformed")
        .otherwise("parsed"),
    )
    # a sound body begins with five letters, its address
    return computed_once(checked.drop("_other"), {"fields": F.when(sound, F.split("body", ","))}).withColumns(
        {"talker_id": F.when(sound, F.upper(F.substring("body", 1, 2))), "sentence_type": F.when(sound, F.substring("body", 3, 3))}
    )


def parse_stats(tokens: DataFrame) -> DataFrame:
    """Parsed, malformed and other lines per track."""
    return tokens.groupBy("track_id").agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("parsed", "malformed", "other")]
    )


def count_types(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("sentence_type").isNotNull()).groupBy("sentence_type").agg(F.count(F.lit(1)).alias("n"))


def _field(i: int) -> Column:
    return F.trim(F.get("fields", F.lit(i)))


def _text(i: int) -> Column:
    return F.nullif(_field(i), F.lit(""))


def _real(i: int) -> Column:
    """Number in a field; blank text is told first, as a cast of it fails at the price of an exception."""
    return _text(i).try_cast("double")


def _whole(i: int) -> Column:
    return _field(i).try_cast("int")


def time_micros(text: Column) -> Column:
    """``hhmmss[.ff]`` to microseconds of the day; NULL if invalid."""
    ok = text.rlike(r"^\d{6}(\.\d*)?$")
    h, m = F.substring(text, 1, 2).try_cast("int"), F.substring(text, 3, 2).try_cast("int")
    s = F.substring(text, 5, 20).try_cast("double")
    micros = (h * 3600 + m * 60).cast("bigint") * 1_000_000 + F.round(s * S.number(1e6)).cast("bigint")
    return F.when(ok & (h < 24) & (m < 60) & (s < 60), micros)


def date_ddmmyy(text: Column, pivot: int = 69) -> Column:
    """``ddmmyy`` to a date; two-digit years from ``pivot`` on belong to the last century."""
    yy = F.substring(text, 5, 2)
    century = F.when(yy.try_cast("int") >= pivot, "19").otherwise("20")
    iso = F.concat(century, yy, F.lit("-"), F.substring(text, 3, 2), F.lit("-"), F.substring(text, 1, 2))
    return F.when(text.rlike(r"^\d{6}$"), iso.try_cast("date"))


def day_time(date: Column, micros: Column) -> Column:
    return F.timestamp_micros(F.unix_date(date).cast("bigint") * 86_400_000_000 + micros)


def _satellites() -> Column:
    slots = F.array(
        *[
            F.struct(
                _whole(b).alias("prn"),
                _whole(b + 1).alias("elevation"),
                _whole(b + 2).alias("azimuth"),
                _whole(b + 3).alias("snr"),
            )
            for b in (4, 8, 12, 16)
        ]
    )
    return F.filter(slots, lambda s: s["prn"].isNotNull()).cast(f"array<{SATELLITE}>")


def extract_fields(tokens: DataFrame) -> DataFrame:
    """One row per parsed sentence with the prefixed columns of its type; others stay NULL."""
    kind = F.col("sentence_type")

    def of(sentence: str, value: Column) -> Column:
        return F.when(kind == sentence, value)

    # the position fields of RMC start one place later than those of GGA
    raw = {
        name: F.when(kind == "RMC", _field(i + 1)).when(kind == "GGA", _field(i))
        for name, i in (("_lat", 2), ("_ns", 3), ("_lon", 4), ("_ew", 5))
    }
    raw["_time"] = F.when(kind.isin("RMC", "GGA"), _field(1))
    raw["_date"] = of("RMC", _field(9))
    keep = [c for c in ("track_id", "line_no", "chunk") if c in tokens.columns]
    known = tokens.where((F.col("status") == "parsed") & kind.isin("RMC", "GGA", "VTG", "GSA", "GSV"))
    staged = known.select(*keep, kind, "talker_id", "fields", *[v.alias(n) for n, v in raw.items()])
    staged = staged.withColumns({"_lat": S.dm_to_deg("_lat"), "_lon": S.dm_to_deg("_lon")})
    ns, ew = F.nullif(F.col("_ns"), F.lit("")), F.nullif(F.col("_ew"), F.lit(""))
    return staged.select(
        *keep,
        kind,
        "talker_id",
        date_ddmmyy(F.col("_date")).alias("own_date"),
        time_micros(F.col("_time")).alias("own_time"),
        S.signed_coord("_lat", ns).alias("lat"),
        S.signed_coord("_lon", ew).alias("lon"),
        of("RMC", _text(2)).alias("rmc_status"),
        of("RMC", _real(7)).alias("rmc_speed_knots"),
        of("RMC", _real(8)).alias("rmc_true_course"),
        of("RMC", _real(10)).alias("rmc_mag_variation"),
        of("GGA", _whole(6)).alias("gga_gps_quality"),
        of("GGA", _whole(7)).alias("gga_num_sats"),
        of("GGA", _real(8)).alias("gga_hdop"),
        of("GGA", _real(9)).alias("gga_altitude"),
        of("GGA", _real(11)).alias("gga_geo_separation"),
        of("VTG", _real(5)).alias("vtg_speed_knots"),
        of("VTG", _real(7)).alias("vtg_speed_kmh"),
        of("VTG", _real(1)).alias("vtg_true_track"),
        of("VTG", _real(3)).alias("vtg_mag_track"),
        of("GSA", _whole(2)).alias("gsa_fix_type"),
        of("GSA", _real(15)).alias("gsa_pdop"),
        of("GSA", _real(16)).alias("gsa_hdop"),
        of("GSA", _real(17)).alias("gsa_vdop"),
        of("GSV", _whole(1)).alias("gsv_num_messages"),
        of("GSV", _whole(2)).alias("gsv_msg_num"),
        of("GSV", F.coalesce(_whole(3), F.lit(0))).alias("gsv_in_view"),
        of("GSV", _satellites()).alias("gsv_satellites"),
    )


def carry_clock(fields: DataFrame) -> DataFrame:
    """Carry date, time and the last complete clock along the log and stamp each sentence.

    RMC uses its own date and time only; GGA the carried date; VTG and GSA carried date and time. ``clock`` is
    the last complete stamp of an RMC or GGA sentence.
    """
    kind = F.col("sentence_type")
    df = carry(fields, {"date": F.col("own_date"), "time": F.col("own_time")}, order=LINE_ORDER)
    ts = (
        F.when(kind == "RMC", day_time(F.col("own_date"), F.col("own_time")))
        .when(kind == "GGA", day_time(F.col("date"), F.col("own_time")))
        .when(kind.isin("VTG", "GSA"), day_time(F.col("date"), F.col("time")))
    )
    tick = F.when(kind.isin("RMC", "GGA"), F.col("ts"))
    return carry(df.withColumn("ts", ts), {"clock": tick}, order=LINE_ORDER)


def _final_clock() -> Column:
    """Clock of the last sentence that has one."""
    return F.max_by("clock", F.when(F.col("clock").isNotNull(), F.col("line_no")))


def _with_final(clocked: DataFrame) -> DataFrame:
    """Add ``_final``, the last clock of the track, in the pass that carries the clock; left out where a track is split."""
    if CHUNK in clocked.columns or "_final" in clocked.columns:
        return clocked
    last = _final_clock().over(Window.partitionBy("track_id"))
    return clocked.withColumn("_final", F.when(F.col("track_id").isNotNull(), last))


def group_gsv(clocked: DataFrame) -> DataFrame:
    """Join the GSV sentences of one report into one row with all satellites.

    A complete report carries the clock of its last sentence, an incomplete one the clock of the sentence that
    ends it, or of the end of the log. The satellite count is what was collected; the header count is kept too.
    """
    clocked = _with_final(clocked)
    zero = F.col("gsv_in_view") == 0
    complete = F.coalesce(F.col("gsv_msg_num") == F.col("gsv_num_messages"), F.lit(False))
    gsv = clocked.where(F.col("sentence_type") == "GSV").withColumn("_closed", zero | complete)
    gsv, row = with_neighbours(gsv, ["talker_id", "_closed", "clock"], 1, order=LINE_ORDER)
    before, after = F.col(row[-1]), F.col(row[1])
    starts = (
        zero
        | F.coalesce(F.col("gsv_msg_num") == 1, F.lit(False))
        | before.isNull()
        | before["_closed"]
        | (before["talker_id"] != F.col("talker_id"))
    )
    gsv = running_sum(gsv, starts.cast("bigint"), "group_no", order=LINE_ORDER)
    if "_final" not in clocked.columns:
        gsv = attach_track(gsv, clocked.groupBy("track_id").agg(_final_clock().alias("_final")))
    stamp = F.when(F.col("_closed"), F.col("clock")).when(after.isNotNull(), after["clock"]).otherwise(F.col("_final"))
    parts = F.array_sort(F.collect_list(F.struct("line_no", F.col("gsv_satellites").alias("s"))))
    return (
        gsv.withColumn("_stamp", F.struct(stamp.alias("t")))
        .groupBy("track_id", "group_no")
        .agg(
            F.first("talker_id").alias("talker_id"),
            F.max_by("_stamp", "line_no")["t"].alias("ts"),
            F.min("line_no").alias("line_no"),
            F.count(F.lit(1)).alias("n_sentences"),
            F.max_by("gsv_in_view", "line_no").alias("header_in_view"),
            F.flatten(F.transform(parts, lambda p: p["s"])).alias("gsv_satellites"),
        )
        .withColumn("num_sv_in_view", F.size("gsv_satellites"))
    )


def build_schema_a(clocked: DataFrame) -> DataFrame:
    """All sentences and satellite groups of a track in one table, ordered by time with ``seq``.

    Rows without a time come first; satellite groups follow the other sentences of the same time. The parsed
    sentences are written once, because sentences, groups and the final clock all start from them.
    """
    clocked = settle(_with_final(clocked), "sentences")
    drop = ["_final", "own_date", "own_time", "date", "time", "clock", "gsv_num_messages", "gsv_msg_num", "gsv_in_view"]
    others = clocked.where(F.col("sentence_type") != "GSV").drop(*drop, "gsv_satellites")
    groups = group_gsv(clocked).drop("group_no", "n_sentences", "header_in_view")
    rows = others.drop("chunk").unionByName(
        groups.withColumn("sentence_type", F.lit("GSV")), allowMissingColumns=True
    )
    rows = rows.withColumn("_late", (F.col("sentence_type") == "GSV").cast("int"))
    return row_index(split_hot_tracks(rows, bound=clocked), order=("ts", "_late", "line_no"), name="seq").drop("_late")


def check_gga_against_rmc(schema_a: DataFrame, tolerance_deg: float = POSITION_TOLERANCE_DEG) -> DataFrame:
    """Add ``pos_mismatch`` and ``time_mismatch`` on GGA rows that have a valid RMC of the same time."""
    rmc = (
        schema_a.where((F.col("sentence_type") == "RMC") & (F.col("rmc_status") == "A") & F.col("ts").isNotNull())
        .groupBy("track_id", "ts")
        .agg(F.min_by(F.struct("lat", "lon"), "seq").alias("_rmc"))
    )
    gga = F.col("sentence_type") == "GGA"
    tol = S.number(tolerance_deg)
    dlat, dlon = F.abs(F.col("_rmc.lat") - F.col("lat")), F.abs(F.col("_rmc.lon") - F.col("lon"))
    complete = dlat.isNotNull() & dlon.isNotNull()
    return (
        skew_join(schema_a, rmc, ["track_id", "ts"], within_track=True)
        .withColumn("pos_mismatch", F.when(gga & complete, (dlat > tol) | (dlon > tol)))
        .withColumn("time_mismatch", F.when(gga & F.col("_rmc").isNotNull(), F.lit(False)))
        .drop("_rmc")
    )


SCHEMA_A_TYPES = {
    "sentence_type": "string",
    "talker_id": "string",
    "rmc_status": "string",
    "gga_gps_quality": "smallint",
    "gga_num_sats": "smallint",
    "gsa_fix_type": "smallint",
    "num_sv_in_view": "smallint",
    "rmc_speed_knots": "float",
    "rmc_true_course": "float",
    "rmc_mag_variation": "float",
    "gga_hdop": "float",
    "gga_altitude": "float",
    "gga_geo_separation": "float",
    "vtg_speed_knots": "float",
    "vtg_speed_kmh": "float",
    "vtg_true_track": "float",
    "vtg_mag_track": "float",
    "gsa_pdop": "float",
    "gsa_hdop": "float",
    "gsa_vdop": "float",
    "lat": "double",
    "lon": "double",
}


def apply_types(schema_a: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Cast the columns that are present to their stored types; unreadable values become NULL."""
    chosen = SCHEMA_A_TYPES if types is None else types
    return schema_a.withColumns({c: F.col(c).try_cast(t) for c, t in chosen.items() if c in schema_a.columns})


def field_names(schema_a: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The columns that some sentence of each type fills."""
    names = columns or [c for c in schema_a.columns if c not in ("track_id", "seq", "line_no", "sentence_type", "chunk")]
    present = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names]), lambda x: x.isNotNull())
    return (
        schema_a.select("sentence_type", F.explode(present).alias("f"))
        .groupBy("sentence_type")
        .agg(F.array_sort(F.collect_set("f")).alias("fields"))
    )
