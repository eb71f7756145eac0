"""Scalar expressions on tracks: distance, units, coordinates, formats and classes.

Everything here is built from Spark's own functions. Missing input gives NULL, never NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_A = 6378137.0
EARTH_B = 6356752.314245179
EARTH_F = 1 / 298.257223563
SECOND_ECCENTRICITY_SQ = 0.006739496742276434
KMH_PER_KNOT = 1.852
KMH_PER_MPS = 3.6
KNOTS_PER_MPS = 1.94384
STANDARD_GRAVITY = 9.80665
METRES_PER_DEGREE = 111_320.0
METRES_PER_DEGREE_LAT_MESH = 110_540.0
FOOT = 0.3048
TALKER_NAMES = {
    "GP": "GPS",
    "GL": "GLONASS",
    "GA": "Galileo",
    "GB": "BeiDou",
    "BD": "BeiDou",
    "GQ": "QZSS",
    "GI": "NavIC",
    "GN": "Multi-GNSS",
}
FIX_LABELS = {
    0: "Kein Fix",
    1: "GPS",
    2: "DGPS",
    3: "PPS",
    4: "RTK Fix",
    5: "RTK Float",
    6: "Geschätzt",
    7: "Manuell",
    8: "Simuliert",
}

_LONG_LINE_M = 200_000.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(x: float) -> Column:
    """A DOUBLE literal."""
    return F.lit(float(x))


# --- distance -------------------------------------------------------------------------------


def _short_line_m(p1: Column, l1: Column, p2: Column, l2: Column) -> Column:
    """Bowring's closed form for short lines on the ellipsoid; arguments in radians."""
    e2 = number(SECOND_ECCENTRICITY_SQ)
    cos1 = F.cos(p1)
    c2 = cos1 * cos1
    a = F.sqrt(1 + e2 * c2 * c2)
    b2 = 1 + e2 * c2
    b = F.sqrt(b2)
    w = a * (l2 - l1) / 2
    dp = p2 - p1
    d = dp / (2 * b) * (1 + 3 * e2 / (4 * b2) * dp * F.sin(2 * p1 + number(2.0 / 3.0) * dp))
    e = F.sin(d) * F.cos(w)
    f = F.sin(w) * (b * cos1 * F.cos(d) - F.sin(p1) * F.sin(d)) / a
    return number(EARTH_A) * F.sqrt(1 + e2) / b2 * 2 * F.asin(F.least(F.hypot(e, f), number(1.0)))


def _let(body, **values: Column) -> Column:
    """``body`` of a struct of values, each computed once."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def _long_line_m(p1: Column, l1: Column, p2: Column, l2: Column) -> Column:
    """Vincenty's inverse formula, iterated a fixed number of times; arguments in radians."""
    u1 = F.atan(number(1 - EARTH_F) * F.tan(p1))
    u2 = F.atan(number(1 - EARTH_F) * F.tan(p2))
    # the short way round when the line crosses the date line
    turn = number(2 * math.pi)
    dl = (l2 - l1) - turn * F.round((l2 - l1) / turn)

    def on_sphere(g: Column, lam: Column, body) -> Column:
        x = g["c2"] * F.sin(lam)
        y = g["c1"] * g["s2"] - g["s1"] * g["c2"] * F.cos(lam)
        cos_s = g["s1"] * g["s2"] + g["c1"] * g["c2"] * F.cos(lam)

        def with_azimuth(k: Column) -> Column:
            sin_a = F.coalesce(g["c1"] * g["c2"] * F.sin(lam) / F.nullif(k["sin_s"], number(0)), number(0))
            return _let(with_midpoint(k), sin_a=sin_a)

        def with_midpoint(k: Column):
            def inner(m: Column) -> Column:
                cos2a = 1 - m["sin_a"] * m["sin_a"]
                cos2m = F.when(cos2a < 1e-15, number(0)).otherwise(
                    k["cos_s"] - 2 * g["s1"] * g["s2"] / F.nullif(cos2a, number(0))
                )
                return _let(
                    body,
                    sin_s=k["sin_s"],
                    cos_s=k["cos_s"],
                    sigma=F.atan2(k["sin_s"], k["cos_s"]),
                    sin_a=m["sin_a"],
                    cos2a=cos2a,
                    m=cos2m,
                )

            return inner

        return _let(with_azimuth, sin_s=F.hypot(x, y), cos_s=cos_s)

    def better(g: Column):
        def step(lam: Column, _: Column) -> Column:
            def next_lam(t: Column) -> Column:
                c = number(EARTH_F / 16) * t["cos2a"] * (4 + number(EARTH_F) * (4 - 3 * t["cos2a"]))
                inner = t["m"] + c * t["cos_s"] * (2 * t["m"] * t["m"] - 1)
                return g["dl"] + (1 - c) * number(EARTH_F) * t["sin_a"] * (t["sigma"] + c * t["sin_s"] * inner)

            return on_sphere(g, lam, next_lam)

        return step

    def metres(t: Column) -> Column:
        usq = t["cos2a"] * number((EARTH_A**2 - EARTH_B**2) / EARTH_B**2)
        return _let(
            lambda q: number(EARTH_B)
            * q["a"]
            * (
                t["sigma"]
                - q["b"]
                * t["sin_s"]
                * (
                    t["m"]
                    + q["b"]
                    / 4
                    * (
                        t["cos_s"] * (2 * t["m"] * t["m"] - 1)
                        - q["b"] / 6 * t["m"] * (4 * t["sin_s"] * t["sin_s"] - 3) * (4 * t["m"] * t["m"] - 3)
                    )
                )
            ),
            a=1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq))),
            b=usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq))),
        )

    return _let(
        lambda g: F.aggregate(F.sequence(F.lit(1), F.lit(12)), g["dl"], better(g), lambda lam: on_sphere(g, lam, metres)),
        c1=F.cos(u1),
        s1=F.sin(u1),
        c2=F.cos(u2),
        s2=F.sin(u2),
        dl=dl,
    )


def geodesic_m(lat1, lon1, lat2, lon2) -> Column:
    """Distance in metres on the WGS84 ellipsoid.

    Lines below 200 km use a closed form (error below 2 cm), longer ones Vincenty's formula, which does not
    settle for nearly antipodal points.
    """
    p1, l1, p2, l2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    short = _short_line_m(p1, l1, p2, l2)
    # the degree span says safely whether the closed form applies, without computing it first
    is_short = (F.abs(p2 - p1) < number(0.03)) & (F.abs(l2 - l1) * F.cos(p1) < number(0.03)) & (F.abs(l2 - l1) < 1)
    return F.when(is_short, short).otherwise(_long_line_m(p1, l1, p2, l2))


def geodesic_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The closed form as SQL text, for engines without a distance function."""
    p1, l1, p2, l2 = (f"radians({c})" for c in (lat1, lon1, lat2, lon2))
    e2 = repr(SECOND_ECCENTRICITY_SQ) + "::DOUBLE"
    a = f"sqrt(1+{e2}*pow(cos({p1}),4))"
    b2 = f"(1+{e2}*pow(cos({p1}),2))"
    w = f"({a}*({l2}-{l1})/2)"
    dp = f"({p2}-{p1})"
    d = f"({dp}/(2*sqrt({b2}))*(1+3*{e2}/(4*{b2})*{dp}*sin(2*{p1}+(2::DOUBLE/3)*{dp})))"
    e = f"(sin({d})*cos({w}))"
    f = f"(sin({w})*(sqrt({b2})*cos({p1})*cos({d})-sin({p1})*sin({d}))/{a})"
    return f"(6378137::DOUBLE*sqrt(1+{e2})/{b2}*2*asin(least(sqrt({e}*{e}+{f}*{f}),1::DOUBLE)))"


# --- coordinates and units ------------------------------------------------------------------


def signed_coord(degrees, direction) -> Column:
    """Degrees with the sign of the hemisphere letter; NULL if a part is missing."""
    d = col(direction)
    return F.when(d.isin("S", "W"), -col(degrees)).when(d.isNotNull(), col(degrees))


def dm_to_deg(field) -> Column:
    """``dddmm.mmmm`` text to degrees; NULL if empty or not numeric."""
    value = col(field).try_cast("double")
    whole = F.floor(value / 100)
    return whole + (value - whole * 100) / 60


def milli_minutes_to_deg(degrees, milli_minutes) -> Column:
    return col(degrees) + col(milli_minutes) / number(1000) / number(60)


def knots_to_kmh(c) -> Column:
    return col(c) * number(KMH_PER_KNOT)


def mps_to_kmh(c) -> Column:
    return col(c) * number(KMH_PER_MPS)


def mps_to_knots(c) -> Column:
    return col(c) * number(KNOTS_PER_MPS)


def kmh_to_mps(c) -> Column:
    return col(c) / number(KMH_PER_MPS)


def local_xy(lat, lon, ref_lat, ref_lon) -> tuple[Column, Column]:
    """Equirectangular metres east and north of a reference point."""
    k = number(METRES_PER_DEGREE)
    x = (col(lon) - col(ref_lon)) * (k * F.cos(F.radians(col(ref_lat))))
    y = (col(lat) - col(ref_lat)) * k
    return x, y


def metres_per_degree(lat) -> tuple[Column, Column]:
    """(east, north) metres per degree as used for mesh sizes; the north constant differs from ``local_xy``."""
    return number(METRES_PER_DEGREE) * F.cos(F.radians(col(lat))), number(METRES_PER_DEGREE_LAT_MESH)


def unify_speed(rmc_knots, vtg_knots, vtg_kmh) -> tuple[Column, Column]:
    """(knots, km/h): knots from RMC, else VTG; km/h from VTG, else from the knots."""
    knots = F.coalesce(col(rmc_knots), col(vtg_knots))
    return knots, F.coalesce(col(vtg_kmh), knots_to_kmh(knots))


# --- time -----------------------------------------------------------------------------------


def micros(ts) -> Column:
    """Microseconds since 1970 of a TIMESTAMP or TIMESTAMP_NTZ (session time zone UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def epoch_ms(ts) -> Column:
    """Whole milliseconds since 1970, rounded down."""
    return F.floor(micros(ts) / F.lit(1000)).cast("bigint")


def seconds_between(start, end) -> Column:
    return (micros(end) - micros(start)) / number(1_000_000)


def shift_back(ts, seconds: Column, dtype) -> Column:
    """``ts`` minus ``seconds``, to the microsecond, in the type it had."""
    moved = F.timestamp_micros(micros(ts) - F.round(seconds * number(1_000_000)).cast("bigint"))
    return moved.cast(dtype)


def iso_time(text) -> Column:
    """ISO-8601 text with ``Z`` or an offset to TIMESTAMP; NULL if invalid."""
    return F.trim(col(text)).try_cast("timestamp")


# --- numbers and text -----------------------------------------------------------------------


def safe_cast(text, dtype: str, default=None) -> Column:
    """Cast text; empty, missing or unreadable text gives the default."""
    value = col(text).try_cast(dtype)
    return value if default is None else F.coalesce(value, F.lit(default).cast(dtype))


def fixed(value, decimals: int) -> Column:
    """Text with fixed decimals, rounded from the exact binary value, halves to even."""
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", col(value).cast("double"), F.lit(pattern))


def round_or_null(value, decimals: int) -> Column:
    """Rounded as ``fixed`` rounds; NaN becomes NULL."""
    v = col(value).cast("double")
    return fixed(F.when(~F.isnan(v), v), decimals).cast("double")


def format_number(value, decimals: int) -> Column:
    """Fixed decimals without trailing zeros: 7.0 -> 7, 7.50 -> 7.5."""
    text = fixed(value, decimals)
    if decimals > 0:
        text = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return F.when(col(value).isNotNull(), F.when(text == "", F.lit("0")).otherwise(text))


def xml_escape(text) -> Column:
    out = F.replace(col(text), F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def _shown(value, decimals: int, suffix: str) -> Column:
    text = F.concat(fixed(value, decimals), F.lit(suffix))
    return F.when(col(value).isNotNull(), text).otherwise(F.lit("N/A"))


def point_label(
    idx, ts, lat, lon, alt, speed_kmh, speed_geodesic_kmh, speed_diff_kmh, distance_m, terrain=None, above=None
) -> Column:
    """Multi-line description of one point; two more lines if terrain columns are given."""
    parts = [
        ("Index", col(idx).cast("string")),
        ("Zeit", F.concat(F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))),
        ("Position", F.concat(_shown(lat, 6, "°"), F.lit(" N, "), _shown(lon, 6, "°"), F.lit(" E"))),
        ("Höhe", _shown(alt, 1, " m")),
        ("", None),
        ("GPS-Geschwindigkeit", _shown(speed_kmh, 1, " km/h")),
        ("Berechnet (geodesic)", _shown(speed_geodesic_kmh, 1, " km/h")),
        ("Differenz", _shown(speed_diff_kmh, 1, " km/h")),
        ("Distanz zu Vorgänger", _shown(distance_m, 1, " m")),
    ]
    if terrain is not None:
        parts += [("Geländehöhe", _shown(terrain, 1, " m")), ("Höhe über Grund", _shown(above, 1, " m"))]
    lines = [F.lit("") if v is None else F.concat(F.lit(f"<b>{name}:</b> "), v) for name, v in parts]
    return F.concat_ws("<br>", *lines)


def _js_round(value) -> Column:
    """Nearest integer, halves upward."""
    return F.floor(col(value).cast("double") + number(0.5)).cast("bigint")


def format_speed(kmh) -> Column:
    shown = F.concat(fixed(kmh, 1), F.lit(" km/h"))
    return F.when(col(kmh).isNull(), F.lit("–")).otherwise(shown)


def format_altitude(m) -> Column:
    return F.when(col(m).isNull(), F.lit("–")).otherwise(F.concat(_js_round(m).cast("string"), F.lit(" m")))


def format_distance(m) -> Column:
    km = F.concat(fixed(col(m) / number(1000), 2), F.lit(" km"))
    return (
        F.when(col(m).isNull(), F.lit("–"))
        .when(col(m) >= 1000, km)
        .otherwise(F.concat(_js_round(m).cast("string"), F.lit(" m")))
    )


def format_duration(seconds) -> Column:
    s = F.floor(col(seconds)).cast("bigint")
    h = F.floor(s / 3600).cast("bigint")
    m = F.floor((s % 3600) / 60).cast("bigint")
    return (
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("min")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("min "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat((s % 60).cast("string"), F.lit("s")))
    )


def format_utc(ts) -> Column:
    """Like ``Mon, 01 Jan 2024 00:00:07 UTC``."""
    return F.concat(F.date_format(col(ts), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" UTC"))


def _lookup(table: dict, key: Column, otherwise: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), otherwise)


def fix_label(code) -> Column:
    return _lookup(FIX_LABELS, col(code).cast("int"), col(code).cast("string"))


def talker_name(talker) -> Column:
    return _lookup(TALKER_NAMES, col(talker), col(talker))


# --- satellites -----------------------------------------------------------------------------


def marker_size(snr: Column) -> Column:
    return F.when(snr > 0, F.greatest(number(8), F.least(snr * number(0.6), number(30)))).otherwise(number(8))


def valid_satellites(satellites) -> Column:
    """The satellites that have both elevation and azimuth."""
    return F.filter(col(satellites), lambda s: s["elevation"].isNotNull() & s["azimuth"].isNotNull())


def sky_polar(satellites) -> Column:
    """Polar position and marker size of the valid satellites: zenith in the centre, north at angle 0."""

    def place(s: Column) -> Column:
        r = number(90) - s["elevation"]
        theta = s["azimuth"].cast("double")
        return F.struct(
            s["prn"].alias("prn"),
            r.alias("r"),
            theta.alias("theta"),
            marker_size(s["snr"]).alias("size"),
            F.when(s["snr"] > 0, s["snr"]).otherwise(F.lit(0)).alias("shade"),
            (r / 90 * F.sin(F.radians(theta))).alias("x"),
            (-r / 90 * F.cos(F.radians(theta))).alias("y"),
        )

    return F.transform(valid_satellites(satellites), place)


# --- classes and views ----------------------------------------------------------------------


def flight_class(alt_msl, alt_agl) -> Column:
    """low / mid by height above ground, then transition / high by height above sea."""
    agl, msl = col(alt_agl), col(alt_msl)
    return (
        F.when(agl < number(500 * FOOT), "low")
        .when(agl < number(1000 * FOOT), "mid")
        .when(msl < number(5000 * FOOT), "transition")
        .otherwise("high")
    )


def drone_class(alt_agl) -> Column:
    agl = col(alt_agl)
    return F.when(agl.isNull(), "unknown").when(agl <= 100, "ok").otherwise("violation")


def z_offset_view(alt, terrain, base, z_offset: float = 0.0, z_scale: float = 1.0) -> dict[str, Column]:
    """Altitude and height above ground with an offset, and the exaggerated altitude around the track base."""
    shifted = col(alt) + number(z_offset)
    drawn = F.coalesce(col(alt), col(base)) + number(z_offset)
    return {
        "alt_view": shifted,
        "above_view": shifted - col(terrain),
        "alt_exaggerated": col(base) + (drawn - col(base)) * number(z_scale),
    }


def color_channel(mode, columns: dict[str, str] | None = None) -> Column:
    """The value that a colour mode shows; modes without their own scale show speed."""
    c = {
        "altitude": "alt",
        "altitude_gnd": "above_terrain",
        "energy": "energy_height_m",
        "accuracy": "hdop",
        "speed": "speed_kmh",
        **(columns or {}),
    }
    m = col(mode)
    out = F.when(m == "altitude", F.col(c["altitude"]))
    for name in ("altitude_gnd", "energy", "accuracy"):
        out = out.when(m == name, F.col(c[name]))
    return out.otherwise(F.col(c["speed"]))
