"""Chart overlays: a picture with a text file of the same name that gives four corners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.sources.files import file_name, options, stem

CORNERS = ("tl", "tr", "bl", "br")


def _metadata(lines: Column, key: str) -> Column:
    hits = F.filter(lines, lambda s: F.lower(F.trim(F.regexp_extract(s, r"^([^:]*):", 1))) == key)
    return F.trim(F.regexp_replace(F.try_element_at(hits, F.lit(-1)), r"^[^:]*:", ""))


def parse_overlays(texts: DataFrame) -> DataFrame:
    """``(name, value)`` texts to overlays; texts without four coordinate lines are dropped.

    Blank lines and ``#`` comments do not count. A line with a colon is ``key: value``. A coordinate line whose
    first two words are not numbers means the text is no overlay.
    """
    lines = F.filter(
        F.transform(F.split("value", r"\r\n|\r|\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~s.startswith("#")
    )
    words = F.filter(
        F.transform(
            F.filter(F.col("_lines"), lambda s: ~s.contains(":")),
            lambda s: F.filter(F.split(F.replace(s, F.lit(","), F.lit(" ")), r"\s+"), lambda w: w != ""),
        ),
        lambda w: F.size(w) >= 2,
    )
    pairs = F.transform(
        words, lambda w: F.struct(w[0].try_cast("double").alias("lon"), w[1].try_cast("double").alias("lat"))
    )
    last = F.filter(F.col("_lines"), lambda s: s.contains(":"))
    keep = [c for c in texts.columns if c != "value"]
    df = texts.withColumn("_lines", lines).withColumns(
        {"_pairs": pairs, "_elev": _metadata(last, "elevation_m"), "_sub": _metadata(last, "subdivision")}
    )
    sound = (F.size("_pairs") >= 4) & ~F.exists("_pairs", lambda p: p["lon"].isNull() | p["lat"].isNull())
    sub = F.col("_sub").try_cast("int")
    corners = [F.col("_pairs")[i].alias(f"corner_{c}") for i, c in enumerate(CORNERS)]
    return df.where(sound).select(
        *keep,
        *corners,
        F.coalesce(F.col("_elev").try_cast("double"), F.lit(0.0)).alias("elevation_m"),
        F.when(sub.between(2, 256), sub).alias("subdivision"),
    )


def overlay_bounds(overlays: DataFrame) -> DataFrame:
    """Smallest box around the four corners."""
    lons = F.array(*[F.col(f"corner_{c}.lon") for c in CORNERS])
    lats = F.array(*[F.col(f"corner_{c}.lat") for c in CORNERS])
    return overlays.withColumns(
        {
            "lon_min": F.array_min(lons),
            "lat_min": F.array_min(lats),
            "lon_max": F.array_max(lons),
            "lat_max": F.array_max(lats),
        }
    )


def pair_by_stem(texts: DataFrame, pictures: DataFrame) -> DataFrame:
    """Texts that have a picture of the same folder and name."""
    return texts.join(pictures, ["folder", "name"], "inner")


def _listed(df: DataFrame) -> DataFrame:
    path = F.col("_path")
    return df.withColumns({"folder": F.regexp_replace(path, "/[^/]*$", ""), "name": stem(file_name(path))})


def read_overlays(spark: SparkSession, path) -> DataFrame:
    """All overlays below a path, with the picture's path."""
    texts = (
        spark.read.options(**options("*.txt")).text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("_path"), "value")
    )
    # the same form of path as that of the texts
    pictures = (
        spark.read.format("binaryFile").options(**options("*.png")).load(path)
        .select(F.col("_metadata.file_path").alias("_path"))
    )
    pictures = _listed(pictures).withColumnRenamed("_path", "picture")
    return parse_overlays(pair_by_stem(_listed(texts).drop("_path"), pictures))
