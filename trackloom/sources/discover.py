"""What a directory holds: logs by format, elevation tiles, pictures, sidecar files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.sources.cuts import SUFFIX
from trackloom.sources.files import file_name, options, stem

FORMATS = {"txt": "nmea", "gpx": "gpx", "kml": "kml", "igc": "igc", "tif": "dem", "tiff": "dem", "asc": "dem", "png": "picture"}


def classify(files: DataFrame) -> DataFrame:
    """``(path, length)`` listings to kinds. A ``.txt`` beside a ``.png`` of the same name is an overlay."""
    path = F.col("path")
    df = files.withColumns({"name": file_name(path), "folder": F.regexp_replace(path, "/[^/]*$", "")})
    extension = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    kind = F.when(F.col("name").endswith(SUFFIX), "cuts").otherwise(
        F.coalesce(F.try_element_at(table, extension), F.lit("other"))
    )
    return df.withColumns({"kind": kind, "stem": stem(F.col("name"))})


def overlay_pairs(classified: DataFrame) -> DataFrame:
    """Mark texts that have a picture of the same folder and name as overlays."""
    pictures = classified.where(F.col("kind") == "picture").select("folder", "stem").distinct().withColumn("_p", F.lit(True))
    joined = classified.join(pictures, ["folder", "stem"], "left")
    return joined.withColumn(
        "kind", F.when((F.col("kind") == "nmea") & F.col("_p"), "overlay").otherwise(F.col("kind"))
    ).drop("_p")


def sidecars(classified: DataFrame) -> DataFrame:
    """Add the path of ``<file>.cuts.json`` in the same folder, if there is one."""
    cuts = classified.where(F.col("kind") == "cuts").select(
        "folder",
        F.regexp_replace("name", r"\.cuts\.json$", "").alias("name"),
        F.col("path").alias("cuts_path"),
    )
    return classified.where(F.col("kind") != "cuts").join(cuts, ["folder", "name"], "left")


def discover_inputs(spark: SparkSession, path) -> DataFrame:
    """Every file below a path with its kind and sidecar. File contents are not read."""
    files = spark.read.format("binaryFile").options(**options(None)).load(path)
    # the same form of path as the readers see
    files = files.select(F.col("_metadata.file_path").alias("path"), "length")
    return sidecars(overlay_pairs(classify(files))).select("path", "name", "stem", "kind", "length", "cuts_path")
