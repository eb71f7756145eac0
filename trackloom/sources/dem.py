"""Elevation grids as pixel tables. Binary rasters must be converted to ASCII grids or Parquet beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.raster import BLOCK, pack_lines
from trackloom.operators.terrain import pixel_centre
from trackloom.plans.sequence import row_index
from trackloom.sources.files import read_lines

HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")


def _ascii_lines(spark: SparkSession, path, glob: str | None, named: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tiles with ``nodata``, lines of words) of ASCII grids."""
    lines = read_lines(spark, path, "dem", glob, named).withColumn("value", F.trim("value")).where(F.col("value") != "")
    words = F.split("value", r"\s+")
    head = F.lower(F.get(words, F.lit(0)))
    header = (
        lines.where(head.isin(*HEADER))
        .groupBy("track_id")
        .agg(*[F.max(F.when(head == h, F.get(words, F.lit(1)).try_cast("double"))).alias(h) for h in HEADER])
    )
    tiles = header.select(
        F.col("track_id").alias("tile_id"),
        F.col("track_id").alias("priority"),
        F.col("xllcorner").alias("left"),
        F.col("yllcorner").alias("bottom"),
        (F.col("xllcorner") + F.col("ncols") * F.col("cellsize")).alias("right"),
        (F.col("yllcorner") + F.col("nrows") * F.col("cellsize")).alias("top"),
        F.col("cellsize").alias("dx"),
        F.col("cellsize").alias("dy"),
        F.col("nrows").cast("int").alias("n_rows"),
        F.col("ncols").cast("int").alias("n_cols"),
        F.col("nodata_value").alias("nodata"),
    )
    body = row_index(lines.where(~head.isin(*HEADER)), order=("line_no",), name="row")
    return tiles, body.select(F.col("track_id").alias("tile_id"), F.col("row").cast("int").alias("row"), words.alias("words"))


def read_ascii_grid(
    spark: SparkSession, path, glob: str | None = "*.asc", named: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(tiles, pixels) of ASCII grids; tile order is file name order. ``named``: as in ``read_lines``."""
    tiles, lines = _ascii_lines(spark, path, glob, named)
    pixels = (
        lines.select("tile_id", "row", F.posexplode("words").alias("col", "text"))
        .join(tiles.select("tile_id", "nodata"), "tile_id")
        .select("tile_id", "row", "col", F.nullif(F.col("text").try_cast("double"), F.col("nodata")).alias("elev"))
    )
    return tiles.drop("nodata"), pixels


def read_ascii_blocks(spark: SparkSession, path, glob: str | None = "*.asc", size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(tiles, blocks) of ASCII grids: lines are cut into segments where they are read, and never become pixels."""
    tiles, lines = _ascii_lines(spark, path, glob)
    lines = lines.join(tiles.select("tile_id", "nodata", "n_cols"), "tile_id")
    values = F.transform("words", lambda w: F.nullif(w.try_cast("double"), F.col("nodata")).cast("float"))
    line = F.slice(F.concat(values, F.array_repeat(F.lit(None).cast("float"), F.col("n_cols"))), F.lit(1), F.col("n_cols"))
    count = F.ceil(F.col("n_cols") / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice("_line", (b * size + 1).cast("int"), F.lit(size)))
    segments = lines.withColumn("_line", line).select("tile_id", "row", F.posexplode(cut).alias("bcol", "line"))
    return tiles.drop("nodata"), pack_lines(segments, tiles, size=size)


def with_centres(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """Add the coordinates of each pixel's centre and its row counted from the south."""
    lat, lon = pixel_centre("row", "col")
    return pixels.join(tiles, "tile_id").select(
        "tile_id", "row", "col", (F.col("n_rows") - 1 - F.col("row")).alias("row_from_south"),
        lat.alias("lat"), lon.alias("lon"), "elev",
    )
