"""NMEA logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.nmea import tokenize
from trackloom.sources.files import read_lines


def read_nmea(spark: SparkSession, path, glob: str | None = "*.txt", named: bool = False) -> DataFrame:
    """Tokenized sentences of all logs below ``path``; unsound lines stay, with their ``status``. ``named``: as in ``read_lines``."""
    return tokenize(read_lines(spark, path, "nmea", glob, named))


def corrupt_lines(tokens: DataFrame) -> DataFrame:
    """The lines that are no sound sentence."""
    return tokens.where(F.col("status") != "parsed").select("track_id", "line_no", "status", "value")
