"""Cut instruction files: one JSON document next to each edited log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.edit import cut_error
from trackloom.sources.files import file_name, options

SUFFIX = ".cuts.json"
_RANGE = "struct<start:bigint,end:bigint,mode:string>"


def _kind(doc: Column, path: str) -> Column:
    """JSON type of a field, NULL if absent or null."""
    return F.nullif(F.schema_of_variant(F.try_variant_get(doc, path, "variant")), F.lit("VOID"))


def parse_cuts(files: DataFrame) -> DataFrame:
    """``(path, value)`` documents to instructions with a ``reason`` where a document is rejected.

    Sound documents give ``source``, ``n_points_reference``, ``cut_ranges`` (sorted by start, mode ``trim`` if
    none is given), ``z_offset_m`` and ``created_at``.
    """
    doc = F.col("_doc")
    df = files.withColumn("_doc", F.try_parse_json("value"))
    ranges_kind = _kind(doc, "$.cut_ranges")
    listed = F.try_variant_get(doc, "$.cut_ranges", f"array<{_RANGE}>")
    with_mode = F.transform(
        F.coalesce(listed, F.expr(f"cast(array() as array<{_RANGE}>)")),
        lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.coalesce(r["mode"], F.lit("trim")).alias("mode")),
    )
    source = F.when(_kind(doc, "$.source") == "STRING", F.try_variant_get(doc, "$.source", "string"))
    count_kind = _kind(doc, "$.n_points_reference")
    offset_kind = _kind(doc, "$.z_offset_m")
    offset = F.try_variant_get(doc, "$.z_offset_m", "double")
    df = df.withColumns(
        {
            "source": source,
            "n_points_reference": F.try_variant_get(doc, "$.n_points_reference", "bigint"),
            "cut_ranges": F.array_sort(with_mode),
            "z_offset_m": offset,
            "created_at": F.try_variant_get(doc, "$.created_at", "string"),
        }
    )
    bad_cut = F.get(
        F.filter(
            F.transform("cut_ranges", lambda r: cut_error(r["start"], r["end"], r["mode"])), lambda x: x.isNotNull()
        ),
        F.lit(0),
    )
    reason = (
        F.when(doc.isNull(), "not JSON")
        .when(F.coalesce(F.col("source"), F.lit("")) == "", "source missing or empty")
        .when(count_kind.isNotNull() & (count_kind != "BIGINT"), "n_points_reference is no integer")
        .when(ranges_kind.isNotNull() & ~ranges_kind.startswith("ARRAY"), "cut_ranges is no list")
        .when(ranges_kind.isNotNull() & listed.isNull(), "cut_ranges has an unreadable entry")
        .when(bad_cut.isNotNull(), bad_cut)
        .when(offset_kind.isNotNull() & offset.isNull(), "z_offset_m is no number")
    )
    return df.withColumn("reason", reason).drop("_doc", "value")


def read_cuts(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(instructions, rejects) below a path; ``source_name`` is the log's file name taken from the document's."""
    files = (
        spark.read.options(**options(f"*{SUFFIX}"))
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    parsed = parse_cuts(files).withColumn(
        "source_name", F.regexp_replace(file_name(F.col("path")), r"\.cuts\.json$", "")
    )
    return parsed.where(F.col("reason").isNull()).drop("reason"), parsed.where(F.col("reason").isNotNull())


def cut_rows(instructions: DataFrame, key: str = "track_id") -> DataFrame:
    """One row per cut."""
    return instructions.select(key, F.posexplode("cut_ranges").alias("cut_id", "c")).select(key, "cut_id", "c.*")
