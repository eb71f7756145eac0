"""Exact deduplication by a 128-bit content hash with a comparison of bytes, in built-in expressions only.

The texts meet once, grouped by hash and text: rows of one text are combined before the shuffle, so a text that a third
of all rows share moves once a partition. Two texts under one hash remain two groups there, which is the byte
comparison. The rows themselves are then matched by hash alone (16 bytes, no text); only for hashes that hold
two texts, should there be any, are they matched by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.plans.session import settle

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; null as ''.

    ``lower`` does that where all characters are ASCII. Other texts have their other characters percent-encoded
    meanwhile, whose hexadecimal digits mean the same in either case.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.url_decode(F.lower(F.url_encode(text))))


def content_hash(text: Column) -> Column:
    """The 128 bits by which rows are matched, as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    normalise: Callable[[Column], Column] = ascii_lower,
    digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256 of the normalised text.

    Rows are a group if their normalised texts are identical byte by byte; the row with the largest id stays. Null text
    counts as empty. Rows without an id belong to groups but never stay unless no row of the group has an id (then
    keep_id is null and kept false). Rows that repeat an id are all marked as the row with that id is. Other columns of
    ``docs`` are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalise(F.col(text)).alias("_t")).withColumn("_h", digest(F.col("_t")))
    groups = settle(
        rows.groupBy("_h", "_t")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .withColumn("text_sha256", F.sha2(F.col("_t").cast("binary"), 256))
        .withColumn("_n", F.length("_t")),
        "texts",
    )
    shared = groups.groupBy("_h").count().where("count > 1").select("_h")
    found = rows.drop("_t").join(groups.drop("_t", "_n"), "_h")
    if not shared.isEmpty():
        shared = settle(shared, "collisions")
        apart = rows.join(shared, "_h", "left_semi").join(groups.drop("_n"), ["_h", "_t"])
        found = found.join(shared, "_h", "left_anti").unionByName(apart.drop("_t"))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        "text_sha256",
    )
