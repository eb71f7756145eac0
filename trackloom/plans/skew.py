"""Keep hot keys from landing in one task.

A window or a collected group over ``track_id`` puts a whole track into one task. That is fine
for ordinary tracks and not for one that holds a third of all rows. ``split_hot_tracks`` cuts such
tracks into consecutive *chunks* and adds a ``chunk`` column; the sequence helpers then work on
``(track_id, chunk)`` and pass a small summary from chunk to chunk. If no track is hot the column is
not added and the helpers use plain windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.plans.session import settle

CHUNK = "chunk"
TARGET_ROWS = 500_000
TARGET_ROWS_CONF = "trackloom.targetRows"
BROADCAST_ROWS = 1_000_000
_SUB_SPLITS = 1 << 20
_BEFORE_ALL = -(1 << 62)

Keys = list[str] | tuple[str, ...]


def target_rows_of(df: DataFrame) -> int:
    """Rows that one task may hold of one key: the session's ``trackloom.targetRows``, else 500 000."""
    return int(df.sparkSession.conf.get(TARGET_ROWS_CONF, str(TARGET_ROWS)))


def position(df: DataFrame, order: str) -> Column:
    """Order column as a BIGINT: microseconds for timestamps, the value itself for integers."""
    kind = df.schema[order].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(order).cast("timestamp"))
    return F.col(order).cast("bigint")


def split_hot_tracks(
    df: DataFrame,
    key: Keys = ("track_id",),
    order: str = "ts",
    target_rows: int | None = None,
    cell: int | None = None,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Add ``chunk`` if some track has more than ``target_rows`` rows, else return ``df`` unchanged.

    A histogram over cells of the order column (one hour, or 65 536 positions) is grouped into runs of
    about ``target_rows`` rows; a cell that is itself too full is divided evenly. Chunk numbers grow with
    the order column, so "all earlier rows" means "earlier chunks, then earlier rows of this chunk".
    Rows that share one order value stay together. ``bound`` is a table at hand, with at least as many rows of
    each track: where none of its tracks is hot the rows need not be made to be counted.
    """
    key = list(key)
    if CHUNK in df.columns:
        return df
    target_rows = target_rows or target_rows_of(df)
    if cell is None:
        is_time = isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType))
        cell = 3_600_000_000 if is_time else 65_536
    if bound is not None and _hot_keys(bound, key, target_rows).isEmpty():
        return df
    hot = _hot_keys(df, key, target_rows)
    if hot.isEmpty():
        return df

    pos = position(df, order)
    cell_no = F.floor(pos / F.lit(float(cell)))
    by_track = Window.partitionBy(*key).orderBy("_cell")
    cells = (
        df.join(_broadcast_largest(hot).select(*key), key, "left_semi")
        .groupBy(*key, cell_no.alias("_cell"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_cell").isNotNull())
        .withColumn("_run", F.floor((F.sum("_n").over(by_track) - F.col("_n")) / F.lit(target_rows)))
        .withColumn("_first", F.min("_cell").over(Window.partitionBy(*key, "_run")))
        .select(
            *key,
            "_cell",
            "_first",
            F.least(F.ceil(F.col("_n") / F.lit(target_rows)), F.lit(_SUB_SPLITS - 1)).alias("_parts"),
        )
    )
    cells = settle(cells, "cells")
    if cells.count() <= BROADCAST_ROWS:
        cells = F.broadcast(cells)
    within = (pos - F.col("_cell") * F.lit(cell)) * F.col("_parts") / F.lit(float(cell))
    chunk = F.when(pos.isNull(), F.lit(_BEFORE_ALL)).otherwise(
        F.coalesce(F.col("_first") * F.lit(_SUB_SPLITS) + F.floor(within), F.lit(0))
    )
    return (
        df.withColumn("_cell", cell_no)
        .join(cells, [*key, "_cell"], "left")
        .withColumn(CHUNK, chunk.cast("bigint"))
        .drop("_cell", "_first", "_parts")
    )


def _hot_keys(df: DataFrame, key: list[str], target_rows: int) -> DataFrame:
    return df.groupBy(*key).count().where(F.col("count") > target_rows)


def _broadcast_largest(hot: DataFrame) -> DataFrame:
    """At most ``BROADCAST_ROWS`` keys, those with the most rows, so the broadcast is bounded at any size.

    A key left out holds less than one row in ``BROADCAST_ROWS`` and is joined like an ordinary one.
    """
    return F.broadcast(hot.orderBy(F.desc("count")).limit(BROADCAST_ROWS))


def partition_keys(df: DataFrame, key: Keys) -> list[str]:
    """The columns whose rows one task may hold together."""
    return [*key, CHUNK] if CHUNK in df.columns else list(key)


def attach_track(df: DataFrame, per_track: DataFrame, key: Keys = ("track_id",), how: str = "left") -> DataFrame:
    """Join one-row-per-track values to the rows without gathering a hot track.

    With chunks the values are first spread over the (track, chunk) pairs, a small table, and the rows are
    joined on that pair.
    """
    key = list(key)
    if CHUNK not in df.columns:
        return df.join(per_track, key, how)
    pairs = df.select(*key, CHUNK).distinct()
    return df.join(pairs.join(per_track, key, how), [*key, CHUNK], how)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: Keys,
    how: str = "left",
    target_rows: int | None = None,
    within_track: bool = False,
) -> DataFrame:
    """Equi-join in which a key with more than ``target_rows`` left rows is salted.

    Only the hot keys are salted, and only their right rows are repeated. ``within_track`` says that the key contains the track and
    that the rows went through ``split_hot_tracks``: without chunks no track is hot, so no key can be.
    """
    keys = list(keys)
    if within_track and CHUNK not in left.columns:
        return left.join(right, keys, how)
    target_rows = target_rows or target_rows_of(left)
    hot = _broadcast_largest(_hot_keys(left, keys, target_rows)).select(
        *keys, F.ceil(F.col("count") / F.lit(target_rows)).cast("int").alias("_salts")
    )
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    # the salt depends on the row only, so a task that runs again puts it in the same place
    salted = (
        left.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int"))
        .drop("_salts")
    )
    spread = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")
