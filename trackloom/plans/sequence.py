"""Ordered-sequence helpers: index, running sum, carry-forward, neighbours.

Each helper has two forms. Without a ``chunk`` column it is one window per track. With it, the window covers
one chunk, and what must cross the chunk border (a count, a sum, the last value, a few rows) is computed
per chunk, passed along a window over the chunk table, and joined back on ``(track, chunk)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.plans.skew import CHUNK, Keys, partition_keys

TRACK: Keys = ("track_id",)
ORDER: Keys = ("ts", "seq")


def track_window(df: DataFrame, key: Keys = TRACK, order: Keys = ORDER):
    """Window over the rows one task holds, in track order, nulls first."""
    return Window.partitionBy(*partition_keys(df, key)).orderBy(*[F.col(c).asc_nulls_first() for c in order])


def _chunk_window(key: Keys):
    return Window.partitionBy(*key).orderBy(CHUNK)


def _earlier(key: Keys):
    return _chunk_window(key).rowsBetween(Window.unboundedPreceding, -1)


def row_index(df: DataFrame, key: Keys = TRACK, order: Keys = ORDER, name: str = "idx") -> DataFrame:
    """0-based position of each row in its track."""
    local = F.row_number().over(track_window(df, key, order)).cast("bigint") - 1
    if CHUNK not in df.columns:
        return df.withColumn(name, local)
    sizes = df.groupBy(*key, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*key, CHUNK, F.coalesce(F.sum("_n").over(_earlier(key)), F.lit(0)).alias("_offset"))
    return df.join(offsets, [*key, CHUNK]).withColumn(name, local + F.col("_offset")).drop("_offset")


def running_sum(
    df: DataFrame, value: Column, name: str, key: Keys = TRACK, order: Keys = ORDER
) -> DataFrame:
    """Sum of ``value`` over the rows up to and including this one."""
    return running_sums(df, {name: value}, key, order)


def running_sums(df: DataFrame, values: dict[str, Column], key: Keys = TRACK, order: Keys = ORDER) -> DataFrame:
    """For each name the sum of its value over the rows up to and including this one, in one pass."""
    frame = track_window(df, key, order).rowsBetween(Window.unboundedPreceding, 0)
    raw = {f"_v_{n}": v for n, v in values.items()}
    df = df.withColumns(raw)
    local = {n: F.sum(f"_v_{n}").over(frame) for n in values}
    if CHUNK not in df.columns:
        return df.withColumns(local).drop(*raw)
    sums = df.groupBy(*key, CHUNK).agg(*[F.sum(c).alias(f"_s{c}") for c in raw])
    before = sums.select(*key, CHUNK, *[F.sum(f"_s{c}").over(_earlier(key)).alias(f"_b{c}") for c in raw])
    whole = {
        n: F.when(F.col(f"_b_v_{n}").isNull(), local[n]).otherwise(F.coalesce(local[n], F.lit(0)) + F.col(f"_b_v_{n}")) for n in values
    }
    return df.join(before, [*key, CHUNK]).withColumns(whole).drop(*raw, *[f"_b{c}" for c in raw])


def carry(
    df: DataFrame,
    values: dict[str, Column],
    key: Keys = TRACK,
    order: Keys = ORDER,
    backward: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Latest non-null value of each expression up to this row (or, ``backward``, the next one from it on).

    ``strict`` leaves the row itself out.
    """
    direction = [F.col(c).desc_nulls_last() if backward else F.col(c).asc_nulls_first() for c in order]
    keys = partition_keys(df, key)
    frame = Window.partitionBy(*keys).orderBy(*direction).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    raw = {f"_v_{n}": v for n, v in values.items()}
    df = df.withColumns(raw)
    local = {n: F.last(f"_v_{n}", ignorenulls=True).over(frame) for n in values}
    if CHUNK not in df.columns:
        return df.withColumns(local).drop(*raw)
    pick = F.min_by if backward else F.max_by
    # the row order inside a chunk, as a struct; rows whose value is null take no part
    place = F.struct(*order)
    ends = df.groupBy(*key, CHUNK).agg(
        *[pick(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"_e{c}") for c in raw]
    )
    by_chunk = Window.partitionBy(*key).orderBy(F.col(CHUNK).desc() if backward else F.col(CHUNK))
    outside = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    context = ends.select(
        *key, CHUNK, *[F.last(f"_e{c}", ignorenulls=True).over(outside).alias(f"_c{c}") for c in raw]
    )
    return (
        df.join(context, [*key, CHUNK])
        .withColumns({n: F.coalesce(local[n], F.col(f"_c_v_{n}")) for n in values})
        .drop(*raw, *[f"_c{c}" for c in raw])
    )


def with_neighbours(
    df: DataFrame, fields: list[str], reach: int, key: Keys = TRACK, order: Keys = ORDER
) -> tuple[DataFrame, dict[int, str]]:
    """Add the rows before and after as struct columns; returns the names by offset -reach..reach.

    A null struct means "no such row"; a null field means "row without a value".
    """
    row = F.struct(*fields)
    w = track_window(df, key, order)
    names = {j: f"_row{'m' if j < 0 else 'p'}{abs(j)}" for j in range(-reach, reach + 1)}
    if CHUNK not in df.columns:
        columns = {names[j]: (F.lag(row, -j) if j < 0 else F.lead(row, j)).over(w) for j in names if j}
        return df.withColumns({names[0]: row, **columns}), names

    whole = Window.partitionBy(*key, CHUNK)
    placed = df.withColumn("_p", F.row_number().over(w)).withColumn(
        "_q", F.count(F.lit(1)).over(whole) - F.col("_p") + 1
    )
    # at most 2 * reach rows of a chunk take part in these lists
    border = (
        placed.where((F.col("_p") <= reach) | (F.col("_q") <= reach))
        .groupBy(*key, CHUNK)
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("_p") <= reach, F.struct("_p", row.alias("r"))))).alias("_head"),
            F.array_sort(F.collect_list(F.when(F.col("_q") <= reach, F.struct("_p", row.alias("r"))))).alias("_tail"),
        )
    )
    cw = _chunk_window(key)
    context = border.select(
        *key,
        CHUNK,
        F.flatten(F.collect_list("_tail").over(cw.rowsBetween(-reach, -1))).alias("_before"),
        F.flatten(F.collect_list("_head").over(cw.rowsBetween(1, reach))).alias("_after"),
    )
    out = placed.join(context, [*key, CHUNK])
    columns = {names[0]: row}
    for j in range(1, reach + 1):
        earlier = F.get(F.col("_before"), (F.size("_before") + F.col("_p") - 1 - j).cast("int"))["r"]
        later = F.get(F.col("_after"), (F.lit(j) - F.col("_q")).cast("int"))["r"]
        columns[names[-j]] = F.when(F.col("_p") > j, F.lag(row, j).over(w)).otherwise(earlier)
        columns[names[j]] = F.when(F.col("_q") > j, F.lead(row, j).over(w)).otherwise(later)
    return out.withColumns(columns).drop("_p", "_q", "_before", "_after"), names
