"""Exact quantiles, classes, ranks and scales.

Ordinary tracks use Spark's ``percentile``, which keeps the distinct values of a group in memory. Where a
group may be huge (tracks with chunks, or values pooled over many tracks) the same numbers come from counting:
count equal values, put them in order by ranges, find the ranges that hold the wanted ranks, and look only there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.plans.sequence import TRACK
from trackloom.plans.session import settle
from trackloom.plans.skew import CHUNK, Keys, attach_track, skew_join

DEFAULT_CLASSES = 5


def even_probabilities(n: int) -> list[float]:
    return [i / n for i in range(n + 1)]


def _known(df: DataFrame, value: str, key: Keys) -> DataFrame:
    v = F.col(value).cast("double")
    chunk = [CHUNK] if CHUNK in df.columns else []
    return df.select(*key, *chunk, v.alias("_v")).where(v.isNotNull() & ~F.isnan(v))


def _counted(values: DataFrame, key: list[str]) -> DataFrame:
    """Distinct values with their number ``_m``, written in value order.

    ``_cell`` numbers the ranges of that order. Spark chooses them from a sample, so a range fits a task whatever the
    distribution of the values and however many a group has; a value that many rows share is one row here.
    """
    counts = values.groupBy(*key, "_v").agg(F.count(F.lit(1)).alias("_m"))
    ranged = counts.repartitionByRange(*[F.col(c) for c in [*key, "_v"]])
    return settle(ranged.withColumn("_cell", F.spark_partition_id()), "values")


def _sizes(counted: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(number, least and largest value of each group; ranks before and up to each of its ranges)."""
    by_cell = Window.partitionBy(*key).orderBy("_cell")
    groups = counted.groupBy(*key).agg(F.sum("_m").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    cells = counted.groupBy(*key, "_cell").agg(F.sum("_m").alias("_c"))
    cells = cells.withColumn("_upto", F.sum("_c").over(by_cell)).withColumn("_from", F.col("_upto") - F.col("_c"))
    return groups, cells


def _quantiles_by_counting(df: DataFrame, value: str, probs: list[float], key: Keys) -> DataFrame:
    key = list(key)
    counted = _counted(_known(df, value, key), key)
    sizes, cells = _sizes(counted, key)
    place = F.col("_p") * (F.col("_n") - 1)
    ranks = sizes.select(
        *key, F.col("_n"), F.posexplode(F.array(*[S.number(p) for p in probs])).alias("_i", "_p")
    ).withColumns({"_low": F.floor(place), "_high": F.ceil(place), "_place": place})
    ranks = ranks.select(*key, "_i", "_place", F.explode(F.array_distinct(F.array("_low", "_high"))).alias("_r"))
    # a group has at most as many ranges as there are tasks; they meet a handful of ranks
    wanted = ranks.join(cells, key).where((F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_upto")))
    needed = wanted.select(*key, "_cell").distinct()
    values = counted.join(needed, [*key, "_cell"], "left_semi").withColumn(
        "_last", F.sum("_m").over(Window.partitionBy(*key, "_cell").orderBy("_v"))
    )
    hit = values.join(wanted, [*key, "_cell"]).where(
        (F.col("_r") - F.col("_from") < F.col("_last")) & (F.col("_r") - F.col("_from") >= F.col("_last") - F.col("_m"))
    )
    ends = hit.groupBy(*key, "_i", "_place").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    low = F.floor("_place")
    line = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(
        (low + 1 - F.col("_place")) * F.col("_a") + (F.col("_place") - low) * F.col("_b")
    )
    listed = ends.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_i", line.alias("q")))).alias("_q"))
    return listed.join(sizes, key).select(
        *key, F.transform("_q", lambda x: x["q"]).alias("q"), F.col("_n").alias("n"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi")
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: list[float], key: Keys = TRACK, large: bool | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per group: ``q`` (array), ``n``, ``lo``, ``hi``; groups without values are absent."""
    if large is None:
        large = CHUNK in df.columns
    if large:
        return _quantiles_by_counting(df, value, probs, key)
    return (
        _known(df, value, key)
        .groupBy(*key)
        .agg(
            F.percentile("_v", F.array(*[S.number(p) for p in probs])).alias("q"),
            F.count(F.lit(1)).alias("n"),
            F.min("_v").alias("lo"),
            F.max("_v").alias("hi"),
        )
    )


def exact_quantiles_of(
    df: DataFrame, channels: dict[str, Column], probs: list[float], key: Keys = TRACK
) -> DataFrame:
    """``exact_quantiles`` of several values in one pass: one column per channel, a struct of ``q``, ``n``, ``lo``, ``hi``."""
    chunk = [CHUNK] if CHUNK in df.columns else []
    pairs = F.array(*[F.struct(F.lit(n).alias("channel"), v.cast("double").alias("v")) for n, v in channels.items()])
    long = df.select(*key, *chunk, F.inline(pairs))
    q = exact_quantiles(long, "v", probs, (*key, "channel"))
    picked = [
        F.max_by(F.struct("q", "n", "lo", "hi"), F.when(F.col("channel") == n, F.lit(1))).alias(n) for n in channels
    ]
    return q.groupBy(*key).agg(*picked)


def _all_groups(df: DataFrame, per_group: DataFrame, key: Keys) -> DataFrame:
    return df.select(*key).distinct().join(per_group, list(key), "left")


def quantile_breaks(
    df: DataFrame, value: str, n: int = DEFAULT_CLASSES, key: Keys = TRACK, large: bool | None = None
) -> DataFrame:
    """``n + 1`` class limits, without repeats, rounded, padded with the last; zeros if fewer than two values."""
    q = exact_quantiles(df, value, even_probabilities(n), key, large)
    return _all_groups(df, q, key).select(*key, breaks_of(F.col("q"), F.col("lo"), F.col("hi"), n).alias("breaks"))


def breaks_of(q: Column, lo: Column, hi: Column, n: int) -> Column:
    """Class limits from quantiles."""
    limits = F.transform(F.array_distinct(q), lambda b: F.round(b, 3))
    padded = F.concat(limits, F.array_repeat(F.element_at(limits, -1), F.lit(n + 1) - F.size(limits)))
    return F.when(lo < hi, padded).otherwise(F.array_repeat(S.number(0), n + 1))


def quantile_boundaries(df: DataFrame, value: str, n: int = DEFAULT_CLASSES, key: Keys = TRACK) -> DataFrame:
    """Raw quantiles; ``[0, 1]`` for a track without values."""
    q = exact_quantiles(df, value, even_probabilities(n), key)
    empty = F.array(S.number(0), S.number(1))
    return _all_groups(df, q, key).select(*key, F.coalesce("q", empty).alias("boundaries"))


def global_boundaries(df: DataFrame, value: str, n: int = DEFAULT_CLASSES, group: Keys = ("comparison_id",)) -> DataFrame:
    """Quantiles over all tracks of a comparison together."""
    pooled = df.drop(CHUNK)
    q = exact_quantiles(pooled, value, even_probabilities(n), group, large=True)
    return q.select(*group, F.col("q").alias("boundaries"))


def class_of(value: Column, bins: Column) -> Column:
    """Class number by right-closed bins, the lowest limit included; -1 without a value."""
    below = F.size(F.filter(bins, lambda b: b < value))
    return F.when(value.isNull(), F.lit(-1)).otherwise(F.greatest(below - 1, F.lit(0)))


def quantile_class(
    df: DataFrame, value: str, name: str = "q_class", n: int = DEFAULT_CLASSES, key: Keys = TRACK
) -> DataFrame:
    """Class 0..n-1 of each row within its track; a track with fewer than two distinct values gets 0 throughout."""
    q = exact_quantiles(df, value, even_probabilities(n), key)
    bins = q.select(*key, F.when(F.col("lo") < F.col("hi"), F.array_distinct("q")).alias("_bins"))
    v = F.col(value).cast("double")
    out = F.when(F.col("_bins").isNull(), F.lit(0)).otherwise(class_of(v, F.col("_bins")))
    return attach_track(df, bins, key).withColumn(name, out).drop("_bins")


def quantile_class_norm(
    df: DataFrame, value: str, name: str = "q_norm", n: int = DEFAULT_CLASSES, key: Keys = TRACK
) -> DataFrame:
    """Class divided by the highest class of the track, 0 if there is only one; NULL without a value."""
    classed = quantile_class(df, value, "_class", n, key)
    top = classed.groupBy(*key).agg(F.max("_class").alias("_top"))
    joined = attach_track(classed, top, key)
    norm = F.when(F.col("_top") <= 0, S.number(0)).when(F.col(value).isNotNull(), F.col("_class") / F.col("_top"))
    return joined.withColumn(name, norm).drop("_class", "_top")


def class_by_boundaries(df: DataFrame, value: str, boundaries: DataFrame, group: Keys, name: str = "q_class") -> DataFrame:
    """Classes from limits shared by several tracks. ``boundaries`` has one row per group and is joined as it is."""
    bins = boundaries.select(*group, F.array_distinct("boundaries").alias("_bins"))
    spread = df.select(*group, "track_id").distinct().join(bins, list(group))
    joined = skew_join(df, spread, [*group, "track_id"])
    return joined.withColumn(name, class_of(F.col(value).cast("double"), F.col("_bins"))).drop("_bins")


def quantile_position(value, breaks) -> Column:
    """Position 0..1: each class takes an equal share, linear inside; a class of zero width counts as its middle."""
    v, b = S.col(value).cast("double"), S.col(breaks)
    k = F.size(b) - 1
    first, last = F.element_at(b, 1), F.element_at(b, -1)
    inner = F.slice(b, 2, F.greatest(k - 1, F.lit(0)))
    i = F.size(F.filter(inner, lambda x: x < v))
    lo, hi = F.element_at(b, i + 1), F.element_at(b, i + 2)
    within = F.when(hi > lo, F.greatest(S.number(0), F.least(S.number(1), (v - lo) / (hi - lo)))).otherwise(S.number(0.5))
    return (
        F.when(v.isNull(), F.lit(None).cast("double"))
        .when(k < 1, S.number(0.5))
        .when(v <= first, S.number(0))
        .when(v >= last, S.number(1))
        .otherwise((i + within) / k)
    )


def rank_position(df: DataFrame, value: str, name: str = "rank_pos", key: Keys = TRACK) -> DataFrame:
    """Average rank among the track's known values, scaled to 0..1; 0.5 if there is only one."""
    key = list(key)
    if CHUNK not in df.columns:
        known = F.col(value).isNotNull()
        order = Window.partitionBy(*key, known).orderBy(value)
        n = F.count(F.lit(1)).over(Window.partitionBy(*key, known))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*key, known, F.col(value)))
        place = (F.rank().over(order) - 1 + (ties - 1) / 2) / (n - 1)
        return df.withColumn(name, F.when(known & (n <= 1), S.number(0.5)).when(known, place))
    known_values = settle(_known(df, value, key), "chunk-values")
    counted = _counted(known_values, key)
    sizes, cells = _sizes(counted, key)
    offsets = cells.join(sizes, key).select(*key, "_cell", "_from", "_n")
    upto = F.sum("_m").over(Window.partitionBy(*key, "_cell").orderBy("_v"))
    first = F.col("_from") + F.col("_last") - F.col("_m")
    ranked = counted.withColumn("_last", upto).join(offsets, [*key, "_cell"]).select(
        *key,
        "_v",
        F.when(F.col("_n") <= 1, S.number(0.5))
        .otherwise((first + (F.col("_m") - 1) / 2) / F.nullif(F.col("_n") - 1, F.lit(0)))
        .alias(name),
    )
    # one row per value and chunk, so that a value shared by most rows is not one join key
    local = known_values.select(*key, CHUNK, "_v").distinct().join(ranked, [*key, "_v"])
    return df.withColumn("_v", F.col(value).cast("double")).join(local, [*key, CHUNK, "_v"], "left").drop("_v")


def robust_scale(
    df: DataFrame, value: str, name: str = "scale", p: float = 0.98, key: Keys = TRACK, large: bool | None = None
) -> DataFrame:
    """98th percentile of the magnitudes; if that is 0 the largest; if there is none, 1."""
    size = df.withColumn("_abs", F.abs(F.col(value).cast("double")))
    q = exact_quantiles(size, "_abs", [p], key, large)
    return _all_groups(df, q, key).select(*key, scale_of(F.col("q")[0], F.col("hi")).alias(name))


def scale_of(percentile: Column, largest: Column) -> Column:
    return F.when(percentile > 0, percentile).when(largest > 0, largest).otherwise(S.number(1))


def pooled_scale(df: DataFrame, values: list[str], name: str = "scale", key: Keys = TRACK) -> DataFrame:
    """``robust_scale`` over several columns together."""
    chunk = [CHUNK] if CHUNK in df.columns else []
    long = df.select(*key, *chunk, F.explode(F.array(*[F.col(v).cast("double") for v in values])).alias("_x"))
    return robust_scale(long, "_x", name, key=key)


def signed_norm(value, scale) -> Column:
    """Value over scale, limited to -1..1."""
    return F.when(S.col(value).isNotNull(), F.greatest(S.number(-1), F.least(S.number(1), S.col(value) / S.col(scale))))
