"""Near-duplicates by SimHash: fingerprints within a Hamming distance, found by the general pigeonhole principle.

The 64 bits are dealt to m partitions, correlated bits to the same one. With thresholds t_i (-1: not probed) that sum to
tau - m + 1, two fingerprints within tau agree up to t_i bits in some partition i that is probed. Which m and which
thresholds are cheapest is found by dynamic programming on the number of candidates that a bounded sample leads to expect;
the choice changes the work only, never the links. Candidates meet in an equi-join on (partition, bits), where the
whole distance is verified, so only true links leave the join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import components, fresh_name
from trackloom.llm.fingerprints import fingerprint
from trackloom.plans.session import settle

#: Fingerprints looked at to estimate candidate counts; a bound, not a share.
SAMPLE = 1 << 15
#: Cost of verifying one candidate, in costs of one probe.
VERIFY = 0.2
#: Most bit patterns that a partition may be probed with.
PATTERNS = 50_000
#: A fingerprint that more than one row in so many has is joined without a shuffle; there are fewer than HOT_SHARE such.
HOT_SHARE = 1024
#: Most ids of dropped documents that are broadcast, 8 bytes each; beyond it ids are shuffled against the documents.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Probe:
    """Bits of one partition as a mask, and how many of them may differ."""

    mask: int
    threshold: int


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42,
    of: Callable[..., int] = fingerprint,
) -> DataFrame:
    """(doc_id, fp BIGINT, the fingerprint's bits) of every row; null text as empty, whose fingerprint is 0."""

    @F.pandas_udf("bigint")
    def made(texts: pd.Series) -> pd.Series:
        found = np.array([of(t, words, seed) for t in texts], np.uint64)
        return pd.Series(found.view(np.int64))

    return docs.select(F.col(doc_id).alias("doc_id"), made(F.col(text)).alias("fp"))


def group_bits(sample: np.ndarray, m: int) -> list[int]:
    """m masks of nearly equal width; a partition takes the bits that correlate most with those it has."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    spread = bits.std(axis=0)
    centred = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    tied = np.abs(centred.T @ centred) / max(1, len(bits))
    np.fill_diagonal(tied, 0)
    free, masks = list(range(64)), []
    for i in range(m):
        width = 64 * (i + 1) // m - 64 * i // m
        group = [max(free, key=lambda b: (tied[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < width:
            best = max(free, key=lambda b: (tied[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        masks.append(sum(1 << b for b in group))
    return masks


def flips(mask: int, threshold: int) -> list[int]:
    """Every pattern of at most ``threshold`` bits inside the mask; none for a threshold of -1."""
    bits = [1 << b for b in range(64) if mask >> b & 1]
    return [sum(c) for n in range(threshold + 1) for c in combinations(bits, n)]


def _expected(sample: np.ndarray, mask: int, threshold: int, rows: int) -> float:
    """Estimated number of pairs among ``rows`` fingerprints that differ in at most ``threshold`` bits of the mask."""
    if threshold < 0 or not len(sample):
        return 0.0
    width, patterns = mask.bit_count(), flips(mask, threshold)
    values, counts = np.unique(sample & np.uint64(mask), return_counts=True)
    met = 0.0
    for pattern in patterns:
        other = values ^ np.uint64(pattern)
        at = np.minimum(np.searchsorted(values, other), len(values) - 1)
        met += float((counts * np.where(values[at] == other, counts[at], 0)).sum())
    met = max(0.0, met - len(sample)) / 2
    by_chance = len(sample) ** 2 / 2 * len(patterns) / 2.0**width
    return max(met, by_chance) * (rows / len(sample)) ** 2


def plan_probes(sample: np.ndarray, rows: int, tau: int) -> list[Probe]:
    """The cheapest partitions and thresholds for ``rows`` fingerprints, by dynamic programming for each m."""
    best: tuple[float, list[Probe]] | None = None
    sample, rows = (sample, rows) if len(sample) else (np.zeros(1, np.uint64), 1)
    for m in range(1, min(64, tau + 2) + 1):
        masks = group_bits(sample, m)
        # spent[s]: least cost of the partitions so far with thresholds that sum to s
        spent: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for mask in masks:
            costs = {
                t: rows * (1 + len(flips(mask, t))) * (t >= 0) + VERIFY * _expected(sample, mask, t, rows)
                for t in range(-1, tau + 1)
                if sum(comb(mask.bit_count(), n) for n in range(t + 1)) <= PATTERNS
            }
            following: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, chosen) in spent.items():
                for t, more in costs.items():
                    if total + t not in following or cost + more < following[total + t][0]:
                        following[total + t] = (cost + more, [*chosen, t])
            spent = following
        found = spent.get(tau - m + 1)
        if found and (best is None or found[0] < best[0]):
            best = (found[0], [Probe(mask, t) for mask, t in zip(masks, found[1], strict=True) if t >= 0])
    assert best is not None
    return best[1]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _keys(part: int, own: Column, patterns: Column) -> Column:
    """Array of (part, key) for each pattern of bits that may differ."""
    return F.transform(patterns, lambda x: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(x).alias("key")))


def hamming_links(distinct: DataFrame, tau: int, probes: list[Probe] | None = None) -> DataFrame:
    """Pairs (a, b) of different fingerprints, a < b, that differ in at most ``tau`` bits.

    distinct: one column fp BIGINT without repeats and nulls. Each pair occurs once. ``probes`` are planned from a sample
    of at most about SAMPLE fingerprints unless given.
    """
    if probes is None:
        rows = distinct.count()
        some = distinct
        if rows > SAMPLE:
            step = -(-rows // SAMPLE)
            some = distinct.where(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(step)) == 0)
        sample = some.toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
        probes = plan_probes(sample, rows, tau)
    sides = []
    for probing in (False, True):
        keys = []
        for i, p in enumerate(probes):
            own = F.col("fp").bitwiseAND(F.lit(_signed(p.mask)))
            patterns = F.array(*[F.lit(_signed(x)) for x in (flips(p.mask, p.threshold) if probing else [0])])
            keys.append(_keys(i, own, patterns))
        sides.append(distinct.select("fp", F.explode_outer(F.concat(*keys)).alias("_at")).select("fp", "_at.part", "_at.key"))
    kept, probe = sides[0].withColumnRenamed("fp", "a"), sides[1].withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau
    return kept.join(probe, ["part", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, tau: int = 2, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp BIGINT, component_id.

    Texts whose fingerprints differ in at most ``tau`` bits are linked; component_id is the smallest id that links lead
    to, the own one included. Null text is empty; texts without words have fingerprint 0 and are linked like others.
    Rows without an id keep it null and take part in links; a component without any id has a null component_id. Copies
    have one fingerprint and are one node, so a group of copies adds no pairs, whatever its size. An empty table gives
    an empty result; columns other than id and text are not read.
    """
    rows = settle(fingerprints(docs, doc_id, text, words, seed), "fingerprints")
    firsts = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    links = hamming_links(firsts.select("fp"), tau)
    roots = components(links)
    linked = roots.join(firsts, roots["node"] == firsts["fp"]).select("node", "root", "first")
    lowest = linked.groupBy("root").agg(F.min("first").alias("low"))
    of_node = linked.join(lowest, "root").select(F.col("node").alias("fp"), "low")
    classes = firsts.join(of_node, "fp", "left").select("fp", "n", F.coalesce("low", "first").alias("component_id"))
    return _with_class(rows, settle(classes, "classes"))


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with the class of their fingerprint; those of the commonest fingerprints stay where they are.

    A fingerprint is common if more than one row in HOT_SHARE has it, so fewer than HOT_SHARE are broadcast at any size and
    no key of the shuffled join holds more rows than that share.
    """
    total = classes.agg(F.sum("n")).first()[0] or 0
    common = F.col("n") * HOT_SHARE > total
    few = F.broadcast(classes.where(common).select("fp", "component_id"))
    others = rows.join(few.select("fp"), "fp", "left_anti").join(classes.where(~common).select("fp", "component_id"), "fp")
    return rows.join(few, "fp").unionByName(others).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, tau: int = 2) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id. Rows without an id all stay.

    Rows that repeat an id stay or go together. Ids alone are shuffled against the documents.
    """
    groups = near_groups(docs, doc_id, text, words, tau)
    name = fresh_name(docs, "gone")
    gone = settle(groups.where(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias(name)).distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(f"`{doc_id}`") == F.col(name), "left_anti")
