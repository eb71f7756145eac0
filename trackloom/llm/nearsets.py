"""Near-duplicates by the share of word shingles that two texts have in common (Jaccard), found without loss.

All shingles get one order, and a text is dealt under its first ones only: of n shingles, n - ceil(share n) + 1. Two texts
that share enough have one of these in common (prefix filter), whatever the order is. In the order used, shingles that a
bounded sample shows to be common come last, so they are hardly ever dealt; it changes the work, not the links. Texts that
meet are told apart by their sizes, by the places of their common shingles and by a 256-bit parity of their sets, then by a
parity of about a bit for each shingle, and the rest by the whole sets. The longer a text, the more others it meets by
chance and the less 256 bits tell; so the pairs grow faster than the table, but whole sets go only to those that are about as near.

Each shingle first links its texts to one of them. Then only texts of different components are compared, so a group of
near copies that has come together costs no pairs within it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import WORD_PIECE_CHARS, components, fresh_name, pieces_of, release_memory
from trackloom.llm.fingerprints import shingle_hashes
from trackloom.llm.simhash import BROADCAST_IDS, SAMPLE, _with_class
from trackloom.plans.session import passing_tables, scratch_path, settle

#: Most shingles that are known to be common; they go to every task, 12 bytes each.
COMMON = 1 << 16

#: Words of 64 bits in the parity of a set, and their columns.
PARITY_WORDS = 4
PARITY = tuple(f"p{i}" for i in range(PARITY_WORDS))
#: Fewest and most bits in the long parity of a set.
LONG_BITS = (64 * PARITY_WORDS, 1 << 20)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different shingles of a text as sorted BIGINTs."""
    return np.unique(shingle_hashes(text, words).view(np.int64))


def prefix(shingles: np.ndarray, common: np.ndarray, times: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """The first shingles in the order of (times in the sample, hash); ``common`` is sorted, others have been seen 0 times."""
    n, (num, den) = len(shingles), share
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        seen = np.where(common[at] == shingles, times[at], 0)
        shingles = shingles[np.argsort(seen, kind="stable")]
    return shingles[: n + 1 - -(-num * n // den)] if n else shingles


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bit i is set if an odd number of shingles have remainder i. Two sets differ in as many shingles as bits at least."""
    bits = np.bincount(shingles & (64 * PARITY_WORDS - 1), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def long_parity(shingles: np.ndarray) -> bytes:
    """The same in as many bits as there are shingles, rounded up to a power of 2 within LONG_BITS."""
    low, high = LONG_BITS
    width = min(high, max(low, 1 << max(0, len(shingles) - 1).bit_length()))
    return np.packbits((np.bincount(shingles & (width - 1), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Bits in which two long parities differ, the longer one folded to the other's width: at most the shingles that only one set has."""
    width = 8 * min(len(a), len(b))
    ends = []
    for whole in (a, b):
        bits, wide = int.from_bytes(whole, "little"), 8 * len(whole)
        while wide > width:
            wide //= 2
            bits = (bits & ((1 << wide) - 1)) ^ (bits >> wide)
        ends.append(bits)
    return (ends[0] ^ ends[1]).bit_count()


def _sets(
    docs: DataFrame, doc_id: str, text: str, words: int, order: tuple[np.ndarray, np.ndarray, tuple[int, int]] | None = None
) -> DataFrame:
    """(doc_id, fp, size, shingles, long, p0, ...): a hash of the shingle set, its size, and the set, or its prefix if an order is
    given; its long parity, and that in PARITY_WORDS columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces_of(batch, "text", WORD_PIECE_CHARS):
                whole = [shingle_set(t, words) for t in texts]
                some = whole if order is None else [prefix(s, *order) for s in whole]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in some]))).astype(np.int32)
                fps = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in whole], np.uint64).view(np.int64)
                parities = np.array([parity(s) for s in whole], np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(fps), pa.array([len(s) for s in whole], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(some))),
                        pa.array([long_parity(s) for s in whole], pa.binary()),
                        *[pa.array(np.ascontiguousarray(p)) for p in parities],
                    ],
                    names=["doc_id", "fp", "size", "shingles", "long", *PARITY],
                )
        release_memory()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    schema = "doc_id bigint, fp bigint, size int, shingles array<bigint>, long binary"
    return rows.mapInArrow(run, schema + "".join(f", {p} bigint" for p in PARITY))


def common_shingles(docs: DataFrame, doc_id: str, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several different sets of a sample of about SAMPLE rows have, sorted, and how many; at most COMMON."""
    step = -(-docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64(doc_id, F.lit("sample")), F.lit(step)) == 0) if step > 1 else docs
    seen = _sets(some, doc_id, text, words).dropDuplicates(["fp"]).select(F.explode("shingles").alias("key"))
    seen = seen.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("times")).where("times > 1")
    # written first, so that the shuffled shingles of the sample are gone before others come
    found = settle(seen.orderBy(F.desc("times"), "key").limit(COMMON), "common-shingles").orderBy("key").toPandas()
    return found["key"].to_numpy(np.int64), found["times"].to_numpy(np.int32)


def _pairs(left: DataFrame, right: DataFrame, differ: Column, share: tuple[int, int], everywhere: bool) -> DataFrame:
    """(a, b), a < b, of sets that meet under a key, where sizes, parities and the places of common shingles allow the share.

    The join itself compares sizes and parities, so of the pairs of a crowded key only those leave it that may be near.
    ``everywhere`` says that a pair meets under each key that both have, so the first of these is seen.
    """
    num, den = share
    sides = [d.select("key", *[F.col(c).alias(f"{x}_{c}") for c in d.columns if c != "key"]) for d, x in ((left, "l"), (right, "r"))]
    fits = (F.least("l_size", "r_size").cast("bigint") * den >= F.greatest("l_size", "r_size").cast("bigint") * num) & differ
    # each bit that differs is a shingle that only one of the sets has
    apart = reduce(add, [F.bit_count(F.col(f"l_{p}").bitwiseXOR(F.col(f"r_{p}"))) for p in PARITY]).cast("bigint")
    fits &= apart * (num + den) <= (F.col("l_size") + F.col("r_size")).cast("bigint") * (den - num)
    met = sides[0].join(sides[1], "key").where(fits)
    swap = F.col("l_fp") > F.col("r_fp")
    side = lambda c, x, y: F.when(swap, F.col(f"{y}_{c}")).otherwise(F.col(f"{x}_{c}"))
    met = met.select(
        side("fp", "l", "r").alias("a"), side("fp", "r", "l").alias("b"),
        side("i", "l", "r").alias("i"), side("i", "r", "l").alias("j"),
        side("size", "l", "r").alias("m"), side("size", "r", "l").alias("n"),
    )
    of_pair = met.groupBy("a", "b", "m", "n")
    if everywhere:
        # the first common shingle is the first in both prefixes, so all others come after it in both
        first = of_pair.agg(F.min("i").alias("i"), F.min("j").alias("j"))
        first = first.withColumn("most", F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")))
    else:
        # others may come before this one in both, or after it in both
        first = of_pair.agg(F.min(F.least("i", "j") + F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j"))).alias("most"))
    enough = F.col("most").cast("bigint") * (num + den) >= (F.col("m") + F.col("n")).cast("bigint") * num
    return first.where(enough).select("a", "b")


def _possible(pairs: DataFrame, one: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Those of the pairs whose long parities allow the share."""
    num, den = share
    ends = [one.select(F.col("fp").alias(x), F.col("size").alias(f"{x}_size"), F.col("long").alias(f"{x}_long")) for x in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(2), np.int64) + np.asarray(batch.column(3), np.int64)
            differ = np.fromiter(map(apart, batch.column(4).to_pylist(), batch.column(5).to_pylist()), np.int64, len(sizes))
            yield batch.select([0, 1]).filter(pa.array(differ * (num + den) <= sizes * (den - num)))

    met = pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "a_size", "b_size", "a_long", "b_long")
    return met.mapInArrow(run, "a bigint, b bigint")


def _verified(
    pairs: DataFrame, one: DataFrame, docs: DataFrame, firsts: DataFrame, doc_id: str, text: str, words: int, share: tuple[int, int]
) -> DataFrame:
    """Those of the pairs whose whole sets have the share in common."""
    num, den = share
    pairs = settle(_possible(settle(pairs, "met-pairs"), one, share), "set-pairs")
    nodes = settle(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "set-nodes")
    ids = firsts.join(nodes, "fp", "left_semi").select(F.col("first").alias("_first")).distinct()
    # few enough ids go to the texts, so that no text is shuffled
    ids = settle(ids, "set-documents")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    wanted = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).join(ids, F.col("_doc") == F.col("_first"), "left_semi")
    sets = _sets(wanted, "_doc", "_text", words).select("fp", "size", "shingles").join(nodes, "fp", "left_semi")
    sets = settle(sets.dropDuplicates(["fp"]), "whole-sets", batch_bytes=4 * WORD_PIECE_CHARS)
    ends = [sets.select(F.col("fp").alias(x), F.col("size").alias(f"{x}_size"), F.col("shingles").alias(f"{x}_set")) for x in "ab"]
    both = F.size(F.array_intersect("a_set", "b_set")).cast("bigint")
    whole = pairs.join(ends[0], "a").join(ends[1], "b")
    near = both * (num + den) >= (F.col("a_size") + F.col("b_size")).cast("bigint") * num
    return settle(whole.where(near).select("a", "b"), "set-links")


def set_links(rows: DataFrame, firsts: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) of different shingle sets, enough of them for the components of all pairs that reach the share."""
    num, den = share
    # one row for each set, so that a key and a set meet once
    one = rows.join(firsts.select(F.col("uid")), "uid", "left_semi")
    dealt = one.select("fp", "size", F.posexplode("shingles").alias("i", "key"))
    # of the sets under a key the next smaller and the next larger one show whether any is near enough in size
    of_key, size = Window.partitionBy("key").orderBy("size"), F.col("size").cast("bigint")
    met = dealt.withColumns({"below": F.lag("size").over(of_key), "above": F.lead("size").over(of_key)})
    met = met.where((F.col("below").cast("bigint") * den >= size * num) | (size * den >= F.col("above").cast("bigint") * num))
    # few prefix rows meet others, and only they carry the parity
    dealt = settle(met.select("key", "fp", "size", "i").join(one.select("fp", *PARITY), "fp"), "prefix-meetings")
    of_set = ["fp", "size", "i", *PARITY]
    heads = dealt.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "fp").alias("h"), *of_set)).alias("head"))
    heads = heads.select("key", *[f"head.{c}" for c in of_set])
    pairs = _pairs(heads, dealt, F.col("l_fp") != F.col("r_fp"), share, everywhere=False)
    links = _verified(pairs, one, docs, firsts, doc_id, text, words, share)
    roots = components(links)
    placed = dealt.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    placed = settle(placed.select("key", *of_set, F.coalesce("root", "fp").alias("root")), "placed-meetings")
    shares = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("sets"))
    largest = shares.groupBy("key").agg(F.max(F.struct("sets", "root")).alias("top"), F.count(F.lit(1)).alias("roots"))
    largest = largest.where("roots > 1").select("key", F.col("top.root").alias("main"))
    mixed = placed.join(largest, "key")
    # of two sets with different roots one at least is not of the largest component under the key
    others = mixed.where("root <> main").drop("main")
    pairs = _pairs(others, mixed.drop("main"), F.col("l_root") != F.col("r_root"), share, everywhere=True)
    return links.unionByName(_verified(pairs, one, docs, firsts, doc_id, text, words, share)).distinct()


def near_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, share: tuple[int, int] = (4, 5)
) -> DataFrame:
    """One row per row of ``docs`` that has an id: doc_id, fp (a hash of the shingle set), component_id.

    Texts are linked if they have ``share`` of the shingles of both together in common; component_id is the smallest id that
    links lead to. Texts of the same shingles are one node. Texts without words have the empty set and are copies.
    """
    spark = docs.sparkSession
    with passing_tables(spark):
        common, times = common_shingles(docs, doc_id, text, words)
        rows = _sets(docs, doc_id, text, words, (common, times, share)).withColumn("uid", F.monotonically_increasing_id())
        rows = settle(rows, "prefixes", batch_bytes=4 * WORD_PIECE_CHARS)
        firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("uid").alias("uid"), F.count(F.lit(1)).alias("n"))
        firsts = settle(firsts, "distinct-sets")
        roots = components(set_links(rows, firsts, docs, doc_id, text, words, share))
        linked = roots.join(firsts, roots["node"] == firsts["fp"]).select("node", "root", "first")
        lowest = linked.groupBy("root").agg(F.min("first").alias("low"))
        of_node = linked.join(lowest, "root").select(F.col("node").alias("fp"), "low")
        classes = firsts.join(of_node, "fp", "left").select("fp", "n", F.coalesce("low", "first").alias("component_id"))
        path = scratch_path(spark, "near-groups")
        _with_class(rows.select("doc_id", "fp"), settle(classes, "classes")).write.parquet(path)
    return spark.read.parquet(path)


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, share: tuple[int, int] = (4, 5)
) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id. Rows without an id all stay, and link none.

    Rows that repeat an id stay or go together. Ids alone are shuffled against the documents.
    """
    groups = near_groups(docs, doc_id, text, words, share)
    name = fresh_name(docs, "gone")
    gone = groups.where(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(f"`{doc_id}`") == F.col(name), "left_anti")
