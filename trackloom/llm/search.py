"""Exact top-k search by BM25: inverted indexes of shards, read with block-max dynamic pruning, merged exactly.

A shard is a run of rows of one partition. Its index holds the postings of each term, and for each term and block of BLOCK rows
the largest term weight there. Weights need the mean length and idf of the whole corpus, which are summed over all shards
first; so every shard gives the scores that one index of everything would give, and the k best of the union are exact.

For a query, the lists of rare terms are added up row by row; the frequent ones, whose lists would be the cost, are
bounded by block maxima. The blocks with the highest bounds are finished first; then a block is only finished for the
queries whose k-th best score so far does not exceed its bound, and skipped with all its postings for the others, as the
pivot of WAND skips rows. Queries are looked at together, so bounds and scores are products of small matrices.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import pieces_of, release_memory
from trackloom.plans.session import settle

K1, B = 1.2, 0.75
#: Rows and words at which a shard ends, rows of a block, bytes and number of queries that are sent to the tasks at once.
SHARD_ROWS, SHARD_WORDS, BLOCK, TASK_BYTES, TASK_QUERIES = 1 << 14, 1 << 21, 64, 32 << 20, 4096
#: Blocks that a query looks at before the others, and queries that are looked at together.
FIRST, TOGETHER = 2, 128
#: A term is frequent in a shard if at least this share of its rows hold it.
FREQUENT = 1 / 8
#: Postings of rare terms that are added up at once, and places of the k best that may be kept for each before they are merged.
POSTINGS, KEPT = 1 << 16, 8
#: Scores are compared after rounding to so many digits, so that the order of additions cannot decide a tie.
DIGITS = 9
_WORD = re.compile(r"\w+")
INDEX = "shard bigint, n int, terms string, df binary, rows binary, counts binary, wide boolean, lengths binary, ids binary, bytes bigint"


def terms_of(text: str) -> list[str]:
    """Words in lower case: runs of letters, digits and underscores."""
    return _WORD.findall(text.lower())


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard of INDEX; rows without an id are left out, null text is empty.

    A task holds the postings of one shard, which SHARD_ROWS and SHARD_WORDS bound (and the length of its last text).
    """

    def packed(shard: int, ids: list[int], numbers: dict[str, int], held: list[np.ndarray]) -> dict:
        lengths = np.array([len(x) for x in held], np.int64)
        names = sorted(numbers)
        place = np.empty(len(names), np.int64)
        place[np.array([numbers[t] for t in names], np.int64)] = np.arange(len(names))
        # (term, row) as one number: sorting brings the occurrences of a posting together
        pairs = place[np.concatenate(held)] * len(ids) + np.repeat(np.arange(len(ids)), lengths)
        postings, counts = np.unique(pairs, return_counts=True)
        df, wide = np.bincount(postings // len(ids), minlength=len(names)), bool(len(counts)) and counts.max() > 255
        terms = "\n".join(names)
        return {
            "shard": shard, "n": len(ids), "terms": terms, "df": df.astype("<i4").tobytes(),
            "rows": (postings % len(ids)).astype("<u2").tobytes(), "counts": counts.astype("<u4" if wide else "u1").tobytes(),
            "wide": wide, "lengths": lengths.astype("<i4").tobytes(), "ids": np.array(ids, "<i8").tobytes(),
            "bytes": (6 if wide else 3) * len(postings) + 4 * len(names) + len(terms) + 12 * len(ids),
        }

    schema = pa.schema([
        ("shard", pa.int64()), ("n", pa.int32()), ("terms", pa.string()), ("df", pa.binary()),
        ("rows", pa.binary()), ("counts", pa.binary()), ("wide", pa.bool_()), ("lengths", pa.binary()), ("ids", pa.binary()), ("bytes", pa.int64()),
    ])

    def run(batches):
        shard = TaskContext.get().partitionId() << 32
        ids, numbers, held, words = [], defaultdict(count().__next__), [], 0
        for batch in batches:
            for part, texts in pieces_of(batch, "text"):
                for key, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    found = terms_of(text)
                    held.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                    ids.append(key)
                    words += len(found)
                    if len(ids) >= SHARD_ROWS or words >= SHARD_WORDS:
                        yield pa.RecordBatch.from_pylist([packed(shard, ids, numbers, held)], schema=schema)
                        shard += 1
                        ids, numbers, held, words = [], defaultdict(count().__next__), [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([packed(shard, ids, numbers, held)], schema=schema)
        ids, numbers, held = [], {}, []
        release_memory()

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, INDEX)


class Queries:
    """Queries as runs of term numbers with weights; ``numbers`` has the number of each term that some query has."""

    def __init__(self, terms: list[list[str]], weights: list[np.ndarray]):
        numbers = defaultdict(count().__next__)
        self.terms = [np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in terms]
        self.weights = [np.asarray(w, float) for w in weights]
        self.numbers = dict(numbers)

    def __len__(self) -> int:
        return len(self.terms)


class Shard:
    """A shard's index with the weights of the whole corpus, for the terms that some query has."""

    def __init__(self, row: dict, mean_length: float, queries: Queries):
        self.queries = queries
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.blocks = -(-len(self.ids) // BLOCK)
        lengths = np.frombuffer(row["lengths"], "<i4")
        self.rows = np.frombuffer(row["rows"], "<u2").astype(np.int32)
        counts = np.frombuffer(row["counts"], "<u4" if row["wide"] else "u1").astype(float)
        self.worth = counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths[self.rows] / mean_length))
        sizes = np.frombuffer(row["df"], "<i4").astype(np.int64)
        terms = row["terms"].split("\n") if len(sizes) else []
        number = np.fromiter((queries.numbers.get(t, -1) for t in terms), np.int64, len(terms))
        known = number >= 0
        # by number of a term: where its postings begin, how many there are, and its row of the dense arrays
        self.begin, self.df, self.row = (np.full(len(queries.numbers), x, np.int64) for x in (0, 0, -1))
        self.begin[number[known]], self.df[number[known]] = (np.cumsum(sizes) - sizes)[known], sizes[known]
        frequent = np.flatnonzero(self.df >= max(1, FREQUENT * len(self.ids)))
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), self.blocks * BLOCK))
        for row_of, number_of in zip(self.dense, frequent, strict=True):
            at = slice(self.begin[number_of], self.begin[number_of] + self.df[number_of])
            row_of[self.rows[at]] = self.worth[at]
        self.maxima = self.dense.reshape(len(frequent), self.blocks, BLOCK).max(axis=2)

    def added(self, owner: np.ndarray, numbers: np.ndarray, weights: np.ndarray, many: int) -> np.ndarray:
        """Scores, many x rows, by the postings of rare terms, about POSTINGS at a time."""
        width = self.blocks * BLOCK
        sums, sizes = np.zeros(many * width), self.df[numbers]
        ends = np.cumsum(sizes)
        cuts = [0, *(np.flatnonzero(np.diff(ends // POSTINGS)) + 1).tolist(), len(sizes)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            own, first = sizes[lo:hi], owner[lo] * width
            at = np.arange(own.sum()) + np.repeat(self.begin[numbers[lo:hi]] - (np.cumsum(own) - own), own)
            place = self.rows[at] + np.repeat(owner[lo:hi] * width - first, own)
            made = np.bincount(place, self.worth[at] * np.repeat(weights[lo:hi], own))
            sums[first : first + len(made)] += made
        return sums.reshape(many, width)

    def best(self, part: range, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores, queries x k, of the k best rows of some queries, among those given and this shard's; of equal scores
        the smaller ids come first.

        Places without a row that scores above 0 hold a score of 0.
        """
        many, k = ids.shape
        numbers = np.concatenate([self.queries.terms[q] for q in part])
        weights = np.concatenate([self.queries.weights[q] for q in part])
        owner = np.repeat(np.arange(many), [len(self.queries.terms[q]) for q in part])
        rare, common = (self.row[numbers] < 0) & (self.df[numbers] > 0), self.row[numbers] >= 0
        sums, share = self.added(owner[rare], numbers[rare], weights[rare], many), np.zeros((many, len(self.dense)))
        share[owner[common], self.row[numbers[common]]] = weights[common]
        bounds = sums.reshape(many, self.blocks, BLOCK).max(axis=2) + share @ self.maxima
        bounds = np.round(bounds * (1 + 1e-9) + 1e-9, DIGITS)  # never below a score that is rounded
        least, found = scores[:, -1].copy(), []

        def finish(block: int, asked: np.ndarray) -> None:
            """Complete scores of one block for some queries; those that may be among the best are kept."""
            lo, hi = block * BLOCK, min((block + 1) * BLOCK, len(self.ids))
            some = np.round(sums[asked, lo:hi] + share[asked] @ self.dense[:, lo:hi], DIGITS)
            q, row = np.nonzero(some >= np.maximum(least[asked], 10.0**-DIGITS)[:, None])
            found.append((asked[q], self.ids[lo + row], some[q, row]))

        def merge() -> None:
            """Puts what has been kept among the best of each query."""
            nonlocal ids, scores, least
            rows = np.repeat(np.arange(many), k)
            held = [np.concatenate(x) for x in zip((rows, ids.ravel(), scores.ravel()), *found, strict=True)]
            order = np.lexsort((held[1], -held[2], held[0]))
            q = held[0][order]
            order = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
            ids, scores = held[1][order].reshape(many, k), held[2][order].reshape(many, k)
            least = scores[:, -1].copy()
            found.clear()

        # the blocks with the highest bounds first, so that most others are below the k-th best when their turn comes;
        # what earlier shards have led to does the same
        done = np.zeros(bounds.shape, bool)
        first = np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST]
        for turn in range(first.shape[1]):
            block_of = np.where(least > 0, -1, first[:, turn])
            for block in np.unique(block_of[block_of >= 0]):
                asked = np.flatnonzero((block_of == block) & (bounds[:, block] > 0))
                done[asked, block] = True
                if len(asked):
                    finish(block, asked)
        merge()
        for block in np.argsort(-bounds.max(axis=0)):
            asked = np.flatnonzero(~done[:, block] & (bounds[:, block] >= least) & (bounds[:, block] > 0))
            if len(asked):
                finish(block, asked)
            if sum(len(x[0]) for x in found) > KEPT * many * k:
                merge()
        merge()
        return ids, scores


def search(
    docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", index: DataFrame | None = None
) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best rows of ``docs`` for every row (query_id, text) of ``queries``.

    score = sum over the query's terms of occurrences in the query x idf x BM25 weight, idf = ln(1 + (N - df + 0.5) / (df + 0.5)).
    Rows that share no term with the query are no results, so a query may have fewer than k, and one without words
    has none. Ties go to the smaller id. Rows that repeat an id are results each. Queries are split into blocks of bounded size,
    which are broadcast one after the other; the index is not shuffled, a task reads its shards one by one.
    """
    spark = docs.sparkSession
    index = settle(index if index is not None else build_index(docs, doc_id, text), "index")
    total = index.agg(F.sum("n").alias("n")).first()
    result = "query_id bigint, rank int, doc_id bigint, score double"
    if not total["n"]:
        return spark.createDataFrame([], result)

    def lengths(batches):
        for batch in batches:
            yield pd.DataFrame({"words": [int(np.frombuffer(x, "<i4").sum(dtype=np.int64)) for x in batch["lengths"]]})

    all_words = index.select("lengths").mapInPandas(lengths, "words bigint").agg(F.sum("words")).first()[0]
    mean_length = max(1.0, all_words / total["n"])

    def counted(batches):  # terms with their occurrences
        for batch in batches:
            for part, texts in pieces_of(batch, "text"):
                rows = [(q, t, n) for q, x in zip(part.column(0).to_pylist(), texts, strict=True) for t, n in sorted(Counter(terms_of(x)).items())]
                yield pa.RecordBatch.from_pylist([dict(zip(("query_id", "term", "n"), r, strict=True)) for r in rows], schema=pa.schema([("query_id", pa.int64()), ("term", pa.string()), ("n", pa.int32())]))

    asked = queries.where(F.col("query_id").isNotNull()).select(F.col("query_id").cast("bigint").alias("query_id"), "text")
    asked = asked.mapInArrow(counted, "query_id bigint, term string, n int")

    def lists(batches):
        kind = pa.schema([("term", pa.string()), ("df", pa.int32())])
        for batch in batches:
            for terms, df in zip(batch["terms"].to_pylist(), batch["df"].to_pylist(), strict=True):
                if df:
                    yield pa.RecordBatch.from_arrays([pa.array(terms.split("\n")), pa.array(np.frombuffer(df, "<i4"))], schema=kind)

    pairs = index.select("terms", "df").mapInArrow(lists, "term string, df int")
    df = pairs.groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log(1 + (F.lit(float(total["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").groupBy("query_id", "term").agg(F.max(F.col("n") * idf).alias("weight"))
    vectors = weighed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("t"))
    vectors = settle(vectors.select("query_id", F.array_join("t.term", "\n").alias("terms"), "t.weight"), "queries")
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("terms") + 8 * F.size("weight")).alias("bytes")).first()
    blocks = max(-(-size["n"] // TASK_QUERIES), -(-(size["bytes"] or 0) // TASK_BYTES))
    kind = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def ranked(block: int) -> DataFrame:
        """Results of one block of queries; the index is read where it lies and only the k best rows of each task are shuffled."""
        some = vectors.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()
        sent = spark.sparkContext.broadcast((some["query_id"].to_numpy(np.int64), some["terms"].tolist(), some["weight"].tolist()))

        def answer(batches):
            query_ids, terms, weights = sent.value
            asked = Queries([t.split("\n") for t in terms], weights)
            ids, scores = np.full((len(asked), k), np.iinfo(np.int64).max), np.zeros((len(asked), k))
            for batch in batches:
                for i in range(batch.num_rows):
                    shard = None  # the one before goes first
                    shard = Shard(batch.slice(i, 1).to_pylist()[0], mean_length, asked)
                    for at in range(0, len(asked), TOGETHER):
                        part = range(at, min(at + TOGETHER, len(asked)))
                        of = slice(part.start, part.stop)
                        ids[of], scores[of] = shard.best(part, ids[of], scores[of])
            shard = None
            release_memory()
            use = scores > 0
            query_ids = np.repeat(query_ids, k).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (query_ids, ids, scores)], schema=kind)

        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        met = index.mapInArrow(answer, "query_id bigint, doc_id bigint, score double")
        found = met.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
        found = settle(found, "ranked")
        sent.destroy()
        return found

    if not blocks:
        return spark.createDataFrame([], result)
    return reduce(DataFrame.unionByName, [ranked(block) for block in range(blocks)])
