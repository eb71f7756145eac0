"""What several operators share: Arrow passes in bounded pieces, hold-out rule, sampling, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.plans.session import settle

#: Characters that a Python worker handles at once, unless one text alone is longer.
PIECE_CHARS = 4_000_000
#: The same where every word of them is an object of its own.
WORD_PIECE_CHARS = 1_000_000


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True where CRC32 of the id as text leaves no remainder by ``folds``, and for rows without an id."""
    rest = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))
    return F.coalesce(rest == 0, F.lit(True))


def share_of(doc_id: str = "doc_id") -> Column:
    """A number from 0 to below 1 that depends on the id only; for samples that are the same in every run."""
    return F.pmod(F.xxhash64(F.col(doc_id), F.lit("share")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def release_memory() -> None:
    """Gives memory that a reused worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces_of(batch: pa.RecordBatch, column: str, chars: int = PIECE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts a batch into runs of rows whose texts together have about ``chars`` characters; null text as ''."""
    texts = batch.column(batch.schema.get_field_index(column))
    start, held, size = 0, [], 0
    for i in range(len(texts)):
        text = texts[i].as_py() or ""
        held.append(text)
        size += len(text)
        if size >= chars:
            yield batch.slice(start, i + 1 - start), held
            start, held, size = i + 1, [], 0
    if held:
        yield batch.slice(start), held


def add_columns(
    df: DataFrame, column: str, fields: list[T.StructField], compute: Callable[[list[str]], list[list]]
) -> DataFrame:
    """``df`` with columns that ``compute`` makes from the whole texts of one column.

    ``compute`` gets a list of texts (null as '') and returns one list for each field. Rows keep their place, so there
    is no shuffle. A column of ``df`` that has the name of a result is replaced by it.
    """
    names = {f.name for f in fields}
    if column in names:
        raise ValueError(f"{column} is both read and made")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])
    schema = T.StructType([*df.schema.fields, *fields])
    kinds = [(f.name, f.dataType) for f in fields]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(kind) for _, kind in kinds]
        for batch in batches:
            for part, texts in pieces_of(batch, column):
                made = [pa.array(v, type=t) for v, t in zip(compute(texts), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *[n for n, _ in kinds]])
        release_memory()

    return df.mapInArrow(run, schema)


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted in taken:
        wanted += "_"
    return wanted


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b BIGINT): (node, root), root being the smallest node.

    Large-star and small-star steps in turn: each node's neighbours are hooked to the smallest of them until nothing
    changes, about log(size) rounds. A step is an aggregation of minima, which combines before its shuffle, and a join
    that adaptive execution splits where one node has many edges. Each round is written to the shared folder, so the
    lineage stays short and a lost executor costs at most one round. Nothing but two numbers a round reaches the driver.
    Loops and repeated edges are allowed; a node that has only a loop to itself is its own root.
    """
    now = settle(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(now.where(F.col("u") == F.col("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = (
            pairs.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = settle(small, "components")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
