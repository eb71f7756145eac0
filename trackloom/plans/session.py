"""Session helpers: tables written once into the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder the cluster names in ``spark.checkpoint.dir``; a private one only where that is unset (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="trackloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Spark's setting that the shuffle files of a query are removed at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the bytes of a batch for Python workers.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Paths that the innermost ``passing_tables`` has to remove.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are settled inside are removed at the end; what is returned must have been read or written by then.

    An inner block removes its own tables only. Tables stay if an error ends the block, as its cause may lie in them.
    """
    made: list[str] = []
    token = _PASSING.set(made)
    try:
        yield
    finally:
        _PASSING.reset(token)
    for path in made:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside."""
    was = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def settle(df: DataFrame, label: str = "table", batch_bytes: int = 0) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it from there.

    Used where a result is needed several times: it is computed once, survives lost executors, and later
    readers fetch only the columns they use. The folder belongs to the cluster, which clears it, unless the table
    was made in a block of ``passing_tables``. ``batch_bytes`` bounds the Arrow batches that Python workers get, as long as
    a row alone is not larger.
    """
    path = scratch_path(df.sparkSession, label)
    passing = _PASSING.get()
    if passing is not None:
        passing.append(path)
    # shuffle files go when the query ends, not when the driver happens to collect its garbage
    wanted = {SHUFFLE_CLEANUP: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    with settings(df.sparkSession, wanted):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with new columns that are computed once for each row, however often they are used later.

    A condition on a plain column is moved below it, where the whole expression is repeated for each use; the rows of a
    generator are not looked through.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
