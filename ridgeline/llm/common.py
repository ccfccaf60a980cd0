"""What the corpus operators share: row keys, and tables settled in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, forget, new_path, settled, shared_dir

materialize = settled


def apart(id_col: str, *result: str) -> None:
    """An id column can't be named as a column of the result."""
    if id_col in result:
        raise ValueError(f"the id column can't be named {id_col!r}: the result has a column of that name")


def keyed(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """``df`` as ``(rk, <id_col>, *cols)`` where ``rk`` is a long that no two rows share.

    Integer ids that are unique and not null are their own keys (one light job
    over the id column tells).  Otherwise rows are numbered and written once, so
    that the numbers survive recomputation.  Other columns are dropped, so their
    names can't clash with ours.
    """
    part = df.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    names = [F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)]]
    if dict(part.dtypes)["_id"] in ("bigint", "int", "smallint", "tinyint"):
        ids = part.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col("_id").isNull())
        if ids.limit(1).count() == 0:
            return part.select(F.col("_id").cast("long").alias("rk"), *names)
    numbered = materialize(part.select(F.monotonically_increasing_id().alias("rk"), "*"), "keyed")
    return numbered.select("rk", *names)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``: at a task's end what Arrow and malloc hold for later is given back, for workers outlive their tasks."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not glibc
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many texts, so that what is made of them stays small on both sides."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


__all__ = ["apart", "delete", "forget", "keyed", "materialize", "new_path", "partitions", "shared_dir", "sliced", "tidy"]
