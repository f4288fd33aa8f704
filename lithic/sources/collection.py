"""A stored collection of chunks: payload columns that filters prune by, pages by key.

The table is partitioned by its most selective payload columns and sorted by key within a
partition, so that Spark's own pruning skips the folders a filter rules out and the row groups
that lie before a page. A rewrite is a new version beside the old one (``files.replaced``): a
reader sees one or the other, and a failed write is never seen.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.sources import files


def create(chunks: DataFrame, path: str, key: str, indexed: Sequence[str], recreate: bool = False) -> bool:
    """Write a collection unless there is one; says whether it was written.

    Rows of a partition are ranged by key, so that a payload value that most rows share is spread
    over files as well.
    """
    if not recreate and files.versions(chunks.sparkSession, path):
        return False
    laid = chunks.repartitionByRange(*indexed, key).sortWithinPartitions(*indexed, key)
    files.replaced(laid, path, by=indexed)
    return True


def searched(spark: SparkSession, path: str, **payload: object) -> DataFrame:
    """Rows whose payload agrees: a value, or any of a list; all conditions hold (A-EM6)."""
    rows = files.latest(spark, path)
    for column, wanted in payload.items():
        rows = rows.filter(F.col(column).isin(*wanted) if isinstance(wanted, (list, tuple)) else F.col(column) == F.lit(wanted))
    return rows


def page(rows: DataFrame, key: str, after: object = None, size: int = 2_000) -> DataFrame:
    """The next rows in the order of a unique key: by range of keys, never by offset."""
    return (rows if after is None else rows.filter(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def pages(rows: DataFrame, key: str, size: int = 2_000) -> Iterator[list]:
    """All rows, a page at a time: the driver holds one page."""
    held = page(rows, key, None, size).collect()
    while held:
        yield held
        held = page(rows, key, held[-1][key], size).collect() if len(held) == size else []


def looked_up(parents: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The parents of these keys, each once."""
    return parents.join(wanted.select(key).distinct(), key, "left_semi")


def stats(rows: DataFrame, parent: str, indexed: Sequence[str]) -> DataFrame:
    """Exact counts of chunks, parents and values of each indexed column."""
    return rows.agg(F.count("*").alias("n_chunks"), F.count_distinct(parent).alias("n_parents"), *(F.count_distinct(c).alias(f"n_{c}") for c in indexed))
