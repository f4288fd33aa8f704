"""Mutual information of a number and a class by k nearest neighbours (B-M16).

A point's radius reaches its k-th neighbour of the same class; what counts is how many points of any
class lie nearer. Points are sorted by range, classes and values spread over tasks, and a task
borrows the k values on either side of its own, so that no class is ever in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithic.sources.shared import stored


def digamma(x: np.ndarray) -> np.ndarray:
    """Of numbers above 0: shifted up by the recurrence, then the asymptotic series."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (low := x < 10).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    s = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s * (5 / 660)))))


def kth_distances(x: np.ndarray, k: int) -> np.ndarray:
    """Distance of each value of a sorted array to its k-th nearest other one."""
    n = len(x)
    padded = np.concatenate([np.full(k, -np.inf), x, np.full(k, np.inf)])
    out = np.full(n, np.inf)
    for below in range(k + 1):  # so many neighbours below, the others above
        low, high = padded[k - below : k - below + n], padded[2 * k - below : 2 * k - below + n]
        np.minimum(out, np.maximum(x - low, high - x), out)
    return out


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order, and back."""
    at = x.view(np.int64)
    return np.where(at < 0, np.int64(-(2**63)) - at, at)


def _double(at: np.ndarray) -> np.ndarray:
    return np.where(at < 0, np.int64(-(2**63)) - at, at).view(np.float64)


def reach(x: np.ndarray, distance: np.ndarray, sign: int) -> np.ndarray:
    """The farthest value on one side that is nearer than ``distance`` as doubles subtract; itself at distance 0."""
    x = x + 0.0  # no negative zero
    near, far = _ordered(x), _ordered(x + sign * (2 * distance + 1e-300) + 0.0)
    while True:
        mid = (near >> 1) + (far >> 1) + (near & far & 1)  # their difference may be beyond a whole number
        if ((mid == near) | (mid == far)).all():
            break
        inside = np.abs(_double(mid) - x) < distance
        near, far = np.where(inside, mid, near), np.where(inside, far, mid)
    return _double(near)


def _with_borders(rows: DataFrame, k: int) -> DataFrame:
    """(y, part, x, own, id, n_y): rows of each part of a class, and the k values on either side of it."""
    ranged = rows.repartitionByRange("y", "x", "id").withColumn("part", F.spark_partition_id())
    placed = stored(ranged)
    # the k values before a part are the last ones of earlier parts of its class, whatever their sizes; a few rows a part
    in_order = Window.partitionBy("y").orderBy("part", "x", "id")
    borrowed = []
    up, down = [F.asc("x"), F.asc("id")], [F.desc("x"), F.desc("id")]
    for order, span, edge in ((down, (-k, -1), up), (up, (1, k), down)):
        ends = placed.withColumn("n_", F.row_number().over(Window.partitionBy("y", "part").orderBy(*order))).filter(F.col("n_") <= k).select("y", "part", "x", "id")
        beside = ends.withColumns({"beside": F.collect_list("x").over(in_order.rowsBetween(*span)), "n_": F.row_number().over(Window.partitionBy("y", "part").orderBy(*edge))})
        borrowed.append(beside.filter("n_ = 1").select("y", "part", F.explode("beside").alias("x"), F.lit(False).alias("own"), F.lit(None).cast("long").alias("id")))
    own = placed.select("y", "part", "x", F.lit(True).alias("own"), "id")
    return own.unionByName(borrowed[0]).unionByName(borrowed[1])


def neighbour_information(df: DataFrame, x: str, y: str, k: int = 3) -> DataFrame:
    """One row, ``mi``: mutual information of ``x`` and the class ``y`` in nats, at least 0.

    Rows without x or y and classes of one row are left out; a small class takes as many
    neighbours as it has.
    """
    spark = df.sparkSession
    held = df.select(F.col(y).cast("string").alias("y"), F.col(x).cast("double").alias("x")).filter("y is not null and x is not null and not isnan(x)")
    sizes = held.groupBy("y").agg(F.count("*").alias("n_y")).filter("n_y > 1")
    rows = stored(held.join(sizes, "y", "left_semi").withColumn("id", F.monotonically_increasing_id()))
    bordered = _with_borders(rows, k).join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "y")

    def radii(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table["x"]), kind="stable")
        x_, own, ids = (np.asarray(table[c].fill_null(0) if c == "id" else table[c])[order] for c in ("x", "own", "id"))
        n_y = int(table["n_y"][0].as_py())
        near = min(k, n_y - 1)
        distance = kth_distances(x_, near)[own]
        mine, n = x_[own], int(own.sum())
        ends = np.concatenate([reach(mine, distance, -1), mine, reach(mine, distance, 1)])
        return pa.table({"v": ends, "kind": np.repeat(np.array([0, 1, 2], np.int32), n), "id": np.tile(ids[own], 3), "fixed": np.repeat(digamma(np.array([near])) - digamma(np.array([n_y])), 3 * n)})

    events = stored(bordered.groupBy("y", "part").applyInArrow(radii, "v double, kind int, id long, fixed double"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            point = np.asarray(batch.column("kind")) == 1
            upto = seen + np.cumsum(point)
            seen += int(point.sum())
            side = np.where(np.asarray(batch.column("kind")) == 2, 1, -1)[~point]
            yield pa.RecordBatch.from_pydict({"id": np.asarray(batch.column("id"))[~point], "part": np.full(len(side), part, np.int32), "side": side.astype(np.int32), "n": upto[~point]})
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([part], pa.int32()), pa.array([0], pa.int32()), pa.array([seen], pa.int64())], ["id", "part", "side", "n"])

    ranged = events.select("v", "kind", "id").repartitionByRange("v", "kind", "id").sortWithinPartitions("v", "kind", "id")
    local = stored(ranged.mapInArrow(counted, "id long, part int, side int, n long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    offsets = local.filter("id is null").select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    near = local.filter("id is not null").join(F.broadcast(offsets), "part").groupBy("id").agg(F.sum(F.col("side") * (F.col("n") + F.col("before"))).alias("m"))

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, times = np.asarray(batch.column("m")), np.asarray(batch.column("times"))
            yield pa.RecordBatch.from_pydict({"part": [float((digamma(m) * times).sum())]})

    spread = near.groupBy("m").agg(F.count("*").alias("times")).mapInArrow(logs, "part double").agg(F.sum("part")).first()[0]
    fixed, n = events.filter("kind = 1").agg(F.sum("fixed"), F.count("*")).first()
    value = max(0.0, float(digamma(np.array([n]))[0]) + (fixed - spread) / n) if n else None
    return spark.createDataFrame([(value,)], "mi double")
