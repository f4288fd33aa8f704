"""Exact attribution of tree models' scores to their columns (B-M15).

A fitted Spark ML tree, forest or boosted model becomes a list of leaves, each with the columns on
its path, the range that a column must lie in there, and the share of the training weight that
goes on at the column's splits. Shapley values of a leaf follow from those alone, so batches of
rows are scored leaf by leaf in arrays; nothing but the leaves goes to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Leaf:
    """A leaf: value, and for each column on its path its range (low, high] and share of weight."""

    value: float
    columns: list[int]
    low: list[float]
    high: list[float]
    share: list[float]


def leaves(model) -> list[Leaf]:
    """The leaves of a fitted model; values are probabilities of class 1, or margins if boosted."""
    trees = getattr(model, "trees", None) or [model]
    weights = model.treeWeights if hasattr(model, "treeWeights") else [1.0] * len(trees)
    boosted = "GBT" in type(model).__name__
    scale = 1.0 if boosted else 1.0 / sum(weights)
    out: list[Leaf] = []
    for tree, weight in zip(trees, weights, strict=True):
        regression = "Regression" in type(tree).__name__

        def walk(node, path: dict[int, tuple[float, float, float]], factor=weight * scale, regression=regression) -> None:
            if node.getClass().getSimpleName() == "LeafNode":
                stats = list(node.impurityStats().stats())
                value = node.prediction() if regression else stats[1] / sum(stats)
                out.append(Leaf(factor * value, list(path), *([v[i] for v in path.values()] for i in range(3))))
                return
            split = node.split()
            if split.getClass().getSimpleName() != "ContinuousSplit":
                raise ValueError("only splits of numbers are attributed")
            at, cut, total = split.featureIndex(), split.threshold(), node.impurityStats().count()
            low, high, share = path.get(at, (-np.inf, np.inf, 1.0))
            for child, bounds in ((node.leftChild(), (low, min(high, cut))), (node.rightChild(), (max(low, cut), high))):
                walk(child, path | {at: (*bounds, share * child.impurityStats().count() / total)})

        walk(tree._call_java("rootNode"), {})
    return out


def attributions(rows: np.ndarray, held: Sequence[Leaf]) -> tuple[np.ndarray, float]:
    """Shapley values (rows x columns) of the sum of leaves, and the value that no column explains."""
    out, base = np.zeros(rows.shape), 0.0
    for leaf in held:
        p = len(leaf.columns)
        base += leaf.value * float(np.prod(leaf.share))
        if not p:
            continue
        inside = np.stack([(rows[:, c] > lo) & (rows[:, c] <= hi) for c, lo, hi in zip(leaf.columns, leaf.low, leaf.high, strict=True)]).astype(float)
        for i, column in enumerate(leaf.columns):
            sums = np.zeros((p, len(rows)))  # by the number of other columns that are known
            sums[0] = 1.0
            for n, j in enumerate([j for j in range(p) if j != i], 1):
                sums[1 : n + 1] = sums[1 : n + 1] * leaf.share[j] + sums[:n] * inside[j]
                sums[0] *= leaf.share[j]
            weights = np.array([factorial(s) * factorial(p - s - 1) / factorial(p) for s in range(p)])
            out[:, column] += leaf.value * (inside[i] - leaf.share[i]) * (weights @ sums)
    return out, base


def explained(scored: DataFrame, model, key: str, names: Sequence[str], features: str = "features") -> DataFrame:
    """(key, base, margin, a column for each of ``names``): attributions of every row, which add up to
    the margin less the base."""
    held = leaves(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column("f_").flatten()).reshape(batch.num_rows, -1)
            values, base = attributions(rows, held)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.full(len(rows), base)), pa.array(base + values.sum(axis=1)), *(pa.array(values[:, i]) for i in range(len(names)))], [key, "base", "margin", *names])

    kind = dict(scored.dtypes)[key]
    return scored.select(key, vector_to_array(F.col(features)).alias("f_")).mapInArrow(run, f"{key} {kind}, base double, margin double, " + ", ".join(f"{n} double" for n in names))


def mean_attributions(told: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, mean_abs): the mean size of each column's attributions."""
    row = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(f"m_{n}").alias("mean_abs")) for n in names))).alias("r")
    return told.agg(*(F.avg(F.abs(n)).alias(f"m_{n}") for n in names)).select(row).select("r.*")
