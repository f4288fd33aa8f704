"""Scores against outcomes: confusion, ROC, precision-recall, KS, PSI, VIF, chi-square (B-M*).

A scored table has a 0/1 label and a score. Curves are built from one row a distinct score, so the
sort that accumulates them is over distinct scores, dealt by ranges that a sketch of the scores
makes of like size: partial sums a range, their running totals, then running sums within each. Ties share one point, as they must.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.operators.features import exact_quantiles

#: Ranges of scores that are accumulated side by side.
RANGES = 64


def confusion(df: DataFrame, y: str, predicted: Column) -> DataFrame:
    """Counts and the measures of class 1; NULL where a denominator is 0 (B-M23)."""
    p, t = predicted.cast("int"), F.col(y)
    cells = df.agg(F.count_if((p == 1) & (t == 1)).alias("tp"), F.count_if((p == 1) & (t == 0)).alias("fp"), F.count_if((p == 0) & (t == 1)).alias("fn"), F.count_if((p == 0) & (t == 0)).alias("tn"))
    return cells.select("*", F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def cumulative(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row a distinct score, from the highest: positives and negatives at or above it."""
    points = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    ends = points.agg(F.percentile_approx("score", F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), 2_000).alias("ends_"))
    placed = points.join(F.broadcast(ends)).withColumn("range_", F.size(F.filter("ends_", lambda e: e > F.col("score")))).drop("ends_")
    whole = placed.groupBy("range_").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    offsets = whole.select("range_", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    within = Window.partitionBy("range_").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumns({"p1": F.sum("pos").over(within), "n1": F.sum("neg").over(within)})
    return run.join(F.broadcast(offsets), "range_").select("score", "pos", "neg", (F.col("p0") + F.col("p1")).alias("tp"), (F.col("n0") + F.col("n1")).alias("fp"))


def with_totals(curve: DataFrame) -> DataFrame:
    return curve.join(F.broadcast(curve.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Exact area by the rank sum; tied scores count half (B-M24)."""
    area = F.sum(F.col("pos") * (F.col("N") - F.col("fp") + F.col("neg") / 2.0))
    return with_totals(cumulative(df, y, score)).agg(F.try_divide(area, F.max(F.col("P") * F.col("N")).cast("double")).alias("auc"))


def best_f1(df: DataFrame, y: str, score: str) -> DataFrame:
    """The threshold with the largest F1, the lowest one where several tie (B-M25)."""
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("P"))
    rows = with_totals(cumulative(df, y, score)).select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "P").alias("recall"), f1.alias("f1"))
    best = F.max_by(F.struct("score", "precision", "recall", "f1"), F.struct("f1", -F.col("score"))).alias("b")
    return rows.agg(best).select(F.col("b.score").alias("threshold"), "b.precision", "b.recall", "b.f1")


def youden(df: DataFrame, y: str, score: str) -> DataFrame:
    """The threshold with the largest TPR - FPR, the highest one where several tie (B-M26)."""
    j = F.try_divide("tp", "P") - F.try_divide("fp", "N")
    rows = with_totals(cumulative(df, y, score)).select("score", j.alias("j"))
    return rows.agg(F.max_by(F.struct("score", "j"), F.struct("j", "score")).alias("b")).select(F.col("b.score").alias("threshold"), "b.j")


def ks(df: DataFrame, y: str, score: str) -> DataFrame:
    """Largest gap between the score distributions of the classes (B-M29)."""
    gap = F.abs(F.try_divide("tp", "P") - F.try_divide("fp", "N"))
    return with_totals(cumulative(df, y, score)).agg(F.max(gap).alias("ks"))


def ks_p_value(statistic: float, n: int, m: int) -> float:
    """The two-sided p-value of a two-sample statistic, by the asymptotic series (B-M29)."""
    import math

    if not n or not m:
        return 1.0
    root = math.sqrt(n * m / (n + m))
    x = (root + 0.12 + 0.11 / root) * statistic
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def ks_test(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: statistic, sizes and p-value of the scores of either class (B-M29)."""
    gap = F.abs(F.try_divide("tp", "P") - F.try_divide("fp", "N"))
    row = with_totals(cumulative(df, y, score)).agg(F.max(gap).alias("ks"), F.max("P").alias("n_pos"), F.max("N").alias("n_neg")).first()
    p = None if row["ks"] is None else ks_p_value(row["ks"], row["n_pos"], row["n_neg"])
    return df.sparkSession.createDataFrame([(row["ks"], row["n_pos"], row["n_neg"], p)], "ks double, n_pos long, n_neg long, p_value double")


def psi(expected: DataFrame, actual: DataFrame, col: str, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability by quantile bins of the expected values, [lo, hi) with open ends (B-M30)."""
    row = exact_quantiles(expected, col, {f"e{i}": i / bins for i in range(1, bins)}).first()
    edges = [e for e in row if e is not None] if row else []

    def binned(df: DataFrame, name: str) -> DataFrame:
        at = sum(((F.col(col) >= F.lit(float(e))).cast("int") for e in edges), F.lit(0))
        counted = df.filter(F.col(col).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias(name))
        total = counted.agg(F.sum(name).alias("total_"))
        return counted.join(F.broadcast(total)).select("bin", (F.col(name) / F.col("total_")).alias(name))

    spark = expected.sparkSession
    every = spark.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    rows = every.join(binned(expected, "expected"), "bin", "left").join(binned(actual, "actual"), "bin", "left")
    e, a = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(floor)) for c in ("expected", "actual"))
    return rows.select("bin", e.alias("expected"), a.alias("actual"), ((a - e) * F.ln(a / e)).alias("part"))


def gram(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Sums of products of all pairs of columns in one pass; columns x columns on the driver."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"g{i}") for i, (a, b) in enumerate(pairs))).first()
    at, out = {c: i for i, c in enumerate(cols)}, np.zeros((len(cols), len(cols)))
    for i, (a, b) in enumerate(pairs):
        out[at[a], at[b]] = out[at[b], at[a]] = row[i]
    return out


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance inflation without an added constant: G_ii times (G^-1)_ii (B-M18)."""
    g = gram(df, cols)
    values = np.diag(g) * np.diag(np.linalg.pinv(g))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(cols, values, strict=True)], "feature string, vif double")


def chi2(df: DataFrame, y: str, cols: Sequence[str]) -> DataFrame:
    """Chi-square of non-negative sums by class against the class shares (B-M19)."""
    by_class = df.groupBy(y).agg(F.count("*").alias("n"), *(F.sum(c).cast("double").alias(c) for c in cols))
    long = by_class.select(y, "n", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("observed")) for c in cols))).alias("r")).select(y, "n", "r.*")
    total = long.groupBy("feature").agg(F.sum("n").alias("rows_"), F.sum("observed").alias("sum_"))
    expected = F.col("n") / F.col("rows_") * F.col("sum_")
    return long.join(F.broadcast(total), "feature").groupBy("feature").agg(F.sum(F.try_divide((F.col("observed") - expected) ** 2, expected)).alias("chi2"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information of two discrete columns in nats (B-M16, binned estimator)."""
    both = df.groupBy(a, b).agg(F.count("*").alias("n"))
    left, right = both.groupBy(a).agg(F.sum("n").alias("n_a")), both.groupBy(b).agg(F.sum("n").alias("n_b"))
    total = both.agg(F.sum("n").alias("t"))
    rows = both.join(left, a).join(right, b).join(F.broadcast(total))
    return rows.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("n_a") * F.col("n_b")))).alias("mi"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """R squared, mean absolute error and root mean squared error (B-M32)."""
    e = F.col(actual) - F.col(predicted)
    return df.agg((1 - F.try_divide(F.sum(e * e), F.var_pop(actual) * F.count(actual))).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
