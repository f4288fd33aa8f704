"""Neighbour information, tree attribution, nets and elimination against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from lithic.operators import curves, information, learning, nets, trees


def plain_information(rows, k):
    """By all pairs, as the estimator is defined."""
    rows = [(x, y) for x, y in rows if x is not None and not math.isnan(x)]
    rows = [(x, y) for x, y in rows if sum(z == y for _, z in rows) > 1]
    n, total = len(rows), 0.0
    psi = lambda v: float(information.digamma(np.array([v]))[0])
    for i, (x, y) in enumerate(rows):
        same = sorted(abs(x - z) for j, (z, w) in enumerate(rows) if j != i and w == y)
        near = min(k, len(same))
        r = np.nextafter(same[near - 1], 0)
        total += psi(near) - psi(len(same) + 1) - psi(sum(abs(z - x) <= r for z, _ in rows))
    return max(0.0, psi(n) + total / n)


def test_digamma():
    h = np.cumsum([0.0, *(1 / i for i in range(1, 60))])
    assert np.allclose(information.digamma(np.arange(1, 61)), h - 0.5772156649015329, atol=1e-12)


@pytest.mark.parametrize("ties", [False, True])
def test_neighbour_information(spark, ties):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        y = "a" if i % 3 else ("b" if i % 2 else "c")
        x = rng.gauss({"a": 0.0, "b": 1.0, "c": 3.0}[y], 1.0)
        x *= 1e5 if i % 7 else 1e-5
        rows.append((float(round(x, -4)) if ties else x, y))
    rows += [(5.0, "alone"), (None, "a"), (float("nan"), "b"), (0.1, "two"), (0.30000000000000004, "two")]
    got = information.neighbour_information(spark.createDataFrame(rows, "v double, c string"), "v", "c").first()["mi"]
    assert abs(got - plain_information(rows, 3)) < 1e-9
    assert information.neighbour_information(spark.createDataFrame([], "v double, c string"), "v", "c").first()["mi"] is None


def enumerated(model_leaves, row, width):
    """Shapley values by all subsets: the value of a subset follows the row on its columns and shares elsewhere."""
    def value(known):
        out = 0.0
        for leaf in model_leaves:
            part = leaf.value
            for c, lo, hi, share in zip(leaf.columns, leaf.low, leaf.high, leaf.share, strict=True):
                part *= float(lo < row[c] <= hi) if c in known else share
            out += part
        return out

    phi = np.zeros(width)
    for c in range(width):
        others = [j for j in range(width) if j != c]
        for n in range(width):
            for some in itertools.combinations(others, n):
                phi[c] += math.factorial(n) * math.factorial(width - n - 1) / math.factorial(width) * (value({*some, c}) - value(set(some)))
    return phi


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted", "regression"])
def test_attributions(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, d double, y double")
    made = {"tree": DecisionTreeClassifier(labelCol="y", maxDepth=4), "forest": RandomForestClassifier(labelCol="y", numTrees=4, maxDepth=4, seed=1), "boosted": GBTClassifier(labelCol="y", maxIter=3, maxDepth=3), "regression": RandomForestRegressor(labelCol="y", numTrees=3, maxDepth=3, seed=1)}[kind]
    model = Pipeline(stages=[VectorAssembler(inputCols=list("abcd"), outputCol="features"), made]).fit(df)
    scored = model.transform(df)
    told = trees.explained(scored, model.stages[-1], "id", list("abcd")).orderBy("id").collect()
    score = {"boosted": lambda: vector_to_array("rawPrediction")[1], "regression": lambda: F.col("prediction")}.get(kind, lambda: vector_to_array("probability")[1])()
    want = [r[0] for r in scored.orderBy("id").select(score).collect()]
    assert np.allclose([r["margin"] for r in told], want, atol=1e-9)
    assert np.allclose([r["base"] + r["a"] + r["b"] + r["c"] + r["d"] for r in told], want, atol=1e-9)
    held = trees.leaves(model.stages[-1])
    for i in (0, 7, 399):
        assert np.allclose([told[i][c] for c in "abcd"], enumerated(held, x[i], 4), atol=1e-9)
    means = {r["feature"]: r["mean_abs"] for r in trees.mean_attributions(trees.explained(scored, model.stages[-1], "id", list("abcd")), list("abcd")).collect()}
    assert means["a"] > means["d"]


@pytest.mark.parametrize("normed", [False, True])
def test_gradients_against_differences(normed):
    rng = np.random.default_rng(5)
    net = nets.Net((3, 5, 4, 1), normed)
    net.values = net.values + rng.normal(0, 0.1, len(net.values))
    x, y, w = rng.normal(size=(12, 3)), rng.integers(0, 2, 12).astype(float), rng.uniform(0.5, 2, 12)
    _, grads, _ = net.gradient(x, y, w)
    for i in range(len(net.values)):
        ends = []
        for d in (1e-6, -1e-6):
            moved = nets.Net(net.sizes, normed, values=net.values.copy(), running=net.running)
            moved.values[i] += d
            ends.append(moved.gradient(x, y, w)[0])
        assert abs((ends[0] - ends[1]) / 2e-6 - grads[i]) < 1e-4


def test_net_learns_and_stops_early(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 2))
    rows = [(i, float(a), float(b), int(a * b > 0)) for i, (a, b) in enumerate(x)] + [(-1, None, 0.1, 1), (-2, 0.1, 0.1, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int").repartition(4)
    net, fitted = nets.fit_net(df, ["a", "b"], "y", "id", (16, 8), (1.0, 1.2), batch_rows=400, rounds=10, patience=2, rate=0.03, normed=True)
    assert min(fitted["losses"]) < 0.45 and fitted["losses"][0] > min(fitted["losses"])
    scored = nets.net_scores(df, net, fitted, ["id", "y"])
    assert curves.roc_auc(scored.filter("y is not null"), "y", "score").first()[0] > 0.93
    _, short = nets.fit_net(df.filter("id % 5 = 0"), ["a", "b"], "y", "id", (2,), batch_rows=400, rounds=9, patience=1, rate=3.0)
    assert len(short["losses"]) < 9


def test_a_step_reads_the_files_of_its_own_mini_batch(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    read, summed = [], nets._summed

    def seen(rows, work, width, tasks):
        read.append((tuple(sorted(rows.inputFiles())), rows.count()))
        return summed(rows, work, width, tasks)

    monkeypatch.setattr(nets, "_summed", seen)
    nets.fit_net(df, ["a"], "y", "id", (4,), batch_rows=600, rounds=2)
    steps, again = read[:4], read[5:9]  # each round ends with the rows that are held out
    files = [f for names, _ in steps for f in names]
    assert len(files) == len(set(files)) and again == steps
    assert sum(n for _, n in steps) + df.filter(F.pmod(F.xxhash64(F.lit(42), F.col("id")), F.lit(5)) == 0).count() == 3000


def test_elimination_equals_refits(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 20))
    x[:, 5] += 0.7 * x[:, 6]
    y = x @ rng.normal(size=20) + rng.normal(size=500) + 100
    names = [f"f{i}" for i in range(20)]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], ", ".join(f"{n} double" for n in [*names, "y"]))
    left, gone = list(range(20)), []
    while len(left) > 10:
        fit = np.linalg.lstsq(np.c_[x[:, left], np.ones(500)], y, rcond=None)[0][:-1]
        gone.append(left.pop(int(np.argmin(np.abs(fit)))))
    steps = dict(learning.swept(df, "y", names, 10))
    assert {c: s for c, s in steps.items() if s} == {f"f{i}": n for n, i in enumerate(gone, 1)}
    assert learning.eliminate(df, "y", names, 10) == [f"f{i}" for i in left]
