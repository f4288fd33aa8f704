"""Queries that fit models: out-of-fold scores, tree importances, regression."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.operators import curves, information, nets, trees
from lithic.operators import learning as ml
from lithic.plans.base import query
from lithic.plans.tabular import known, lines

NUMERIC, CATEGORIES = ["amount", "balance"], ["segment", "priority"]


def weighed(spark: SparkSession, sf: str) -> DataFrame:
    return ml.balanced(known(spark, sf).withColumn("year", F.year("issued").cast("double")), "y")


@query("logreg_oof")
def logreg_oof(spark, sf):
    """Area under the curve of out-of-fold scores of a balanced logistic regression."""
    df = weighed(spark, sf)
    scored = ml.out_of_fold(df, ml.features([*NUMERIC, "year"], CATEGORIES), ml.classifier("logistic", "y", "weight", maxIter=20), "loan_id", "y", k=3)
    return curves.roc_auc(scored, "y", "score")


@query("boosted_oof")
def boosted_oof(spark, sf):
    """The same for boosted trees."""
    df = weighed(spark, sf)
    scored = ml.out_of_fold(df, ml.features([*NUMERIC, "year"], []), ml.classifier("boosted", "y", "weight", maxIter=5, maxDepth=3), "loan_id", "y", k=2)
    return curves.roc_auc(scored, "y", "score")


@query("tree_importance")
def tree_importance(spark, sf):
    """Importances of a decision tree."""
    df = weighed(spark, sf)
    return ml.importances(df, ml.features([*NUMERIC, "year"], []), ml.classifier("tree", "y", "weight", maxDepth=5), [*NUMERIC, "year"])


@query("linear_fit")
def linear_fit(spark, sf):
    """R squared and errors of a linear regression of price on quantity, discount and tax."""
    cols = ["l_quantity", "l_discount", "l_tax"]
    model = ml.linear(lines(spark, sf), [VectorAssembler(inputCols=cols, outputCol="features")], "l_extendedprice")
    return curves.regression_metrics(model.transform(lines(spark, sf)), "l_extendedprice", "prediction")


@query("network_fit")
def network_fit(spark, sf):
    """Area of a small feed-forward net on rows that were held out, with class weights and early stopping (B-M11)."""
    _, _, area = ml.network(weighed(spark, sf), ml.features([*NUMERIC, "year"], ["segment"]), "y", "loan_id", (8, 4), "weight", rounds=(10, 10))
    return spark.createDataFrame([(area,)], "auc double")


@query("tuned_threshold")
def tuned_threshold(spark, sf):
    """The threshold that out-of-fold scores choose (B-M28)."""
    return ml.tuned_threshold(weighed(spark, sf), ml.features([*NUMERIC, "year"], []), ml.classifier("logistic", "y", "weight", maxIter=10), "loan_id", "y", 3)


@query("forest_importance")
def forest_importance(spark, sf):
    """Importances of a random forest (B-M12)."""
    return ml.importances(weighed(spark, sf), ml.features([*NUMERIC, "year"], []), ml.classifier("forest", "y", "weight", numTrees=5, maxDepth=4, seed=1), [*NUMERIC, "year"])


@query("eliminated_columns", """WITH m AS (SELECT covar_pop(l_quantity, l_quantity) AS qq, covar_pop(l_quantity, l_tax) AS qt, covar_pop(l_tax, l_tax) AS tt, covar_pop(l_quantity, l_extendedprice) AS qp, covar_pop(l_tax, l_extendedprice) AS tp FROM lineitem),
b AS (SELECT abs(tt * qp - qt * tp) AS q, abs(qq * tp - qt * qp) AS t FROM m)
SELECT 'l_quantity' AS feature, q >= t AS kept FROM b UNION ALL SELECT 'l_tax', q < t FROM b""")
def eliminated_columns(spark, sf):
    """Of two columns the one that elimination keeps (B-M14), against the closed form of two coefficients."""
    left = ml.eliminate(lines(spark, sf), "l_extendedprice", ["l_quantity", "l_tax"], 1)
    return spark.createDataFrame([(c, c in left) for c in ("l_quantity", "l_tax")], "feature string, kept boolean")


@query("eliminated_to_ten")
def eliminated_to_ten(spark, sf):
    """The step at which each of fourteen columns of lines goes until ten are left (B-M14)."""
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    made = {"q": q, "d": d, "t": t, "qd": q * d, "qt": q * t, "dt": d * t, "q2": q * q, "d2": d * d, "t2": t * t, "lq": F.log1p(q), "ld": F.log1p(d), "lt": F.log1p(t), "month": F.month("l_shipdate").cast("double"), "day": F.dayofmonth("l_shipdate").cast("double")}
    rows = lines(spark, sf).withColumns({k: v.cast("double") for k, v in made.items()})
    return spark.createDataFrame(ml.swept(rows, "l_extendedprice", list(made), 10), "feature string, step int")


@query("permutation_drops")
def permutation_drops(spark, sf):
    """The fall of R squared when each column of lines is dealt anew, over ten rounds (B-M17)."""
    cols = ["l_quantity", "l_discount", "l_tax"]
    rows = lines(spark, sf).select(*cols, "l_extendedprice", F.xxhash64("l_orderkey", "l_linenumber").alias("row_"))
    model = ml.linear(rows, [VectorAssembler(inputCols=cols, outputCol="features")], "l_extendedprice")
    return ml.permutation_importance(rows, model, lambda scored: curves.regression_metrics(scored, "l_extendedprice", "prediction").first()["r2"], cols, "row_")


@query("neighbour_information")
def neighbour_information(spark, sf):
    """Mutual information of two amounts and the outcome by three nearest neighbours (B-M16)."""
    df = known(spark, sf)
    one = lambda c: information.neighbour_information(df, c, "y").select(F.lit(c).alias("feature"), F.round("mi", 6).alias("mi"))
    return one("amount").unionByName(one("balance"))


@query("forest_attributions")
def forest_attributions(spark, sf):
    """Mean size of each column's part in the scores of a forest, and how far the parts are from adding up (B-M15)."""
    names = [*NUMERIC, "year"]
    df = weighed(spark, sf)
    model = Pipeline(stages=[*ml.features(names, []), ml.classifier("forest", "y", "weight", numTrees=5, maxDepth=4, seed=1)]).fit(df)
    return trees.mean_attributions(trees.explained(model.transform(df), model.stages[-1], "loan_id", names), names)


@query("trained_net")
def trained_net(spark, sf):
    """Area of a net with ReLU, normalisation, dropout and class weights, trained in mini-batches (B-M11)."""
    df = weighed(spark, sf)
    names = [*NUMERIC, "year"]
    net, fitted = nets.fit_net(df, names, "y", "loan_id", (32, 16, 8), (1.0, 1.5), batch_rows=4096, rounds=3, rate=0.01, normed=True, dropout=0.3)
    return curves.roc_auc(nets.net_scores(df, net, fitted, ["loan_id", "y"]), "y", "score")


@query("permutation_drop", "SELECT unnest(['l_quantity', 'l_tax']) AS feature, unnest([true, false]) AS matters")
def permutation_drop(spark, sf):
    """Whether the error rises when a column is dealt anew (B-M17)."""
    rows = lines(spark, sf).select("l_quantity", "l_tax", (F.col("l_quantity") * 1000.0).alias("price"), F.xxhash64("l_orderkey", "l_linenumber").alias("row_"))
    model = ml.linear(rows, [VectorAssembler(inputCols=["l_quantity", "l_tax"], outputCol="features")], "price")
    fit = lambda scored: curves.regression_metrics(scored, "price", "prediction").first()["r2"]
    return ml.permutation_importance(rows, model, fit, ["l_quantity", "l_tax"], "row_", rounds=1).select("feature", (F.col("drop") > 0.1).alias("matters"))
