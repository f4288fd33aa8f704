"""Queries of the tabular family: profiling, features, scaling, curves and stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.operators import curves
from lithic.operators import features as ft
from lithic.plans.base import query, table

#: Order status as an outcome: finished 1, open 0, partial unknown.
OUTCOME = {"F": 1, "O": 0}

LOANS_SQL = """
loans AS (
  SELECT o_orderkey AS loan_id, o_totalprice AS amount, c_acctbal AS balance, c_mktsegment AS segment,
         o_orderpriority AS priority, o_orderdate AS issued,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS y,
         (o_orderkey * 7919 % 1000 + CASE WHEN o_orderstatus = 'F' THEN 150 ELSE 0 END) / 1150.0::DOUBLE AS score
  FROM orders JOIN customer ON o_custkey = c_custkey)
"""


def loans(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as loans: amount, the customer's balance as limit, outcome and a fixed score."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    score = (F.col("o_orderkey") * 7919 % 1000 + F.when(F.col("o_orderstatus") == "F", 150).otherwise(0)) / F.lit(1150.0)
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("loan_id"), F.col("o_totalprice").alias("amount"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("issued"), ft.mapped(F.col("o_orderstatus"), OUTCOME).alias("y"), score.alias("score"))


def known(spark: SparkSession, sf: str) -> DataFrame:
    return loans(spark, sf).filter("y is not null")


KNOWN_SQL = f"WITH {LOANS_SQL}, known AS (SELECT * FROM loans WHERE y IS NOT NULL)"
LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def each(names, make, sep=" UNION ALL "):
    return sep.join(make(n) for n in names)


def r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since sums of doubles depend on their order."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("value_counts", "SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM orders GROUP BY 1")
def value_counts(spark, sf):
    return r(ft.value_counts(table(spark, sf, "orders"), "o_orderpriority"))


@query("imbalance", KNOWN_SQL + " SELECT count(*) FILTER (y = 0) AS n_neg, count(*) FILTER (y = 1) AS n_pos, round(count(*) FILTER (y = 0) / nullif(count(*) FILTER (y = 1), 0), 6) AS ratio FROM known")
def imbalance(spark, sf):
    return r(ft.imbalance(known(spark, sf), "y"))


@query("group_rates", KNOWN_SQL + " SELECT segment, round(avg(y), 6) AS rate, count(*) AS n FROM known GROUP BY segment")
def group_rates(spark, sf):
    return r(ft.group_rates(known(spark, sf), "segment", "y"))


@query("calendar_rates", KNOWN_SQL + " SELECT month(issued)::INT AS month, round(avg(y), 6) AS rate, count(*) AS n FROM known GROUP BY 1")
def calendar_rates(spark, sf):
    return r(ft.group_rates(known(spark, sf).withColumn("month", F.month("issued")), "month", "y"))


@query("class_means", KNOWN_SQL + ", m AS (" + each(("amount", "balance", "score"), lambda c: f"SELECT '{c}' AS feature, avg({c}) FILTER (y = 0) AS m0, avg({c}) FILTER (y = 1) AS m1 FROM known") + ") SELECT feature, round(m0, 4) AS mean_0, round(m1, 4) AS mean_1, round(m1 - m0, 4) AS diff, round((m1 - m0) / nullif(m0, 0) * 100, 4) AS diff_pct FROM m")
def class_means(spark, sf):
    return r(ft.class_means(known(spark, sf), "y", ["amount", "balance", "score"]), 4)


@query("quantile_cap", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_totalprice <= (SELECT quantile_cont(o_totalprice, 0.98) FROM orders) GROUP BY 1")
def quantile_cap(spark, sf):
    return r(ft.under_quantile(table(spark, sf, "orders"), "o_totalprice", 0.98).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")), 4)


@query("iqr_outliers", "WITH q AS (" + each(LINES, lambda c: f"SELECT '{c}' AS feature, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem") + "), v AS (" + each(LINES, lambda c: f"SELECT '{c}' AS feature, {c} AS value FROM lineitem") + ") SELECT feature, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q1 - 1.5 * (q3 - q1), 4) AS lo, round(q3 + 1.5 * (q3 - q1), 4) AS hi, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_out, count(value) AS n FROM v JOIN q USING (feature) GROUP BY feature, q1, q3")
def iqr_outliers(spark, sf):
    return r(ft.iqr_outliers(lines(spark, sf), LINES), 4)


@query("corr_matrix", "WITH m AS (" + each([(a, b) for i, a in enumerate(LINES) for b in LINES[i + 1 :]], lambda p: f"SELECT '{p[0]}' AS a, '{p[1]}' AS b, CASE WHEN stddev_pop({p[0]}) * stddev_pop({p[1]}) > 0 THEN corr({p[0]}, {p[1]}) END AS r FROM lineitem") + ") SELECT a, b, round(r, 6) AS r FROM m")
def corr_matrix(spark, sf):
    return r(ft.correlation_pairs(lines(spark, sf), LINES))


@query("high_corr_pairs", "WITH m AS (" + each([(a, b) for i, a in enumerate(LINES) for b in LINES[i + 1 :]], lambda p: f"SELECT '{p[0]}' AS a, '{p[1]}' AS b, CASE WHEN stddev_pop({p[0]}) * stddev_pop({p[1]}) > 0 THEN corr({p[0]}, {p[1]}) END AS r FROM lineitem") + ") SELECT a, b, round(r, 6) AS r FROM m WHERE abs(r) > 0.3")
def high_corr_pairs(spark, sf):
    return r(ft.correlation_pairs(lines(spark, sf), LINES).filter(F.abs("r") > 0.3))


@query("unknown_audit", KNOWN_SQL + ", t AS (SELECT count(*) AS total FROM known) " + each((("segment", "BUILDING"), ("priority", "BUILDING")), lambda p: f"SELECT '{p[0]}' AS feature, count(*) FILTER ({p[0]} = '{p[1]}') AS n_unknown, round(100.0 * count(*) FILTER ({p[0]} = '{p[1]}') / count(*), 6)::DOUBLE AS pct_unknown, round(avg(y) FILTER ({p[0]} = '{p[1]}'), 6) AS rate_unknown, round(avg(y) FILTER ({p[0]} <> '{p[1]}'), 6) AS rate_known FROM known"))
def unknown_audit(spark, sf):
    """One value of a category plays the unknown one."""
    return r(ft.known_rates(known(spark, sf), ["segment", "priority"], "y", "BUILDING"))


@query("contact_curve", "WITH c AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS contact FROM events) SELECT contact::INT AS contact, count(*) AS n, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS rate FROM c WHERE contact <= 15 GROUP BY 1")
def contact_curve(spark, sf):
    """Outcome by how many times a user was seen before, up to 15."""
    return r(ft.ranked(table(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 15, "contact").groupBy("contact").agg(F.count("*").alias("n"), F.avg((F.col("event_type") == "purchase").cast("double")).alias("rate")))


@query("vintage_table", f"WITH {LOANS_SQL} SELECT year(issued)::INT AS year, count(y) AS n_known, sum(y)::BIGINT AS n_pos, count(*) FILTER (y IS NULL) AS n_null, round(avg(y), 6) AS rate FROM loans GROUP BY 1")
def vintage_table(spark, sf):
    return r(ft.vintage(loans(spark, sf), "issued", "y"))


@query("histogram_bins", "SELECT least(floor(l_quantity / 1.25), 39)::INT AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def histogram_bins(spark, sf):
    return ft.histogram(lines(spark, sf), "l_quantity", 0.0, 50.0, 40)


@query("null_audit", f"WITH {LOANS_SQL} " + each(("y", "segment", "balance"), lambda c: f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct FROM loans"))
def null_audit(spark, sf):
    return ft.null_audit(loans(spark, sf), ["y", "segment", "balance"])


@query("lookahead_flag", "SELECT count(*) AS n, count(*) FILTER (o_orderdate < last_ship) AS n_before FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def lookahead_flag(spark, sf):
    """Rows whose date lies before the last date known of them (B-P14), compared as dates."""
    last = lines(spark, sf).groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    orders = table(spark, sf, "orders")
    return orders.join(last, orders.o_orderkey == last.l_orderkey).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderdate") < F.col("last_ship")).alias("n_before"))


@query("freq_encode", "WITH c AS (SELECT c_mktsegment AS s, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1) SELECT c_custkey, round(n / (SELECT sum(n) FROM c), 6)::DOUBLE AS segment_share FROM customer LEFT JOIN c ON c_mktsegment = s")
def freq_encode(spark, sf):
    return r(ft.frequency_encode(table(spark, sf, "customer"), "c_mktsegment", "segment_share").select("c_custkey", "segment_share"))


@query("coalesce_features", f"WITH {LOANS_SQL} SELECT loan_id, round(coalesce(CASE WHEN segment = 'BUILDING' THEN amount + balance END, balance, 0), 4) AS joint, round(greatest(0, amount - balance), 4) AS uncovered, round((amount + balance) / 2, 4) AS middle FROM loans")
def coalesce_features(spark, sf):
    df = loans(spark, sf)
    amount, balance = F.col("amount"), F.col("balance")
    return r(df.select("loan_id", ft.joint(balance, amount + balance, F.col("segment") == "BUILDING").alias("joint"), ft.floored_difference(amount, balance).alias("uncovered"), ((amount + balance) / 2).alias("middle")), 4)


@query("safe_ratio", f"WITH {LOANS_SQL}, d AS (SELECT loan_id, amount, CASE WHEN balance < 0 THEN 0 ELSE balance END AS cap FROM loans) SELECT loan_id, round(CASE WHEN amount IS NULL OR cap IS NULL THEN 0 WHEN cap = 0 AND amount > 0 THEN 100 WHEN cap = 0 THEN 0 ELSE least(100, amount / cap * 100) END, 6)::DOUBLE AS used FROM d")
def safe_ratio(spark, sf):
    df = loans(spark, sf).withColumn("cap", F.when(F.col("balance") < 0, 0.0).otherwise(F.col("balance")))
    return r(df.select("loan_id", ft.percent_ratio(F.col("amount"), F.col("cap")).alias("used")))


@query("flags_and_clip", f"WITH {LOANS_SQL} SELECT loan_id, (y IS NULL)::INT AS y_missing, (balance > 5000)::INT AS over_limit, round(least(5000, greatest(0, balance)), 4) AS clipped, round(ln(1 + greatest(0, balance)), 6) AS logged FROM loans")
def flags_and_clip(spark, sf):
    b = F.col("balance")
    floor = F.greatest(F.lit(0.0), b)
    return loans(spark, sf).select("loan_id", F.col("y").isNull().cast("int").alias("y_missing"), (b > 5000).cast("int").alias("over_limit"), F.round(F.least(F.lit(5000.0), floor), 4).alias("clipped"), F.round(F.log1p(floor), 6).alias("logged"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot", "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS \"c_mktsegment_{s}\"" for s in SEGMENTS[1:]) + " FROM customer")
def one_hot(spark, sf):
    """Levels are learned from the customers with orders; unseen ones get zeros."""
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    train = customers.join(orders, customers.c_custkey == orders.o_custkey, "left_semi")
    return ft.one_hot(customers, "c_mktsegment", ft.levels_of(train, "c_mktsegment")).drop("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("impute_stats", "WITH v AS (" + each(LINES, lambda c: f"SELECT '{c}' AS feature, {c} AS value FROM lineitem") + ") SELECT feature, count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(stddev_pop(value), 4) AS std, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr FROM v GROUP BY feature")
def impute_stats(spark, sf):
    return r(ft.fitted(lines(spark, sf), LINES), 4)


def _scale_sql(how: str, expr: str) -> str:
    return f"WITH f AS (SELECT avg(c_acctbal) AS mean, stddev_pop(c_acctbal) AS std, min(c_acctbal) AS low, max(c_acctbal) AS high, quantile_cont(c_acctbal, 0.5) AS median, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS iqr FROM customer) SELECT c_custkey, round({expr}, 5) AS c_acctbal_{how} FROM customer, f"


def _scaled(spark, sf, how):
    customers = table(spark, sf, "customer")
    return r(ft.scaled(customers, ["c_acctbal"], ft.fitted(customers, ["c_acctbal"]), how).select("c_custkey", f"c_acctbal_{how}"), 5)


query("zscore_pop", _scale_sql("zscore", "(c_acctbal - mean) / std"))(lambda spark, sf: _scaled(spark, sf, "zscore"))
query("robust_scale", _scale_sql("robust", "(c_acctbal - median) / iqr"))(lambda spark, sf: _scaled(spark, sf, "robust"))
query("minmax_scale", _scale_sql("minmax", "(c_acctbal - low) / (high - low)"))(lambda spark, sf: _scaled(spark, sf, "minmax"))


@query("strat_split_rates")
def strat_split_rates(spark, sf):
    """Share of each class dealt to the training part."""
    dealt = ft.stratified_split(known(spark, sf), "y", "loan_id")
    return dealt.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_train").alias("n_train"))


CUT_SQL = KNOWN_SQL + ", pts AS (SELECT score, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM known GROUP BY score), cum AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM pts WINDOW w AS (ORDER BY score DESC))"


def _confusion_sql(op: str) -> str:
    return KNOWN_SQL + f", c AS (SELECT count(*) FILTER (score {op} 0.5 AND y = 1) AS tp, count(*) FILTER (score {op} 0.5 AND y = 0) AS fp, count(*) FILTER (NOT score {op} 0.5 AND y = 1) AS fn, count(*) FILTER (NOT score {op} 0.5 AND y = 0) AS tn FROM known) SELECT *, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c"


query("confusion", _confusion_sql(">="))(lambda spark, sf: r(curves.confusion(known(spark, sf), "y", F.col("score") >= 0.5)))
query("confusion_strict", _confusion_sql(">"))(lambda spark, sf: r(curves.confusion(known(spark, sf), "y", F.col("score") > 0.5)))


@query("roc_curve", CUT_SQL + " SELECT round(score, 6)::DOUBLE AS score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / P, 6) AS tpr, round(fp / N, 6) AS fpr FROM cum")
def roc_curve(spark, sf):
    curve = curves.with_totals(curves.cumulative(known(spark, sf), "y", "score"))
    return r(curve.select("score", "tp", "fp", (F.col("tp") / F.col("P")).alias("tpr"), (F.col("fp") / F.col("N")).alias("fpr")))


@query("roc_auc", CUT_SQL + " SELECT round(sum(pos * (N - fp + neg / 2)) / max(P * N), 6) AS auc FROM cum")
def roc_auc(spark, sf):
    return r(curves.roc_auc(known(spark, sf), "y", "score"))


@query("pr_f1_threshold", CUT_SQL + ", f AS (SELECT score, tp / (tp + fp) AS precision, tp / P AS recall, 2 * tp / (tp + fp + P) AS f1 FROM cum) SELECT round(score, 6)::DOUBLE AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, f.score LIMIT 1")
def pr_f1_threshold(spark, sf):
    return r(curves.best_f1(known(spark, sf), "y", "score"))


@query("youden", CUT_SQL + ", j AS (SELECT score, tp / P - fp / N AS j FROM cum) SELECT round(score, 6)::DOUBLE AS threshold, round(j, 6) AS j FROM j ORDER BY j.j DESC, j.score DESC LIMIT 1")
def youden(spark, sf):
    return r(curves.youden(known(spark, sf), "y", "score"))


@query("ks", CUT_SQL + " SELECT round(max(abs(tp / P - fp / N)), 6) AS ks FROM cum")
def ks(spark, sf):
    return r(curves.ks(known(spark, sf), "y", "score"))


@query("psi", "WITH e AS (SELECT o_totalprice AS x FROM orders WHERE year(o_orderdate) < 1996), a AS (SELECT o_totalprice AS x FROM orders WHERE year(o_orderdate) >= 1996), q AS (SELECT unnest(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM e), be AS (SELECT bin, count(*) AS n FROM (SELECT (SELECT count(*) FROM q WHERE x >= edge) AS bin FROM e) GROUP BY 1), ba AS (SELECT bin, count(*) AS n FROM (SELECT (SELECT count(*) FROM q WHERE x >= edge) AS bin FROM a) GROUP BY 1), s AS (SELECT b.bin::INT AS bin, greatest(coalesce(be.n / (SELECT sum(n) FROM be), 0), 1e-6) AS expected, greatest(coalesce(ba.n / (SELECT sum(n) FROM ba), 0), 1e-6) AS actual FROM range(10) b(bin) LEFT JOIN be USING (bin) LEFT JOIN ba USING (bin)) SELECT bin, round(expected, 6)::DOUBLE AS expected, round(actual, 6)::DOUBLE AS actual, round((actual - expected) * ln(actual / expected), 6) AS part FROM s")
def psi(spark, sf):
    orders = table(spark, sf, "orders")
    early = F.year("o_orderdate") < 1996
    return r(curves.psi(orders.filter(early), orders.filter(~early), "o_totalprice"))


@query("vif")
def vif(spark, sf):
    return r(curves.vif(lines(spark, sf), LINES), 4)


@query("chi2", KNOWN_SQL + ", v AS (" + each(("amount", "score"), lambda c: f"SELECT '{c}' AS feature, y, count(*) AS n, sum({c}) AS o FROM known GROUP BY y") + "), e AS (SELECT feature, o, n / sum(n) OVER (PARTITION BY feature) * sum(o) OVER (PARTITION BY feature) AS x FROM v) SELECT feature, round(sum((o - x) * (o - x) / x), 4) AS chi2 FROM e GROUP BY feature")
def chi2(spark, sf):
    return r(curves.chi2(known(spark, sf), "y", ["amount", "score"]), 4)


@query("mutual_info_binned", KNOWN_SQL + ", b AS (SELECT priority, y, count(*) AS n FROM known GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY priority) AS a, sum(n) OVER (PARTITION BY y) AS c FROM b) SELECT round(sum(n / t * ln(n * t / (a * c))), 6) AS mi FROM t")
def mutual_info_binned(spark, sf):
    return r(curves.mutual_information(known(spark, sf), "priority", "y"))


@query("regression_metrics", "WITH p AS (SELECT l_extendedprice AS a, l_quantity * 1500 AS p FROM lineitem) SELECT round(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(a)), 6) AS r2, round(avg(abs(a - p)), 4) AS mae, round(sqrt(avg((a - p) * (a - p))), 4) AS rmse FROM p")
def regression_metrics(spark, sf):
    m = curves.regression_metrics(lines(spark, sf).select(F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 1500).alias("p")), "a", "p")
    return m.select(F.round("r2", 6).alias("r2"), F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@query("expected_revenue", KNOWN_SQL + " SELECT segment, round(sum(score * balance), 2) AS revenue FROM known GROUP BY 1")
def expected_revenue(spark, sf):
    """Probability times balance (B-M31)."""
    return r(known(spark, sf).groupBy("segment").agg(F.sum(F.col("score") * F.col("balance")).alias("revenue")), 2)


@query("champion_challenger", KNOWN_SQL + ", two AS (SELECT y, score, 1 - score AS other FROM known), ra AS (SELECT y, avg(k) OVER (PARTITION BY score) AS k FROM (SELECT y, score, row_number() OVER (ORDER BY score) AS k FROM two)), rb AS (SELECT y, avg(k) OVER (PARTITION BY other) AS k FROM (SELECT y, other, row_number() OVER (ORDER BY other) AS k FROM two)), a AS (SELECT (sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM ra), b AS (SELECT (sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM rb) SELECT round(a.auc, 6) AS champion, round(b.auc, 6) AS challenger, round(a.auc - b.auc, 6) AS gap FROM a, b")
def champion_challenger(spark, sf):
    """Areas of two scores and their difference (B-M33)."""
    df = known(spark, sf).withColumn("other", 1 - F.col("score"))
    a, b = curves.roc_auc(df, "y", "score").select(F.col("auc").alias("champion")), curves.roc_auc(df, "y", "other").select(F.col("auc").alias("challenger"))
    return r(a.join(F.broadcast(b)).select("champion", "challenger", (F.col("champion") - F.col("challenger")).alias("gap")))


@query("prepared_rows", f"WITH {LOANS_SQL} SELECT loan_id, round(ln(1 + amount), 6) AS loan_amount, y::INT AS y, (segment = 'BUILDING')::INT AS building FROM loans WHERE y IS NOT NULL AND balance IS NOT NULL")
def prepared_rows(spark, sf):
    """Renamed, reduced to rows with all they need, booleans as integers, logged (B-P1, 3, 5, 13, 16)."""
    rows = loans(spark, sf).withColumn("building", F.col("segment") == "BUILDING")
    out = ft.prepared(rows, {"amount": "loan_amount"}, ["priority", "issued"], ["y", "balance"], ["loan_amount"])
    return out.select("loan_id", F.round("loan_amount", 6).alias("loan_amount"), "y", "building")


@query("derived_totals", "SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, 0) + coalesce(l_tax, 0), 6) AS total, round(l_extendedprice * 0.001, 6) AS thousands FROM lineitem")
def derived_totals(spark, sf):
    """A derived sum and a column in another unit (B-P2, B-P17), columns chosen (B-P4)."""
    rows = table(spark, sf, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round(ft.total(F.col("l_quantity"), F.col("l_tax")), 6).alias("total"), ft.converted(F.col("l_extendedprice"), 0.001).alias("thousands"))


@query("segment_rates", "SELECT CASE WHEN passed = -1 THEN 'never' ELSE 'before' END AS kind, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT CASE WHEN user_id % 4 = 0 THEN -1 ELSE user_id % 30 END AS passed, value FROM events) GROUP BY 1")
def segment_rates(spark, sf):
    """Rows apart by the value that stands for never (B-P7)."""
    passed = F.when(F.col("user_id") % 4 == 0, -1).otherwise(F.col("user_id") % 30)
    return table(spark, sf, "events").groupBy(ft.segment(passed, -1, "never", "before").alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("joined_columns", "SELECT o_orderkey, o_orderstatus, round(o_totalprice * 2, 2) AS twice FROM orders")
def joined_columns(spark, sf):
    """Columns of two tables side by side by their row id (B-P20)."""
    orders = table(spark, sf, "orders")
    return ft.joined_columns(orders.select("o_orderkey", "o_orderstatus"), orders.select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("twice")), "o_orderkey")


@query("imputed_rows", f"WITH {LOANS_SQL}, v AS (SELECT loan_id, CASE WHEN loan_id % 5 <> 0 THEN amount END AS amount FROM loans) SELECT loan_id, round(coalesce(amount, (SELECT median(amount) FROM v)), 4) AS amount FROM v")
def imputed_rows(spark, sf):
    """Missing values filled with the median of the others (B-M2)."""
    rows = loans(spark, sf).select("loan_id", F.when(F.col("loan_id") % 5 != 0, F.col("amount")).alias("amount"))
    return ft.imputed(rows, ["amount"], ft.fitted(rows, ["amount"])).select("loan_id", F.round("amount", 4).alias("amount"))


@query("unscaled_rows", "SELECT l_orderkey, l_linenumber, round(l_quantity, 4) AS l_quantity FROM lineitem")
def unscaled_rows(spark, sf):
    """Standard scores and back (B-M35)."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    fit = ft.fitted(rows, ["l_quantity"])
    r = fit.first()
    scores = ft.scaled(rows, ["l_quantity"], fit, "zscore")
    return scores.select("l_orderkey", "l_linenumber", F.round(ft.unscaled(F.col("l_quantity_zscore"), r["mean"], r["std"]), 4).alias("l_quantity"))


@query("sampled_rows", "SELECT 100 AS n, 100 AS n_distinct")
def sampled_rows(spark, sf):
    """A sample of 100 rows, the same ones every time (B-M34): the limit is the feature."""
    picked = ft.sample_rows(table(spark, sf, "orders"), "o_orderkey", 100)
    again = ft.sample_rows(table(spark, sf, "orders"), "o_orderkey", 100)
    return picked.select("o_orderkey").join(again.select("o_orderkey"), "o_orderkey").agg(F.count("*").cast("int").alias("n"), F.count_distinct("o_orderkey").cast("int").alias("n_distinct"))


@query("ks_test", CUT_SQL + ", k AS (SELECT max(abs(tp / P - fp / N)) AS ks, max(P)::BIGINT AS n_pos, max(N)::BIGINT AS n_neg FROM cum), x AS (SELECT *, sqrt(n_pos * n_neg / (n_pos + n_neg)) AS e FROM k) SELECT round(any_value(ks), 6) AS ks, any_value(n_pos) AS n_pos, any_value(n_neg) AS n_neg, round(least(1, greatest(0, 2 * sum((CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * i * i * ((e + 0.12 + 0.11 / e) * ks) ** 2)))), 6)::DOUBLE AS p_value FROM x, range(1, 101) r(i)")
def ks_test(spark, sf):
    """The two-sample statistic with its p-value (B-M29)."""
    return curves.ks_test(known(spark, sf), "y", "score").select(F.round("ks", 6).alias("ks"), "n_pos", "n_neg", F.round("p_value", 6).alias("p_value"))
