"""Tabular profiling and feature building as DataFrame expressions (B-P*, B-A*, B-M1 to B-M5).

Missing values are NULL. Divisions are guarded, since ANSI mode raises on a zero divisor, and
quantiles are the exact interpolated ones. Statistics that are fitted on one table and used on
another come back as one-row tables or literals, so what is learned from which rows stays visible.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.sources.shared import stored


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows and share of each value, NULL as a value of its own (B-A1)."""
    counted = df.groupBy(col).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).select(F.col(col).alias("value"), "n", (F.col("n") / F.col("total")).alias("share"))


def imbalance(df: DataFrame, y: str) -> DataFrame:
    """Rows of either class and their ratio (B-A2)."""
    pos, neg = F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)
    return df.agg(neg.alias("n_neg"), pos.alias("n_pos"), F.try_divide(neg, pos).alias("ratio"))


def group_rates(df: DataFrame, by: str, y: str) -> DataFrame:
    """Mean outcome and rows of each group (B-A4)."""
    return df.groupBy(by).agg(F.avg(y).alias("rate"), F.count("*").alias("n"))


def class_means(df: DataFrame, y: str, cols: Sequence[str]) -> DataFrame:
    """One row a column: mean in either class, difference, difference in per cent (B-A5)."""
    aggs = [F.avg(F.when(F.col(y) == k, F.col(c))).alias(f"{c}_{k}") for c in cols for k in (0, 1)]
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}_0").alias("mean_0"), F.col(f"{c}_1").alias("mean_1")) for c in cols))).alias("r")
    wide = df.agg(*aggs).select(rows).select("r.*")
    diff = F.col("mean_1") - F.col("mean_0")
    return wide.select("*", diff.alias("diff"), (F.try_divide(diff, F.col("mean_0")) * 100).alias("diff_pct"))


#: Entries of the sketch that brackets quantiles; its error in rank is a share of 1 / SKETCH.
SKETCH = 10_000
#: Groups whose brackets, a few dozen bytes each, every task may hold.
HELD_GROUPS = 100_000


def exact_quantiles(df: DataFrame, value: str, named: dict[str, float], by: Sequence[str] = (), nearest: bool = False) -> DataFrame:
    """Interpolated quantiles of each group, a column each, or with ``nearest`` the value at position
    n * q; NULLs and NaN are left out.

    A sketch of bounded size brackets each quantile. One more pass counts the values between and
    beside brackets, and each value within one, so that only brackets are shuffled and sorted,
    each in a task of its own. A rank outside its bracket, which the sketch's bound rules out, is
    an error and never another value.
    """
    by = list(by)
    held = df.select(*by, F.col(value).cast("double").alias("v_")).filter("v_ is not null and not isnan(v_)")
    wide = 3.0 / SKETCH
    places = [min(1.0, max(0.0, q + d)) for q in named.values() for d in (-wide, wide)]
    bounds = held.groupBy(*by).agg(F.percentile_approx("v_", F.array(*map(F.lit, places)), SKETCH).alias("edges_"), F.count("*").alias("all_"))
    # a bracket of a small group is the whole group: there, the next rank may lie beyond an edge of the sketch
    small = F.col("all_") <= 4 * SKETCH
    ends = (F.when(small, F.lit(end)).otherwise(F.col("edges_")[2 * i + k]).alias(f"{side}{i}_") for i in range(len(named)) for k, (side, end) in enumerate((("lo", float("-inf")), ("hi", float("inf")))))
    bounds = bounds.select(*by, "all_", *ends)
    if by:
        bounds = stored(bounds)
        # rows go to the brackets: sizes are estimates, and a plan may take all rows for the smaller side
        few = bounds.limit(HELD_GROUPS + 1).count() <= HELD_GROUPS
        placed = _joined(held, F.broadcast(bounds) if few else bounds.hint("merge"), by)
        lows, highs = ([F.col(f"{side}{i}_") for i in range(len(named))] for side in ("lo", "hi"))
    else:
        row = bounds.first()
        placed = held.withColumn("all_", F.lit(row["all_"]))
        lows, highs = ([F.lit(row[f"{side}{i}_"]) for i in range(len(named))] for side in ("lo", "hi"))
    zone = sum(((F.col("v_") >= lo).cast("int") + (F.col("v_") > hi).cast("int") for lo, hi in zip(lows, highs, strict=True)), F.lit(0))
    inside = reduce(lambda a, b: a | b, (F.col("v_").between(lo, hi) for lo, hi in zip(lows, highs, strict=True)))
    counted = placed.groupBy(*by, "all_", zone.alias("zone_"), F.when(inside, F.col("v_")).alias("v_")).agg(F.count("*").alias("n_"))
    within = Window.partitionBy(*by, "zone_").orderBy("v_").rowsBetween(Window.unboundedPreceding, 0)
    sums = counted.groupBy(*by, "zone_").agg(F.sum("n_").alias("in_"))
    before = Window.partitionBy(*by, F.lit(0)).orderBy("zone_").rowsBetween(Window.unboundedPreceding, -1)  # two zones a quantile
    offsets = sums.select(*by, "zone_", F.coalesce(F.sum("in_").over(before), F.lit(0)).alias("before_"))
    run = _joined(counted.withColumn("upto_", F.sum("n_").over(within)), offsets, [*by, "zone_"]).withColumn("upto_", F.col("upto_") + F.col("before_"))
    rank = {n: F.floor(F.col("all_") * F.lit(float(q))) if nearest else (F.col("all_") - 1) * F.lit(float(q)) for n, q in named.items()}
    at = lambda r, k: F.least(F.floor(r) + k, F.col("all_") - 1)
    hit = lambda r, k: (F.col("upto_") > at(r, k)) & (F.col("upto_") - F.col("n_") <= at(r, k))
    found = run.groupBy(*by, "all_").agg(*(F.max(F.when(hit(r, k), F.col("v_"))).alias(f"{n}_{k}_") for n, r in rank.items() for k in (0, 1)))
    sure = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
    out = found.select(*by, *((sure(f"{n}_0_") + (sure(f"{n}_1_") - sure(f"{n}_0_")) * (r - F.floor(r))).alias(n) for n, r in rank.items()))
    return out if by else df.sparkSession.range(1).join(F.broadcast(out), F.lit(True), "left").select(*named)


def _joined(rows: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with what was summed a group: NULL is a group of its own."""
    if not by:
        return rows.join(F.broadcast(small))
    named = small.withColumnsRenamed({c: f"{c}_by_" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"{c}_by_")) for c in by]
    return rows.join(named, on).drop(*(f"{c}_by_" for c in by))


def quantiles(df: DataFrame, col: str, **named: float) -> DataFrame:
    return exact_quantiles(df, col, named)


def under_quantile(df: DataFrame, col: str, q: float) -> DataFrame:
    """Rows up to a quantile of one of their columns (B-A6)."""
    cap = exact_quantiles(df, col, {"cap_": q})
    return df.join(F.broadcast(cap), F.col(col) <= F.col("cap_")).drop("cap_")


def iqr_outliers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Quartiles, fences and rows outside them for each column (B-A7)."""
    long = melt(df, cols)
    quart = exact_quantiles(long, "value", {"q1": 0.25, "q3": 0.75}, ["feature"])
    iqr = F.col("q3") - F.col("q1")
    fences = quart.withColumns({"lo": F.col("q1") - 1.5 * iqr, "hi": F.col("q3") + 1.5 * iqr})
    return long.join(F.broadcast(fences), "feature").groupBy("feature", "q1", "q3", "lo", "hi").agg(F.count_if((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).alias("n_out"), F.count("value").alias("n"))


def melt(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols))).alias("r")
    return df.select(*keep, rows).select(*keep, "r.*")


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair i < j in one pass, NULL where a column is constant (B-A8)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    moments = [F.stddev_pop(c).alias(f"s_{c}") for c in cols] + [F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs]
    row = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.try_divide(F.col(f"c_{a}_{b}"), F.col(f"s_{a}") * F.col(f"s_{b}")).alias("r")) for a, b in pairs))).alias("x")
    return df.agg(*moments).select(row).select("x.*")


def known_rates(df: DataFrame, cols: Sequence[str], y: str, unknown: str) -> DataFrame:
    """For each column: unknown values, their share, outcome among unknown and known (B-A11)."""
    aggs = []
    for c in cols:
        is_unknown = F.col(c) == unknown
        aggs += [F.count_if(is_unknown).alias(f"{c}_n"), F.avg(F.when(is_unknown, F.col(y))).alias(f"{c}_u"), F.avg(F.when(~is_unknown, F.col(y))).alias(f"{c}_k")]
    wide = df.agg(F.count("*").alias("total_"), *aggs)
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}_n").alias("n_unknown"), (100 * F.col(f"{c}_n") / F.col("total_")).alias("pct_unknown"), F.col(f"{c}_u").alias("rate_unknown"), F.col(f"{c}_k").alias("rate_known")) for c in cols))).alias("r")
    return wide.select(rows).select("r.*")


def vintage(df: DataFrame, date: str, y: str) -> DataFrame:
    """Outcome by year of a date: known outcomes, positives, unknown ones, rate (B-A3)."""
    return df.groupBy(F.year(date).alias("year")).agg(F.count(y).alias("n_known"), F.sum(y).alias("n_pos"), F.count_if(F.col(y).isNull()).alias("n_null"), F.avg(y).alias("rate"))


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows in each of ``bins`` equal bins of [low, high], the last one closed (B-A12)."""
    at = F.least(F.floor((F.col(col) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(col).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def null_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing and distinct values of each column (B-A14)."""
    wide = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in cols), *(F.count_distinct(c).alias(f"{c}_distinct") for c in cols))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}_null").alias("n_null"), F.col(f"{c}_distinct").alias("n_distinct")) for c in cols))).alias("r")
    return wide.select(rows).select("r.*")


def mapped(col: Column, values: dict) -> Column:
    """A value map; anything else becomes NULL (B-P6)."""
    return reduce(lambda c, kv: c.when(col == kv[0], F.lit(kv[1])), values.items(), F.when(F.lit(False), F.lit(next(iter(values.values())))))


def joint(single: Column, both: Column, is_joint: Column) -> Column:
    """The joint figure of joint rows, else the single one, 0 where neither is known (B-P8)."""
    return F.coalesce(F.when(is_joint, both), single, F.lit(0))


def percent_ratio(num: Column, den: Column) -> Column:
    """100 * num / den, capped at 100: 100 over a zero base with a balance, 0 without (B-P10)."""
    return F.when(num.isNull() | den.isNull(), F.lit(0.0)).when((den == 0) & (num > 0), F.lit(100.0)).when(den == 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), num / F.nullif(den, F.lit(0)) * 100))


def floored_difference(a: Column, b: Column) -> Column:
    """a - b, not below 0, NULL where either is (B-P9): greatest() alone would skip the NULL."""
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.greatest(F.lit(0.0), a - b))


def frequency_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """The share of non-null rows that hold the row's value (B-P11)."""
    counted = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n_"))
    total = counted.agg(F.sum("n_").alias("total_"))
    shares = counted.join(F.broadcast(total)).select(col, (F.col("n_") / F.col("total_")).alias(out))
    return df.join(shares, col, "left")


def one_hot(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """Indicators of all levels but the first in order, as learned from another table (B-P19)."""
    return df.withColumns({f"{col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in sorted(levels)[1:]})


def levels_of(df: DataFrame, col: str, most: int = 1000) -> list[str]:
    """The values of a category; an error beyond ``most``, since they become columns."""
    found = [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} values")
    return sorted(found)


def fitted(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row a column with what scalers and imputers learn (B-M2 to B-M5)."""
    long = melt(df, cols)
    sums = long.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    middle = exact_quantiles(long, "value", {"q1_": 0.25, "median": 0.5, "q3_": 0.75}, ["feature"])
    return sums.join(middle, "feature", "left").select("feature", "n", "mean", "median", "std", "low", "high", (F.col("q3_") - F.col("q1_")).alias("iqr"))


def scaled(df: DataFrame, cols: Sequence[str], fit: DataFrame, how: str) -> DataFrame:
    """``df`` with scaled columns by a fit of maybe other rows; constant columns become 0."""
    held = {r["feature"]: r for r in fit.collect()}  # a row a column
    shift = {"zscore": "mean", "robust": "median", "minmax": "low"}[how]

    def scale(c: str) -> Column:
        r = held[c]
        by = {"zscore": r["std"], "robust": r["iqr"], "minmax": r["high"] - r["low"]}[how]
        return ((F.col(c) - r[shift]) / by if by else F.col(c) - r[shift]).alias(f"{c}_{how}")

    return df.select("*", *(scale(c) for c in cols))


def imputed(df: DataFrame, cols: Sequence[str], fit: DataFrame, by: str = "median") -> DataFrame:
    held = {r["feature"]: r[by] for r in fit.collect()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(held[c])) for c in cols})


def stratified_split(df: DataFrame, y: str, key: str, fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """``df`` with ``is_train``: the given share of each class, dealt by a hash of the key (B-M1).

    The rows of a class are not sorted in one task: the cut is a quantile of the hashes of the class.
    """
    dealt = df.withColumn("deal_", F.xxhash64(F.lit(seed), F.col(key)).cast("double"))
    cuts = dealt.groupBy(y).agg(F.percentile_approx("deal_", fraction, 1_000_000).alias("cut_"))
    return dealt.join(F.broadcast(cuts), dealt[y].eqNullSafe(cuts[y]), "left").drop(cuts[y]).withColumn("is_train", F.col("deal_") <= F.col("cut_")).drop("deal_", "cut_")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a hash of their key: the same ones every time (B-M34)."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def ranked(df: DataFrame, part: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each part; ties must be settled by ``order``."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col(rank) <= k)


def prepared(df: DataFrame, rename: dict[str, str] | None = None, drop: Sequence[str] = (), required: Sequence[str] = (), logged: Sequence[str] = ()) -> DataFrame:
    """Renamed, without dropped columns and rows that lack a required value, log1p taken, booleans
    as integers (B-P1, B-P3, B-P5, B-P13, B-P16)."""
    out = df.withColumnsRenamed(rename or {}).drop(*drop)
    out = out.dropna(subset=list(required)) if required else out
    ints = {c: F.col(c).cast("int") for c, t in out.dtypes if t == "boolean"}
    return out.withColumns(ints | {c: F.log1p(F.col(c)) for c in logged}) if ints or logged else out


def missing_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A 0/1 column for each column's missing values (B-P12)."""
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in cols})


def clipped(col: Column, low: float, high: float) -> Column:
    """Within bounds, NULL staying NULL (B-P18)."""
    return F.when(col.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), col)))


def joined_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of two tables side by side by their row id (B-P20)."""
    return a.join(b, key)


def unscaled(col: Column, mean: float, std: float) -> Column:
    """Back from standard scores, for display (B-M35)."""
    return col * std + mean


def total(*cols: Column) -> Column:
    """A derived sum, in which a missing part counts as 0 (B-P2)."""
    return sum((F.coalesce(c, F.lit(0)) for c in cols), F.lit(0))


def segment(col: Column, sentinel, absent: str, present: str) -> Column:
    """Rows apart by a value that stands for "never" (B-P7)."""
    return F.when(col == F.lit(sentinel), absent).otherwise(present)


def converted(col: Column, factor: float, digits: int = 6) -> Column:
    """A column in another unit (B-P17)."""
    return F.round(col * factor, digits)
