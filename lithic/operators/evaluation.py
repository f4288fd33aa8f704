"""Evaluation of retrieval and answers (E1 to E51): measures over tables of claims, runs and labels.

A measure that could not be taken is NULL, never 0; one that was taken and failed is NaN, and the
two are counted apart. Inputs are ordinary tables, named with each function.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions.text import is_bin, long_words
from lithic.operators.features import exact_quantiles

AGREED, LOST, SPREAD = 0.85, 0.05, (0.1, 0.9)
GAP, SHARE, WORDS = 6.0, 0.45, 3

#: How replies that decline look, and how a citation does.
DECLINES = (
    r"\bdo(?:es)? not (?:contain|provide|include|address|answer|cover)\b|\bcannot be answered\b|\bcan(?:not|'t) answer\b|\bno information\b|\bnot (?:enough|sufficient) (?:information|context)\b|"
    r"\binsufficient\b|\bnot (?:addressed|covered|mentioned) in the (?:excerpts|passages|provided)\b|\bthe excerpts? (?:do|does) not\b|\bunable to answer\b"
)
CITED = r"\[S\d+\]"


def graded_claims(claims: DataFrame, runs: DataFrame) -> DataFrame:
    """``claims`` (qid, claim_no, label, locator) with cited, valid and in_window.

    runs(qid, labels, unit_locators): the label table of an answer and, for each label's number, the
    locators of its passage. in_window is NULL where nothing can be checked.
    """
    label, place = F.trim(F.coalesce("label", F.lit(""))), F.trim(F.coalesce("locator", F.lit("")))
    valid = label.rlike(r"^S\d+$") & F.coalesce(F.array_contains("labels", label), F.lit(False))
    number = F.regexp_extract(label, r"^S(\d+)$", 1).try_cast("int")
    known = F.filter(F.coalesce(F.get("unit_locators", number - 1), F.array().cast("array<string>")), lambda u: u != "")
    window = F.when(~valid | (F.size(known) == 0), None).when(place == "", False).otherwise(F.array_contains(known, place))
    held = claims.join(runs.select("qid", "labels", "unit_locators"), "qid")
    return held.withColumns({"cited": label != "", "valid": valid, "in_window": window}).drop("labels", "unit_locators")


def citation_rates(graded: DataFrame, by: str) -> DataFrame:
    """Claims that pass each layer, of those that could be checked."""
    return graded.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if("cited").alias("cited"), F.count_if("valid").alias("valid"), F.count("in_window").alias("checkable"),
        F.count_if("in_window").alias("in_window"), F.count_if(F.col("valid") & F.col("in_window").isNull()).alias("unmeasurable"))


def misses(graded: DataFrame) -> DataFrame:
    """Claims that fail a layer, with the first reason."""
    why = F.when(~F.col("cited"), "no label").when(~F.col("valid"), "label not in table").when(~F.col("in_window"), "locator outside the window")
    return graded.withColumn("reason", why).filter("reason is not null")


def tally(grades: DataFrame, by: str, verdict: str, values: Sequence[str]) -> DataFrame:
    """Hand grades by mode, a column a verdict, and those that are wrong (E9): all but the first."""
    each = [F.count_if(F.col(verdict) == v).alias(v) for v in values]
    return grades.groupBy(by).agg(F.count("*").alias("n"), *each).withColumn("wrong", sum((F.col(v) for v in values[1:]), F.lit(0)).cast("long"))


def index_drift(made: DataFrame, indexed: DataFrame, parents: DataFrame) -> DataFrame:
    """One row: what the code makes against what the index holds.

    made and indexed (chunk_id, parent_id, text), parents (parent_id): counts, chunks missing and extra,
    texts that are the same, chunks of parents that are not there, parents that stand twice.
    """
    a, b = (df.select("chunk_id", F.xxhash64("text").alias(f"{n}_1"), F.md5("text").alias(f"{n}_2")) for df, n in ((made, "a"), (indexed, "b")))
    both = a.join(b, "chunk_id", "full").agg(
        F.count("a_2").alias("n_made"), F.count("b_2").alias("n_indexed"), F.count_if(F.col("b_2").isNull()).alias("missing"), F.count_if(F.col("a_2").isNull()).alias("extra"),
        F.count_if((F.col("a_1") == F.col("b_1")) & (F.col("a_2") == F.col("b_2"))).alias("same"))
    dangling = indexed.join(parents.select("parent_id").distinct(), "parent_id", "left_anti").agg(F.count("*").alias("dangling"))
    twice = parents.groupBy("parent_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("parents_twice"))
    return both.join(F.broadcast(dangling)).join(F.broadcast(twice))


def carried_labels(new: DataFrame, old: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``new`` rows with the labels of an earlier run where they have none; labels are never wiped."""
    held = old.select(*keys, *(F.col(c).alias(f"{c}_old") for c in columns)).dropDuplicates(list(keys))
    return new.join(held, list(keys), "left").withColumns({c: F.coalesce(c, f"{c}_old") for c in columns}).drop(*(f"{c}_old" for c in columns))


def agreement(rows: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """Rows that both raters settled, how many they agree on, and whether that reaches the bar."""
    both = rows.filter(F.col(a).isin(*values) & F.col(b).isin(*values))
    same = F.count_if(F.col(a) == F.col(b))
    rate = F.try_divide(same, F.count("*"))
    return both.agg(F.count("*").alias("n"), same.alias("same"), rate.alias("rate"), (rate >= AGREED).alias("passes"))


def separation(rows: DataFrame, relevant: str, features: Sequence[str]) -> DataFrame:
    """For each feature: the middle 80 % of relevant and other rows, the cut midway between them if
    they are apart, and whether it loses at most LOST of the relevant rows (E15, E17)."""
    long = rows.select(F.col(relevant).alias("rel"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features))).alias("f")).select("rel", "f.*").filter("value is not null")
    spread = exact_quantiles(long, "value", {"lo": SPREAD[0], "hi": SPREAD[1]}, ["feature", "rel"])
    side = lambda rel, n: spread.filter(F.col("rel") == rel).select("feature", F.col("lo").alias(f"{n}_lo"), F.col("hi").alias(f"{n}_hi"))
    pair = side(True, "rel").join(side(False, "other"), "feature")
    below = F.col("rel_hi") < F.col("other_lo")
    above = F.col("other_hi") < F.col("rel_lo")
    cuts = pair.withColumns({"below": below, "cut": F.when(below, (F.col("rel_hi") + F.col("other_lo")) / 2).when(above, (F.col("other_hi") + F.col("rel_lo")) / 2)})
    out = F.when(F.col("below"), F.col("value") > F.col("cut")).otherwise(F.col("value") < F.col("cut"))
    lost = long.filter("rel").join(F.broadcast(cuts), "feature").groupBy("feature").agg(F.avg(F.when(F.col("cut").isNotNull(), out.cast("int"))).alias("lost"))
    verdict = F.when(F.col("cut").isNull(), "overlaps").when(F.col("lost") <= LOST, "candidate").otherwise("loses too much")
    return cuts.join(lost, "feature").drop("below").withColumn("verdict", verdict)


def question_scores(delivered: DataFrame, qid: str, relevant: str, order: Sequence[Column]) -> DataFrame:
    """Precision, hit, first place and reciprocal rank of each question in a given order."""
    q = delivered.withColumn("k_", F.row_number().over(Window.partitionBy(qid).orderBy(*order))).groupBy(qid)
    first = F.min(F.when(F.col(relevant) == 1, F.col("k_")))
    return q.agg(F.avg(relevant).alias("precision"), F.max(relevant).alias("hit"), F.max(F.when(F.col("k_") == 1, F.col(relevant))).alias("p_at_1"), F.coalesce(1.0 / first, F.lit(0.0)).alias("rr"))


def reply_class(text: Column, marker: str = "NOT_IN_SOURCES") -> tuple[Column, Column]:
    """(refused, ambiguous) of a reply: empty and hedged replies are for a human to judge."""
    t = F.trim(F.coalesce(text, F.lit("")))
    marked = F.contains(F.lower(F.substring(t, 1, 200)), F.lit(marker.lower()))
    hit, cited = F.substring(t, 1, 400).rlike("(?i)" + DECLINES), t.rlike(CITED)
    return (t == "") | marked | hit, (t == "") | (~marked & hit & cited)


def score_overlap(rows: DataFrame, positive: Column, score: str) -> DataFrame:
    """Ranges of a score among positives and others; a boundary midway only where they are apart."""
    r = rows.agg(F.max(F.when(~positive, F.col(score))).alias("other_max"), F.min(F.when(positive, F.col(score))).alias("positive_min"))
    apart = F.col("other_max") < F.col("positive_min")
    return r.select("other_max", "positive_min", apart.alias("viable"), F.when(apart, (F.col("other_max") + F.col("positive_min")) / 2).alias("boundary"), F.greatest(F.lit(0.0), F.col("other_max") - F.col("positive_min")).alias("overlap"))


def facet_margins(best: DataFrame, qid: str, score: str) -> DataFrame:
    """(qid, margin): how far the best facet lies before the second one, where there are several."""
    order = Window.partitionBy(qid).orderBy(F.desc(score))
    k = best.withColumns({"k_": F.row_number().over(order), "next_": F.lead(score).over(order)})
    return k.filter("k_ = 1 and next_ is not null").select(qid, (F.col(score) - F.col("next_")).alias("margin"))


def intent_confusion(rows: DataFrame, truth: str, got: str, seconds: str) -> DataFrame:
    """Truth by decision, with the median latency of each cell."""
    cells = rows.groupBy(truth, got).agg(F.count("*").alias("n"))
    return cells.join(exact_quantiles(rows, seconds, {"median_seconds": 0.5}, [truth, got]), [truth, got], "left")


def claim_gaps(scored: DataFrame, qid: str, score: str, margin: float = GAP) -> DataFrame:
    """``scored`` claims with their distance from the best claim of their answer, and ``far``."""
    gap = F.max(score).over(Window.partitionBy(qid)) - F.col(score)
    return scored.withColumn("gap", gap).withColumn("far", F.col("gap") > margin)


def rank_quartiles(rows: DataFrame, value: str) -> DataFrame:
    """Nearest-rank quartiles of the values above 0: positions 0, n/4, n/2, 3n/4 and n-1."""
    some = rows.filter(F.col(value) > 0)
    found = exact_quantiles(some, value, {"least": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "most": 1.0}, nearest=True)
    return some.agg(F.nullif(F.count("*"), F.lit(0)).alias("n")).join(F.broadcast(found))


def judged_metrics(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """For each metric: values, mean and median of what was measured, and NaN and absent ones apart."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("r")).select("r.*")
    fair = F.when(~F.isnan("value"), F.col("value"))
    counts = long.groupBy("metric").agg(F.count(fair).alias("n"), F.avg(fair).alias("mean"), F.count_if(F.coalesce(F.isnan("value"), F.lit(False))).alias("n_nan"), F.count_if(F.col("value").isNull()).alias("n_absent"))
    return counts.join(exact_quantiles(long.filter("value is not null and not isnan(value)"), "value", {"median": 0.5}, ["metric"]), "metric", "left")


def judge_separates(rows: DataFrame, good: Column, bad: Column, metric: str, gap: float = 0.30) -> DataFrame:
    """Whether a judge tells good rows from bad ones: no NaN, and means ``gap`` apart."""
    value = F.col(metric)
    r = rows.agg(F.count_if(F.coalesce(F.isnan(value), F.lit(False))).alias("n_nan"), F.avg(F.when(good & ~F.isnan(value), value)).alias("good"), F.avg(F.when(bad & ~F.isnan(value), value)).alias("bad"))
    return r.withColumn("passes", F.coalesce((F.col("n_nan") == 0) & (F.col("good") - F.col("bad") >= gap), F.lit(False)))


def claim_totals(screened: DataFrame, by: str) -> DataFrame:
    """Claims that are valid, invalid and weak."""
    return screened.groupBy(by).agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if("weak").alias("weak"))


def auto_cited(sentences: DataFrame, passages: DataFrame) -> DataFrame:
    """``sentences`` (qid, no, text) with the passage that holds most of their long words.

    passages(qid, place, passage). Sentences under WORDS long words are not attributed, nor those whose
    best share is under SHARE; of equal shares the first passage wins.
    """
    words = long_words(F.col("text"))
    met = sentences.withColumn("w_", words).join(passages.select("qid", "place", F.lower("passage").alias("p_")), "qid", "left")
    share = F.when((F.size("w_") >= WORDS) & F.col("p_").isNotNull(), F.size(F.filter("w_", lambda w: F.contains(F.col("p_"), w))) / F.size("w_")).otherwise(0.0)
    best = met.withColumn("s_", share).groupBy("qid", "no").agg(F.max(F.struct(F.col("s_").alias("share"), (-F.col("place")).alias("minus"))).alias("b"))
    return best.select("qid", "no", F.when(F.col("b.share") >= SHARE, -F.col("b.minus")).alias("cited"), F.col("b.share").alias("share"))


def stable_runs(runs: DataFrame, key: str, text: str) -> DataFrame:
    """Whether all runs of a question gave one text."""
    return runs.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64(text), F.length(text)).alias("n_texts")).withColumn("same", F.col("n_texts") <= 1)


def step_times(timings: DataFrame, step: str, seconds: str) -> DataFrame:
    """Best and mean time of each step over its runs."""
    return timings.groupBy(step).agg(F.count("*").alias("n"), F.min(seconds).alias("best"), F.avg(seconds).alias("mean"))


def expected_rank(ranked: DataFrame, expected: DataFrame, qid: str, key: str) -> DataFrame:
    """Where the expected row of each question stands, NULL where it was not found."""
    return expected.join(ranked.select(qid, key, "rank"), [qid, key], "left")


def fusion_trace(fused: DataFrame, qid: str, ranks: Sequence[str]) -> DataFrame:
    """Fused rows with the arms that found them and the share of the sum that each arm gave."""
    parts = {r: F.coalesce(1.0 / (61 + F.col(r)), F.lit(0.0)) for r in ranks}
    whole = sum(parts.values(), F.lit(0.0))
    arms = F.concat_ws("+", *(F.when(F.col(r).isNotNull(), F.lit(r.removesuffix("_rank"))) for r in ranks))
    return fused.withColumns({"arms": arms} | {f"{r.removesuffix('_rank')}_share": F.round(p / whole, 6) for r, p in parts.items()})


def read_rates(runs: DataFrame, tokens: Column, reported: Column, wall: Column, expected: Column) -> DataFrame:
    """``runs`` with their rates by the reported and by the wall time, whether the prompt came from a
    cache (the rates are more than three apart) and whether it was cut (E45)."""
    rate, honest = F.try_divide(tokens, reported), tokens / F.greatest(wall, F.lit(1e-6))
    out = runs.withColumns({"reported_rate": rate, "rate": honest})
    return out.withColumns({"cached": F.coalesce("reported_rate", F.lit(0.0)) / F.greatest("rate", F.lit(1e-6)) > 3, "cut": tokens < 0.6 * expected})


#: What a paragraph number and a bracketed marker at the start of a chunk look like.
DOTTED, BRACKET = r"^\s*\(?\d{1,3}(?:\.\d{1,3}){1,3}\)?[\s.:)]", r"^\s*\((?:[a-zA-Z]|\d{1,2}|[ivxIVX]{1,4})\)\s"


def locator_buckets(chunks: DataFrame, parents: DataFrame, kind: str, text: str) -> DataFrame:
    """``chunks`` (with parent_id) with ``dotted`` and, for those cited by their section only, why:
    A1 a number in the text, A2 a marker, B a parent that names nothing, C a parent that does (E23)."""
    met = chunks.join(parents.select("parent_id", "heading"), "parent_id", "left")
    dotted = F.coalesce(F.col(text).rlike(DOTTED), F.lit(False))
    nameless = F.col("heading").isNull() | (F.trim("heading") == "?") | is_bin(F.col("heading"))
    why = F.when(dotted, "A1").when(F.col(text).rlike(BRACKET), "A2").when(nameless, "B").otherwise("C")
    return met.withColumns({"dotted": dotted, "bucket": F.when(F.col(kind) == "section", why)}).drop("heading")


#: Settings of the cuts: whether scores are used at all, whether facets are held to the margin, hits to the floor.
SETTINGS = {"all_cuts": (True, True, True), "no_margin": (True, False, True), "no_floor": (True, True, False), "neither": (True, False, False), "unranked": (False, True, True)}


def ablated(hits: DataFrame, family: str, least: int = 3) -> DataFrame:
    """Families that each question still delivers under five settings of the cuts, and what costs one
    that needs ``least`` of them: the floor, the margin, or the order of the scores (E40)."""
    from lithic.operators import assembly as asm

    rows = None
    for name, (scored, margin, floor) in SETTINGS.items():
        left = hits if scored else hits.withColumn("rerank", F.lit(None).cast("double"))
        left = asm.facet_margin(left).filter("in_margin") if margin else left
        left = asm.floor_and_rescue(left).filter("above or rescued") if floor else left
        named, pooled = asm.quota(left.filter("not inferred")), asm.pool(left.filter("inferred"))
        one = named.select("qid", family).unionByName(pooled.select("qid", family)).select("qid", family, F.lit(name).alias("setting"))
        rows = one if rows is None else rows.unionByName(one)
    counts = rows.groupBy("qid").agg(*(F.count_distinct(F.when(F.col("setting") == name, F.col(family))).alias(name) for name in SETTINGS))
    lost = (F.col("unranked") >= least) & (F.col("all_cuts") < least)
    return counts.withColumn("culprit", F.when(lost, F.when(F.col("no_floor") >= least, "floor").when(F.col("no_margin") >= least, "margin").otherwise("order")))


def citation_sets(arms: dict[str, DataFrame], expected: DataFrame, key: str, item: str) -> DataFrame:
    """(key, found_*, shared_*_*): whether each arm holds a question's expected citation, and how many
    citations each two arms share (E39). ``expected``: key and item, both null-free."""
    names = list(arms)
    held = None
    for name, arm in arms.items():
        one = arm.select(key, item, *(F.lit(n == name).alias(n) for n in names))
        held = one if held is None else held.unionByName(one)
    sets = held.groupBy(key, item).agg(*(F.bool_or(n).alias(n) for n in names)).join(expected.withColumn("wanted", F.lit(True)), [key, item], "left")
    found = [F.coalesce(F.bool_or(F.col("wanted") & F.col(n)), F.lit(False)).alias(f"found_{n}") for n in names]
    shared = [F.count_if(F.col(a) & F.col(b)).alias(f"shared_{a}_{b}") for i, a in enumerate(names) for b in names[i + 1 :]]
    return sets.groupBy(key).agg(*found, *shared)
