"""Evaluation queries: recall, citations, precision, agreement, separation, drift, timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.operators import evaluation as ev
from lithic.operators.features import exact_quantiles
from lithic.plans import answers, retrieval
from lithic.plans.base import query, table
from lithic.sources.shared import stored

BM, UNITS = retrieval.BM25_SQL, answers.UNITS_SQL


@query("literal_recall", f"WITH {BM}, want AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{{6,}}')) AS w FROM benchmark), blob AS (SELECT item_id, string_agg(lower(text), ' ' ORDER BY rank) AS b FROM lex JOIN documents USING (doc_id) WHERE rank < 5 GROUP BY 1) SELECT item_id, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(b, x))) / len(w) END, 6)::DOUBLE AS recall FROM want JOIN blob USING (item_id)")
def literal_recall(spark, sf):
    """Share of a question's long words found in what was retrieved for it."""
    want = table(spark, sf, "benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("w"))
    found = retrieval.bm25_top20(spark, sf).filter("rank < 5").join(table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t")), "doc_id")
    blob = found.groupBy("item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), " ").alias("b"))
    share = F.try_divide(F.size(F.filter("w", lambda x: F.contains("b", x))), F.nullif(F.size("w"), F.lit(0)))
    return want.join(blob, "item_id").select("item_id", F.round(share, 6).alias("recall"))


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Delivered documents with a relevance label: quality of the labelled ones."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("relevant"))
    return retrieval.bm25_top20(spark, sf).join(labels, "doc_id")


JUDGED = f"WITH {BM}, j AS (SELECT item_id, doc_id, score, rank, quality AS relevant FROM lex JOIN labels USING (doc_id))"


SCORED = ", q AS (SELECT item_id, avg(relevant) AS p, max(relevant) AS hit, arg_min(relevant, k) AS p1, min(CASE WHEN relevant = 1 THEN k END) AS first FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {order}) AS k FROM j) GROUP BY 1) SELECT item_id, round(p, 6) AS precision, hit::INT AS hit, p1::INT AS p_at_1, round(coalesce(1 / first, 0), 6)::DOUBLE AS rr FROM q"


def _scores(delivered: DataFrame, *order) -> DataFrame:
    q = ev.question_scores(delivered, "item_id", "relevant", order)
    return q.select("item_id", F.round("precision", 6).alias("precision"), F.col("hit").cast("int").alias("hit"), F.col("p_at_1").cast("int").alias("p_at_1"), F.round("rr", 6).alias("rr"))


@query("precision_mrr", JUDGED + SCORED.format(order="rank"))
def precision_mrr(spark, sf):
    """Precision, hit, first place and reciprocal rank of each question in the order of delivery."""
    return _scores(judged(spark, sf), F.col("rank"))


@query("precision_by_rerank", JUDGED + SCORED.format(order="c DESC, doc_id").replace("FROM j) GROUP", "FROM (SELECT j.*, coalesce(cov.score, 0) AS c FROM j LEFT JOIN cov USING (item_id, doc_id))) GROUP"))
def precision_by_rerank(spark, sf):
    """The same measures in the order of a second score."""
    other = retrieval.arms(spark, sf).select("item_id", "doc_id", "cover")
    return _scores(judged(spark, sf).join(other, ["item_id", "doc_id"], "left"), F.desc("cover"), F.col("doc_id"))


@query("headline", JUDGED + ", q AS (SELECT item_id, avg(relevant) AS p, max(relevant) AS hit, min(CASE WHEN relevant = 1 THEN k END) AS first FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS k FROM j) GROUP BY 1) SELECT round(avg(hit), 6) AS hit_rate, round(avg(p), 6) AS precision, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM q")
def headline(spark, sf):
    """Means of the per-question measures."""
    q = ev.question_scores(judged(spark, sf), "item_id", "relevant", [F.col("rank")])
    return q.agg(F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("rr"), 6).alias("mrr"))


@query("label_coverage", f"WITH {BM}, c AS (SELECT item_id, count(*) AS n, count(quality) AS labelled FROM lex LEFT JOIN labels USING (doc_id) GROUP BY 1) SELECT CASE WHEN labelled = n THEN 'full' WHEN labelled = 0 THEN 'none' ELSE 'partial' END AS coverage, count(*) AS n FROM c GROUP BY 1")
def label_coverage(spark, sf):
    """Questions whose hits are all, partly or not labelled."""
    c = retrieval.bm25_top20(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").groupBy("item_id").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"))
    return c.groupBy(F.when(F.col("labelled") == F.col("n"), "full").when(F.col("labelled") == 0, "none").otherwise("partial").alias("coverage")).agg(F.count("*").alias("n"))


FEATURES_SQL = "s AS (SELECT quality = 1 AS rel, unnest([{'feature': 'n_chars', 'value': length(text)::DOUBLE}, {'feature': 'n_words', 'value': len(string_split(text, ' '))::DOUBLE}, {'feature': 'graded', 'value': CASE WHEN quality = 1 THEN doc_id % 50 ELSE 60 + doc_id % 40 END::DOUBLE}, {'feature': 'early', 'value': CASE WHEN quality = 0 THEN doc_id % 10 WHEN doc_id % 12 = 0 THEN 5 ELSE 40 + doc_id % 9 END::DOUBLE}], recursive := true) FROM labels JOIN documents USING (doc_id))"


@query("separation_test", f"WITH {FEATURES_SQL}, p AS (SELECT feature, rel, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM s GROUP BY ALL), c AS (SELECT a.feature, a.lo AS rel_lo, a.hi AS rel_hi, b.lo AS other_lo, b.hi AS other_hi, CASE WHEN a.hi < b.lo THEN (a.hi + b.lo) / 2 WHEN b.hi < a.lo THEN (b.hi + a.lo) / 2 END AS cut FROM p a JOIN p b USING (feature) WHERE a.rel AND NOT b.rel), l AS (SELECT feature, avg(CASE WHEN cut IS NOT NULL THEN (CASE WHEN rel_hi < other_lo THEN value > cut ELSE value < cut END)::INT END) AS lost FROM s JOIN c USING (feature) WHERE rel GROUP BY 1) SELECT feature, round(rel_lo, 4) AS rel_lo, round(rel_hi, 4) AS rel_hi, round(other_lo, 4) AS other_lo, round(other_hi, 4) AS other_hi, round(cut, 4) AS cut, round(lost, 6) AS lost, CASE WHEN cut IS NULL THEN 'overlaps' WHEN lost <= 0.05 THEN 'candidate' ELSE 'loses too much' END AS verdict FROM c JOIN l USING (feature)")
def separation_test(spark, sf):
    """Which features part relevant from other rows, where the cut lies and what it loses."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    k = F.col("doc_id")
    graded = F.when(F.col("quality") == 1, k % 50).otherwise(60 + k % 40)
    early = F.when(F.col("quality") == 0, k % 10).when(k % 12 == 0, 5).otherwise(40 + k % 9)
    s = rows.select((F.col("quality") == 1).alias("rel"), F.length("text").alias("n_chars"), F.size(F.split("text", " ")).alias("n_words"), graded.alias("graded"), early.alias("early"))
    out = ev.separation(s, "rel", ["n_chars", "n_words", "graded", "early"])
    return out.select("feature", *(F.round(c, 4).alias(c) for c in ("rel_lo", "rel_hi", "other_lo", "other_hi", "cut")), F.round("lost", 6).alias("lost"), "verdict")


RATED_SQL = "r AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'unsure' WHEN quality = 1 THEN 'relevant' ELSE 'irrelevant' END AS a, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN toxic = 0 THEN 'relevant' ELSE 'irrelevant' END AS b FROM labels)"


def rated(spark: SparkSession, sf: str) -> DataFrame:
    """Two raters of the labelled documents, who sometimes do not settle."""
    k = F.col("doc_id")
    a = F.when(k % 9 == 0, "unsure").when(F.col("quality") == 1, "relevant").otherwise("irrelevant")
    b = F.when(k % 7 == 0, None).when(F.col("toxic") == 0, "relevant").otherwise("irrelevant")
    return table(spark, sf, "labels").select("doc_id", a.alias("a"), b.alias("b"))


@query("agreement", f"WITH {RATED_SQL} SELECT count(*) AS n, count(*) FILTER (a = b) AS same, round(avg((a = b)::INT), 6)::DOUBLE AS rate, avg((a = b)::INT) >= 0.85 AS passes FROM r WHERE a <> 'unsure' AND b IS NOT NULL")
def agreement(spark, sf):
    """Rows that both raters settled and agree on, against a bar of 0.85."""
    return ev.agreement(rated(spark, sf), "a", "b", ["relevant", "irrelevant"]).withColumn("rate", F.round("rate", 6))


@query("confusion_counts", "SELECT quality::INT AS truth, (length(text) > 1500)::INT AS got, count(*) AS n, round(median(length(text) / 1000.0::DOUBLE), 6) AS median_seconds FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def confusion_counts(spark, sf):
    """Truth by decision, with the median latency of each cell."""
    s = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(F.col("quality").cast("int").alias("truth"), (F.length("text") > 1500).cast("int").alias("got"), (F.length("text") / 1000.0).alias("s"))
    return ev.intent_confusion(s, "truth", "got", "s").withColumn("median_seconds", F.round("median_seconds", 6))


GRADED_SQL = """c AS (SELECT doc_id AS qid, lang AS mode, (generate_subscripts(l, 1) - 1)::INT AS claim_no FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents)),
cl AS (SELECT *, CASE (qid + claim_no) % 6 WHEN 0 THEN '' WHEN 1 THEN 'S9' WHEN 2 THEN 'X1' ELSE 'S' || (1 + claim_no % 3) END AS label, CASE claim_no % 4 WHEN 0 THEN '' WHEN 1 THEN '1.1' WHEN 2 THEN '2.1' ELSE '9.9' END AS locator FROM c),
g AS (SELECT *, label <> '' AS cited, label IN ('S1', 'S2', 'S3') AS valid, CASE WHEN label = 'S1' THEN locator IN ('1.1', '1.2') WHEN label = 'S3' THEN locator = '2.1' END AS in_window FROM cl)"""


def graded(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as claims, each with a label and a locator, some of which are not there."""
    docs = table(spark, sf, "documents")
    lines = docs.select(F.col("doc_id").alias("qid"), F.col("lang").alias("mode"), F.posexplode(F.split("text", "\n")).alias("claim_no", "text"))
    at, no = (F.col("qid") + F.col("claim_no")) % 6, F.col("claim_no")
    label = F.when(at == 0, "").when(at == 1, "S9").when(at == 2, "X1").otherwise(F.concat(F.lit("S"), (1 + no % 3).cast("string")))
    place = F.when(no % 4 == 0, "").when(no % 4 == 1, "1.1").when(no % 4 == 2, "2.1").otherwise("9.9")
    units = F.array(F.array(F.lit("1.1"), F.lit("1.2")), F.array(F.lit(""), F.lit("")), F.array(F.lit("2.1")))
    runs = docs.select(F.col("doc_id").alias("qid"), F.array(*map(F.lit, ("S1", "S2", "S3"))).alias("labels"), units.alias("unit_locators"))
    return ev.graded_claims(lines.select("qid", "mode", "claim_no", label.alias("label"), place.alias("locator")), runs)


@query("citation_layers", f"WITH {GRADED_SQL} SELECT mode, count(*) AS n, count(*) FILTER (cited) AS cited, count(*) FILTER (valid) AS valid, count(in_window) AS checkable, count(*) FILTER (in_window) AS in_window, count(*) FILTER (valid AND in_window IS NULL) AS unmeasurable FROM g GROUP BY 1")
def citation_layers(spark, sf):
    """Claims that are cited, valid and in the window by plan mode; what cannot be checked is apart."""
    return ev.citation_rates(graded(spark, sf), "mode")


@query("graded_claims", f"WITH {GRADED_SQL} SELECT qid, claim_no, cited, valid, in_window FROM g")
def graded_claims(spark, sf):
    """The three layers of every claim."""
    return graded(spark, sf).select("qid", "claim_no", "cited", "valid", "in_window")


@query("verdict_pivot", f"WITH {RATED_SQL} SELECT lang AS mode, count(*) AS n, count(*) FILTER (a = 'relevant') AS relevant, count(*) FILTER (a = 'irrelevant') AS irrelevant, count(*) FILTER (a = 'unsure') AS unsure, count(*) FILTER (a <> 'relevant') AS wrong FROM r JOIN documents USING (doc_id) GROUP BY 1")
def verdict_pivot(spark, sf):
    """Hand grades by mode, a column a verdict."""
    rows = rated(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("mode")), "doc_id")
    return ev.tally(rows, "mode", "a", ["relevant", "irrelevant", "unsure"])


DRIFT_SQL = "a AS (SELECT doc_id, source, text FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0), p AS (SELECT source FROM documents WHERE doc_id % 3 = 0 AND source NOT LIKE '%1')"


@query("index_drift", f"WITH {DRIFT_SQL} SELECT count(a.doc_id) AS n_made, count(b.doc_id) AS n_indexed, count(*) FILTER (b.doc_id IS NULL) AS missing, count(*) FILTER (a.doc_id IS NULL) AS extra, count(*) FILTER (a.text = b.text) AS same, (SELECT count(*) FROM b WHERE source NOT IN (SELECT source FROM p)) AS dangling, (SELECT count(*) FROM (SELECT source FROM p GROUP BY 1 HAVING count(*) > 1)) AS parents_twice FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def index_drift(spark, sf):
    """What the code makes against what the index holds, down to parents that are not there."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("parent_id"), "text")
    held = docs.filter("chunk_id % 11 <> 0").withColumn("text", F.when(F.col("chunk_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return ev.index_drift(docs.filter("chunk_id % 10 <> 0"), held, docs.filter("chunk_id % 3 = 0 and parent_id not like '%1'"))


@query("cut_loss_summary", f"WITH {BM}, d AS (SELECT qid, chunk_id, 'relevance_floor' AS cut FROM kept WHERE NOT above AND NOT rescued UNION ALL SELECT qid, chunk_id, 'facet_margin' FROM margin WHERE NOT in_margin) SELECT cut, count(*) AS n, count(*) FILTER (quality = 1) AS relevant FROM d LEFT JOIN labels ON doc_id = chunk_id GROUP BY 1")
def cut_loss_summary(spark, sf):
    """What each cut took and how much of it was relevant."""
    margin, left = retrieval.asm.facet_margin(retrieval.hits(spark, sf)), retrieval.kept(spark, sf)
    rows = left.filter("not above and not rescued").select("chunk_id", F.lit("relevance_floor").alias("cut")).union(margin.filter("not in_margin").select("chunk_id", F.lit("facet_margin")))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    return rows.join(labels, "chunk_id", "left").groupBy("cut").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("relevant"))


@query("gap_to_best", f"WITH {BM} SELECT item_id, doc_id, round(max(score) OVER (PARTITION BY item_id) - score, 6) AS gap FROM lex")
def gap_to_best(spark, sf):
    """Distance of each hit from its question's best."""
    return retrieval.bm25_top20(spark, sf).select("item_id", "doc_id", F.round(F.max("score").over(Window.partitionBy("item_id")) - F.col("score"), 6).alias("gap"))


@query("facet_probe", f"WITH {BM}, f AS (SELECT item_id AS qid, lang AS facet, count(*) AS n, max(score) AS best, avg(CASE WHEN k <= 5 THEN score END) AS top5 FROM (SELECT *, row_number() OVER (PARTITION BY item_id, lang ORDER BY score DESC, doc_id) AS k FROM lex JOIN documents USING (doc_id)) GROUP BY 1, 2) SELECT qid, facet, n, best, round(top5, 6) AS top5, best = max(best) OVER (PARTITION BY qid) AS wins FROM f")
def facet_probe(spark, sf):
    """Best and mean of the best five scores of each facet, and which facet wins."""
    rows = retrieval.bm25_top20(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    k = F.row_number().over(Window.partitionBy("item_id", "lang").orderBy(F.desc("score"), "doc_id"))
    f = rows.withColumn("k", k).groupBy(F.col("item_id").alias("qid"), F.col("lang").alias("facet")).agg(F.count("*").alias("n"), F.max("score").alias("best"), F.avg(F.when(F.col("k") <= 5, F.col("score"))).alias("top5"))
    return f.select("qid", "facet", "n", "best", F.round("top5", 6).alias("top5"), (F.col("best") == F.max("best").over(Window.partitionBy("qid"))).alias("wins"))


@query("rerank_changes", f"WITH {BM}, a AS (SELECT item_id, doc_id, rank AS p FROM lex WHERE rank < 5), b AS (SELECT item_id, doc_id, rank AS p FROM cover WHERE rank < 5) SELECT item_id, count(*) FILTER (a.p IS NOT NULL AND b.p IS NOT NULL AND a.p <> b.p) AS moved, count(*) FILTER (b.p IS NULL) AS dropped, count(*) FILTER (a.p IS NULL) AS new FROM a FULL JOIN b USING (item_id, doc_id) GROUP BY 1")
def rerank_changes(spark, sf):
    """Places moved, dropped and new between two orders."""
    a = retrieval.bm25_top20(spark, sf).filter("rank < 5").select("item_id", "doc_id", F.col("rank").alias("a"))
    b = retrieval.coverage_top20(spark, sf).filter("rank < 5").select("item_id", "doc_id", F.col("rank").alias("b"))
    return a.join(b, ["item_id", "doc_id"], "full").groupBy("item_id").agg(F.count_if(F.col("a") != F.col("b")).alias("moved"), F.count_if(F.col("b").isNull()).alias("dropped"), F.count_if(F.col("a").isNull()).alias("new"))


@query("rate_medians", "WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1) SELECT event_type, round(m, 6) AS median_rate, (SELECT count(*) FROM events r WHERE r.event_type = m.event_type AND value > 3 * m.m) AS n_cached FROM m")
def rate_medians(spark, sf):
    """Median rates and readings over three times the median, as cached runs look."""
    e = table(spark, sf, "events")
    m = exact_quantiles(e, "value", {"m": 0.5}, ["event_type"])
    return e.join(F.broadcast(m), "event_type").groupBy("event_type", "m").agg(F.count_if(F.col("value") > 3 * F.col("m")).alias("n_cached")).select("event_type", F.round("m", 6).alias("median_rate"), "n_cached")


REPLY_SQL = "t AS (SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN '' WHEN 1 THEN 'NOT_IN_SOURCES: ' || text WHEN 2 THEN 'The excerpts do not cover this. ' || text WHEN 3 THEN 'There is insufficient detail [S2]. ' || text WHEN 4 THEN text || ' [S1]' ELSE text END AS t FROM conversations)"


@query("refusal_classes", f"WITH {REPLY_SQL}, c AS (SELECT trim(t) AS t, regexp_matches(left(trim(t), 400), '{ev.DECLINES.replace(chr(39), chr(39) * 2)}', 'i') AS hit, regexp_matches(t, '{ev.CITED}') AS cited, contains(lower(left(trim(t), 200)), 'not_in_sources') AS marked FROM t) SELECT (t = '' OR marked OR hit) AS refused, (t = '' OR (NOT marked AND hit AND cited)) AS ambiguous, count(*) AS n FROM c GROUP BY 1, 2")
def refusal_classes(spark, sf):
    """Replies that refuse, and those that a human must judge."""
    k, text = (F.col("conv_id") + F.col("turn")) % 6, F.col("text")
    reply = F.when(k == 0, "").when(k == 1, F.concat(F.lit("NOT_IN_SOURCES: "), text)).when(k == 2, F.concat(F.lit("The excerpts do not cover this. "), text)).when(k == 3, F.concat(F.lit("There is insufficient detail [S2]. "), text)).when(k == 4, F.concat(text, F.lit(" [S1]"))).otherwise(text)
    refused, ambiguous = ev.reply_class(F.col("reply"))
    return table(spark, sf, "conversations").select(reply.alias("reply")).groupBy(refused.alias("refused"), ambiguous.alias("ambiguous")).agg(F.count("*").alias("n"))


@query("reproducibility", "SELECT source, count(*) AS n, count(DISTINCT text) AS n_texts, count(DISTINCT text) <= 1 AS same FROM documents GROUP BY 1")
def reproducibility(spark, sf):
    """Whether repeated runs gave one text."""
    return ev.stable_runs(table(spark, sf, "documents"), "source", "text")


@query("table_lines", "SELECT page_id, len(list_filter(string_split(html, chr(10)), lambda l: length(l) - length(replace(l, '|', '')) >= 2)) AS n_table_lines FROM pages")
def table_lines(spark, sf):
    """Lines with two bars or more, as tables in plain text have."""
    return table(spark, sf, "pages").select("page_id", F.size(F.filter(F.split("html", "\n"), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)).cast("long").alias("n_table_lines"))


@query("claim_margin", f"WITH {UNITS} SELECT qid, claim_no, round(max(score * 10) OVER (PARTITION BY qid) - score * 10, 6) AS gap, max(score * 10) OVER (PARTITION BY qid) - score * 10 > 6 AS far FROM best WHERE k = 1")
def claim_margin(spark, sf):
    """Distance of a claim from the best claim of its answer, far beyond 6."""
    best = answers.cl.align(answers.claims(spark, sf), answers.units(spark, sf)).withColumn("score", F.col("best") * 10)
    return ev.claim_gaps(best, "qid", "score").select("qid", "claim_no", F.round("gap", 6).alias("gap"), "far")


@query("claim_gap_quartiles", f"WITH {UNITS}, g AS (SELECT round(max(score * 10) OVER (PARTITION BY qid) - score * 10, 4) AS gap FROM best WHERE k = 1), s AS (SELECT list_sort(list(gap)) AS l FROM g WHERE gap > 0) SELECT len(l) AS n, l[1] AS least, l[len(l) // 4 + 1] AS p25, l[len(l) // 2 + 1] AS p50, l[3 * len(l) // 4 + 1] AS p75, l[len(l)] AS most FROM s")
def claim_gap_quartiles(spark, sf):
    """Nearest-rank quartiles of the gaps above 0."""
    best = answers.cl.align(answers.claims(spark, sf), answers.units(spark, sf)).withColumn("score", F.col("best") * 10)
    gaps = stored(ev.claim_gaps(best, "qid", "score").select(F.round("gap", 4).alias("gap")))  # read three times
    return ev.rank_quartiles(gaps, "gap")


@query("vocabulary_check", "SELECT count(*) AS n, count(*) FILTER (event_type IN ('click', 'view', 'purchase')) AS in_vocabulary, count(*) FILTER (json_valid(props)) AS parsed FROM events")
def vocabulary_check(spark, sf):
    """Extractions whose values lie in the vocabulary and whose JSON parses."""
    e = table(spark, sf, "events")
    return e.agg(F.count("*").alias("n"), F.count_if(F.col("event_type").isin("click", "view", "purchase")).alias("in_vocabulary"), F.count_if(F.expr("try_parse_json(props) is not null")).alias("parsed"))


@query("document_hits", f"WITH {BM}, want AS (SELECT item_id, item_id % 20 AS s FROM benchmark), got AS (SELECT item_id, max((source = 'src' || (item_id % 20)::VARCHAR)::INT) AS hit FROM lex JOIN documents USING (doc_id) WHERE rank < 5 GROUP BY 1) SELECT s AS scenario, count(*) AS n, round(avg(hit), 6) AS hit_rate FROM want JOIN got USING (item_id) GROUP BY 1")
def document_hits(spark, sf):
    """Whether an expected source is among the first five, by scenario."""
    expected = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    got = retrieval.bm25_top20(spark, sf).filter("rank < 5").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    hits = got.groupBy("item_id").agg(F.max((F.col("source") == expected).cast("int")).alias("hit"))
    return hits.groupBy((F.col("item_id") % 20).alias("scenario")).agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit_rate"))


@query("missed_citations", f"WITH {GRADED_SQL} SELECT qid, claim_no, CASE WHEN NOT cited THEN 'no label' WHEN NOT valid THEN 'label not in table' ELSE 'locator outside the window' END AS reason FROM g WHERE NOT cited OR NOT valid OR NOT in_window")
def missed_citations(spark, sf):
    """Claims that fail a layer, with the first reason."""
    return ev.misses(graded(spark, sf)).select("qid", "claim_no", "reason")


@query("carried_labels", "SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN quality WHEN doc_id % 3 <> 0 THEN toxic END)::INT AS label FROM labels")
def carried_labels(spark, sf):
    """Labels of an earlier run where the new one has none."""
    labels = table(spark, sf, "labels")
    new = labels.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("quality")).cast("int").alias("label"))
    old = labels.filter("doc_id % 3 <> 0").select("doc_id", F.col("toxic").cast("int").alias("label"))
    return ev.carried_labels(new, old, ["doc_id"], ["label"])


@query("label_budget", f"WITH {BM} SELECT qid, facet, chunk_id, row_number() OVER (PARTITION BY qid, facet ORDER BY pos) <= 3 AS to_label FROM kept WHERE NOT above AND NOT rescued")
def label_budget(spark, sf):
    """The first few of what a cut took from each facet are to be labelled."""
    cut = retrieval.kept(spark, sf).filter("not above and not rescued")
    k = F.row_number().over(Window.partitionBy("qid", "facet").orderBy("pos"))
    return cut.select("qid", "facet", "chunk_id", (k <= 3).alias("to_label"))


@query("size_caps", "SELECT lang, count(*) AS n, count(*) FILTER (length(text) > 5000) AS over_5000, count(*) FILTER (length(text) > 25000) AS over_25000, median(length(text))::DOUBLE AS middle FROM documents GROUP BY 1")
def size_caps(spark, sf):
    """Sizes against the caps, with the true median."""
    rows = table(spark, sf, "documents").select("lang", F.length("text").alias("n_"))
    sums = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_") > 5000).alias("over_5000"), F.count_if(F.col("n_") > 25000).alias("over_25000"))
    return sums.join(exact_quantiles(rows, "n_", {"middle": 0.5}, ["lang"]), "lang")


@query("locator_audit", "SELECT CASE WHEN regexp_matches(text, '^\\d{1,3}\\.\\d{1,3}\\s') THEN 'A1' WHEN regexp_matches(text, '^\\d{1,3}\\.\\s') THEN 'A2' WHEN length(text) < 200 THEN 'B' ELSE 'C' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def locator_audit(spark, sf):
    """How precisely a text can be cited."""
    t = F.col("text")
    bucket = F.when(t.rlike(r"^\d{1,3}\.\d{1,3}\s"), "A1").when(t.rlike(r"^\d{1,3}\.\s"), "A2").when(F.length(t) < 200, "B").otherwise("C")
    return table(spark, sf, "documents").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


LINE_CHUNKS_SQL = f"""lines AS (SELECT doc_id AS parent_id, source, (generate_subscripts(l, 1) - 1)::INT AS k, unnest(l) AS line, l[1] AS opening FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
chunks AS (SELECT parent_id, source, CASE k % 3 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'section' ELSE 'other' END AS kind, CASE k % 5 WHEN 0 THEN '36.' || k || ' ' || line WHEN 1 THEN '(a) ' || line ELSE line END AS text,
  CASE parent_id % 4 WHEN 0 THEN 'Notes.' WHEN 1 THEN NULL ELSE left(opening, 100) END AS heading FROM lines),
buckets AS (SELECT *, regexp_matches(text, '{ev.DOTTED}') AS dotted, CASE WHEN kind = 'section' THEN CASE WHEN regexp_matches(text, '{ev.DOTTED}') THEN 'A1' WHEN regexp_matches(text, '{ev.BRACKET}') THEN 'A2'
  WHEN heading IS NULL OR length(heading) > 90 OR trim(regexp_replace(lower(heading), '[^a-z0-9 ]+', ' ', 'g')) IN ('footnotes', 'footnote', 'notes', 'table', 'tables', '') THEN 'B' ELSE 'C' END END AS bucket FROM chunks)"""


@query("locator_buckets", f"WITH {LINE_CHUNKS_SQL} SELECT source, count(*) AS n, count(*) FILTER (kind = 'paragraph') AS precise, count(*) FILTER (dotted) AS dotted, count(*) FILTER (bucket = 'A1') AS a1, count(*) FILTER (bucket = 'A2') AS a2, count(*) FILTER (bucket = 'B') AS b, count(*) FILTER (bucket = 'C') AS c FROM buckets GROUP BY 1")
def locator_buckets(spark, sf):
    """How precisely each source's lines can be cited, and why the coarse ones lack a number."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("parent_id"), "source", F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    k, p = F.col("k"), F.col("parent_id")
    lines = docs.select("parent_id", "source", F.posexplode("l").alias("k", "line"))
    text = F.when(k % 5 == 0, F.concat(F.lit("36."), k.cast("string"), F.lit(" "), "line")).when(k % 5 == 1, F.concat(F.lit("(a) "), "line")).otherwise(F.col("line"))
    chunks = lines.select("parent_id", "source", F.when(k % 3 == 0, "paragraph").when(k % 3 == 1, "section").otherwise("other").alias("kind"), text.alias("text"))
    parents = docs.select("parent_id", F.when(p % 4 == 0, "Notes.").when(p % 4 != 1, F.substring(F.col("l")[0], 1, 100)).alias("heading"))
    met = ev.locator_buckets(chunks, parents, "kind", "text")
    of = lambda name: F.count_if(F.col("bucket") == name).alias(name.lower())
    return met.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "paragraph").alias("precise"), F.count_if("dotted").alias("dotted"), of("A1"), of("A2"), of("B"), of("C"))


@query("fell_out", f"WITH {BM}, want AS (SELECT item_id, min(doc_id) AS doc_id FROM bm WHERE score > 0 GROUP BY 1) SELECT item_id, CASE WHEN w.doc_id IN (SELECT chunk_id FROM turns t WHERE t.qid = w.item_id) THEN 'delivered' WHEN w.doc_id IN (SELECT chunk_id FROM kept k WHERE k.qid = w.item_id AND (above OR rescued)) THEN 'quota' WHEN w.doc_id IN (SELECT chunk_id FROM hits h WHERE h.qid = w.item_id) THEN 'cut' ELSE 'not found' END AS stage FROM want w")
def fell_out(spark, sf):
    """The stage at which a wanted document was lost."""
    want = retrieval.first_found(spark, sf)
    key = lambda df, name: df.select(F.col("qid").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.lit(True).alias(name)).distinct()
    hits = stored(retrieval.hits(spark, sf))
    left = retrieval.kept_of(hits)
    found = want.join(key(retrieval.served_of(left), "a"), ["item_id", "doc_id"], "left").join(key(left.filter("above or rescued"), "b"), ["item_id", "doc_id"], "left").join(key(hits, "c"), ["item_id", "doc_id"], "left")
    return found.select("item_id", F.when(F.col("a"), "delivered").when(F.col("b"), "quota").when(F.col("c"), "cut").otherwise("not found").alias("stage"))


@query("completeness_probe", "SELECT page_id, len(list_filter(['<p>', '<div', '<title>'], lambda x: NOT contains(html, x))) AS n_missing FROM pages")
def completeness_probe(spark, sf):
    """Expected values that an extraction does not hold."""
    expected = F.array(*(F.lit(x) for x in ("<p>", "<div", "<title>")))
    return table(spark, sf, "pages").select("page_id", F.size(F.filter(expected, lambda x: ~F.contains("html", x))).cast("long").alias("n_missing"))


@query("in_scope", "SELECT role, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY 1")
def in_scope(spark, sf):
    """Rows of a run without those out of scope."""
    return table(spark, sf, "conversations").filter("role <> 'system'").groupBy("role").agg(F.count("*").alias("n"))


@query("filter_ablation", f"WITH {BM}, j AS (SELECT h.*, d.source FROM hits h JOIN documents d ON doc_id = chunk_id) SELECT 'all' AS setting, count(DISTINCT source) AS families FROM j UNION ALL SELECT 'named', count(DISTINCT source) FROM j WHERE NOT inferred UNION ALL SELECT 'above', count(DISTINCT source) FROM j WHERE rerank >= 0 UNION ALL SELECT 'first', count(DISTINCT source) FROM j WHERE pos = 0")
def filter_ablation(spark, sf):
    """Families that are reached under each setting, in one pass."""
    h = retrieval.hits(spark, sf)
    family = F.col("parent_id")
    wide = h.agg(F.count_distinct(family).alias("all"), F.count_distinct(F.when(~F.col("inferred"), family)).alias("named"), F.count_distinct(F.when(F.col("rerank") >= 0, family)).alias("above"), F.count_distinct(F.when(F.col("pos") == 0, family)).alias("first"))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("setting"), F.col(c).alias("families")) for c in ("all", "named", "above", "first")))).alias("x")).select("x.*")


def _setting_sql(name: str, scored: bool, margin: bool, floor: bool) -> str:
    """Families a question under one setting: the chain of BM25_SQL with some of its cuts left out."""
    above = "(rerank IS NULL OR rerank >= 0)" if floor else "true"
    value = "rerank" if scored else "NULL::DOUBLE AS rerank"
    return f"""{name}_h AS (SELECT * EXCLUDE (rerank), {value} FROM hits),
{name}_m AS (SELECT *, {'true' if not margin else 'NOT inferred OR n_facets = 1 OR best IS NULL OR coalesce(facet_best >= best - 6, false)'} AS in_margin
  FROM (SELECT *, max(rerank) OVER (PARTITION BY qid, facet) AS facet_best, max(rerank) OVER (PARTITION BY qid) AS best, len(list_distinct(list(facet) OVER (PARTITION BY qid))) AS n_facets FROM {name}_h)),
{name}_k AS (SELECT *, NOT inferred AND lefts = 0 AND ord <= 2 AS rescued FROM (SELECT *, count(*) FILTER (above) OVER (PARTITION BY qid, facet) AS lefts, row_number() OVER (PARTITION BY qid, facet ORDER BY coalesce(rerank, rrf) DESC, pos) AS ord
  FROM (SELECT *, {above} AS above FROM {name}_m WHERE in_margin))),
{name}_p AS (SELECT qid, parent_id FROM {name}_k WHERE (above OR rescued) AND NOT inferred QUALIFY row_number() OVER (PARTITION BY qid, facet ORDER BY pos) <= 5
  UNION ALL SELECT qid, parent_id FROM {name}_k WHERE (above OR rescued) AND inferred QUALIFY row_number() OVER (PARTITION BY qid ORDER BY coalesce(rerank, 0) DESC, facet_ord, pos) <= 5),
{name}_n AS (SELECT qid, count(DISTINCT parent_id) AS {name} FROM {name}_p GROUP BY 1)"""


_SETTING_CTES = ", ".join(_setting_sql(name, *flags) for name, flags in ev.SETTINGS.items())
_COUNTS = ", ".join(f"coalesce({name}, 0) AS {name}" for name in ev.SETTINGS)


@query("cut_ablation", f"WITH {BM}, {_SETTING_CTES}, c AS (SELECT qid, {_COUNTS} FROM (SELECT DISTINCT qid FROM hits) " + " ".join(f"LEFT JOIN {name}_n USING (qid)" for name in ev.SETTINGS) + ") SELECT *, CASE WHEN unranked >= 3 AND all_cuts < 3 THEN CASE WHEN no_floor >= 3 THEN 'floor' WHEN no_margin >= 3 THEN 'margin' ELSE 'order' END END AS culprit FROM c WHERE greatest(all_cuts, no_margin, no_floor, neither, unranked) > 0")
def cut_ablation(spark, sf):
    """Families of documents that each question delivers with cuts left out, and the cut that costs them."""
    from lithic.sources.shared import stored

    return ev.ablated(stored(retrieval.hits(spark, sf)), "parent_id")


@query("citation_sets", f"""WITH {BM}, want AS (SELECT item_id, min(doc_id) AS doc_id FROM lex WHERE rank = item_id % 9 GROUP BY 1),
s AS (SELECT item_id, doc_id, bool_or(a = 'fused') AS fused, bool_or(a = 'lexical') AS lexical, bool_or(a = 'cover') AS cover FROM (SELECT item_id, doc_id, 'fused' AS a FROM fused WHERE rank < 6 UNION ALL SELECT item_id, doc_id, 'lexical' FROM lex WHERE rank < 6 UNION ALL SELECT item_id, doc_id, 'cover' FROM cover WHERE rank < 6) GROUP BY 1, 2)
SELECT s.item_id, bool_or(w.doc_id IS NOT NULL AND fused) AS found_fused, bool_or(w.doc_id IS NOT NULL AND lexical) AS found_lexical, bool_or(w.doc_id IS NOT NULL AND cover) AS found_cover,
  count(*) FILTER (fused AND lexical) AS shared_fused_lexical, count(*) FILTER (fused AND cover) AS shared_fused_cover, count(*) FILTER (lexical AND cover) AS shared_lexical_cover
FROM s LEFT JOIN want w ON w.item_id = s.item_id AND w.doc_id = s.doc_id GROUP BY 1""")
def citation_sets(spark, sf):
    """The six first citations of three arms: what they share, and whether they hold an expected one."""
    from lithic.operators import search as se
    from lithic.sources.shared import stored

    both = stored(retrieval.arms(spark, sf).withColumn("bm25", F.col("score")))
    lexical, cover = se.lexical_top(both, "item_id", "doc_id"), se.lexical_top(both.withColumn("score", F.col("cover")), "item_id", "doc_id")
    fused = se.fuse({"cover": cover, "lexical": lexical}, ["item_id"], "doc_id", carry=["bm25"])
    want = lexical.filter(F.col("rank") == F.col("item_id") % 9).select("item_id", "doc_id")
    return ev.citation_sets({"fused": fused.filter("rank < 6"), "lexical": lexical.filter("rank < 6"), "cover": cover.filter("rank < 6")}, want, "item_id", "doc_id")


@query("judge_metrics", "WITH r AS (SELECT unnest([{'metric': 'recall', 'value': CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 'nan'::DOUBLE ELSE value END}, {'metric': 'faith', 'value': CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 2 END}], recursive := true) FROM events) SELECT metric, count(*) FILTER (value IS NOT NULL AND NOT isnan(value)) AS n, round(avg(value) FILTER (NOT isnan(value)), 6) AS mean, round(median(value) FILTER (NOT isnan(value)), 6) AS median, count(*) FILTER (isnan(value)) AS n_nan, count(*) FILTER (value IS NULL) AS n_absent FROM r GROUP BY 1")
def judge_metrics(spark, sf):
    """Mean and median of what a judge measured; NaN and absent values are counted apart."""
    k, v = F.col("event_id"), F.col("value")
    rows = table(spark, sf, "events").select(F.when(k % 10 == 0, None).when(k % 10 == 1, F.lit(float("nan"))).otherwise(v).alias("recall"), F.when(k % 4 != 0, v / 2).alias("faith"))
    return ev.judged_metrics(rows, ["recall", "faith"]).select("metric", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "n_nan", "n_absent")


@query("judge_separates", "SELECT count(*) FILTER (isnan(v)) AS n_nan, round(avg(v) FILTER (quality = 1), 6) AS good, round(avg(v) FILTER (quality = 0), 6) AS bad, avg(v) FILTER (quality = 1) - avg(v) FILTER (quality = 0) >= 0.3 AS passes FROM (SELECT quality, (doc_id % 50) / 100.0::DOUBLE + CASE WHEN quality = 1 THEN 0.4 ELSE 0 END::DOUBLE AS v FROM labels)")
def judge_separates(spark, sf):
    """Whether a judge tells good rows from bad ones."""
    rows = table(spark, sf, "labels").withColumn("v", (F.col("doc_id") % 50) / 100.0 + F.when(F.col("quality") == 1, 0.4).otherwise(0.0))
    return ev.judge_separates(rows, F.col("quality") == 1, F.col("quality") == 0, "v").select("n_nan", F.round("good", 6).alias("good"), F.round("bad", 6).alias("bad"), "passes")


@query("claim_totals", f"WITH {answers.OVERLAP_SQL} SELECT qid, count(*) AS n, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid, count(*) FILTER (valid AND o < 0.45) AS weak FROM screen GROUP BY 1")
def claim_totals(spark, sf):
    """Valid, invalid and weak claims of each answer."""
    return ev.claim_totals(answers.screened(spark, sf), "qid")


@query("score_overlap", f"WITH {BM}, o AS (SELECT max(score) FILTER (quality = 0) AS a, min(score) FILTER (quality = 1) AS b FROM lex JOIN labels USING (doc_id)) SELECT a AS other_max, b AS positive_min, a < b AS viable, CASE WHEN a < b THEN (a + b) / 2 END AS boundary, round(greatest(0.0::DOUBLE, a - b), 6) AS overlap FROM o")
def score_overlap(spark, sf):
    """Whether any boundary on a score parts relevant hits from the others."""
    rows = judged(spark, sf)
    return ev.score_overlap(rows, F.col("relevant") == 1, "score").withColumn("overlap", F.round("overlap", 6))


@query("facet_margins", f"WITH {BM}, f AS (SELECT item_id, lang, max(score) AS s FROM lex JOIN documents USING (doc_id) GROUP BY 1, 2), k AS (SELECT item_id, s, lead(s) OVER w AS n, row_number() OVER w AS k FROM f WINDOW w AS (PARTITION BY item_id ORDER BY s DESC)) SELECT item_id, round(s - n, 6) AS margin FROM k WHERE k = 1 AND n IS NOT NULL")
def facet_margins(spark, sf):
    """How far the best facet of a question lies before the second."""
    best = retrieval.bm25_top20(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy("item_id", "lang").agg(F.max("score").alias("s"))
    return ev.facet_margins(best, "item_id", "s").select("item_id", F.round("margin", 6).alias("margin"))


@query("auto_cite", f"WITH {answers.CLAIMS_SQL}, w AS (SELECT qid, claim_no, item, {answers.LONG_SQL.format(t='text').replace('{{', '{').replace('}}', '}')} AS w FROM claims), two AS (SELECT item, 0 AS place, lower(passage) AS p FROM items UNION ALL SELECT (item + 1) % (SELECT count(*) FROM items), 1, lower(passage) FROM items), m AS (SELECT qid, claim_no, place, CASE WHEN len(w) >= 3 THEN len(list_filter(w, lambda x: contains(p, x))) / len(w) ELSE 0 END AS s FROM w JOIN two USING (item)), b AS (SELECT qid, claim_no, max(s) AS s, arg_max(place, s - place / 1000000) AS place FROM m GROUP BY 1, 2) SELECT qid, claim_no AS no, CASE WHEN s >= 0.45 THEN place END::INT AS cited, round(s, 6)::DOUBLE AS share FROM b")
def auto_cite(spark, sf):
    """Lines with the passage that holds most of their long words, out of two."""
    n = table(spark, sf, "benchmark").count()
    said = answers.claims(spark, sf).select("qid", F.col("label").alias("item"), F.col("claim_no").alias("no"), "text")
    held = answers.passages(spark, sf).withColumnRenamed("label", "item")
    two = held.withColumn("place", F.lit(0)).union(held.select(((F.col("item") + 1) % n).alias("item"), "passage", F.lit(1).alias("place")))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), (F.col("doc_id") % n).alias("item"))
    return ev.auto_cited(said, docs.join(two, "item")).select("qid", "no", "cited", F.round("share", 6).alias("share"))


@query("step_times", "SELECT event_type AS step, count(*) AS n, round(min(value), 6) AS best, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def step_times(spark, sf):
    """Best and mean time of each step."""
    return ev.step_times(table(spark, sf, "events").withColumnRenamed("event_type", "step"), "step", "value").select("step", "n", F.round("best", 6).alias("best"), F.round("mean", 6).alias("mean"))


@query("expected_rank", f"WITH {BM} SELECT item_id, item_id % 200 AS doc_id, rank::INT AS rank FROM benchmark LEFT JOIN lex ON lex.item_id = benchmark.item_id AND lex.doc_id = benchmark.item_id % 200".replace("SELECT item_id, item_id % 200", "SELECT benchmark.item_id, benchmark.item_id % 200"))
def expected_rank(spark, sf):
    """Where an expected document stands, if it was found."""
    want = table(spark, sf, "benchmark").select("item_id", (F.col("item_id") % 200).alias("doc_id"))
    return ev.expected_rank(retrieval.bm25_top20(spark, sf), want, "item_id", "doc_id").select("item_id", "doc_id", "rank")


@query("fusion_trace", f"WITH {BM} SELECT item_id, doc_id, concat_ws('+', CASE WHEN cover_rank IS NOT NULL THEN 'cover' END, CASE WHEN lexical_rank IS NOT NULL THEN 'lexical' END) AS arms, round(coalesce(1.0::DOUBLE / (61 + cover_rank), 0) / (coalesce(1.0::DOUBLE / (61 + cover_rank), 0) + coalesce(1.0::DOUBLE / (61 + lexical_rank), 0)), 6) AS cover_share FROM fused")
def fusion_trace(spark, sf):
    """What each arm gave to a fused hit."""
    return ev.fusion_trace(retrieval.fused(spark, sf), "item_id", ["cover_rank", "lexical_rank"]).select("item_id", "doc_id", "arms", "cover_share")
