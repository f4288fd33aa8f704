"""Queries of the retrieval family: search, fusion, cuts and assembly.

Benchmark items are the questions and documents the corpus; ``lang`` is a facet, ``source`` a short
name and a document a parent whose lines are children. Two lexical arms stand for the lexical
and the dense one where a text model would be needed, and are named as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.functions import text as tx
from lithic.operators import assembly as asm
from lithic.operators import search as se
from lithic.plans.base import query, table
from lithic.sources.shared import stored

TOKENS_SQL = """list_filter(flatten(list_transform(regexp_extract_all(lower({t}), '[a-z0-9]+(?:[.\\-/][a-z0-9]+)*'),
  lambda x: CASE WHEN regexp_matches(x, '[.\\-/]') THEN list_concat([x], list_filter(string_split_regex(x, '[.\\-/]'), lambda p: p <> '')) ELSE [x] END)), lambda y: y IS NOT NULL)"""

BM25_SQL = f"""
dtok AS (SELECT doc_id, {TOKENS_SQL.format(t="coalesce(text, '')")} AS t FROM documents),
post AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM dtok) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dtok),
df AS (SELECT token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY token, n),
idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
ask AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest({TOKENS_SQL.format(t="coalesce(text, '')")}) AS token FROM benchmark) GROUP BY ALL),
bm AS (SELECT item_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM ask JOIN post USING (token) JOIN idf USING (token), st GROUP BY ALL),
lex AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank
        FROM bm WHERE score > 0 QUALIFY rank < 20),
cov AS (SELECT item_id, doc_id, round(sum(idf) / max(whole), 6) AS score
        FROM ask JOIN post USING (token) JOIN idf USING (token)
        JOIN (SELECT item_id, sum(idf) AS whole FROM ask JOIN idf USING (token) GROUP BY 1) USING (item_id) GROUP BY ALL),
cover AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank
          FROM cov WHERE score > 0 QUALIFY rank < 20),
rrf AS (SELECT item_id, doc_id, min(c) AS cover_rank, min(l) AS lexical_rank,
               round(coalesce(1.0::DOUBLE / (61 + min(c)), 0) + coalesce(1.0::DOUBLE / (61 + min(l)), 0), 9) AS rrf
        FROM (SELECT item_id, doc_id, rank AS c, NULL AS l FROM cover UNION ALL SELECT item_id, doc_id, NULL, rank FROM lex) GROUP BY 1, 2),
fused AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, cover_rank NULLS LAST, lexical_rank NULLS LAST, doc_id) - 1 AS rank
          FROM rrf QUALIFY rank < 20),
hits AS (SELECT item_id AS qid, lang AS facet, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS facet_ord,
                doc_id AS chunk_id, source AS parent_id, rank AS pos, rrf, round(coalesce(bm.score, 0) * 0.125::DOUBLE - 3, 9) AS rerank, item_id % 2 = 0 AS inferred
         FROM fused JOIN documents USING (doc_id) LEFT JOIN bm USING (item_id, doc_id)),
margin AS (SELECT *, NOT inferred OR n_facets = 1 OR best IS NULL OR coalesce(facet_best >= best - 6, false) AS in_margin
           FROM (SELECT *, max(rerank) OVER (PARTITION BY qid, facet) AS facet_best, max(rerank) OVER (PARTITION BY qid) AS best,
                        len(list_distinct(list(facet) OVER (PARTITION BY qid))) AS n_facets FROM hits)),
kept AS (SELECT * FROM (SELECT *, NOT inferred AND lefts = 0 AND ord <= 2 AS rescued
         FROM (SELECT *, count(*) FILTER (above) OVER (PARTITION BY qid, facet) AS lefts,
                      row_number() OVER (PARTITION BY qid, facet ORDER BY coalesce(rerank, rrf) DESC, pos) AS ord
               FROM (SELECT * EXCLUDE (facet_best, best, n_facets), rerank IS NULL OR rerank >= 0 AS above FROM margin WHERE in_margin)))),
named AS (SELECT *, row_number() OVER (PARTITION BY qid, facet ORDER BY pos) AS rank_in_facet FROM kept
          WHERE (above OR rescued) AND NOT inferred QUALIFY rank_in_facet <= 5),
pooled AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coalesce(rerank, 0) DESC, facet_ord, pos) AS rank_in_facet FROM kept
           WHERE (above OR rescued) AND inferred QUALIFY rank_in_facet <= 5),
turns AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank_in_facet, facet_ord) - 1 AS turn FROM (SELECT * FROM named UNION ALL SELECT * FROM pooled)),
passages AS (SELECT qid, parent_id, row_number() OVER (PARTITION BY qid ORDER BY min(turn)) - 1 AS place, count(*) AS n_children, arg_min(chunk_id, turn) AS child FROM turns GROUP BY 1, 2)
"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 of every question and document (item_id, doc_id, score)."""
    return se.bm25(questions(spark, sf), table(spark, sf, "documents"), "item_id", "text", "doc_id", "text")


def arms(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents of every question by BM25 and by coverage, which stands for a dense arm."""
    return se.lexical_arms(questions(spark, sf), table(spark, sf, "documents"), "item_id", "text", "doc_id", "text")


def fused(spark: SparkSession, sf: str) -> DataFrame:
    both = arms(spark, sf).withColumn("bm25", F.col("score"))
    ranked = {"cover": se.lexical_top(both.withColumn("score", F.col("cover")), "item_id", "doc_id"), "lexical": se.lexical_top(both, "item_id", "doc_id")}
    return se.fuse(ranked, ["item_id"], "doc_id", carry=["bm25"])


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Fused hits with facet, parent and a stand-in pair score; every second question's plan is inferred."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    found = fused(spark, sf).join(docs, "doc_id")
    order = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2).otherwise(3)
    return found.select(F.col("item_id").alias("qid"), F.col("lang").alias("facet"), order.alias("facet_ord"), F.col("doc_id").alias("chunk_id"), F.col("source").alias("parent_id"), F.col("rank").alias("pos"), "rrf", F.round(F.coalesce("bm25", F.lit(0.0)) * 0.125 - 3, 9).alias("rerank"), (F.col("item_id") % 2 == 0).alias("inferred"))


def first_found(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, doc_id): the first document, by its id, that BM25 finds for each question."""
    return se.first_found(questions(spark, sf), table(spark, sf, "documents"), "item_id", "text", "doc_id", "text")


def kept_of(found: DataFrame) -> DataFrame:
    return asm.floor_and_rescue(asm.facet_margin(found).filter("in_margin"))


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return kept_of(hits(spark, sf))


def served(spark: SparkSession, sf: str) -> DataFrame:
    return served_of(kept(spark, sf))


def served_of(left: DataFrame) -> DataFrame:
    """Hits that pass every cut before assembly, with their turn."""
    left = left.filter("above or rescued")
    pooled = asm.pool(left.filter("inferred")).withColumnRenamed("rank_in_pool", "rank_in_facet")
    return asm.round_robin(asm.quota(left.filter("not inferred")).unionByName(pooled))


@query("tok_stats", f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {TOKENS_SQL.format(t='text')} AS t FROM documents)")
def tok_stats(spark, sf):
    t = tx.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("bm25_top20", f"WITH {BM25_SQL} SELECT item_id, doc_id, score, rank::INT AS rank FROM lex")
def bm25_top20(spark, sf):
    return se.lexical_top(arms(spark, sf).drop("cover"), "item_id", "doc_id")


@query("coverage_top20", f"WITH {BM25_SQL} SELECT item_id, doc_id, score, rank::INT AS rank FROM cover")
def coverage_top20(spark, sf):
    return se.lexical_top(arms(spark, sf).select("item_id", "doc_id", F.col("cover").alias("score")), "item_id", "doc_id")


DENSE_SQL = "SELECT q.vec_id AS qid, c.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score, (row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) DESC, c.vec_id) - 1)::INT AS rank FROM embeddings q JOIN embeddings c ON {on} WHERE q.vec_id % 20 = 0 QUALIFY rank < 20"


def _vectors(spark, sf):
    """All rows as corpus; those whose id is divisible by 20 are the stated queries."""
    vectors = table(spark, sf, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label", F.col("embedding").alias("vec"))
    return asked, vectors.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))


@query("dense_topk", DENSE_SQL.format(on="true"))
def dense_topk(spark, sf):
    return se.dense_top(*_vectors(spark, sf))


@query("dense_topk_filtered", DENSE_SQL.format(on="q.label = c.label"))
def dense_topk_filtered(spark, sf):
    return se.dense_top(*_vectors(spark, sf), same=["label"])


@query("rrf_fuse", f"WITH {BM25_SQL} SELECT item_id, doc_id, cover_rank::INT AS cover_rank, lexical_rank::INT AS lexical_rank, rrf, rank::INT AS rank FROM fused")
def rrf_fuse(spark, sf):
    return fused(spark, sf).drop("bm25")


@query("fusion_arms", f"WITH {BM25_SQL} SELECT CASE WHEN cover_rank IS NULL THEN 'lexical' WHEN lexical_rank IS NULL THEN 'cover' ELSE 'both' END AS arms, count(*) AS n, round(avg(rank), 6) AS mean_rank FROM fused GROUP BY 1")
def fusion_arms(spark, sf):
    """Which arms found what was fused (A-AS19, E18)."""
    arms = F.when(F.col("cover_rank").isNull(), "lexical").when(F.col("lexical_rank").isNull(), "cover").otherwise("both")
    return fused(spark, sf).groupBy(arms.alias("arms")).agg(F.count("*").alias("n"), F.round(F.avg("rank"), 6).alias("mean_rank"))


@query("facet_margin", f"WITH {BM25_SQL} SELECT qid, chunk_id, facet, rerank, in_margin FROM margin")
def facet_margin(spark, sf):
    return asm.facet_margin(hits(spark, sf)).select("qid", "chunk_id", "facet", "rerank", "in_margin")


@query("floor_rescue", f"WITH {BM25_SQL} SELECT qid, chunk_id, facet, above, rescued FROM kept")
def floor_rescue(spark, sf):
    return kept(spark, sf).select("qid", "chunk_id", "facet", "above", "rescued")


@query("quota_cut", f"WITH {BM25_SQL} SELECT qid, chunk_id, rank_in_facet::INT AS rank_in_facet FROM named")
def quota_cut(spark, sf):
    return asm.quota(kept(spark, sf).filter("(above or rescued) and not inferred")).select("qid", "chunk_id", "rank_in_facet")


@query("pool_cut", f"WITH {BM25_SQL} SELECT qid, chunk_id, rank_in_facet::INT AS rank_in_pool FROM pooled")
def pool_cut(spark, sf):
    return asm.pool(kept(spark, sf).filter("(above or rescued) and inferred")).select("qid", "chunk_id", "rank_in_pool")


@query("round_robin", f"WITH {BM25_SQL} SELECT qid, chunk_id, facet, turn::INT AS turn FROM turns")
def round_robin(spark, sf):
    return served(spark, sf).select("qid", "chunk_id", "facet", "turn")


@query("parent_resolve", f"WITH {BM25_SQL} SELECT qid, parent_id, place::INT AS place, n_children::INT AS n_children FROM passages")
def parent_resolve(spark, sf):
    return asm.parents(served(spark, sf)).select("qid", "parent_id", "place", F.size("children").alias("n_children"))


@query("refused_questions", f"WITH {BM25_SQL}, q AS (SELECT item_id, length(regexp_replace(lower(text), '[^a-z]', '', 'g')) < 3 AS short, item_id IN (SELECT qid FROM kept WHERE above OR rescued) AS found FROM benchmark) SELECT item_id, short OR (item_id % 2 = 0 AND NOT found) AS refused FROM q")
def refused_questions(spark, sf):
    """Too little to ask, or an inferred plan of which nothing survived (A-AS1, A-AS6)."""
    alive = kept(spark, sf).filter("above or rescued").select(F.col("qid").alias("item_id"), F.lit(True).alias("found")).distinct()
    q = questions(spark, sf).join(alive, "item_id", "left")
    return q.select("item_id", (asm.refused(F.col("text")) | ((F.col("item_id") % 2 == 0) & F.col("found").isNull())).alias("refused"))


FAIR_SQL = f"WITH {BM25_SQL}, sized AS (SELECT qid, parent_id, child, place, length(text) AS full_chars, greatest(5000, 25000 // count(*) OVER (PARTITION BY qid)) AS cap FROM passages JOIN documents ON doc_id = child), used AS (SELECT *, least(full_chars, cap) AS chars FROM sized)"


def sized(spark, sf, turns: DataFrame | None = None):
    """Delivered passages: the first child's text up to a fair share."""
    from pyspark.sql import Window

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("child"), "text")
    found = asm.parents(served(spark, sf) if turns is None else turns).withColumn("child", F.col("children")[0]).join(docs, "child")
    cap = asm.fair_share(F.count("*").over(Window.partitionBy("qid")))
    full = F.length("text")
    return found.withColumn("cap", cap).select("qid", "parent_id", "child", "place", "text", full.cast("long").alias("full_chars"), F.col("cap").cast("long").alias("cap"), F.least(full, F.col("cap")).cast("long").alias("chars"))


@query("fair_share", FAIR_SQL + " SELECT qid, parent_id, full_chars, cap::BIGINT AS cap, chars::BIGINT AS chars FROM used")
def fair_share(spark, sf):
    return sized(spark, sf).select("qid", "parent_id", "full_chars", "cap", "chars")


BUDGET_SQL = FAIR_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + ", walk(qid, place, used, fits) AS (SELECT qid, place, chars, true FROM used WHERE place = 0 UNION ALL SELECT u.qid, u.place, CASE WHEN w.used + u.chars <= 25000 THEN w.used + u.chars ELSE w.used END, w.used + u.chars <= 25000 FROM walk w JOIN used u ON u.qid = w.qid AND u.place = w.place + 1)"


@query("context_budget", BUDGET_SQL + " SELECT qid, parent_id, place::INT AS place, chars::BIGINT AS chars, fits FROM walk JOIN used USING (qid, place)")
def context_budget(spark, sf):
    return asm.within_budget(sized(spark, sf), "place", "chars").select("qid", "parent_id", "place", "chars", "fits")


@query("containment_drop", f"WITH {FAIR_SQL[5:]}, sq AS (SELECT qid, parent_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM used JOIN documents ON doc_id = child) SELECT DISTINCT a.qid, a.parent_id FROM sq a JOIN sq b ON a.qid = b.qid AND a.parent_id <> b.parent_id AND length(a.t) < length(b.t) AND contains(b.t, a.t)")
def containment_drop(spark, sf):
    return asm.contained(sized(spark, sf), "parent_id", ["qid"], "text")


@query("drop_ledger", f"WITH {BM25_SQL} SELECT qid, chunk_id, 'facet_margin' AS cut FROM margin WHERE NOT in_margin UNION ALL SELECT qid, chunk_id, 'relevance_floor' FROM kept WHERE NOT above AND NOT rescued UNION ALL SELECT qid, chunk_id, CASE WHEN inferred THEN 'fallback_pool' ELSE 'quota' END FROM kept WHERE (above OR rescued) AND (qid, chunk_id) NOT IN (SELECT (qid, chunk_id) FROM turns)")
def drop_ledger(spark, sf):
    """Every hit that was cut before assembly and the cut that took it (A-AS16)."""
    found = stored(hits(spark, sf))  # at most 20 a question, read for every cut
    margin, left = asm.facet_margin(found), kept_of(found)
    end = served_of(left)
    late = left.filter("above or rescued").join(end.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    row = lambda df, cut: df.select("qid", "chunk_id", cut.alias("cut"))
    return row(margin.filter("not in_margin"), F.lit("facet_margin")).union(row(left.filter("not above and not rescued"), F.lit("relevance_floor"))).union(row(late, F.when(F.col("inferred"), "fallback_pool").otherwise("quota")))


@query("loss_resolution", f"WITH {FAIR_SQL[5:]}, gone AS (SELECT qid, chunk_id, parent_id FROM kept WHERE (above OR rescued) AND (qid, chunk_id) NOT IN (SELECT (qid, chunk_id) FROM turns)), sent AS (SELECT qid, parent_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM used JOIN documents ON doc_id = child) SELECT g.qid, g.chunk_id, CASE WHEN s.t IS NULL THEN 'absent' WHEN contains(s.t, substr(trim(regexp_replace(d.text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 1, 120)) THEN 'none' ELSE 'windowed_out' END AS loss FROM gone g JOIN documents d ON doc_id = chunk_id LEFT JOIN sent s ON g.qid = s.qid AND g.parent_id = s.parent_id")
def loss_resolution(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("own"))
    left = kept_of(stored(hits(spark, sf)))  # at most 20 hits a question, read for every cut
    end = served_of(left)
    gone = left.filter("above or rescued").join(end.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti").select("qid", "chunk_id", "parent_id").join(docs, "chunk_id")
    sent = sized(spark, sf, end).select("qid", "parent_id", F.col("text").alias("sent"))
    return gone.join(sent, ["qid", "parent_id"], "left").select("qid", "chunk_id", asm.loss(F.col("own"), F.col("sent")).alias("loss"))


@query("window_trim")
def window_trim(spark, sf):
    """Delivered text of passages over their share: whole paragraphs around the match (A-AS14)."""
    w = asm.windowed(sized(spark, sf).withColumn("kid", F.substring("text", 1, 60)), "text", "kid", "cap")
    return w.select("qid", "parent_id", "trimmed", F.length("delivered").alias("n_chars"))


@query("empty_facets", f"WITH {BM25_SQL}, grid AS (SELECT q.item_id AS qid, l.facet FROM benchmark q, (SELECT DISTINCT lang AS facet FROM documents) l) SELECT qid, facet FROM grid EXCEPT SELECT qid, facet FROM hits")
def empty_facets(spark, sf):
    """Questions by facets in which nothing was found (E49): a few facets a question."""
    facets = table(spark, sf, "documents").agg(F.collect_set("lang").alias("facets"))
    grid = questions(spark, sf).join(F.broadcast(facets)).select(F.col("item_id").alias("qid"), F.explode("facets").alias("facet"))
    return grid.join(hits(spark, sf).select("qid", "facet"), ["qid", "facet"], "left_anti")


@query("point_ids")
def point_ids(spark, sf):
    """Name-based identifiers of all documents."""
    return table(spark, sf, "documents").select("doc_id", tx.point_id(F.concat(F.lit("doc::"), F.col("doc_id").cast("string")), "6ba7b810-9dad-11d1-80b4-00c04fd430c8").alias("point_id"))
