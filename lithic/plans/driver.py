"""Queries of the whole retrieval: every question searches every facet (A-AS2, A-AS18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.operators import retrieve as rt
from lithic.operators.tracing import Tracer
from lithic.plans.base import query, table
from lithic.plans.retrieval import BM25_SQL, questions
from lithic.sources.shared import stored

_HEAD, _REST = BM25_SQL[: BM25_SQL.index("lex AS")], BM25_SQL[BM25_SQL.index("margin AS") :]
FACETS_SQL = f"""{_HEAD}
cov AS (SELECT item_id, doc_id, round(sum(idf) / max(whole), 6) AS score FROM ask JOIN post USING (token) JOIN idf USING (token)
        JOIN (SELECT item_id, sum(idf) AS whole FROM ask JOIN idf USING (token) GROUP BY 1) USING (item_id) GROUP BY ALL),
able AS (SELECT item_id FROM benchmark WHERE length(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g')) >= 3),
lex AS (SELECT item_id, lang, doc_id, row_number() OVER (PARTITION BY item_id, lang ORDER BY score DESC, doc_id) - 1 AS rank
        FROM bm JOIN able USING (item_id) JOIN documents USING (doc_id) WHERE score > 0 AND lang IS NOT NULL QUALIFY rank < 20),
cover AS (SELECT item_id, lang, doc_id, row_number() OVER (PARTITION BY item_id, lang ORDER BY score DESC, doc_id) - 1 AS rank
          FROM cov JOIN able USING (item_id) JOIN documents USING (doc_id) WHERE score > 0 AND lang IS NOT NULL QUALIFY rank < 20),
rrf AS (SELECT item_id, lang, doc_id, min(c) AS cover_rank, min(l) AS lexical_rank,
               round(coalesce(1.0::DOUBLE / (61 + min(c)), 0) + coalesce(1.0::DOUBLE / (61 + min(l)), 0), 9) AS rrf
        FROM (SELECT item_id, lang, doc_id, rank AS c, NULL AS l FROM cover UNION ALL SELECT item_id, lang, doc_id, NULL, rank FROM lex) GROUP BY 1, 2, 3),
fused AS (SELECT *, row_number() OVER (PARTITION BY item_id, lang ORDER BY rrf DESC, cover_rank NULLS LAST, lexical_rank NULLS LAST, doc_id) - 1 AS rank
          FROM rrf QUALIFY rank < 20),
hits AS (SELECT item_id AS qid, f.lang AS facet, CASE f.lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS facet_ord,
                doc_id AS chunk_id, source AS parent_id, rank AS pos, rrf, round(coalesce(bm.score, 0) * 0.125::DOUBLE - 3, 9) AS rerank, item_id % 2 = 0 AS inferred
         FROM fused f JOIN documents USING (doc_id) LEFT JOIN bm USING (item_id, doc_id)),
{_REST},
whole AS (SELECT qid, parent_id, place, n_children, text, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM passages JOIN documents ON doc_id = child),
apart AS (SELECT * FROM whole a WHERE NOT EXISTS (SELECT 1 FROM whole b WHERE b.qid = a.qid AND b.parent_id <> a.parent_id AND length(a.t) < length(b.t) AND contains(b.t, a.t)))"""


def retrieved(spark, sf: str, tracer: Tracer | None = None) -> rt.Retrieved:
    """Languages are facets, sources parents without a text of their own; BM25 stands for a pair scorer."""
    asked = questions(spark, sf).select(F.col("item_id").alias("qid"), "text", (F.col("item_id") % 2 == 0).alias("inferred"))
    lang = F.col("lang")
    order = F.when(lang == "de", 0).when(lang == "en", 1).when(lang == "es", 2).otherwise(3)
    docs = table(spark, sf, "documents")
    langs = docs.select("lang").filter("lang is not null").distinct().agg(F.collect_list(F.struct(order.alias("facet_ord"), lang.alias("facet"))).alias("all_"))
    facets = asked.select("qid").join(F.broadcast(langs)).select("qid", F.inline("all_")).withColumn("cells", F.array("facet"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("parent_id"), lang.alias("cell"), "text")
    rescore = lambda hits: hits.withColumn("rerank", F.round(F.coalesce("bm25", F.lit(0.0)) * 0.125 - 3, 9))
    return rt.retrieve(asked, facets, chunks, rescore=rescore, hold=stored, tracer=tracer)


@query("retrieved_passages", f"WITH {FACETS_SQL} SELECT qid, parent_id, place::INT AS place, n_children::INT AS n_children, length(text) AS full_chars, greatest(5000, 25000 // count(*) OVER (PARTITION BY qid))::INT AS cap FROM apart")
def retrieved_passages(spark, sf):
    """What each question is given, by the whole driver."""
    return retrieved(spark, sf).passages.select("qid", "parent_id", "place", F.size("children").alias("n_children"), "full_chars", "cap")


@query("retrieved_refusals", f"WITH {FACETS_SQL} SELECT item_id AS qid, CASE WHEN item_id IN (SELECT item_id FROM able) THEN 'nothing relevant found' ELSE 'too little to ask' END AS reason FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM able) OR (item_id % 2 = 0 AND item_id NOT IN (SELECT qid FROM kept WHERE above OR rescued))")
def retrieved_refusals(spark, sf):
    return retrieved(spark, sf).refused


@query("retrieved_cuts", f"WITH {FACETS_SQL} SELECT cut, count(*) AS n FROM (SELECT 'facet_margin' AS cut FROM margin WHERE NOT in_margin UNION ALL SELECT 'relevance_floor' FROM kept WHERE NOT above AND NOT rescued UNION ALL SELECT CASE WHEN inferred THEN 'fallback_pool' ELSE 'quota' END FROM kept WHERE (above OR rescued) AND (qid, chunk_id) NOT IN (SELECT (qid, chunk_id) FROM turns)) GROUP BY 1")
def retrieved_cuts(spark, sf):
    """The ledger before the budget, which depends on windowed texts, by cut."""
    return retrieved(spark, sf).ledger.filter("cut != 'context_budget'").groupBy("cut").agg(F.count("*").alias("n"))
