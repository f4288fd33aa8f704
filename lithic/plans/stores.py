"""Queries over what sources keep: parse caches, upserts, listings and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.operators import assembly as asm
from lithic.operators import evaluation, search
from lithic.operators.features import exact_quantiles
from lithic.plans import retrieval
from lithic.plans.base import query, table
from lithic.plans.registry import REG_SQL, registry
from lithic.sources import collection, files

KEYS_SQL = """keys AS (SELECT doc_id, substr(sha256(text), 1, 16) AS sha16 FROM documents),
cache AS (SELECT doc_id, sha16, 'v2' AS parser FROM keys WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'gone', 'v2' FROM keys WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, sha16, 'v1' FROM keys WHERE doc_id % 7 = 0)"""


def keys(spark: SparkSession, sf: str) -> DataFrame:
    return files.parse_keys(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")), "v2")


def cache(spark: SparkSession, sf: str) -> DataFrame:
    """Parses that are held: current ones, ones of content that is gone, and ones of an older parser."""
    k = keys(spark, sf)
    return k.filter("doc_id % 3 = 0").union(k.filter("doc_id % 5 = 0").withColumn("sha16", F.lit("gone"))).union(k.filter("doc_id % 7 = 0").withColumn("parser", F.lit("v1")))


@query("cache_status", f"WITH {KEYS_SQL} SELECT doc_id, doc_id % 3 = 0 AS cached, (doc_id % 5 = 0)::BIGINT + (doc_id % 7 = 0)::BIGINT AS n_stale FROM keys")
def cache_status(spark, sf):
    """Whether a document's parse is held, and older ones of it."""
    return files.cache_status(keys(spark, sf), cache(spark, sf))


@query("cache_misses", f"WITH {KEYS_SQL} SELECT doc_id, sha16 FROM keys WHERE doc_id % 3 <> 0")
def cache_misses(spark, sf):
    """Documents that are to be parsed."""
    return files.cache_misses(keys(spark, sf), cache(spark, sf)).select("doc_id", "sha16")


@query("stale_entries", f"WITH {KEYS_SQL} SELECT doc_id, sha16, parser FROM cache WHERE sha16 = 'gone' OR parser = 'v1'")
def stale_entries(spark, sf):
    """Parses that a purge would take."""
    return files.stale_entries(keys(spark, sf), cache(spark, sf)).select("doc_id", "sha16", "parser")


@query("upserted_rows", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE lang END AS lang FROM documents WHERE doc_id % 6 <> 5")
def upserted_rows(spark, sf):
    """Old rows with new ones in their place, and without a document."""
    old = table(spark, sf, "documents").select("doc_id", "lang")
    new = old.filter("doc_id % 4 = 0").withColumn("lang", F.lit("new"))
    return files.upserted(old, new, "doc_id").filter("doc_id % 6 <> 5")


@query("without_document", "SELECT doc_id FROM documents WHERE doc_id <> 7")
def without_document(spark, sf):
    """A store without one document."""
    return files.without_document(table(spark, sf, "documents").select("doc_id"), 7)


@query("store_stats", "SELECT count(*) AS n_chunks, count(DISTINCT source) AS n_parents FROM documents")
def store_stats(spark, sf):
    """Exact counts of chunks and parents."""
    return files.store_stats(table(spark, sf, "documents").withColumnRenamed("source", "parent_id"))


@query("missing_files", f"WITH {REG_SQL} SELECT doc_id FROM reg WHERE doc_id::BIGINT % 7 = 0")
def missing_files(spark, sf):
    """Registry rows whose file is not there."""
    rows = registry(spark, sf).withColumn("file", F.concat("doc_id", F.lit(".pdf")))
    return files.missing_files(rows, rows.filter(F.col("doc_id").cast("long") % 7 != 0).select("file")).select("doc_id")


@query("swapped_parents", f"WITH {retrieval.BM25_SQL}, f AS (SELECT item_id, source AS parent_id, min(rank) AS r FROM lex JOIN documents USING (doc_id) GROUP BY 1, 2) SELECT item_id, parent_id, (row_number() OVER (PARTITION BY item_id ORDER BY r, parent_id) - 1)::INT AS place FROM f")
def swapped_parents(spark, sf):
    """Parents in place of their children, each once (A-AS20)."""
    hits = retrieval.bm25_top20(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.col("source").alias("parent_id")), "doc_id")
    return asm.swapped_parents(hits, ["item_id"], "rank", "parent_id").select("item_id", "parent_id", "place")


@query("merged_labels", "SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN toxic ELSE quality END)::INT AS quality FROM labels")
def merged_labels(spark, sf):
    """Labels read back by row number; what is new fills in."""
    labels = table(spark, sf, "labels").withColumn("quality", F.col("quality").cast("int"))
    read = labels.filter("doc_id % 2 = 0").select("doc_id", F.col("toxic").cast("int").alias("label"))
    return files.merged_labels(labels.select("doc_id", "quality"), read.withColumnRenamed("label", "quality"), "doc_id", "quality")


INDEXED = ["lang", "source"]


@query("collection_stats", "SELECT count(*) AS n_chunks, count(DISTINCT source) AS n_parents, count(DISTINCT lang) AS n_lang, count(DISTINCT source) AS n_source FROM documents")
def collection_stats(spark, sf):
    """Exact counts of a collection and its indexed columns."""
    return collection.stats(table(spark, sf, "documents"), "source", INDEXED)


@query("scrolled_page", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'en') AND doc_id > 99 ORDER BY doc_id LIMIT 2000")
def scrolled_page(spark, sf):
    """A page of 2,000 rows of two languages after a key."""
    rows = table(spark, sf, "documents").select("doc_id", "lang")
    return collection.page(rows.filter(F.col("lang").isin("de", "en")), "doc_id", 99)


@query("parents_looked_up", f"WITH {retrieval.BM25_SQL} SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM lex)")
def parents_looked_up(spark, sf):
    """The documents that some question found, each once."""
    return collection.looked_up(table(spark, sf, "documents").select("doc_id", "n_chars"), retrieval.bm25_top20(spark, sf), "doc_id")


RUNS_SQL = """runs AS (SELECT event_type AS label, CASE user_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS size, event_id % 4 AS run, 1000 + event_id % 700 AS tokens,
  0.5 + abs(value) AS wall, CASE event_id % 5 WHEN 0 THEN (0.5 + abs(value)) / 40 ELSE 0.5 + abs(value) END AS reported, 1600 AS expected FROM events WHERE value IS NOT NULL),
rates AS (SELECT *, tokens / wall AS rate, (tokens / reported) / (tokens / wall) > 3 AS cached, tokens < 0.6 * expected AS cut FROM runs)"""


@query("read_rates", f"WITH {RUNS_SQL} SELECT label, size, count(*) AS n, count(*) FILTER (cached) AS n_cached, bool_or(cut) AS cut, round(median(rate) FILTER (NOT cached AND run > 0), 6) AS median_rate FROM rates GROUP BY 1, 2")
def read_rates(spark, sf):
    """Median reading rates of runs that no cache served, without warm-ups (E45): events are the runs."""
    e = table(spark, sf, "events").filter("value is not null")
    wall = 0.5 + F.abs("value")
    runs = e.select(F.col("event_type").alias("label"), F.when(F.col("user_id") % 3 == 0, "small").when(F.col("user_id") % 3 == 1, "medium").otherwise("large").alias("size"), (F.col("event_id") % 4).alias("run"), (1000 + F.col("event_id") % 700).alias("tokens"), wall.alias("wall"), F.when(F.col("event_id") % 5 == 0, wall / 40).otherwise(wall).alias("reported"))
    rated = evaluation.read_rates(runs, F.col("tokens"), F.col("reported"), F.col("wall"), F.lit(1600))
    counts = rated.groupBy("label", "size").agg(F.count("*").alias("n"), F.count_if("cached").alias("n_cached"), F.bool_or("cut").alias("cut"))
    medians = exact_quantiles(rated.filter("not cached and run > 0"), "rate", {"m": 0.5}, ["label", "size"])
    return counts.join(medians, ["label", "size"], "left").select("label", "size", "n", "n_cached", "cut", F.round("m", 6).alias("median_rate"))


LOCATED_DOCS_SQL = "located AS (SELECT doc_id, text, 'CRE' || (doc_id % 40) || '.' || doc_id AS locator FROM documents), asks AS (SELECT doc_id AS qid, doc_id AS want, 'what does ' || locator || ' require of ' || coalesce(split_part(text, ' ', 2), '') AS q FROM located WHERE doc_id % 100 = 3)"


def bm25_of(name: str, docs: str) -> str:
    t = retrieval.TOKENS_SQL
    return f"""{name}_t AS (SELECT doc_id, {t.format(t=docs)} AS t FROM located),
{name}_p AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM {name}_t) GROUP BY ALL),
{name}_s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {name}_t),
{name}_d AS (SELECT token, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM {name}_p, {name}_s GROUP BY token, n),
{name}_i AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {name}_d) ELSE raw END AS idf FROM {name}_d),
{name}_b AS (SELECT qid, want, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM toks JOIN {name}_p USING (token) JOIN {name}_i USING (token), {name}_s GROUP BY ALL),
{name}_r AS (SELECT w.qid, count(*) AS rank FROM {name}_b w JOIN {name}_b o ON o.qid = w.qid AND (o.score > w.score OR (o.score = w.score AND o.doc_id <= w.doc_id)) WHERE w.doc_id = w.want GROUP BY w.qid)"""


@query("locator_ranks", f"""WITH {LOCATED_DOCS_SQL}, toks AS (SELECT qid, want, token, count(*) AS times FROM (SELECT qid, want, unnest({retrieval.TOKENS_SQL.format(t='q')}) AS token FROM asks) GROUP BY ALL),
{bm25_of('a', "coalesce(text, '')")}, {bm25_of('b', "locator || ' ' || coalesce(text, '')")}
SELECT asks.qid, (a_r.rank - 1)::BIGINT AS before, (b_r.rank - 1)::BIGINT AS after FROM asks LEFT JOIN a_r USING (qid) LEFT JOIN b_r USING (qid)""")
def locator_ranks(spark, sf):
    """Where a document stands that a question names by its locator, before and after locators are indexed."""
    docs = table(spark, sf, "documents")
    located = docs.select("doc_id", "text", F.concat(F.lit("CRE"), (F.col("doc_id") % 40).cast("string"), F.lit("."), F.col("doc_id").cast("string")).alias("locator"))
    asks = located.filter("doc_id % 100 = 3").select(F.col("doc_id").alias("qid"), F.concat(F.lit("what does "), "locator", F.lit(" require of "), F.coalesce(F.split_part("text", F.lit(" "), F.lit(2)), F.lit(""))).alias("q"))
    return search.located_ranks(asks, located, asks.select("qid", F.col("qid").alias("doc_id")), "qid", "q", "doc_id", "text", "locator")
