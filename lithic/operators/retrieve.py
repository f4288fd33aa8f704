"""The whole retrieval for a table of questions: search, cuts, assembly, ledger and notes (A-AS2, A-AS18).

The order of steps is fixed: refuse, search each facet, rescore, facet margin, floor and rescue,
quota or pool, turns, parents, containment, shares and windows, budget. Every step is a plan over all
questions at once; nothing is collected but the terms of a block of facets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithic.operators import assembly as asm
from lithic.operators import search as se
from lithic.operators.tracing import Tracer

#: A facet's number is below this: a plan has a few, or one a document that is named.
FACETS = 1024
REQUIREMENTS = ("standard", "rule")


@dataclass
class Retrieved:
    """``passages`` (qid, parent_id, place, children, delivered, trimmed, full_chars, cap, fits), ``refused`` (qid, reason),
    ``ledger`` (qid, chunk_id, cut), ``notes`` (qid, notes) and the tracer with the seconds of each step."""

    passages: DataFrame
    refused: DataFrame
    ledger: DataFrame
    notes: DataFrame
    tracer: Tracer


def searched(questions: DataFrame, facets: DataFrame, chunks: DataFrame, k: int = 20, dense: DataFrame | None = None) -> DataFrame:
    """(qid, facet, facet_ord, chunk_id, bm25, rrf, pos): the fused candidates of every facet.

    ``dense``: (qid, facet_ord, chunk_id, rank) of an embedding arm; without one, the weighted share of
    a question's tokens stands in its place."""
    beyond = F.raise_error(F.lit(f"a plan has at most {FACETS} facets, and question ids lie below 2 ** 53 / {FACETS}")).cast("long")
    fits = (F.col("facet_ord") < FACETS) & (F.abs("qid") < 2**53 // FACETS)
    number = F.when(fits, F.col("qid") * FACETS + F.col("facet_ord")).otherwise(beyond).alias("fid")
    asked = facets.join(questions.select("qid", "text"), "qid").select(number, "qid", "facet", "facet_ord", "text", "cells")
    both = se.lexical_arms(asked, chunks, "fid", "text", "chunk_id", "text", k, "cell", "cells").withColumn("bm25", F.col("score"))
    if dense is None:
        first = se.lexical_top(both.withColumn("score", F.col("cover")), "fid", "chunk_id", k)
    else:
        scored = both.select("fid", "chunk_id", "bm25")
        first = dense.select(number, "chunk_id", "rank").filter(F.col("rank") < k).join(scored, ["fid", "chunk_id"], "left")
    fused = se.fuse({"dense": first, "lexical": se.lexical_top(both, "fid", "chunk_id", k)}, ["fid"], "chunk_id", keep=k, carry=["bm25"])
    return fused.join(asked.select("fid", "qid", "facet", "facet_ord"), "fid").select("qid", "facet", "facet_ord", "chunk_id", "bm25", "rrf", F.col("rank").alias("pos"))


def retrieve(
    questions: DataFrame, facets: DataFrame, chunks: DataFrame, parents: DataFrame | None = None, *, dense: DataFrame | None = None,
    rescore: Callable[[DataFrame], DataFrame] | None = None, quota: int = asm.QUOTA, requirement_only: bool = False, short_name: str | None = None,
    hold: Callable[[DataFrame], DataFrame] = lambda df: df, tracer: Tracer | None = None,
) -> Retrieved:
    """``questions`` (qid, text, inferred), ``facets`` (qid, facet, facet_ord, cells: the corpus cells that it searches),
    ``chunks`` (chunk_id, parent_id, cell, text, and doc_type for ``requirement_only``), ``parents`` (parent_id, text).

    ``rescore`` puts a column rerank on hits (qid, question, chunk_id, text, bm25, ...); without it
    scores are null and the fused order decides. A parent that is not held is its first child's text.
    ``short_name``: a column of chunks within which contained passages are dropped, else a question's.
    ``hold`` keeps what several steps read, with a checkpoint for example; what it does is timed.
    """
    tracer = tracer or Tracer(on=False)
    with tracer.span("refuse"):
        little = questions.filter(asm.refused(F.coalesce("text", F.lit(""))))
        asked = questions.join(little.select("qid"), "qid", "left_anti")
    eligible = chunks.filter(F.col("doc_type").isin(*REQUIREMENTS)) if requirement_only else chunks
    if requirement_only:  # statistics stay those of the whole corpus
        chunks = chunks.withColumn("cell", F.when(F.col("doc_type").isin(*REQUIREMENTS), F.col("cell")))
    with tracer.span("search"):
        found = hold(searched(asked, facets.join(asked.select("qid"), "qid", "left_semi"), chunks, dense=dense))
    with tracer.span("rescore"):
        kept = ["chunk_id", "parent_id", F.col("text")] + ([short_name] if short_name else [])
        hits = found.join(asked.select("qid", F.col("text").alias("question"), "inferred"), "qid").join(eligible.select(*kept), "chunk_id")
        hits = hold(rescore(hits) if rescore else hits.withColumn("rerank", F.lit(None).cast("double")))
    with tracer.span("cuts"):
        margin = asm.facet_margin(hits)
        if rescore is None:  # a plan without scores keeps all its facets
            margin = margin.withColumn("in_margin", F.lit(True))
        floor = hold(asm.floor_and_rescue(margin.filter("in_margin")))
        alive = floor.filter("above or rescued")
        pooled = asm.pool(alive.filter("inferred"), quota).withColumnRenamed("rank_in_pool", "rank_in_facet")
        turns = hold(asm.round_robin(asm.quota(alive.filter("not inferred"), quota).unionByName(pooled)))
    with tracer.span("assembly"):
        passages = _passages(turns, parents, short_name)
        passages = hold(asm.within_budget(passages.withColumn("chars", F.length("delivered")), "place", "chars"))
    row = lambda df, cut: df.select("qid", "chunk_id", cut.alias("cut"))
    late = alive.join(turns.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    over = passages.filter("not fits").select("qid", F.explode("children").alias("chunk_id"))
    ledger = (
        row(margin.filter("not in_margin"), F.lit("facet_margin")).union(row(floor.filter("not above and not rescued"), F.lit("relevance_floor")))
        .union(row(late, F.when(F.col("inferred"), "fallback_pool").otherwise("quota"))).union(row(over, F.lit("context_budget")))
    )
    lost = asked.filter("inferred").join(alive.select("qid").distinct(), "qid", "left_anti")
    refused = little.select("qid", F.lit("too little to ask").alias("reason")).union(lost.select("qid", F.lit("nothing relevant found").alias("reason")))
    return Retrieved(passages, refused, ledger, _notes(asked, facets, found, ledger, passages, rescore is not None), tracer)


def _passages(turns: DataFrame, parents: DataFrame | None, short_name: str | None) -> DataFrame:
    """Parents with the text that each may deliver; contained ones are gone before shares are dealt."""
    named = [short_name] if short_name else []
    child = turns.select("qid", F.col("chunk_id").alias("child"), F.col("text").alias("child_text"), *named)
    found = asm.parents(turns).withColumn("child", F.col("children")[0]).join(child.dropDuplicates(["qid", "child"]), ["qid", "child"])
    if parents is not None:
        found = found.join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id", "left")
    else:
        found = found.withColumn("parent_text", F.lit(None).cast("string"))
    found = found.withColumn("text", F.coalesce("parent_text", "child_text", F.lit(""))).drop("parent_text")
    inside = asm.contained(found, "parent_id", ["qid", *named], "text").select("qid", "parent_id").distinct()
    left = found.join(inside, ["qid", "parent_id"], "left_anti")
    shared = left.withColumn("cap", asm.fair_share(F.count("*").over(Window.partitionBy("qid")))).withColumn("full_chars", F.length("text").cast("long"))
    return asm.windowed(shared, "text", "child_text", "cap").drop("text", "child_text", "child", *named)


def _notes(asked: DataFrame, facets: DataFrame, found: DataFrame, ledger: DataFrame, passages: DataFrame, scored: bool) -> DataFrame:
    """(qid, notes): what a reader of an answer should know, in a fixed order."""
    empty = facets.join(found.select("qid", "facet").distinct(), ["qid", "facet"], "left_anti").select("qid", F.lit(1).alias("o"), F.concat(F.lit("nothing found in "), "facet").alias("note"))
    cut = ledger.groupBy("qid", "cut").agg(F.count("*").alias("n")).select("qid", F.lit(2).alias("o"), F.concat("cut", F.lit(": "), F.col("n").cast("string")).alias("note"))
    short = passages.filter("trimmed").groupBy("qid").agg(F.count("*").alias("n")).select("qid", F.lit(3).alias("o"), F.concat(F.lit("windowed: "), F.col("n").cast("string")).alias("note"))
    rows = empty.union(cut).union(short)
    if not scored:
        rows = rows.union(asked.select("qid", F.lit(0).alias("o"), F.lit("pairs were not scored").alias("note")))
    listed = rows.join(asked.select("qid"), "qid", "left_semi").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("o", "note"))).alias("all_"))
    return asked.select("qid").join(listed, "qid", "left").select("qid", F.coalesce(F.transform("all_", lambda x: x["note"]), F.array().cast("array<string>")).alias("notes"))
