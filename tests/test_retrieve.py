import pytest
from pyspark.sql import functions as F

from lithic.operators import retrieve as rt
from lithic.operators.tracing import Tracer


def asked(spark):
    questions = spark.createDataFrame([(1, "capital buffer rules", False), (2, "7?", False), (3, "capital liquidity", True), (4, "zebra", True)], "qid long, text string, inferred boolean")
    facets = spark.createDataFrame([(q, f, i, [f]) for q in (1, 2, 3, 4) for i, f in enumerate(("uk", "us"))], "qid long, facet string, facet_ord int, cells array<string>")
    rows = [
        (10, "p", "uk", "standard", "capital buffer rules for banks"), (11, "p", "uk", "guidance", "capital buffer"), (12, "r", "us", "rule", "buffer and liquidity rules"),
        (13, "s", "us", "guidance", "liquidity of all kinds"), (14, "t", None, "rule", "capital capital capital"), (15, "t", "uk", "rule", None),
    ]
    rows += [(100 + i, f"x{i}", "other", "rule", f"filler word{i} of another kind") for i in range(30)]
    return questions, facets, spark.createDataFrame(rows, "chunk_id long, parent_id string, cell string, doc_type string, text string")


def test_driver(spark):
    tracer = Tracer()
    parents = spark.createDataFrame([("p", "whole of p: capital buffer rules")], "parent_id string, text string")
    out = rt.retrieve(*asked(spark), parents, tracer=tracer)
    got = {(r["qid"], r["parent_id"]): r for r in out.passages.collect()}
    assert set(got) == {(1, "p"), (1, "r"), (3, "p"), (3, "s"), (3, "r")}
    assert got[1, "p"]["delivered"].startswith("whole of p") and got[1, "p"]["children"] == [10, 11]
    assert got[1, "r"]["delivered"] == "buffer and liquidity rules"
    assert {(r["qid"], r["reason"]) for r in out.refused.collect()} == {(2, "too little to ask"), (4, "nothing relevant found")}
    notes = {r["qid"]: r["notes"] for r in out.notes.collect()}
    assert notes[4] == ["pairs were not scored", "nothing found in uk", "nothing found in us"] and notes[1] == ["pairs were not scored"]
    assert list(tracer.timings()) == ["refuse", "search", "rescore", "cuts", "assembly"]
    assert tracer.table(spark).filter("seconds >= 0").count() == 5


def test_requirements_only_and_quota(spark):
    only = rt.retrieve(*asked(spark), requirement_only=True)
    assert {(r["qid"], tuple(r["children"])) for r in only.passages.filter("qid = 1").collect()} == {(1, (10,)), (1, (12,))}
    one = rt.retrieve(*asked(spark), quota=1)
    assert {r["cut"] for r in one.ledger.collect()} == {"quota", "fallback_pool"}


def test_tracers():
    off = Tracer(on=False)
    with off.span("a"):
        pass
    assert off.trace_id is None and off.rows == [] and off.timings() == {}
    ticks = iter(range(10))
    on = Tracer(clock=lambda: next(ticks))
    with pytest.raises(KeyError), on.span("a"), on.span("b", "inner"):
        raise KeyError("x")
    assert [(r[2], r[3], r[4], r[5]) for r in on.rows] == [(None, "a", 3, "KeyError"), (0, "b", 1, "KeyError")]


def test_ranks_before_and_after_locators_in_blocks_of_any_size(spark, monkeypatch):
    """Ranks do not depend on how questions and documents are cut; no pair of a question and a document is shuffled."""
    from lithic.operators import search

    rows = [(i, None if i == 5 else f"rule {'of' if i % 2 else 'on'} {'capital' if i % 3 else 'risk'}", f"CRE{i % 4}.{i}") for i in range(40)]
    corpus = spark.createDataFrame(rows, "d long, text string, loc string")
    asks = corpus.filter("d % 5 = 0").select(F.col("d").alias("q"), F.concat(F.lit("what of "), F.when(F.col("d") == 10, "").otherwise(F.col("loc"))).alias("t"))
    wanted = asks.select("q", F.col("q").alias("d"))

    def ranks():
        df = search.located_ranks(asks, corpus, wanted, "q", "t", "d", "text", "loc")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "explode" not in plan and "ahead" in plan
        return {r["q"]: (r["before"], r["after"]) for r in df.collect()}

    whole = ranks()
    # texts of even documents hold no word of the questions; document 25 shares "of" and is tied with the odd ones before it
    assert whole[0] == (None, 0) and whole[5] == (None, 0) and whole[10] == (None, None) and whole[25][1] == 0 and whole[25][0] == 11
    monkeypatch.setattr(search, "BLOCK_CELLS", 3)
    monkeypatch.setattr(search, "BLOCK_TERMS", 4)
    assert ranks() == whole


def test_dense_scores_in_cells_of_any_number(spark, monkeypatch):
    """The best rows do not depend on how many are scored at once, ties and groups included."""
    from lithic.operators import search

    rows = spark.range(60).select("id", (F.col("id") % 2).alias("g"), F.array((F.col("id") % 5).cast("double"), (F.col("id") % 3).cast("double")).alias("vec")).coalesce(2)
    asked = rows.filter("id % 7 = 0").withColumnRenamed("id", "qid")
    best = lambda: sorted(map(tuple, search.dense_top(asked, rows, 4, ["g"]).select("qid", "id", "score", "rank").collect()))
    whole = best()
    monkeypatch.setattr(search, "SCORE_CELLS", 20)
    assert best() == whole and len(whole) == 36
