import pytest
from pyspark.sql import functions as F

from lithic.operators import claims as cl
from lithic.operators import features as ft
from lithic.operators import gate, ingest, models
from lithic.operators import planning as pl
from lithic.operators import reading

NAMES = ["SR 11-7", "SR 26-2", "Basel CRE", "Basel CAP", "SS1/23"]


def names(spark):
    return spark.createDataFrame(list(enumerate(NAMES)), "row_ord long, short_name string").withColumn("doc_id", F.col("row_ord"))


def test_names(spark):
    owners = {r["token"]: r["owners"] for r in reading.name_index(names(spark)).collect()}
    assert {t for t, n in owners.items() if n > 1} == {"sr", "basel"}
    asked = {1: "basel cre", 2: "Basel", 3: "Solvency II", 4: "US guidance", 5: "", 6: None, 7: "SR 26-2 and Basel CRE"}
    got = {r["q"]: (r["name_kind"], r["hit"]) for r in reading.name_kinds(spark.createDataFrame(list(asked.items()), "q int, name string"), reading.name_index(names(spark)), "q", "name").collect()}
    assert got == {1: ("EXACT", "Basel CRE"), 2: ("FAMILY", None), 3: ("ABSENT", None), 4: ("NONE", None), 5: ("NONE", None), 6: ("NONE", None), 7: ("EXACT", "SR 26-2")}
    rows = [("Solvency II", "what does solvency ii say", True), ("Solvency II", "what of insolvency", False), ("the guidance", "the guidance", False)]
    seen = spark.createDataFrame(rows, "name string, question string, want boolean")
    assert seen.filter(reading.document_seen(F.col("name"), F.col("question")) != F.col("want")).count() == 0


def test_reading_and_classifying(spark):
    texts = {1: "What do the US and the UK say on stress testing?", 2: "capital in the UK", 3: "model validation", 4: "what does Basel CRE say", 5: "old and new capital"}
    asked = spark.createDataFrame(list(texts.items()), "q int, t string")
    read = {r["q"]: r for r in reading.readings(asked, "q", "t").collect()}
    assert read[1]["jurisdictions"] == ["US", "UK"] and read[1]["subject"] == "stress_testing" and read[1]["jurisdiction"] is None and read[5]["version"]
    said = spark.createDataFrame([(q, True, "data_quality", "US", "Solvency II") for q in (1, 2, 5)], "q int, banking boolean, subject string, jurisdiction string, document string")
    got = {r["q"]: r for r in reading.classified(asked, said, names(spark), pl.alias_index(names(spark)), "q", "t").collect()}
    assert (got[2]["subject"], got[2]["jurisdiction"], got[2]["document_seen"], got[2]["name_kind"]) == ("capital_adequacy", "UK", False, "ABSENT")
    assert got[1]["jurisdiction"] is None and got[5]["jurisdiction"] == "US"
    assert got[3]["banking"] and got[3]["name_kind"] == "EXACT" and got[4]["documents"] == ["Basel CRE"] and got[4]["name_kind"] == "EXACT"


def test_what_is_said_back(spark):
    grid = spark.createDataFrame([("cap", "US", ["A"]), ("cap", "UK", ["B", "C"]), ("dq", "GLOBAL", ["D"])], "subject string, jurisdiction string, names array<string>")
    rows = [(1, "cap", True, ["US", "UK"], "INCOMPLETE"), (2, "cap", True, ["US"], "ANSWERABLE"), (3, None, False, [], "INCOMPLETE"), (4, "cap", False, ["US", "UK"], "INCOMPLETE"), (5, "dq", False, [], "INCOMPLETE"), (6, "cap", True, ["US", "GLOBAL"], "ANSWERABLE")]
    judged = spark.createDataFrame(rows, "q int, subject string, subject_read boolean, jurisdictions array<string>, decision string").withColumn("question", F.lit("q"))
    settled = {r["q"]: (r["locked"], r["sent"]) for r in reading.settled(judged, grid).collect()}
    assert settled[1] == (["A"], "q") and settled[2] == ([], "q") and settled[4][0] == [] and settled[6] == (["A"], "q (A)")
    told = {r["q"]: r["message"] for r in reading.clarified(judged, grid).collect()}
    assert told[1] == "On cap: US: using A; UK: B, C - which one?" and told[2] is None and told[5] == "On dq: GLOBAL: using D" and told[3] == told[4] == "Which document or regulator should be used?"
    assert gate.config_text(b=1, a=2) == "a=2|b=1"


def test_versions_are_settled_where_each_side_holds_one(spark):
    grid = spark.createDataFrame([("cap", "US", ["A", "B"]), ("dq", "US", ["C", "D", "E"])], "subject string, jurisdiction string, names array<string>")
    status = spark.createDataFrame([("cap", "US", "current", ["A"]), ("cap", "US", "historic", ["B"]), ("dq", "US", "current", ["C", "D"]), ("dq", "US", "historic", ["E"])], "subject string, jurisdiction string, bucket string, names array<string>")
    rows = [(1, "cap", None, True, True, "ANSWERABLE"), (2, "dq", None, True, True, "INCOMPLETE"), (3, "dq", None, True, False, "ANSWERABLE"), (4, "dq", "US", False, True, "ANSWERABLE")]
    x = spark.createDataFrame(rows, "q int, subject string, jurisdiction string, subject_read boolean, version boolean, want string")
    x = x.withColumns({"banking": F.lit(True), "jurisdictions": F.array().cast("array<string>"), "name_kind": F.lit("NONE"), "document_seen": F.lit(None).cast("boolean")})
    assert [r["q"] for r in pl.decide(x, grid, status).collect() if r["decision"] != r["want"]] == []


def test_no_nested_loop_between_patterns_and_texts(spark, capsys):
    asked = spark.createDataFrame([(1, "what does CRE36 say"), (2, "see ss1/23, or CAP 10."), (3, "secret crew")], "q int, t string")
    found = reading.documents_named(asked, pl.alias_index(names(spark)), "q", "t")
    assert {(r["q"], r["short_name"]) for r in found.collect()} == {(1, "Basel CRE"), (2, "SS1/23"), (2, "Basel CAP")}
    gaps = spark.createDataFrame([("Regulation Q", "REG Q"), ("x", None), (" ", "zz")], "instrument string, short_name string")
    held = reading.gaps_mentioned(spark.createDataFrame([(1, "the preg quota"), (2, "REGULATION Q"), (3, "oxen"), (4, "none")], "q int, t string"), gaps, "q", "t")
    assert {(r["q"], r["instrument"]) for r in held.collect()} == {(1, "Regulation Q"), (1, " "), (2, "Regulation Q"), (2, " "), (3, "x")}
    found.explain()
    held.explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_chapters_pages_and_ids(spark):
    texts = ["preface", "CRE20 Scope", "line one", "", "CRE30", "line two"]
    items = spark.createDataFrame([("d", i, t, i // 2) for i, t in enumerate(texts)], "doc_id string, idx int, text string, page int")
    assert [(r["start_idx"], r["code"]) for r in ingest.chapter_starts(items, "CRE").orderBy("start_idx").collect()] == [(1, "CRE20"), (4, "CRE30")]
    assert ingest.chapter_starts(items, "CRE30").first()["start_idx"] == 4
    spans = spark.createDataFrame([("d", "CRE20", 1, 4, "Scope", None), ("d", "CRE30", 4, 6, "", "2020-01-01")], "doc_id string, chapter string, start_idx int, end_idx int, heading string, effective_from string")
    assert [(r["page_from"], r["page_to"]) for r in ingest.page_spans(items, spans).orderBy("start_idx").collect()] == [(0, 1), (2, 2)]
    whole = spark.createDataFrame([("d", "2019-05-05")], "doc_id string, effective_from string")
    assert [r["effective_from"] for r in ingest.overlaid(spans, whole).orderBy("start_idx").collect()] == ["2019-05-05", "2020-01-01"]
    parents, chunks = ingest.assembled(items, spans, items.filter("idx in (2, 5)"))
    assert [(r["parent_id"], r["text"], r["n_children"]) for r in parents.orderBy("parent_id").collect()] == [("d::CRE20::0000", "CRE20 Scope\n\nline one", 1), ("d::CRE30::0000", "CRE30\n\nline two", 1)]
    assert [r["chunk_id"] for r in chunks.orderBy("idx").collect()] == ["d::CRE20::0000::000", "d::CRE30::0000::000"]
    assert ingest.parents_report(parents).first()["n"] == 2
    assert ingest.without_heading_line(items, ["doc_id"]).count() == 5
    with pytest.raises(ValueError, match="none of"):
        ingest.collection_name("other")


def test_footnotes_are_repaired_apart(spark):
    rows = [("d", 0, "A bank must", False), ("d", 1, "see the note", True), ("d", 2, "hold capital.", False), ("d", 3, "and the annex.", True)]
    got = ingest.streams(spark.createDataFrame(rows, "doc_id string, idx int, text string, is_footnote boolean"), ["doc_id"]).orderBy("first_idx").collect()
    assert [(r["first_idx"], r["text"]) for r in got] == [(0, "A bank must hold capital."), (1, "see the note and the annex.")]


def test_stand_in_models(spark):
    embed = models.hashed_embedder(64)
    assert models.batching_drift(embed, ["a b", "c", "d e f"]) == 0 and models.throughput(embed, ["a"])["texts_a_second"] > 0
    assert models.asymmetry(embed, "capital ratio rules", "capital ratio rules apply", "weather today")
    df = models.embedded(spark.createDataFrame([("a b",), (None,)], "t string"), F.col("t"), embed)
    assert [round(r[0], 6) for r in df.select(models.dot(F.col("vec"), F.col("vec"))).collect()] == [1.0, 0.0]
    hits = spark.createDataFrame([(1, 1, "red fox", "a red fox"), (1, 2, "red fox", "blue")], "qid long, chunk_id long, q string, t string")
    assert [r["chunk_id"] for r in models.best_rescored(models.rescored(hits, "q", "t", models.shared_token_scorer()), 1).collect()] == [1]
    assert models.rescored(hits, "q", "t", None).filter("rerank is null").count() == 2


def test_registry_lookups(spark):
    rows = [(0, "a", "A", "superseded", 3, "rule", "F", "Basel one"), (1, "b", "B", "in_force", 3, "guidance", "F", "x"), (2, "c", "C", "in_force", 3, "rule", "G", "y"), (3, "d", "D", "in_force", 3, "rule", "G", "z")]
    reg = spark.createDataFrame(rows, "row_ord int, doc_id string, short_name string, status string, authority_rank int, doc_type string, framework string, subject string").withColumns({"verified": F.lit(True), "volume": F.lit(None).cast("string"), "applicability": F.lit(None).cast("string"), "jurisdiction": F.lit("US")})
    assert pl.by_id(reg, "a").count() == 1 and pl.current(reg, framework="F").first()["doc_id"] == "b" and pl.requirement_sources(reg).count() == 3
    with pytest.raises(KeyError, match="zz"):
        pl.by_id(reg, "zz")
    with pytest.raises(ValueError, match="several"):
        pl.current(reg, framework="G")
    assert pl.version_families(reg).count() == 2 and pl.status_view(reg).count() == 4
    gaps = spark.createDataFrame([("Reg Z", "Z rule")], "instrument string, short_name string")
    assert pl.gap_for(gaps, " reg z ").count() == 1
    asked = spark.createDataFrame([(1, "what of REG Z"), (2, "nothing")], "q long, t string")
    assert [r["q"] for r in reading.gaps_mentioned(asked, gaps, "q", "t").collect()] == [1]


def test_whole_answers(spark):
    said = spark.createDataFrame([(1, 0, "capital must be held daily.", "S1"), (1, 1, "other words.", "S2")], "qid long, claim_no int, text string, label string")
    units = spark.createDataFrame([(1, "S1", 0, "1.1", "capital must be held daily here"), (1, "S1", 1, "1.2", "unlike text stands below")], "qid long, label string, pos int, locator string, text string")
    cites = spark.createDataFrame([(1, "S1", "Doc")], "qid long, label string, citation string")
    got = cl.answers(said, units, cites).first()
    assert got["body"] == "capital must be held daily [1]. other words [unattributed]." and got["sources"] == "[1] Doc, 1.1"
    assert cl.labelled(said, cites.withColumn("label", F.lit("S1"))).orderBy("claim_no").select("valid").collect()[0][0]
    assert cl.filled("a b", "[1] x").endswith("SOURCES\n  [1] x")


def test_prepared_columns(spark):
    df = spark.createDataFrame([(1.0, True, None), (None, False, 2.0)], "a double, b boolean, c double")
    got = ft.prepared(df, {"c": "d"}, required=["a"], logged=["a"]).collect()
    assert len(got) == 1 and got[0]["b"] == 1 and round(got[0]["a"], 4) == 0.6931
    flags = ft.missing_flags(df, ["c"]).select("c_missing", ft.clipped(F.col("a"), 0.0, 0.5)).collect()
    assert [tuple(r) for r in flags] == [(1, 0.5), (0, None)]
