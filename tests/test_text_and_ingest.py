from pyspark.sql import functions as F

from lithic.functions import text as tx
from lithic.operators import ingest


def values(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("t")).alias("v")).collect()]


def test_tokens_keep_compounds_and_add_parts(spark):
    assert values(spark, ["CRE36.122", "modelvalidation", "a-b/c", ""], tx.tokens) == [["cre36.122", "cre36", "122"], ["modelvalidation"], ["a-b/c", "a", "b", "c"], []]


def test_cleaning(spark):
    got = values(spark, ["M{{i}}, E{{i}}", "framework,2[Footnote 3 next", "making.[Fo tn1oe They", "a   b\t\tc ", "“x” – y"], tx.cleaned)
    assert got == ["Mi, Ei", "framework, 3 next", "making. They", "a b c", '"x" - y']
    assert values(spark, ["ﬁn①"], tx.fold) == ["fin1"]
    assert values(spark, ["x [Foo y", None], tx.residue) == [["x [Foo y"], []]


def test_noise(spark):
    assert values(spark, ["FAQ1", "Footnotes", "Page 3", "1234", "•", "n/a", "(a)", "xiv.", "A real line"], tx.is_noise) == [True] * 8 + [False]


def test_locators(spark):
    got = values(spark, ["36.122 Text", "5.5.1 Text", "21. Text", "Text"], lambda t: tx.locator(t, F.lit("CRE36")))
    assert got == ["CRE36.122", "5.5.1", "21", None]
    assert values(spark, ["(1) x", "x", "(b) x"], lambda t: tx.enumerated_locator(t, F.lit("(b)"))) == ["(b)(1)", "(b)", "(b)"]


def test_overlap_is_by_substring(spark):
    got = values(spark, ["data models", "the of", "zzzz data"], lambda t: tx.overlap(t, F.lit("A database of models")))
    assert got == [1.0, 0.0, 0.5]


def test_bins(spark):
    assert values(spark, ["Footnotes", "Table", "", None, "x" * 91, "Scope"], tx.is_bin) == [True, True, True, True, True, False]


def test_point_id(spark):
    import uuid

    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    names = ["a::0001::002", "é", ""]
    assert values(spark, names, lambda t: tx.point_id(t, ns)) == [str(uuid.uuid5(uuid.UUID(ns), n)) for n in names]


def test_reading_order_enters_groups_once(spark):
    body = spark.createDataFrame([("d", 0, "t0"), ("d", 1, "g0"), ("d", 2, "t3"), ("d", 3, "g0")], "doc_id string, pos int, ref string")
    groups = spark.createDataFrame([("d", "g0", ["t1", "g1"]), ("d", "g1", ["t2"])], "doc_id string, ref string, children array<string>")
    assert [r["ref"] for r in ingest.reading_order(body, groups).orderBy("idx").collect()] == ["t0", "t1", "t2", "t3"]


def test_clean_prefers_the_original_and_drops_page_furniture(spark):
    rows = [("d", 0, "head", None, "PAGE_HEADER", 1), ("d", 1, "short", "short and whole", "TEXT", 1), ("d", 2, "  ", None, "TEXT", 1), ("d", 3, "note", "note", "FOOTNOTE", 2)]
    got = ingest.clean(spark.createDataFrame(rows, "doc_id string, idx int, text string, orig string, label string, page int")).orderBy("idx").collect()
    assert [(r["idx"], r["orig_idx"], r["text"], r["is_footnote"]) for r in got] == [(0, 1, "short and whole", False), (1, 3, "note", True)]


def test_prose_tables(spark):
    rows = [(["1.1", "x" * 130], 2), (["5%"] * 10, 5), (["Chapter ..... 3"] * 8 + ["x" * 130], 2)]
    df = spark.createDataFrame(rows, "cells array<string>, n int")
    assert [r[0] for r in df.select(ingest.is_prose_table(F.col("cells"), F.col("n"))).collect()] == [True, False, False]
    line = spark.createDataFrame([(["5.5.12", "", "5.5.12", "If the cash flows", "If the cash flows", None],)], "c array<string>")
    assert line.select(ingest.table_line(F.col("c"))).first()[0] == "5.5.12 5.5.12 If the cash flows".replace("5.5.12 5.5.12", "5.5.12")


def test_sections_and_stamps(spark):
    texts = ["preface", "CRE20", "Effective as of 1 Jan 2023", "body", "CRE30", "Effective as of", "", "15 Dec 2019", "body names CRE20"]
    items = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, idx int, text string")
    found = ingest.sections(items, F.col("text").rlike(r"^\s*CRE\d{2}(?![\w.])"), F.regexp_extract("text", r"(CRE\d{2})", 1))
    dated = ingest.stamps(items, found, "(?i)effective as of").orderBy("start_idx").collect()
    assert [(r["code"], r["start_idx"], r["end_idx"], str(r["effective_from"])) for r in dated] == [("CRE20", 1, 4, "2023-01-01"), ("CRE30", 4, 9, "2019-12-15")]
    assert ingest.coverage_faults(found, items).count() == 0
    assert ingest.coverage_faults(found.filter("start_idx = 1"), items).count() == 1


def test_letters_in_sequence():
    run = lambda s: ingest.accepted_letters([None if c == "|" else f"({c})" for c in s])
    assert run("abicd") == [True, True, False, True, True]
    assert run("abcdefghij") == [True] * 10
    assert run("ab|cab") == [True, True, False, False, True, True]


def test_letter_parents(spark):
    texts = ["preface", "(a) one", "(b) two", "(1) x", "(i) y", "(c) three"]
    df = spark.createDataFrame([("d", i, t, False) for i, t in enumerate(texts)], "doc_id string, idx int, text string, is_heading boolean")
    assert [r["text"][:3] for r in ingest.letter_parents(df).filter("opens").orderBy("idx").collect()] == ["(a)", "(b)", "(c)"]


def test_repair_and_splits():
    assert ingest.repair(["A bank must", "hold capital.", "and more", "Then this"]) == ["A bank must hold capital.", "and more", "Then this"]
    assert ingest.repair(["A" * 690, "b" * 20]) == ["A" * 690, "b" * 20]
    parts = ingest.split_long("One is here. Two is here; three is here. " * 3, 40)
    assert all(len(p) <= 40 for p in parts) and " ".join(parts).split() == ("One is here. Two is here; three is here. " * 3).split()
    assert [len(p) for p in ingest.split_long("x" * 95, 40)] == [40, 40, 15]
    chunks = ingest.split_recursively("para one\n\n" + "word " * 100, 80, 20)
    assert all(len(c) <= 80 for c in chunks) and chunks[0] == "para one"
    assert ingest.semantic_groups([[1, 0], [1, 0.1], [0, 1], [0.1, 1]], 60) == [0, 0, 1, 1]
    assert ingest.semantic_groups([]) == []


def test_quantiles_of_three_kinds(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v int").agg(F.collect_list("v").alias("v"))
    assert df.select(ingest.upper_median(F.col("v")), ingest.nearest_rank(F.col("v"), 0.9), ingest.nearest_rank(F.col("v"), 0.5)).first()[:] == (3, 4, 3)


def test_letters_of_many_documents_go_to_python_at_once(spark):
    rows = [(d, i, f"({'abcde'[i % 5]}) x" if i % 4 else None, None if i == 2 else i % 7 == 6) for d in (1, 2, 3) for i in range(20)]
    found = ingest.letter_parents(spark.createDataFrame(rows, "doc_id long, idx int, text string, is_heading boolean"))
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.columns == ["doc_id", "idx", "text", "is_heading", "opens"]
    got = {(r["doc_id"], r["idx"]): r["opens"] for r in found.collect()}
    for d in (1, 2, 3):
        marks = [None if head else (text or "")[:3] for e, _, text, head in rows if e == d]
        live = [i for i, m in enumerate(marks) if m != ""]
        want = dict(zip(live, ingest.accepted_letters([marks[i] for i in live]), strict=True))
        assert [got[d, i] for i in range(20)] == [want.get(i, False) for i in range(20)]
