"""Questions against large registries: rows between the joins follow the questions, not names times questions."""

from pyspark.sql import functions as F

from lithic.operators import planning as pl
from lithic.operators import reading


def most_joined(df):
    """The most rows that a join of the plan made, after a run."""
    df.collect()

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        own, below = node.metrics(), node.children()
        made = own.apply("numOutputRows").value() if "Join" in name and own.contains("numOutputRows") else 0
        return max([made, *(walk(below.apply(i)) for i in range(below.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def registry(spark, n):
    return spark.range(1, n + 1).select(F.col("id").alias("row_ord"), F.concat(F.lit("DOC "), F.col("id").cast("string")).alias("short_name"), F.col("id").cast("string").alias("doc_id"))


def test_a_token_of_all_names_does_not_meet_all_names(spark):
    asked = spark.range(1, 301).select(F.col("id").alias("q"), F.when(F.col("id") % 3 == 0, "the doc").otherwise(F.concat(F.lit("doc "), F.col("id").cast("string"))).alias("name"))
    found = reading.name_kinds(asked, reading.name_index(registry(spark, 400)), "q", "name")
    want = {q: ("FAMILY", None) if q % 3 == 0 else ("EXACT", f"DOC {q}") for q in range(1, 301)}
    assert {r["q"]: (r["name_kind"], r["hit"]) for r in found.collect()} == want
    assert most_joined(found) <= 2 * 300 + 2 * 400  # not 300 x 400


def test_ties_between_names_go_to_more_tokens_and_then_to_the_first(spark):
    names = spark.createDataFrame([(1, "Alpha one two"), (2, "Beta one two"), (3, "Gamma one")], "row_ord long, short_name string")
    asked = spark.createDataFrame([(1, "gamma alpha"), (2, "gamma one beta two"), (3, "one two"), (4, "beta alpha one")], "q int, name string")
    got = {r["q"]: (r["name_kind"], r["hit"]) for r in reading.name_kinds(asked, reading.name_index(names), "q", "name").collect()}
    assert got == {1: ("EXACT", "Alpha one two"), 2: ("EXACT", "Beta one two"), 3: ("FAMILY", None), 4: ("EXACT", "Alpha one two")}


def test_a_word_of_all_aliases_does_not_fetch_all_aliases(spark):
    texts = spark.range(1, 201).select(F.col("id").alias("q"), F.concat(F.lit("what does doc "), F.col("id").cast("string"), F.lit(" say, or DOC7?")).alias("t"))
    found = reading.documents_named(texts, pl.alias_index(registry(spark, 300)), "q", "t")
    want = {(q, d) for q in range(1, 201) for d in {str(q), "7"}}
    assert {(r["q"], r["doc_id"]) for r in found.collect()} == want
    assert most_joined(found) <= 4 * 600  # not 200 x 300


def test_menus_are_written_once(spark):
    grid = spark.createDataFrame([("cap", "US", ["A"]), ("cap", "UK", ["B", "C"])], "subject string, jurisdiction string, names array<string>")
    rows = [(1, "cap", True, ["US", "UK"], "INCOMPLETE"), (2, "cap", True, [], "INCOMPLETE"), (3, "none", True, [], "INCOMPLETE"), (4, "cap", None, ["US", "UK"], "INCOMPLETE"), (5, "cap", True, None, "INCOMPLETE"), (6, "cap", True, [], "ANSWERABLE")]
    judged = spark.createDataFrame(rows, "q int, subject string, subject_read boolean, jurisdictions array<string>, decision string")
    told = {r["q"]: r["message"] for r in reading.clarified(judged, grid, lambda choice: F.length(choice).cast("string")).collect()}
    whole = {r["q"]: r["message"] for r in reading.clarified(judged, grid).collect()}
    assert whole[1] == "On cap: US: using A; UK: B, C - which one?" and whole[2] == whole[4] == whole[5] == "On cap: UK: B, C - which one?; US: using A"
    assert whole[3] == told[3] == "Which document or regulator should be used?" and whole[6] is None and told[1] == str(len(whole[1]))


def test_terms_are_literal_patterns(spark):
    """A pattern that is put together in a row is compiled anew for each term and text."""
    read = reading.readings(spark.createDataFrame([(1, "the u.s. and stress-test, formerly"), (2, None)], "q int, t string"), "q", "t")
    patterns = [line for line in read._jdf.queryExecution().optimizedPlan().toString().splitlines() if "lambda" in line and "\\Q" in line]
    assert patterns == []
    got = {r["q"]: (r["subject"], r["jurisdiction"], r["version"]) for r in read.collect()}
    assert got[1] == ("stress_testing", "US", True)
    planned = {r["q"]: (r["mode"], r["version"], r["recency"]) for r in pl.plan_modes(spark.createDataFrame([(1, "formerly new"), (2, None)], "q int, t string"), "q", "t").collect()}
    assert planned == {1: ("version_fanout", True, True), 2: ("fallback", False, False)}


def test_texts_stay_where_they_are_beside_a_held_index(spark, monkeypatch):
    texts = spark.range(1, 201).select(F.col("id").alias("q"), F.concat(F.lit("doc "), (F.col("id") % 40 + 1).cast("string"), F.lit(" says, doc "), F.col("id").cast("string")).alias("t"))
    found = reading.documents_named(texts, pl.alias_index(registry(spark, 100)), "q", "t")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "rightHint=(strategy=broadcast)" in plan
    want = {(r["q"], r["doc_id"]) for r in found.collect()}
    assert want == {(q, str(d)) for q in range(1, 201) for d in {q % 40 + 1, q} if d <= 100}
    monkeypatch.setattr(reading, "HELD_ROWS", 5)  # as with an index that no task may hold
    apart = reading.documents_named(texts, pl.alias_index(registry(spark, 100)), "q", "t")
    assert {(r["q"], r["doc_id"]) for r in apart.collect()} == want


def test_held_gaps_are_those_of_the_joined_grams(spark, monkeypatch):
    gaps = spark.createDataFrame([("Reg Z", "Z rule"), ("Ox", "é"), ("", "none"), (None, "late"), ("no such", None)], "instrument string, short_name string")
    texts = spark.createDataFrame([(1, "of REG Z and z RULE"), (2, "foxes"), (3, "CAFÉ late"), (4, None), (5, "")], "q long, t string")
    found = lambda: reading.gaps_mentioned(texts, gaps, "q", "t")
    assert "MapInArrow" in found()._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(str, found().collect()))
    monkeypatch.setattr(reading, "HELD_NAMES", 0)
    assert got == sorted(map(str, found().collect())) and len(got) == 8
