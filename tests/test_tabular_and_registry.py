import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.operators import curves, learning, planning
from lithic.operators import features as ft
from lithic.operators import reading
from lithic.sources import files
from lithic.streaming import audit


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(20)
    rows = [(i, int(rng.random() < 0.4), round(rng.random() * 20) / 20) for i in range(400)]
    return rows, spark.createDataFrame(rows, "id long, y int, s double")


def test_auc_and_ks_with_ties(scored):
    rows, df = scored
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    area = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert curves.roc_auc(df, "y", "s").first()[0] == pytest.approx(area)
    gap = max(abs(sum(p >= t for p in pos) / len(pos) - sum(n >= t for n in neg) / len(neg)) for t in {s for *_, s in rows})
    assert curves.ks(df, "y", "s").first()[0] == pytest.approx(gap)


def test_thresholds(scored):
    rows, df = scored

    def f1(t):
        tp = sum(y for _, y, s in rows if s >= t)
        return 2 * tp / (sum(1 for *_, s in rows if s >= t) + sum(y for _, y, _ in rows))

    best = max({s for *_, s in rows}, key=lambda t: (round(f1(t), 12), -t))
    got = curves.best_f1(df, "y", "s").first()
    assert got["threshold"] == best and got["f1"] == pytest.approx(f1(best))
    one = curves.confusion(df, "y", F.col("s") >= best).first()
    assert one["f1"] == pytest.approx(f1(best))


def test_edge_tables(spark):
    one = spark.createDataFrame([(1, 0.5), (1, 0.5)], "y int, s double")
    assert curves.roc_auc(one, "y", "s").first()[0] is None
    none = spark.createDataFrame([], "y int, s double")
    assert curves.ks(none, "y", "s").first()[0] is None and curves.confusion(none, "y", F.col("s") > 0).first()["precision"] is None


def test_psi_with_duplicate_edges(spark):
    base = spark.createDataFrame([(0.0,)] * 60 + [(float(i),) for i in range(40)], "x double")
    same = curves.psi(base, base, "x")
    assert same.count() == 10 and same.agg(F.sum("part")).first()[0] == pytest.approx(0)
    moved = curves.psi(base, base.select((F.col("x") + 20).alias("x")), "x").agg(F.sum("part")).first()[0]
    assert moved > 0.25


def test_vif_is_uncentred(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(200, 3)) + 2
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    g = x.T @ x
    want = np.diag(g) * np.diag(np.linalg.inv(g))
    got = {r["feature"]: r["vif"] for r in curves.vif(df, ["a", "b", "c"]).collect()}
    assert [got[c] for c in "abc"] == pytest.approx(want.tolist())


def test_ratios_and_nulls(spark):
    rows = [(5.0, 10.0, 50.0), (0.0, 0.0, 0.0), (3.0, 0.0, 100.0), (None, 4.0, 0.0), (9.0, 3.0, 100.0)]
    df = spark.createDataFrame(rows, "n double, d double, want double")
    assert all(r[0] == r[1] for r in df.select(ft.percent_ratio(F.col("n"), F.col("d")), "want").collect())
    assert [r[0] for r in df.select(ft.floored_difference(F.col("n"), F.col("d"))).collect()] == [0.0, 0.0, 3.0, None, 6.0]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0) for i in range(9)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["r"] for r in ft.correlation_pairs(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(1) and got["a", "c"] is None


def test_split_is_stratified_and_repeatable(spark):
    df = spark.range(2000).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    one, two = (ft.stratified_split(df, "y", "id") for _ in range(2))
    shares = {r["y"]: r["s"] for r in one.groupBy("y").agg(F.avg(F.col("is_train").cast("int")).alias("s")).collect()}
    assert all(abs(s - 0.8) < 0.01 for s in shares.values())
    assert one.exceptAll(two).count() == 0


def test_unseen_category_is_zeros(spark):
    df = spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "c string")
    assert [r[1] for r in ft.one_hot(df, "c", ["a", "b"]).collect()] == [0, 1, 0, 0]


def test_folds_and_out_of_fold(spark):
    df = spark.range(600).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 3).cast("double").alias("x"))
    scored = learning.out_of_fold(learning.balanced(df, "y"), learning.features(["x"], []), learning.classifier("tree", "y", "weight", maxDepth=2), "id", "y", 3)
    assert scored.count() == 600 and curves.roc_auc(scored, "y", "score").first()[0] == 1.0
    assert sorted(r[0] for r in learning.permuted(df, "x", "id", 1).select("x").collect()) == sorted(float(i % 3) for i in range(600))


def registry(spark, **change):
    rows = {
        "old": dict(short_name="SR 11-7", status="superseded", superseded_by=["new"], supersedes=[], authority_rank=3, doc_type="guidance", framework="SR", volume=None, applicability=None, effective_from=None, effective_to=None),
        "new": dict(short_name="SR 26-2", status="in_force", superseded_by=[], supersedes=["old"], authority_rank=3, doc_type="guidance", framework="SR", volume=None, applicability=None, effective_from=None, effective_to=None),
        "data": dict(short_name="Basel CRE", status="in_force", superseded_by=[], supersedes=[], authority_rank=0, doc_type="report", framework="B", volume="CRE", applicability=None, effective_from=None, effective_to=None),
    }
    for key, value in change.items():
        doc, field = key.split("__")
        rows[doc][field] = value
    names = ["short_name", "status", "superseded_by", "supersedes", "authority_rank", "doc_type", "framework", "volume", "applicability"]
    made = [(k, *(r[n] for n in names), [], [], r["effective_from"], r["effective_to"], True) for k, r in rows.items()]
    return spark.createDataFrame(made, "doc_id string, short_name string, status string, superseded_by array<string>, supersedes array<string>, authority_rank int, doc_type string, framework string, volume string, applicability string, revises array<string>, revised_by array<string>, effective_from string, effective_to string, verified boolean")


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({}, None), ({"old__superseded_by": []}, "superseded_without_successor"), ({"new__superseded_by": ["data"]}, "successor_of_document_in_force"), ({"data__doc_type": "rule"}, "reference_data_as_requirement"),
        ({"new__supersedes": []}, "one_sided_superseded_by"), ({"old__superseded_by": ["gone"]}, "dangling_superseded_by"), ({"data__short_name": "SR 11-7"}, "duplicate_short_name"),
        ({"old__status": "in_force", "old__superseded_by": [], "new__supersedes": []}, "several_current_in_family"), ({"new__effective_from": "2024-01-02", "new__effective_to": "2024-01-01"}, "ends_before_it_starts"),
    ],
)
def test_registry_rules(spark, change, rule):
    found = {r["rule"] for r in planning.violations(registry(spark, **change)).collect()}
    assert (rule in found) if rule else not found


def test_aliases(spark):
    df = spark.createDataFrame([(1, "SR 11-7"), (2, "SR 15-18"), (3, "SR 15-19"), (4, "Basel CRE"), (5, "12 CFR Part 252"), (6, "Policy (PAP)")], "doc_id long, short_name string")
    held = {}
    for r in planning.alias_index(df).collect():
        held.setdefault(r["doc_id"], set()).add(r["alias"])
    assert {"sr 11-7", "sr117", "sr 11", "sr11"} <= held[1] and "sr 15" not in held[2] and "cre" in held[4] and "part 252" in held[5] and "pap" in held[6]
    asked = spark.createDataFrame([(1, "what does CRE36 say"), (2, "thus and sr 11-7"), (3, "secret crew")], "q long, t string")
    got = {(r["q"], r["doc_id"], r["alias"]) for r in reading.documents_named(asked, planning.alias_index(df), "q", "t").collect()}
    assert got == {(1, 4, "cre"), (2, 1, "sr 11-7")}


def test_plans(spark):
    texts = {1: ("thus must because", "fallback"), 2: ("what is the latest US capital guidance", "single_jurisdiction"), 3: ("what changes are required to the model inventory", "jurisdiction_fanout"), 4: ("how has the guidance changed", "fallback"), 5: ("US and UK rules", "jurisdiction_fanout"), 6: ("CRE old text", "version_fanout"), 7: ("CRE text", "single_document"), 8: ("CRE against SR 11-7", "document_fanout")}
    asked = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "q long, t string")
    named = spark.createDataFrame([(6, 1), (7, 1), (8, 2)], "q long, n_documents int")
    planned = planning.plan_modes(asked, "q", "t", named)
    assert {r["q"]: r["mode"] for r in planned.collect()} == {k: m for k, (_, m) in texts.items()}
    counts = {r["q"]: r["count"] for r in planning.facets(planned, "q").groupBy("q").count().collect()}
    assert counts[1] == 3 and counts[2] == 1 and counts[4] == 3 and counts[5] == 2
    weak = planning.plan_modes(asked.filter("q = 4"), "q", "t", named, weak_version=True)
    assert weak.first()["mode"] == "version_fanout" and planning.facets(weak, "q").count() == 2


def test_gate(spark):
    grid = spark.createDataFrame([("cap", "US", ["a"]), ("cap", "UK", ["b"]), ("mrm", "US", ["c", "d"]), ("dq", "GLOBAL", ["e"])], "subject string, jurisdiction string, names array<string>")
    rows = [
        (1, False, "cap", "US", [], True, "NONE", None, "OUT_OF_DOMAIN"), (2, True, None, None, [], False, "EXACT", None, "ANSWERABLE"), (3, True, "cap", "US", [], True, "ABSENT", True, "OUT_OF_CORPUS"),
        (4, True, "cap", "US", [], True, "ABSENT", False, "ANSWERABLE"), (5, True, "US", None, [], True, "NONE", None, "INCOMPLETE"), (6, True, "dq", None, [], True, "FAMILY", None, "ANSWERABLE"),
        (7, True, "cap", None, [], True, "NONE", None, "INCOMPLETE"), (8, True, "mrm", "UK", [], True, "NONE", None, "INCOMPLETE"), (9, True, "cap", None, ["US", "UK"], True, "NONE", None, "ANSWERABLE"),
        (10, True, "mrm", None, ["US", "UK"], True, "NONE", None, "INCOMPLETE"), (11, True, "cap", None, ["US", "UK"], False, "NONE", None, "INCOMPLETE"),
    ]
    x = spark.createDataFrame(rows, "id long, banking boolean, subject string, jurisdiction string, jurisdictions array<string>, subject_read boolean, name_kind string, document_seen boolean, want string")
    assert [(r["id"], r["decision"]) for r in planning.decide(x, grid).collect() if r["decision"] != r["want"]] == []


def test_files(spark, tmp_path):
    held = tmp_path / "registry.yaml"
    held.write_text("schema_version: 4\ndocuments:\n  - {doc_id: a, short_name: A, verified: true, supersedes: [b]}\n  - {doc_id: b, short_name: B}\n")
    assert [(r["row_ord"], r["doc_id"], r["supersedes"]) for r in files.read_registry(spark, str(held)).collect()] == [(0, "a", ["b"]), (1, "b", [])]
    held.write_text("schema_version: 3\n")
    with pytest.raises(ValueError, match="schema_version"):
        files.read_registry(spark, str(held))
    (tmp_path / "a.csv").write_text("x;y\n1;\n2;NaN\n")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), "x int, y double", ";").collect()
    assert got[0]["y"] is None and math.isnan(got[1]["y"])
    log = spark.createDataFrame([(1, "x")], "id long, what string")
    assert files.append_records(log, str(tmp_path / "log")) and files.append_records(log, str(tmp_path / "log"))
    assert files.read_records(spark, str(tmp_path / "log"), "id long, what string").count() == 2
    assert not files.append_records(log, "nowhere://x")
    keys = files.parse_keys(spark.createDataFrame([("a", b"1"), ("b", b"2")], "doc_id string, content binary"), "v2")
    cache = keys.filter("doc_id = 'a'").unionByName(files.parse_keys(spark.createDataFrame([("a", b"0")], "doc_id string, content binary"), "v1"))
    assert [r["doc_id"] for r in files.cache_misses(keys, cache).collect()] == ["b"]
    assert {r["doc_id"]: (r["cached"], r["n_stale"]) for r in files.cache_status(keys, cache).collect()} == {"a": (True, 1), "b": (False, 0)}
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(tuple(r) for r in files.upserted(old, new, "k").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert files.generated(old, F.col("v"), lambda p: [x.upper() for x in p]).agg(F.max("reply")).first()[0] == "B"


def test_audit_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    events.union(events.limit(50)).write.parquet(str(tmp_path / "log"))
    stream = audit.first_records(audit.read_audit(spark, str(tmp_path / "log"), "parquet"))
    q = audit.to_table(stream.groupBy("event_type").count(), "audit_counts", str(tmp_path / "cp"), "complete")
    q.awaitTermination(120)
    got = {r["event_type"]: r["count"] for r in spark.table("audit_counts").collect()}
    assert got == {r["event_type"]: r["count"] for r in events.groupBy("event_type").count().collect()}
    w = audit.to_table(audit.decisions_by_window(audit.read_audit(spark, str(tmp_path / "log"), "parquet")), "audit_windows", str(tmp_path / "cp2"), "complete")
    w.awaitTermination(120)
    assert spark.table("audit_windows").agg(F.sum("n")).first()[0] == events.count() + 50


def test_brackets_go_to_rows(spark, monkeypatch):
    """Rows of a group are never broadcast or held for its brackets, however sizes are estimated."""
    rows = [(None if i % 3 == 0 else f"g{i % 3}", float(i * i % 101)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v double")
    plan = ft.exact_quantiles(df, "v", {"m": 0.5}, ["g"])
    assert "rightHint=(strategy=broadcast)" in plan._jdf.queryExecution().optimizedPlan().toString()
    want = {g: np.quantile([v for h, v in rows if h == g], 0.5) for g in (None, "g1", "g2")}
    assert {r["g"]: r["m"] for r in plan.collect()} == want
    monkeypatch.setattr(ft, "HELD_GROUPS", 1)  # as with more groups than a task may hold
    plan = ft.exact_quantiles(df, "v", {"m": 0.5}, ["g"])
    assert "rightHint=(strategy=merge)" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert {r["g"]: r["m"] for r in plan.collect()} == want


def test_columns_are_dealt_within_blocks_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(learning, "DEAL_ROWS", 100)
    df = spark.range(2000).select("id", (F.col("id") * 2).alias("x"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("s"))
    blocks = learning.dealt_blocks(df, "id")
    assert 10 <= blocks.count() <= 20
    one, two = (learning.dealt(blocks, "x", seed) for seed in (1, 2))
    assert "Aggregate" not in one._jdf.queryExecution().optimizedPlan().toString() and "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
    a, b = ({r["id"]: r for r in d.collect()} for d in (one, two))
    for rows in (a, b):
        assert sorted(r["x"] for r in rows.values()) == [2 * i for i in range(2000)]
        assert all(r["s"] == (str(i) if i % 7 else None) for i, r in rows.items())
        assert sum(r["x"] == 2 * i for i, r in rows.items()) < 20
    assert sum(a[i]["x"] == b[i]["x"] for i in a) < 100
    assert {r["id"]: r["x"] for r in learning.dealt(learning.dealt_blocks(df.repartition(5), "id"), "x", 1).collect()} == {i: r["x"] for i, r in a.items()}
