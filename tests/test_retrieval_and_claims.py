import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.operators import assembly as asm
from lithic.operators import claims as cl
from lithic.operators import evaluation as ev
from lithic.operators import search as se
from lithic.plans import catalog


def plain_bm25(docs, q):
    n, df = len(docs), Counter(t for d in docs for t in set(d))
    avg = sum(map(len, docs)) / n
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if v < 0 else v for t, v in raw.items()}
    return [sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in q if t in idf) for d in docs]


def test_bm25_against_the_formula(spark):
    texts = ["red fox red", "blue fox", "green dog fox", "blue dog", "fox"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    asked = spark.createDataFrame([(7, "fox red red dog")], "q long, t string")
    got = {r["d"]: r["score"] for r in se.bm25(asked, docs, "q", "t", "d", "t").collect()}
    want = plain_bm25([t.split() for t in texts], "fox red red dog".split())
    assert all(abs(got[i] - want[i]) < 1e-6 for i in got) and set(got) == {0, 1, 2, 3, 4}


def test_fusion_rewards_agreement(spark):
    arm = lambda ids: spark.createDataFrame([(1, i, r) for r, i in enumerate(ids)], "qid long, id string, rank int")
    got = [r["id"] for r in se.fuse({"dense": arm(["a", "b"]), "lexical": arm(["c", "b"])}, ["qid"], "id").orderBy("rank").collect()]
    assert got == ["b", "a", "c"]


def test_dense_filters_before_ranking(spark):
    def v(seed):
        w = np.array([((seed * 7 + j * 13) % 100) / 100 for j in range(16)])
        return (w / np.linalg.norm(w)).tolist()

    rows = spark.createDataFrame([(i, "UK" if i % 5 == 0 else "US", v(i)) for i in range(30)], "id long, j string, vec array<double>")
    asked = spark.createDataFrame([(1, "UK", v(3)), (2, "US", v(4))], "qid long, j string, vec array<double>")
    got = se.dense_top(asked, rows, 5, same=["j"]).collect()
    assert Counter(r["qid"] for r in got) == {1: 5, 2: 5} and all(r["id"] % 5 == 0 for r in got if r["qid"] == 1)
    best = sorted(range(30), key=lambda i: (-round(float(np.dot(v(i), v(4))), 6), i))
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["qid"] == 2] == [i for i in best if i % 5][:5]


def test_query_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(40)], "id long, vec array<double>")
    asked = rows.select(F.col("id").alias("qid"), "vec")
    whole = sorted(se.dense_top(asked, rows, 3).collect())
    monkeypatch.setattr(se, "QUERY_BLOCK", 7)
    assert sorted(se.dense_top(asked, rows, 3).collect()) == whole


HITS = "qid long, facet string, facet_ord int, chunk_id long, parent_id string, pos int, rrf double, rerank double, inferred boolean"


def test_cuts(spark):
    rows = [(1, "A", 0, i, f"p{i}", i, 0.1, s, False) for i, s in enumerate((-1.0, -3.0, -2.0))] + [(1, "B", 1, 10 + i, "q", i, 0.1, 2.0 - i, False) for i in range(3)]
    rows += [(2, "A", 0, 20, "x", 0, 0.1, 9.0, True), (2, "B", 1, 21, "y", 0, 0.1, 2.0, True), (2, "C", 2, 22, "z", 0, 0.1, None, True)]
    hits = spark.createDataFrame(rows, HITS)
    margin = asm.facet_margin(hits)
    assert {r["chunk_id"] for r in margin.filter("not in_margin").collect()} == {21, 22}
    kept = asm.floor_and_rescue(margin.filter("in_margin"))
    assert {r["chunk_id"] for r in kept.filter("rescued").collect()} == {0, 2}
    assert {r["chunk_id"] for r in kept.filter("above").collect()} == {10, 11, 12, 20}
    turns = asm.round_robin(asm.quota(kept.filter("(above or rescued) and not inferred"), 2))
    assert [r["chunk_id"] for r in turns.orderBy("turn").collect()] == [0, 10, 2, 11]
    assert [(r["parent_id"], r["children"]) for r in asm.parents(turns).orderBy("place").collect()] == [("p0", [0]), ("q", [10, 11]), ("p2", [2])]


def test_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(1, 0, 30), (1, 1, 80), (1, 2, 60), (2, 0, 500)], "qid long, place int, chars int")
    assert [r["fits"] for r in asm.within_budget(rows, "place", "chars", 100).orderBy("qid", "place").collect()] == [True, False, True, True]


def test_window_and_containment(spark):
    paras = [f"p{i} " + "x" * 90 for i in range(10)]
    text, trimmed = asm.window_text("\n\n".join(paras), "p5 ", 300)
    assert trimmed and text.startswith("[...]") and text.endswith("[...]") and "p5" in text and "p6" in text and "p4" in text
    assert asm.window_text("short", "x", 300) == ("short", False)
    rows = spark.createDataFrame([(1, "a", "one  two"), (1, "b", "zero one two three"), (1, "c", "one two"), (2, "d", "one two")], "qid long, k string, t string")
    assert {r["k"] for r in asm.contained(rows, "k", ["qid"], "t").collect()} == {"a", "c"}


def test_alignment_verdicts(spark):
    units = [(1, "S1", i, loc, t) for i, (loc, t) in enumerate([("53.1", "backtesting compares realised outcomes with model estimates"), ("53.2", "collateral haircuts apply quarterly across exposures"), ("", "governance committees approve material changes annually")])]
    said = [(1, 1, "Backtesting compares realised outcomes", "S1"), (1, 2, "unrelated words entirely here", "S1"), (1, 3, "governance committees approve material changes", "S1"), (1, 4, "no such label", "S9")]
    got = cl.align(spark.createDataFrame(said, "qid long, claim_no int, text string, label string"), spark.createDataFrame(units, "qid long, label string, pos int, locator string, text string")).orderBy("claim_no").collect()
    assert [r["verdict"] for r in got] == ["MATCH", "FLOOR", "NOLOC", "EMPTY"] and got[0]["moved_to"] == "53.1"
    twin = [(1, "S1", 0, "1.1", "capital must be held"), (1, "S1", 1, "1.2", "capital must be held")]
    tie = cl.align(spark.createDataFrame([(1, 1, "capital held", "S1")], "qid long, claim_no int, text string, label string"), spark.createDataFrame(twin, "qid long, label string, pos int, locator string, text string"))
    assert tie.first()["verdict"] == "TIE"


def test_alignment_shuffles_answers_and_no_pairs(spark):
    """Claims are grouped once and units once; scores equal all pairs scored one by one."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(12)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    units = [(q, "S1", p, f"{p}.1", some(8)) for q in range(6) for p in range(q)]
    said = [(q, c, some(5) if c else None, "S1") for q in range(6) for c in range(7)]
    claims_ = spark.createDataFrame(said, "qid long, claim_no int, text string, label string")
    found = cl.align(claims_, spark.createDataFrame(units, "qid long, label string, pos int, locator string, text string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
    got = {(r["qid"], r["claim_no"]): (r["best"], r["runner_up"]) for r in found.collect()}
    for q, c, text, _ in said:
        held = [set(t.split()) for i, _, _, _, t in units if i == q]
        w = {t: math.log((len(held) + 1) / (sum(t in u for u in held) + 0.5)) if any(t in u for u in held) else 1.0 for t in words}
        mine = (text or "").split()
        scores = sorted([sum(w[t] for t in mine if t in u) / sum(w[t] for t in mine) if mine else 0.0 for u in held] + [0.0, 0.0], reverse=True)
        assert got[q, c] == pytest.approx(tuple(scores[:2]), abs=1e-6)
    assert [cl.half_up(x) for x in (1 / 128, 0.0, 1.0, 2 / 3)] == [0.007813, 0.0, 1.0, 0.666667]


def test_answers_are_numbered_by_citation(spark):
    rows = [(1, 0, "First point.", "B"), (1, 1, "Second", "A"), (1, 2, "Third?", "B"), (1, 3, "Fourth!", None), (1, 4, " ", "A")]
    got = cl.format_answers(spark.createDataFrame(rows, "qid long, claim_no int, text string, citation string")).first()
    assert got["body"] == "First point [1]. Second [2]. Third [1]? Fourth [unattributed]!"
    assert got["sources"] == "[1] B\n[2] A"


SMALL = "/root/testdata/sf0.001"


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    return calls


@pytest.mark.parametrize("name", ["drop_ledger", "loss_resolution", "fell_out"])
def test_questions_search_once(spark, monkeypatch, name):
    calls, pairs = counted(monkeypatch, se, "lexical_arms"), counted(monkeypatch, se, "bm25")
    assert catalog.QUERIES[name](spark, SMALL).count() > 0
    assert (len(calls), len(pairs)) == (1, 0)


def test_gaps_are_made_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ev, "rank_quartiles", lambda rows, value: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()))
    catalog.QUERIES["claim_gap_quartiles"](spark, SMALL)
    assert "Window" not in seen[0] and "MapInArrow" not in seen[0]


def test_first_found_is_the_least_key_with_a_score(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(rng.randrange(10**6), " ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.randrange(0, 9)))) for _ in range(300)]
    asks = [(i, " ".join(rng.choice("abcdefghijklmnopz") * 2 for _ in range(3))) for i in range(20)] + [(99, "zz"), (100, None)]
    corpus, questions = spark.createDataFrame(docs, "id long, t string"), spark.createDataFrame(asks, "q long, t string")
    want = {r["q"]: r["id"] for r in se.bm25(questions, corpus, "q", "t", "id", "t").filter("score > 0").groupBy("q").agg(F.min("id").alias("id")).collect()}
    for cells in (1_000_000, 7):  # as with more questions than a task holds scores for
        monkeypatch.setattr(se, "BLOCK_CELLS", cells)
        assert {r["q"]: r["id"] for r in se.first_found(questions, corpus, "q", "t", "id", "t").collect()} == want


def test_lexical_blocks_are_bounded_in_cells(spark, monkeypatch):
    wide = np.array([3, 1, 9, 0, 2, 2, 5])
    parts = list(se._pieces(wide, 4))
    assert [x for s in parts for x in wide[s]] == wide.tolist() and all(wide[s].sum() <= 4 or s.stop - s.start == 1 for s in parts)
    rng = random.Random(9)
    corpus = spark.createDataFrame([(i, " ".join(rng.choice("abcdefghijkl") * 2 for _ in range(6))) for i in range(200)], "id long, t string")
    questions = spark.createDataFrame([(i, " ".join(rng.choice("abcdefghijkl") * 2 for _ in range(2))) for i in range(10)], "q long, t string")
    best = lambda: sorted(map(tuple, se.lexical_top(se.lexical_arms(questions, corpus, "q", "t", "id", "t", 5), "q", "id", 5).select("q", "id", "score", "rank").collect()))
    want = best()
    monkeypatch.setattr(se, "BLOCK_CELLS", 9)
    monkeypatch.setattr(se, "SLICE_DOCS", 3)
    assert best() == want
