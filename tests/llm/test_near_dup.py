import random

import pytest

from lithic.llm import near_dup
from lithic.llm.queries import op6_near_duplicates
from tests.llm.brute import similar_groups
from tests.llm.fixtures import nothing, odd, odd_rows

SF = "/root/testdata/sf0.001"


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_corpus_against_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op6_near_duplicates(spark, SF)
    assert result(got) == similar_groups(rows)
    assert got.filter("kept != (doc_id = component_id)").count() == 0


def test_odd_rows(spark):
    got = near_dup.near_duplicates(odd(spark)).collect()
    rows = odd_rows()
    assert len(got) == len(rows)
    want = similar_groups([(i, t) for i, t, *_ in rows if i is not None])
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert near_dup.near_duplicates(nothing(spark)).count() == 0
    kept = near_dup.keep_one(odd(spark), width=3, percent=85)
    assert kept.columns == odd(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i, *_ in rows if i is not None and want[i][1] == i)


def test_crowd_chain_and_strays(spark):
    """A large copy group, a chain of small edits, and texts just outside."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(400):
        words = base.copy()
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            words[rng.randrange(120)] = f"e{rng.randrange(9999)}"
        rows.append((i, " ".join(words)))
    chain = base[::-1]
    for i in range(60):
        chain = chain.copy()
        chain[(i * 7) % 120] = f"c{i}"
        rows.append((1000 + i, " ".join(chain)))
    rng.shuffle(rows)
    got = result(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == similar_groups(rows)


def test_families_of_several_components(spark):
    """Texts of one template share regions, but only pairs of them are near."""
    rng = random.Random(8)
    rows = []
    for family in range(4):
        template = [f"f{family}w{k}" for k in range(120)]
        for _ in range(40):
            one = template.copy()
            for k in rng.sample(range(120), 2):
                one[k] = f"own{rng.randrange(10**9)}"
            two = one.copy()
            for k in rng.sample(range(120), 2):
                two[k] = f"own{rng.randrange(10**9)}"
            rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(two))]
    rng.shuffle(rows)
    assert result(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == similar_groups(rows)


def test_pairs_that_only_regions_of_two_hold(spark):
    """One tree, many ranges of its order: pairs of two are joined wherever an end of a range falls."""
    rng = random.Random(9)
    rows = []
    for _ in range(400):
        words = [f"p{rng.randrange(10**9)}" for _ in range(70)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words, "more"]))]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        got = result(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), trees=1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    forest = near_dup.Forest(3, 85, 1, 4)
    region = {i: near_dup.prefix_keys(near_dup.signature(near_dup.shingle_set(t, 3)), forest.tree_at, 4)[0] for i, t in rows}
    share = [i for i in range(0, len(rows), 2) if region[i] == region[i + 1]]
    assert len(share) > 300 and all(got[i + 1][1] == i for i in share)


def test_one_id_with_several_texts_and_joins_beyond_the_bounds(spark, monkeypatch):
    """Every text of an id is compared, and their links meet in the id."""
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 0)
    monkeypatch.setattr(near_dup, "BROADCAST_BYTES", 0)
    text = lambda name, own="": " ".join(f"{name}{k}" for k in range(80)) + own
    rows = [(5, text("a")), (5, text("b")), (7, text("a", " x")), (8, text("b", " y")), (9, text("c")), (10, text("d")), (11, text("d")), (11, text("e")), (12, text("e", " z"))]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(5, 5), (7, 5), (8, 5), (9, 9), (10, 10), (11, 10), (12, 10)}


def test_blocks_of_open_pairs(spark, monkeypatch):
    """A crowded region dealt in several blocks gives the links of comparing all pairs."""
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "SETS_AT_ONCE", 1000)
    test_families_of_several_components(spark)


@pytest.mark.parametrize("in_a_task", [500_000, 0])
def test_components_of_random_graphs(spark, monkeypatch, in_a_task):
    monkeypatch.setattr(near_dup, "EDGES_A_TASK", in_a_task)
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).count() == 0
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(500, 500 + i) for i in range(1, 40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked if find(x) != x}
