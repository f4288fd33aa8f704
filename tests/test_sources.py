"""Stored collections, versions, prompt files, bounded lexical search and bracketed quantiles."""

import math
import os
import random
import re
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.operators import features as ft
from lithic.operators import search
from lithic.sources import collection, files


def chunks(spark, n=400):
    return spark.range(n).select(F.col("id").alias("chunk_id"), F.when(F.col("id") % 10 == 0, "UK").when(F.col("id") % 10 == 1, "US").otherwise("GLOBAL").alias("jurisdiction"), (F.col("id") % 7).alias("parent_id"), F.repeat(F.lit("x"), 20).alias("text"))


def files_read(df):
    """Files that a scan opened, by its own metric."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_collection_prunes_files_and_pages_by_key(spark, tmp_path):
    path = str(tmp_path / "held")
    assert collection.create(chunks(spark), path, "chunk_id", ["jurisdiction"])
    assert not collection.create(chunks(spark, 10), path, "chunk_id", ["jurisdiction"])
    whole = files.latest(spark, path)
    one = collection.searched(spark, path, jurisdiction="UK")
    assert one.count() == 40 and collection.searched(spark, path, jurisdiction=["UK", "US"], parent_id=3).count() == len([i for i in range(400) if i % 10 < 2 and i % 7 == 3])
    assert 0 < files_read(one.filter("true")) < files_read(whole.filter("true"))
    held = list(collection.pages(whole, "chunk_id", 150))
    assert [len(p) for p in held] == [150, 150, 100] and [r["chunk_id"] for p in held for r in p] == list(range(400))
    assert list(collection.pages(whole.filter("chunk_id < 300"), "chunk_id", 150))[1][-1]["chunk_id"] == 299
    wanted = spark.createDataFrame([(3,), (3,), (5,), (900,)], "chunk_id long")
    assert collection.looked_up(whole, wanted, "chunk_id").count() == 2
    assert collection.stats(whole, "parent_id", ["jurisdiction"]).first().asDict() == {"n_chunks": 400, "n_parents": 7, "n_jurisdiction": 3}
    assert collection.create(chunks(spark, 10), path, "chunk_id", ["jurisdiction"], recreate=True) and files.latest(spark, path).count() == 10
    assert whole.count() == 400  # a reader that began before goes on


def test_a_failed_or_running_write_is_never_seen(spark, tmp_path):
    path = str(tmp_path / "parents")
    with pytest.raises(FileNotFoundError):
        files.latest(spark, path)
    files.replaced(spark.range(5), path)
    failing = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        files.replaced(failing, path)
    assert files.versions(spark, path) == [1] and files.latest(spark, path).count() == 5
    assert not [p for p in (tmp_path / "parents").iterdir() if p.name.startswith("_writing")]
    seen, done = set(), threading.Event()

    def read():
        while not done.is_set():
            seen.add(files.latest(spark, path).count())

    reader = threading.Thread(target=read)
    reader.start()
    for n in (6, 7, 8):
        files.replaced(spark.range(n), path, keep=9)
    done.set()
    reader.join()
    assert seen <= {5, 6, 7, 8} and files.latest(spark, path).count() == 8
    writers = [threading.Thread(target=files.replaced, args=(spark.range(n), path, 99)) for n in (20, 30)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert files.versions(spark, path)[-1] == 6 and files.latest(spark, path).count() in (20, 30)
    files.replaced(spark.range(1), path, keep=2)
    assert files.versions(spark, path) == [6, 7]


def test_files_of_prompts_runs_and_tables(spark, tmp_path):
    (tmp_path / "gate.txt").write_text("Subjects: {subjects}. ANSWER")
    text, sha = files.prompt_text(spark, str(tmp_path / "gate.txt"), ("ANSWER",), subjects="a, b")
    assert text == "Subjects: a, b. ANSWER" and len(sha) == 16
    with pytest.raises(ValueError, match="lacks"):
        files.prompt_text(spark, str(tmp_path / "gate.txt"), ("LABEL",))
    assert files.why_unavailable(lambda: 1) == "" and files.why_unavailable(lambda: 1 / 0).startswith("ZeroDivisionError")
    (tmp_path / "x.csv").write_text("a,b\n1,2.5\n3,\n")
    files.csv_to_parquet(spark, str(tmp_path / "x.csv"), str(tmp_path / "x"), "a int, b double")
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "x")).orderBy("a").collect()] == [(1, 2.5), (3, None)]
    for i, name in enumerate(("one.json", "two.json")):
        (tmp_path / name).write_text("{}")
        os.utime(tmp_path / name, (1_700_000_000 - i, 1_700_000_000 - i))
    assert files.newest(spark, str(tmp_path)).endswith("one.json")
    listed = files.listing(spark, str(tmp_path), "*.json")
    assert {r["file"] for r in listed.collect()} == {"one.json", "two.json"}
    rows = spark.createDataFrame([("CRE1.1", "Scope", "t"), ("", "Scope", "t"), ("CRE1.1", "CRE1.1", "t")], "l string, h string, t string")
    assert [r[0] for r in rows.select(search.pair_text(F.col("l"), F.col("h"), F.col("t"))).collect()] == ["CRE1.1. Scope. t", "Scope. t", "CRE1.1. t"]


def plain_bm25(questions, corpus):
    """(qid, doc) -> score, and the weighted share of different tokens."""
    cut = lambda t: [p for x in re.findall(r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*", (t or "").lower()) for p in ([x, *filter(None, re.split(r"[.\-/]", x))] if re.search(r"[.\-/]", x) else [x])]
    docs = {i: Counter(cut(t)) for i, t in corpus}
    mean, df = sum(map(Counter.total, docs.values())) / len(docs), Counter(t for d in docs.values() for t in d)
    raw = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if v < 0 else v for t, v in raw.items()}
    out = {}
    for q, t in questions:
        asked = {x: n for x, n in Counter(cut(t)).items() if x in idf}
        whole = sum(idf[x] for x in asked) or 1.0
        for i, d in docs.items():
            if any(x in d for x in asked):
                part = lambda x, d=d: idf[x] * d[x] * 2.5 / (d[x] + 1.5 * (0.25 + 0.75 * d.total() / mean))
                out[q, i] = sum(n * part(x) for x, n in asked.items() if x in d), sum(idf[x] for x in asked if x in d) / whole
    return out


@pytest.mark.parametrize("terms", [200_000, 12])
def test_bounds_skip_no_document_of_the_best(spark, monkeypatch, terms):
    monkeypatch.setattr(search, "BLOCK_TERMS", terms)
    monkeypatch.setattr(search, "BLOCK_DOCS", 16)
    rng = random.Random(2)
    names = [f"w{i}" for i in range(60)] + ["a-b", "1.2/c", "Über", "the"]
    text = lambda n: " ".join(rng.choices(names, [1 / (i + 1) for i in range(len(names) - 1)] + [3], k=n))
    corpus = [(i, text(rng.choice([0, 3, 20, 60]))) for i in range(300)] + [(300, None)]
    questions = [(q, text(6)) for q in range(12)] + [(12, ""), (13, None), (14, "nowhere")]
    q, c = spark.createDataFrame(questions, "qid long, q string"), spark.createDataFrame(corpus, "id long, t string").repartition(3)
    got = {(r["qid"], r["id"]): (r["score"], r["cover"]) for r in search.lexical_arms(q, c, "qid", "q", "id", "t", k=5).collect()}
    want = plain_bm25(questions, corpus)
    assert all(abs(a - b) < 2e-6 for p, both in got.items() for a, b in zip(both, want[p], strict=True))
    for qid in range(15):
        for arm in (0, 1):
            best = sorted(((-round(s[arm], 6), i) for (k, i), s in want.items() if k == qid and s[arm] > 0))[:5]
            mine = sorted((-s[arm], i) for (k, i), s in got.items() if k == qid and s[arm] > 0)[:5]
            assert [x[0] for x in mine] == pytest.approx([x[0] for x in best], abs=2e-6)


@pytest.mark.parametrize("sketch", [10_000, 40])
def test_quantiles_within_brackets(spark, monkeypatch, sketch):
    monkeypatch.setattr(ft, "SKETCH", sketch)
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=3000), "b": np.round(rng.normal(size=2000), 1), "c": np.array([1.0]), "d": np.array([2.0, 5.0]), None: rng.exponential(size=900)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("b", float("nan")), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    wanted = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "hi": 1.0}
    got = {r["g"]: r for r in ft.exact_quantiles(df, "v", wanted, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose([got[g][n] for n in wanted], np.quantile(vs, list(wanted.values())), atol=1e-12)
    every = np.concatenate(list(groups.values()))
    assert np.allclose(list(ft.exact_quantiles(df, "v", wanted).first()), np.quantile(every, list(wanted.values())), atol=1e-12)
    assert list(ft.exact_quantiles(df.filter("false"), "v", wanted).first()) == [None] * 5
