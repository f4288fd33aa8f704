import hashlib
import random

import pytest

from lithic.llm import substrings
from lithic.llm.queries import op7_suffix_array_dedup
from tests.llm.fixtures import nothing, odd, odd_rows

SF = "/root/testdata/sf0.01"


def plain(rows, length):
    """For each text: the bytes left, bytes and runs removed, by a table of all strings."""
    places = {}
    for t in rows:
        for p in range(len(t) - length + 1):
            h = hash(t[p : p + length])
            places[h] = places.get(h, 0) + 1
    out = []
    for t in rows:
        gone, runs, until = bytearray(), 0, 0
        for p in range(len(t)):
            if p + length <= len(t) and places[hash(t[p : p + length])] > 1:
                runs += p > until or not until
                until = p + length
            gone.append(p < until)
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), runs, left))
    return out


@pytest.mark.parametrize("source", ["documents", "odd", "edits"])
def test_against_all_strings(spark, source):
    if source == "documents":
        docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 400")
    elif source == "odd":
        docs = odd(spark)
    else:
        rng = random.Random(8)
        base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
        rows = []
        for i in range(60):
            a = rng.randrange(2000)
            cut = base[a : a + rng.choice([380, 399, 400, 401, 450, 700, 1000])]
            if rng.random() < 0.4:
                k = rng.randrange(len(cut))
                cut = cut[:k] + "#" + cut[k + 1 :]
            pad = "".join(rng.choice("xyz") for _ in range(rng.choice([0, 1, 50, 300])))
            rows.append((i, pad + cut + pad[::-1] + (cut if rng.random() < 0.2 else "")))
        rows += [(100, "ab" * 900), (101, "a" * 400), (102, "a" * 399), (103, "b" * 401), (104, None)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in substrings.remove_repeats(docs).collect())
    want = sorted(plain([(r["text"] or "").encode() for r in docs.collect()], 400))
    assert got == want


def plain_shared(texts, length):
    """Whether a text holds a string of ``length`` bytes that stands in another row."""
    holders = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            holders.setdefault(hash(t[p : p + length]), set()).add(i)
    found = {i for h in holders.values() if len(h) > 1 for i in h}
    return [i in found for i in range(len(texts))]


def mixed_rows():
    rng = random.Random(18)
    base = "".join(rng.choice("abcdefgh ") for _ in range(2500))
    rows = []
    for i in range(70):
        a = rng.randrange(2000)
        cut = base[a : a + rng.choice([200, 255, 256, 257, 300, 399, 400, 600])]
        own = "".join(rng.choice("uvwxyz") for _ in range(rng.choice([10, 120, 500])))
        rows.append((i, own + cut + own[::-1] + (own * 2 if rng.random() < 0.2 else "")))
    return [*rows, rows[3], (None, rows[4][1]), (80, "x" * 255), (81, "x" * 255), (82, None), (83, "y" * 700)]


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_shared_passages_and_joins_beyond_the_bound(spark, monkeypatch, bound):
    monkeypatch.setattr(substrings, "BROADCAST_ENTRIES", bound)
    docs = spark.createDataFrame(mixed_rows(), "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"], r["shared"]) for r in substrings.remove_repeats(docs).collect())
    texts = [(r["text"] or "").encode() for r in docs.collect()]
    want = sorted((*x, y) for x, y in zip(plain(texts, 400), plain_shared(texts, 256), strict=True))
    assert got == want


def test_query_and_empty_table(spark):
    rows = op7_suffix_array_dedup(spark, SF).collect()
    assert len(rows) == 1000
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r["kept_sha256"] == empty) == (r["n_removed"] == r["n_bytes"]) for r in rows)
    assert substrings.remove_repeats(nothing(spark)).count() == 0
    assert len(odd_rows()) == substrings.remove_repeats(odd(spark)).count()


def test_one_run_stands_for_all_that_are_equal(spark):
    """A text that repeats itself asks for the positions of one of its equal runs, not of each."""
    rows = [(1, 1, 60 * i, 12, 11, 7, 70) for i in range(40)] + [(2, 2, 5, 12, 11, 7, 71), (3, 3, 5, 12, 11, 7, 70), (4, 4, 5, 12, 11, 8, 80)]
    sure, still = substrings.resolved(spark.createDataFrame(rows, ", ".join(f"{c} long" for c in [*substrings.CONTENT, *substrings.RUN])))
    assert sorted((r.content, r.first) for r in sure.collect()) == [*((1, 60 * i) for i in range(40)), (3, 5)]
    left = [(r.content, r.first) for r in still.collect()]
    assert len(left) == 2 and (2, 5) in left
