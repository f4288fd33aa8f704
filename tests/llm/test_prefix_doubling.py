import random
from collections import Counter

from pyspark.sql import functions as F

from lithic.llm import prefix_doubling as doubling
from lithic.llm import substrings
from lithic.llm.common import written


def test_ranks_over_borders_of_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(40), p, 7, 7, p) for p in range(900)]  # one pair with most rows, over many ranges
    rows += [(rng.randrange(3), 1000 + p, rng.randrange(30), rng.randrange(5), p) for p in range(200)]
    rows += [(50, 2000 + p, 100 + p, 0, p) for p in range(50)]  # each pair once
    table = written(spark.createDataFrame(rows, "text long, pos long, r1 long, r2 long, extra long").repartition(5))
    got = {(r.text, r.pos): r for r in doubling.ranked(table, ["extra"]).collect()}
    times = Counter(r[2:4] for r in rows)
    assert set(got) == {r[:2] for r in rows if times[r[2:4]] > 1}
    pairs = sorted(r[2:4] for r in rows)
    assert all(got[r[:2]].rank == pairs.index(r[2:4]) and got[r[:2]].extra == r[4] for r in rows if r[:2] in got)
    holders = {}
    for r in rows:
        holders.setdefault(r[2:4], set()).add(r[0])
    several = {(t, p) for p, h in holders.items() if len(h) > 1 for t in h}
    assert {(r[0], r[2:4]) for r in rows if r[:2] in got and got[r[:2]].crossed} == several


def test_no_rows(spark):
    table = written(spark.createDataFrame([], "text long, pos long, r1 long, r2 long"))
    assert doubling.ranked(table).count() == 0


def test_positions_against_all_strings(spark):
    rng = random.Random(4)
    base = bytes(rng.choice(b"abc") for _ in range(300))
    for length in (9, 40):
        texts = [base[(a := rng.randrange(200)) : a + rng.randrange(length, 100)] + bytes(rng.choice(b"xyz") for _ in range(30)) for _ in range(25)]
        texts += [b"q" * 90, b"ab" * 40]
        rows = [(i, t, [(0, len(t) - length + 1)]) for i, t in enumerate(texts)]
        met = spark.createDataFrame(rows, "text long, data binary, runs array<struct<first:bigint,starts:bigint>>")
        found = doubling.repeated_positions(written(substrings.named_positions(met, length)), length)
        strings = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
        want = {(i, p) for i, t in enumerate(texts) for p in range(len(t) - length + 1) if strings[t[p : p + length]] > 1}
        assert {(r.text, r.pos) for r in found.select("text", F.col("pos")).collect()} == want
