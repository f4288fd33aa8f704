import random
from collections import defaultdict

from lithic.llm import line_dedup
from lithic.llm.queries import op10_line_dedup
from tests.llm.fixtures import nothing, odd, odd_rows

SF = "/root/testdata/sf0.001"


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain(rows, least=20):
    """Every line against every earlier line of nearly its length."""
    trim = lambda x: x.strip(" \t\r\x0b\x0c")
    places = sorted({(-(1 << 63) if i is None else i, n, t, trim(x)) for i, t in rows if t is not None for n, x in enumerate(t.split("\n"))}, key=lambda p: p[:2])
    by_length, gone = defaultdict(dict), set()
    for i, n, t, x in places:
        if len(x) < least:
            continue
        if any(within_one(x, y) for m in (len(x) - 1, len(x), len(x) + 1) for y, at in by_length[m].items() if at < (i, n)):
            gone.add((i, n, t))
        by_length[len(x)].setdefault(x, (i, n))
    out = []
    for i, t in rows:
        key = -(1 << 63) if i is None else i
        out.append((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (key, n, t) not in gone)))
    return out


def check(spark, rows):
    got = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=order) == sorted(plain(rows), key=order)


def test_corpus_against_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(spark, rows)
    assert op10_line_dedup(spark, SF).count() == 200


def test_edits_and_hot_keys(spark):
    rng = random.Random(9)
    base = ["the quick brown fox jumps over it", "page 17 of the long report ends", "aaaaaaaaaaaaaaaaaaaaaaaa", "šéñ ünïcödé line with äccents here"]
    rows = []
    for i in range(220):
        lines = []
        for _ in range(rng.randint(1, 4)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2])):
                k = rng.randrange(len(x))
                x[k : k + rng.choice([0, 1])] = rng.choice(["", "a", "b", "é"])
            lines.append("".join(x) + rng.choice(["", " ", "\r"]))
        rows.append((i, "\n".join(lines)))
    rows += [(300 + i, f"Invoice number {i % 10}{i // 10:04d} was paid") for i in range(200)]
    rng.shuffle(rows)
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(i, t) for i, t, *_ in odd_rows()]
    check(spark, rows)
    kept = line_dedup.keep_lines(odd(spark))
    assert kept.columns == odd(spark).columns
    assert line_dedup.keep_lines(nothing(spark)).count() == 0
    two = [(1, "a line that is long enough to count"), (2, "a line that is long enough to count"), (3, "")]
    assert sorted(r["doc_id"] for r in line_dedup.keep_lines(spark.createDataFrame(two, "doc_id long, text string")).collect()) == [1, 3]


def test_clashing_names_are_passed_through(spark):
    rows = [(i, "a line that stands here twice, it does\nand one of its own, number " + "abcdef"[i] * 9, "mine", 7, 8, 9, 10, 11) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content_ string, n_dropped_ int, rid int, content int, lines int, dropped int")
    kept = line_dedup.keep_lines(docs)
    assert kept.columns == docs.columns
    assert all(tuple(r)[2:] == ("mine", 7, 8, 9, 10, 11) for r in kept.collect())
    assert sorted(r["text"].count("\n") for r in kept.collect()) == [0, 0, 0, 0, 1]


def test_long_lines_against_all_pairs(spark):
    rng = random.Random(19)
    base = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (2047, 2500, 9000, 40_000)] + ["ab" * 3000]
    rows = []
    for i in range(60):
        x = rng.choice(base)
        k = rng.randrange(len(x))
        x = x[:k] + rng.choice(["", "Z", x[k]]) + x[k + rng.choice([0, 1]) :]
        rows.append((i, x))
    check(spark, rows)


def test_many_lines_and_very_long_lines_take_linear_time(spark):
    import time

    rng = random.Random(20)
    many = "\n".join(f"line {rng.random()} of a text with very many lines" for _ in range(100_000))
    long = "".join(rng.choices("abcdefgh ", k=1_000_000))
    rows = [(1, many), (2, many + "\none more line that is here only"), (3, long), (4, long[:500_000] + "Z" + long[500_001:])]
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: many, 2: "one more line that is here only", 3: long, 4: ""}
    assert time.time() - began < 120


def test_joins_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_TEXTS", 0)
    check(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()])
