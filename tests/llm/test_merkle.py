"""The manifest against trees built plainly: sources of one row, of a bucket and of several."""

import hashlib
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lithic.llm import merkle
from lithic.llm.queries import op13_merkle_manifest
from tests.llm.fixtures import nothing, odd, odd_rows

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def joined(*values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def leaf(row):
    return joined(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([joined(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, i):
    for nodes in levels[:-1]:
        run = nodes[i // 16 * 16 :][:16]
        yield run[: i % 16], run[i % 16 + 1 :]
        i //= 16


def plain(rows):
    """Rows of NAMES from (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((leaf(r), r))
    for held in by.values():
        held.sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climbed([h for h, _ in by[s]]) for s in order}
    top = climbed([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for i, (own, r) in enumerate(by[s]):
            sides = [*siblings(trees[s], i), *siblings(top, j)]
            made = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                made = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in sides:
                made = joined(*left, made, *right)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], joined(*(x for a, b in sides for x in (*a, *b))), made, made == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=str)


def made(docs):
    return found(merkle.manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0))


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(op13_merkle_manifest(spark, "/root/testdata/sf0.001")) == plain([tuple(r) for r in docs.select(*COLUMNS).collect()])


def test_odd_rows(spark):
    want = plain([(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows()])
    assert made(odd(spark)) == want
    assert made(nothing(spark)) == []
    one = spark.createDataFrame([(7, "Text", None, None, 4)], "doc_id long, text string, lang string, source string, n_chars int")
    assert made(one) == plain([(7, None, None, 4, "Text")])


@pytest.mark.parametrize("count", [16, 17, 4097])
def test_a_source_of_several_buckets(spark, count):
    rows = [(i // 2 if i < 50 else i, "big" if i < count else f"s{i % 300}", None, i, f"Text {i}") for i in range(count + 400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert made(df) == plain(rows)


def test_batches_are_cut_at_buckets():
    size = merkle.BUCKET
    rows = [("a", i) for i in range(3 * size + 5)] + [("b", i) for i in range(10)]
    batches = [pa.RecordBatch.from_pylist([{"tree": t, "pos": p} for t, p in rows[i : i + 1500]]) for i in range(0, len(rows), 1500)]
    tables = list(merkle.whole_buckets(iter(batches)))
    assert [r for t in tables for r in zip(t["tree"].to_pylist(), t["pos"].to_pylist(), strict=True)] == rows
    held = [{(t, p // size) for t, p in zip(x["tree"].to_pylist(), x["pos"].to_pylist(), strict=True)} for x in tables]
    assert sum(map(len, held)) == len(set().union(*held)) and max(x.num_rows for x in tables) <= 2 * size + 1500
