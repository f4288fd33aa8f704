"""Tokenizer alignment against a plain restatement with the libraries, text by text."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lithic.llm import alignment
from lithic.llm.common import vocabulary
from lithic.llm.queries import op11_tokenizer_alignment
from tests.llm.fixtures import LONG, nothing, odd, odd_rows

SF = "/root/testdata/sf0.001"
A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
first.encode_special_tokens = True
A_BYTES, B_BYTES = alignment.byte_pieces(A), alignment.model_pieces(second)


def plain_groups(text):
    """Lists of (A ids, B ids) a group; none where the bytes aren't those of the text."""
    if not text:
        return []
    a, b, whole = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text), b" " + text.encode()
    if b"".join(A_BYTES[i] for i in a) != whole or b"".join(B_BYTES[i] for i in b) != whole:
        return []
    ends = lambda ids, held: list(np.cumsum([len(held[i]) for i in ids]))
    ea, eb = ends(a, A_BYTES), ends(b, B_BYTES)
    out, i, j = [], 0, 0
    for c in sorted({*ea} & {*eb}):
        x, y = ea.index(c, i) + 1, eb.index(c, j) + 1
        out.append((a[i:x], b[j:y]))
        i, j = x, y
    return out


def plain(rows):
    groups = [(k, plain_groups(t)) for k, t in rows]
    linked = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in groups]
    held = Counter(p for c in linked for p in c)
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for (k, g), c in zip(groups, linked, strict=True):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        sums = (sum(n for p, n in c.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in c.items()))
        out.append((k, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), *sums, hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return out


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r))


def test_query_equals_the_plain_form(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op11_tokenizer_alignment(spark, SF).collect()
    assert by_id(got) == by_id(plain(rows))
    assert {tuple(r)[7] == "" for r in got} >= {False}


def test_odd_rows(spark):
    got = alignment.align(odd(spark), A, B).collect()
    assert by_id(got) == by_id(plain([r[:2] for r in odd_rows()]))
    assert {r[1] for r in got if r[0] in (0, 1)} == {0}
    assert alignment.align(nothing(spark), A, B).collect() == []


def in_one_batch(texts):
    made = alignment.aligner(A, B).batch(7, pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()))
    return made.to_pylist()


PIECES = ["a", "word", " ", "  ", "\n", "\t", " ", " ", "　", "é", "à", "日本", "▁", "'s", "1", "2024", "=", "==", "<|endoftext|>", "<s>", "\x00", "\x1c", "\u0085", "😀", "é", ".", "the"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=6))
def test_parts_are_encoded_as_in_whole_texts(texts):
    want = plain(list(enumerate(texts)))
    got = in_one_batch(texts)
    assert [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in got] == [(*w[:5], w[7]) for w in want]


def test_groups_wider_than_a_slice_of_links(monkeypatch):
    monkeypatch.setattr(alignment, "LINKS", 5)
    monkeypatch.setattr(alignment, "PARTS", 3)
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(40)) for _ in range(30)] + [LONG[:3000]]
    assert [r["n_links"] for r in in_one_batch(texts)] == [w[4] for w in plain(list(enumerate(texts)))]
    rng = np.random.default_rng(1)
    ga, gb = np.repeat(np.arange(4), 50), np.repeat(np.arange(4), 30)
    a, b = rng.integers(0, 9, 200), rng.integers(0, 7, 120)
    keys, times = alignment.linked(ga, a, gb, b, 7, np.arange(4), 63)
    want = Counter((g, x, y) for g, x in zip(ga, a, strict=True) for h, y in zip(gb, b, strict=True) if g == h)
    assert {(k // 63, k % 63 // 7, k % 7): n for k, n in zip(keys.tolist(), times.tolist(), strict=True)} == dict(want)


def test_salted_sums_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BATCHES", 1)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert by_id(alignment.align(docs, A, B).collect()) == by_id(plain(rows))
