import random

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from lithic.llm import sentencepiece_arrays as sa
from lithic.llm.common import vocabulary
from lithic.llm.queries import op2_sentencepiece
from tests.llm.fixtures import nothing, odd

SF = "/root/testdata/sf0.001"
FILE = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=FILE)


def id_lists(held, texts):
    ids, sizes = held.encode(texts)
    assert held.decode_all(ids, sizes).to_pylist() == [t.replace("▁", " ") for t in texts]
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_random_texts_equal_the_library(library):
    rng, held = random.Random(10), sa.Model(FILE)
    texts = ["".join(rng.choice("abcdefthnioes  '▁\n\tstv,.!éßΣİñ日9½́😀") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [" " * k + "x" + " " * (40 - k) for k in range(40)] + ["a" * 3000, "the" * 900, "日本語" * 300]
    for t, ids in zip(texts, id_lists(held, texts), strict=True):
        assert ids == library.encode(t), repr(t)
        assert held.decode(np.array(ids, np.int64)) == t.replace("▁", " ")


def test_bounds_do_not_change_results(library, monkeypatch):
    monkeypatch.setattr(sa, "WINDOW", 500)
    monkeypatch.setattr(sa, "PARTS", 40)
    monkeypatch.setattr(sa, "PAIRS", 50)
    monkeypatch.setattr(sa, "BLOCK_CHARS", 200)
    held, rng = sa.Model(FILE), random.Random(11)
    texts = [" ".join("".join(rng.choice("ethanion") for _ in range(rng.randint(1, 12))) for _ in range(40)) for _ in range(60)]
    for _ in range(2):
        assert id_lists(held, texts) == library.encode(texts)


def test_parts_of_one_key_are_told_apart(library, monkeypatch):
    monkeypatch.setattr(sa, "part_keys", lambda points, first, length: (points[first] % 3).astype(np.uint64))
    held, rng = sa.Model(FILE), random.Random(12)
    texts = [" ".join("".join(rng.choice("ethanion日é") for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(20)]
    for _ in range(2):
        assert id_lists(held, texts) == library.encode(texts)


def test_documents(spark, library):
    rows = op2_sentencepiece(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r["token_ids"] == library.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["token_ids"]) and r["restored"]


def test_odd_rows(spark, library):
    coded = sa.encode_documents(odd(spark), FILE, n_col="n_chars", decoded_col="line")
    assert sorted(coded.columns) == sorted([*odd(spark).columns, "token_ids"])
    for r in coded.collect():
        assert r["token_ids"] == library.encode(r["text"] or "") and r["line"] == (r["text"] or "") and r["n_chars"] == len(r["token_ids"])
    again = sa.decode_documents(coded, FILE).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in again)
    assert sa.encode_documents(nothing(spark), FILE).count() == 0
