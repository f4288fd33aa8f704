import re

from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from lithic.llm.common import vocabulary
from lithic.llm.quality import BAD_CHUNK_SHARE, BANDS, CHUNK_BAND, CHUNK_BYTES
from tests.llm.brute import similar_groups
from tests.llm.fixtures import odd
from tests.llm.test_decontaminate import cut_words
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_text_scans import plain_quality

SF = "/root/testdata/sf0.001"


def good(text):
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    data = text.encode()
    if plain_quality(text)[-1]:
        return False
    low, high = next((a, b) for most, a, b in BANDS if len(data) <= most)
    parts = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
    full = [len(press.compress(p)) / CHUNK_BYTES for p in parts if len(p) == CHUNK_BYTES]
    bad = sum(not CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in full)
    return low <= len(press.compress(data)) / len(data) <= high and (not full or bad <= BAD_CHUNK_SHARE * len(full))


def test_stages_against_plain_restatements(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [cut_words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, r["text"]) for i, r in docs.items() if good(r["text"])]
    before = dict(rows)
    rows = [(i, t) for i, t in plain_lines(rows) if t == before[i] or re.search(r"[^\x20\x09-\x0D]", t)]
    groups = similar_groups(rows, 5, 80)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]

    def leaks(text):
        words = cut_words(text)
        return any(words[k : k + len(x)] == x for x in items for k, w in enumerate(words) if w == x[0])

    rows = {i: t for i, t in rows if not leaks(t)}
    library = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["text"] for r in got} == rows
    for r in got:
        assert r["token_ids"] == library.encode(rows[r["doc_id"]]) and r["restored"]
        assert (r["lang"], r["source"], r["n_chars"]) == (docs[r["doc_id"]]["lang"], docs[r["doc_id"]]["source"], len(r["text"]))


def test_columns_and_odd_rows(spark):
    docs = odd(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd(spark).columns
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(r["doc_id"] for r in last.collect()) == [4]
