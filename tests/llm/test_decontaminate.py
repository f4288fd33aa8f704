import random
import re

import numpy as np

from lithic.llm import decontaminate as dc
from lithic.llm.queries import op3_decontamination
from tests.llm.fixtures import nothing, odd

SF = "/root/testdata/sf0.01"


def cut_words(text):
    """Words as the operator reads them, restated."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D.,;:!?\"'()\[\]{}<>*#%&$|\-_/]+", lowered)


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(12)
    for _ in range(400):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert dc.common_length(a, b) == plain_common(a, b)


def test_latent_space_is_that_of_an_exact_svd(spark):
    rng = np.random.default_rng(13)
    dense = rng.standard_normal((30, 80)) * (rng.random((30, 80)) < 0.2)
    vectors = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in dense]
    full = dc.latent_terms(spark, vectors, 80, 256)
    assert np.allclose(full.T @ full, np.eye(full.shape[1]), atol=1e-8)
    assert np.allclose(dense @ full @ full.T, dense, atol=1e-8)
    low = dc.latent_terms(spark, vectors, 80, 10)
    values = np.linalg.svd(dense, compute_uv=False)
    assert low.shape == (80, 10) and np.linalg.norm(dense @ low) ** 2 > 0.9 * (values[:10] ** 2).sum()


def planted(rng, items, mode):
    words = rng.choice(items).split()
    if mode == "reworded":  # one word in five replaced, none in the last sentence
        words = [w if rng.random() > 0.2 or i > len(words) - 8 else f"other{i}" for i, w in enumerate(words)]
    return words


def test_planted_passages(spark):
    rng = random.Random(14)
    vocabulary = [f"w{i}" for i in range(4000)]
    common = ["the", "of", "and", "to", "in"]
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    items = [" ".join(text(30)) + ". " + " ".join(text(7)) + "." for _ in range(40)]
    rows, leaky = [], set()
    for i in range(300):
        words = text(rng.choice([5, 60, 200, 900]))
        if i % 3 == 0:
            k = rng.randrange(len(words))
            words[k:k] = planted(rng, items, "copied" if i % 2 else "reworded")
            leaky.add(i)
        rows.append((i, " ".join(words).upper() if i % 5 == 0 else " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([*enumerate(items), (98, None), (99, " ")], "item_id long, text string")
    got = {r["doc_id"] for r in dc.find_leaks(docs, benchmark).collect()}
    assert got == leaky
    assert {r["doc_id"] for r in dc.drop_leaks(docs, benchmark).collect()} == {i for i, _ in rows} - leaky


def test_blocks_do_not_change_results(spark, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    pairs = lambda: {(r["doc_id"], r["item_id"], r["n_common"]) for r in dc.find_leaks(docs, benchmark).collect()}
    whole = pairs()
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 17)
    assert pairs() == whole


def test_more_items_than_rank(spark):
    """Copies of a benchmark that fills several blocks are all found, short items too."""
    rng = random.Random(15)
    items = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([16, 24, 48]))) for _ in range(700)]
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    docs = spark.createDataFrame([(i, f"{text(40)} {x} {text(40)}") for i, x in enumerate(items)], "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, benchmark).collect()}
    assert got >= {(i, i) for i in range(len(items))}


def test_long_and_diluted_copies(spark):
    """Copies of long items, and of short ones among benchmark words, are found at any offset."""
    rng = random.Random(16)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [text(n) for n in (6, 12, 16, 48, 200, 400, 600) for _ in range(12)]
    docs = spark.createDataFrame([(i, f"{text(31 + i)} {x} {text(90)}") for i, x in enumerate(items)], "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, benchmark).collect()}
    assert got == {(i, i) for i in range(len(items))}


def test_corpus_against_plain_search(spark):
    """Every item whose words stand in a text one after the other is found, and nothing far from that."""
    strip = cut_words
    texts = {r["doc_id"]: strip(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r["item_id"]: strip(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if any(t[k : k + len(x)] == x for k in (k for k, w in enumerate(t) if w == x[0]))}
    got = {(r["doc_id"], r["item_id"]): r for r in op3_decontamination(spark, SF).collect()}
    assert want and want <= set(got)
    assert all(r["n_common"] >= 0.6 * r["n_words"] for r in got.values())
    assert all(plain_common(texts[d], items[i]) >= r["n_common"] for (d, i), r in got.items())


def test_odd_rows(spark):
    benchmark = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p"), (2, None), (2, "same")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in dc.find_leaks(odd(spark), benchmark).collect())
    assert got == [(4, 1), (9, 2), (10, 2)]
    assert dc.drop_leaks(odd(spark), benchmark).columns == odd(spark).columns
    assert dc.find_leaks(nothing(spark), benchmark).count() == 0
    assert dc.find_leaks(odd(spark), benchmark.limit(0)).count() == 0


def test_only_windows_that_may_hold_an_item_are_looked_at(monkeypatch):
    """Windows are left out by a bound that no cosine passes, and stretches with too few words are not compared."""
    rng = random.Random(17)
    numbers = {}
    items = dc.number_items([(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([20, 45])))) for i in range(30)], numbers)
    weight = np.random.default_rng(17).random(len(numbers)) + 0.01
    search = dc.Search(numbers, items, weight, np.eye(len(numbers)), dc.Limits())
    compared, plain = [], dc.common_length
    monkeypatch.setattr(dc, "common_length", lambda a, b: compared.append(b) or plain(a, b))
    left_out = near_items = 0
    for k in range(60):
        words = [rng.randrange(len(numbers)) if rng.random() < 0.3 else -1 for _ in range(rng.choice([3, 32, 200]))]
        item = rng.choice(items)
        words[10:10] = item.words if k % 3 == 0 else item.words[: len(item.words) // 2] if k % 3 == 1 else []
        ids = np.array(words, np.int32)
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            continue
        opens = np.flatnonzero(np.diff(at // dc.STRIDE, prepend=-1))
        parts = np.add.reduceat(search.latent[ids[at]], opens, axis=0)
        near = set(search.near(ids, at, opens, at[opens] // dc.STRIDE, parts @ search.plain).tolist())
        for w in range(-(-len(ids) // dc.STRIDE)):
            counts = np.zeros(len(numbers))
            held = ids[w * dc.STRIDE : (w + 2) * dc.STRIDE]
            np.add.at(counts, held[held >= 0], 1)
            vector = counts * weight
            high = max((float(vector[t] @ v) / (np.linalg.norm(vector) or 1) for t, v in (dc.item_vector(x, weight) for x in items)), default=0)
            assert high < 0.45 or w in near
            left_out += w not in near
            near_items += high >= 0.45
        compared.clear()
        found = {search.items[i].item_id for i, *_ in search.leaks(ids)}
        assert k % 3 or item.item_id in found
        assert k % 3 != 1 or not compared
    assert left_out and near_items
