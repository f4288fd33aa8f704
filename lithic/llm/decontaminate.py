"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages are TF-IDF vectors over their own terms, weighted by the document frequency of
each term over all passages (stretches of STRIDE words) of all documents. A distributed randomised
SVD of these vectors gives a latent space of at most ``rank`` dimensions: a random projection,
its Gram matrix summed over partitions for an orthonormal basis, the basis times the vectors
summed a term, and a small eigenproblem. Windows of 2 * STRIDE words of every document are
folded in, and the cosine of a window's vector with each item as the latent space holds it gives
candidates. So do windows that follow the item's length: in as many stretches as surely hold SPREAD
times the item, a copy that the limits accept gives the window's vector a product with the item of at
least the sum over the item's least weighty words, as many as the limits ask for. No such copy stays
under that bound, whatever the item's length and the text around it. Where those words have no
weight at all, the words of the item in the window are counted instead. A candidate is a leak when its longest common subsequence of words with the item,
within the best stretch of SPREAD times the item's length, holds ``copied`` of the item's words;
or, for paraphrases, ``reworded`` of them together with ``answered`` of the item's last sentence.

Benchmarks are taken in blocks of BLOCK_ITEMS, and of ``rank`` items at most: so the latent space
loses nothing, the cosine is that of the TF-IDF vectors, the size of the benchmark does not change
results, and what is sent to tasks is bounded for any benchmark; documents are read whole, in one narrow pass for frequencies and one
for the search, and nothing of them is shuffled but counts a term and the leaks found.

Terms in more than COMMON of all passages have no weight, except in items with under three other
terms. Words are runs of bytes other than ASCII white space and the punctuation of CUTS,
A-Z lower-cased. Defined cases: null and empty texts and items hold no words and match nothing;
repeated rows are judged each on their own, repeated items match each; equal scores are all kept; an
empty table gives no rows; other columns are passed through by ``drop_leaks``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import give_back, let_go, sliced, with_small_batches

STRIDE, COMMON, SPREAD, BLOCK_ITEMS, OVERSAMPLE = 32, 0.05, 1.4, 256, 16
#: Bytes that part words beside ASCII white space; A-Z become a-z.
CUTS = b".,;:!?\"'()[]{}<>*#%&$|-_/"
TABLE = bytes(ord(" ") if b in CUTS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


def term_numbers(text: str, numbers: dict[bytes, int]) -> np.ndarray:
    """The number of each word of a text; -1 for words that no item has."""
    words = words_of(text)
    return np.fromiter(map(numbers.get, words, repeat(-1)), np.int32, len(words))


def item_words(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of an item, and those of its last sentence if it has several."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text) if words_of(s)]
    return words_of(text), words_of(sentences[-1]) if len(sentences) > 1 else []


class Item(NamedTuple):
    item_id: int
    words: list[int]
    answer: list[int]


def number_items(rows: list, taken: dict[bytes, int]) -> list[Item]:
    """Items as numbers of terms; ``taken`` gets the numbers."""
    out = []
    for item_id, text in rows:
        words, answer = item_words(text or "")
        out.append(Item(item_id, [taken.setdefault(w, len(taken)) for w in words], [taken[w] for w in answer]))
    return out


def passage_counts(docs: DataFrame, numbers: dict[bytes, int], text_col: str) -> tuple[int, np.ndarray]:
    """How many passages all documents have, and in how many each term occurs."""
    n_terms = len(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passages = np.zeros(n_terms, np.int64), 0
        for batch in batches:
            for part in sliced(batch):
                for text in part.column("text").to_pylist():
                    ids = term_numbers(text, numbers)
                    passages += -(-len(ids) // STRIDE)
                    at = np.flatnonzero(ids >= 0)
                    if len(at):
                        held += np.bincount(np.unique((at // STRIDE) * n_terms + ids[at]) % n_terms, minlength=n_terms)
        some = np.flatnonzero(held)
        numbered = np.concatenate([some, [-1]])
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(numbered, pa.int64()), pa.array(np.concatenate([held[some], [passages]]), pa.int64())], ["term", "n"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    summed = with_small_batches(texts).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term of the block
    out = np.zeros(n_terms, np.int64)
    total = 0
    for r in summed:
        if r["term"] < 0:
            total = r["n"]
        else:
            out[r["term"]] = r["n"]
    return total, out


def term_weights(items: list[Item], total: int, held: np.ndarray) -> np.ndarray:
    """Inverse passage frequency, 0 for common terms but in items that have hardly any other."""
    weight = np.log((total + 1) / (held + 1)) + 1e-3
    common = held > COMMON * max(1, total)
    for item in items:
        if len({w for w in item.words if not common[w]}) < 3:
            common[list(set(item.words))] = False
    return np.where(common, 0.0, weight)


def reach_of(n: int) -> int:
    """Words of the stretch within which an item of ``n`` words must be found."""
    return int(SPREAD * n) + 4


def item_vector_values(item: Item, weight: np.ndarray) -> np.ndarray:
    terms, times = np.unique(np.array(item.words, np.int64), return_counts=True)
    return times * weight[terms]


def item_vector(item: Item, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and values of an item's TF-IDF vector of length 1."""
    terms, times = np.unique(np.array(item.words, np.int64), return_counts=True)
    values = times * weight[terms] if len(terms) else np.empty(0)
    norm = math.sqrt(float((values**2).sum())) or 1.0
    some = values > 0
    return terms[some], values[some] / norm


def latent_terms(spark, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, rank: int) -> np.ndarray:
    """The right singular vectors (terms x dimensions) of the items' vectors, by a randomised SVD."""
    width = max(1, min(len(vectors), rank + OVERSAMPLE))
    rows = [(i, t.tolist(), v.tolist()) for i, (t, v) in enumerate(vectors) if len(t)]
    if not rows:
        return np.zeros((n_terms, 1))
    table = spark.createDataFrame(rows, "item long, terms array<long>, vals array<double>").repartition(max(1, len(rows) // 256), "item")

    def project(terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """A row times a Gaussian matrix whose rows are drawn from the terms' numbers."""
        return values @ np.stack([np.random.default_rng(t + 1).standard_normal(width) for t in terms])

    def local(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.array(t), np.array(v)) for t, v in zip(batch.column("terms").to_pylist(), batch.column("vals").to_pylist(), strict=True)]

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = np.array([project(t, v) for t, v in local(batch)]).reshape(-1, width)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    added = sum(np.frombuffer(r["part"]).reshape(width, width) for r in table.mapInArrow(gram, "part binary").collect())
    values, vectors_of = np.linalg.eigh(added)
    some = values > values[-1] * 1e-12
    whiten = vectors_of[:, some] / np.sqrt(values[some])
    narrow = whiten.shape[1]

    def by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, v in local(batch):
                q = project(t, v) @ whiten
                for term, value in zip(t.tolist(), v.tolist(), strict=True):
                    sums[term] = sums.get(term, 0.0) + value * q
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["term", "part"])

    def summed(held: pd.DataFrame) -> pd.DataFrame:
        out = [(term, np.sum([np.frombuffer(p) for p in g["part"]], axis=0).tobytes()) for term, g in held.groupby("term")]
        return pd.DataFrame(out, columns=["term", "part"])

    parts = table.mapInArrow(by_term, "term long, part binary").withColumn("bucket", F.pmod("term", F.lit(16)))
    rows = parts.groupBy("bucket").applyInPandas(lambda pdf: summed(pdf), "term long, part binary").collect()
    basis = np.zeros((n_terms, narrow))
    for r in rows:
        basis[r["term"]] = np.frombuffer(r["part"])
    values, rotation = np.linalg.eigh(basis.T @ basis)
    keep = [i for i in np.argsort(-values)[:rank] if values[i] > values.max() * 1e-12]
    return basis @ (rotation[:, keep] / np.sqrt(values[keep]))


def common_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``b``."""
    places: dict[int, int] = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        if hit := row & places.get(x, 0):
            row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


class Limits(NamedTuple):
    cosine: float = 0.45
    copied: float = 0.8
    reworded: float = 0.6
    answered: float = 0.6


class Search:
    """What a task needs to find the leaks of one block of items in whole texts."""

    def __init__(self, numbers: dict[bytes, int], items: list[Item], weight: np.ndarray, latent: np.ndarray, limits: Limits):
        items = sorted(items, key=lambda x: reach_of(len(x.words)))  # so that items of one span are neighbours
        self.numbers, self.items, self.weight, self.limits = numbers, items, weight.astype(np.float32), limits
        self.latent = (latent * weight[:, None]).astype(np.float32)
        folded = np.zeros((len(items), latent.shape[1]), np.float32)
        for i, item in enumerate(items):
            t, v = item_vector(item, weight)
            folded[i] = v @ latent[t]
        length = np.linalg.norm(folded, axis=1, keepdims=True)
        self.folded = np.divide(folded, length, out=np.zeros_like(folded), where=length > 0).T
        self.shorten = np.divide(1, length, out=np.zeros_like(length), where=length > 0).T
        # Products need the items as they are; one column more of ``holds`` stands for words of no item.
        self.plain = folded.T
        self.holds = np.zeros((len(items), len(numbers) + 1), bool)
        self.bound, self.asked = np.zeros(len(items)), np.zeros(len(items))
        self.spans = np.zeros(len(items), np.int64)
        for i, item in enumerate(items):
            n = len(item.words)
            self.holds[i, item.words] = True
            self.asked[i] = min(limits.copied, limits.reworded) * n if item.answer else limits.copied * n
            squares = np.sort(weight[item.words] ** 2)[: math.ceil(self.asked[i] - 1e-9)]
            norm = math.sqrt(float((item_vector_values(item, weight) ** 2).sum())) or 1.0
            self.bound[i] = float(squares.sum()) / norm * 0.999 - 1e-6
            self.spans[i] = (reach_of(n) - 2) // STRIDE + 2
        ends = np.flatnonzero(np.diff(self.spans, append=-1)) + 1
        self.alike = [(int(self.spans[e - 1]), slice(int(b), int(e))) for b, e in zip([0, *ends[:-1]], ends, strict=True)]

    def leaks(self, ids: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first word, words in common, cosine) of each item's best leak in a text."""
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return []
        found: dict[int, tuple[int, int, float]] = {}
        at = at[self.weight[ids[at]] > 0]
        opens = np.flatnonzero(np.diff(at // STRIDE, prepend=-1))
        parts = np.add.reduceat(self.latent[ids[at]], opens, axis=0) if len(at) else self.latent[:0]
        here, product = at[opens] // STRIDE, parts @ self.plain
        if len(at):
            self.by_cosine(ids, at, opens, here, parts, product, found)
        self.by_bound(ids, here, product, found)
        return [(int(i), *found[i]) for i in sorted(found)]

    def near(self, ids: np.ndarray, at: np.ndarray, opens: np.ndarray, here: np.ndarray, product: np.ndarray) -> np.ndarray:
        """Windows of two stretches whose cosine with an item may be high enough.

        A vector is no shorter than if each occurrence of a word were a term of its own.
        """
        n = -(-len(ids) // STRIDE)
        most, squares = np.zeros((n + 1, len(self.items)), np.float32), np.zeros(n + 1, np.float32)
        most[here], squares[here] = product, np.add.reduceat(self.weight[ids[at]] ** 2, opens)
        least = np.sqrt(squares[:-1] + squares[1:])
        most = ((most[:-1] + most[1:]) * self.shorten).max(axis=1)
        return np.flatnonzero((least > 0) & (most >= (self.limits.cosine - 1e-3) * least))

    def by_cosine(self, ids: np.ndarray, at: np.ndarray, opens: np.ndarray, here: np.ndarray, parts: np.ndarray, product: np.ndarray, found: dict[int, tuple[int, int, float]]) -> None:
        """Leaks around windows of two stretches whose cosine with an item is high."""
        window = self.near(ids, at, opens, here, product)
        if not len(window):
            return
        # A window is two neighbouring stretches: a word lies in the one that its stretch begins,
        # and in the one before, if there is one.
        n = -(-len(ids) // STRIDE)
        asked, place = np.zeros(n + 1, bool), np.full(n + 1, len(here))
        asked[window], place[here] = True, np.arange(len(here))
        stretch, term = at // STRIDE, ids[at]
        own, later = asked[stretch], asked[stretch - 1]  # the last of ``asked`` stands before the first
        keys, times = np.unique(np.concatenate([stretch[own], stretch[later] - 1]) * len(self.weight) + np.concatenate([term[own], term[later]]), return_counts=True)
        first = np.flatnonzero(np.diff(keys // len(self.weight), prepend=-1))
        norm = np.sqrt(np.add.reduceat((times * self.weight[keys % len(self.weight)]) ** 2, first))
        padded = np.concatenate([parts, np.zeros_like(parts[:1])])
        scores = ((padded[place[window]] + padded[place[window + 1]]) @ self.folded) / norm[:, None]
        for w, i in zip(*np.nonzero(scores >= self.limits.cosine), strict=True):
            start = int(window[w]) * STRIDE
            hit = self.verified(ids, start, int(i))
            if hit and (i not in found or hit[1] > found[i][1]):
                found[i] = (*hit, float(scores[w, i]))

    def by_bound(self, ids: np.ndarray, here: np.ndarray, product: np.ndarray, found: dict[int, tuple[int, int, float]]) -> None:
        """Leaks of items not found yet, in windows of each item's own length that reach its bound."""
        n = -(-len(ids) // STRIDE)
        summed = np.zeros((n + 1, len(self.items)))
        if len(here):
            summed[here + 1] = product
            summed = summed.cumsum(axis=0)
        first = np.arange(n)
        for span, some in self.alike:
            over = summed[np.minimum(first + span, n), some] - summed[:n, some] >= self.bound[some]
            for k in np.flatnonzero(over.any(axis=0)):
                i = some.start + int(k)
                if i in found:
                    continue
                inside = np.concatenate([[0], np.cumsum(self.holds[i][ids])])
                held = inside[np.minimum((first + span) * STRIDE, len(ids))] - inside[first * STRIDE]
                for w in np.flatnonzero(over[:, k] & (held >= self.asked[i] - 1e-9)):
                    start = int(w) * STRIDE
                    hit = self.held_in(ids, start, start + span * STRIDE, i)
                    if hit and (i not in found or hit[1] > found[i][1]):
                        found[i] = (*hit, self.cosine_at(ids, hit[0], i))

    def cosine_at(self, ids: np.ndarray, start: int, i: int) -> float:
        """The cosine of the stretch from ``start`` that an item may fill."""
        held = ids[start : start + reach_of(len(self.items[i].words))]
        terms, times = np.unique(held[held >= 0], return_counts=True)
        norm = float(np.sqrt(((times * self.weight[terms]) ** 2).sum()))
        return float((times @ self.latent[terms]) @ self.folded[:, i]) / norm if norm else 0.0

    def verified(self, ids: np.ndarray, start: int, i: int) -> tuple[int, int] | None:
        """(first word, words in common) if the text around a window holds the item."""
        reach = reach_of(len(self.items[i].words))
        low = max(0, start - reach)
        return self.held_in(ids, low, start + 2 * STRIDE + reach, i)

    def held_in(self, ids: np.ndarray, low: int, stop: int, i: int) -> tuple[int, int] | None:
        """(first word, words in common) if the best stretch of ids[low:stop] holds the item."""
        item = self.items[i]
        n = len(item.words)
        reach = reach_of(n)
        region = ids[low:stop]
        inside = np.concatenate([[0], np.cumsum(self.holds[i][region])])
        starts = np.arange(max(1, len(region) - reach + 1))
        held = inside[np.minimum(starts + reach, len(region))] - inside[starts]
        best = int(np.argmax(held))
        if held[best] < self.asked[i] - 1e-9:  # no common subsequence is longer
            return None
        words = region[best : best + reach].tolist()
        common = common_length(words, item.words)
        if common >= self.limits.copied * n:
            return low + best, common
        if item.answer and common >= self.limits.reworded * n and common_length(words, item.answer) >= self.limits.answered * len(item.answer):
            return low + best, common
        return None


def searches(docs: DataFrame, benchmark: DataFrame, rank: int, limits: Limits, text_col: str, item_col: str, item_text_col: str) -> Iterator[Search]:
    """One search a block of the benchmark."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).orderBy("item_id", "text")
    block = max(1, min(BLOCK_ITEMS, rank))
    for begin in range(0, items.count(), block):
        rows = items.offset(begin).limit(block).collect()
        numbers: dict[bytes, int] = {}
        held_items = [x for x in number_items([(r["item_id"], r["text"]) for r in rows], numbers) if x.words]
        if held_items:
            total, held = passage_counts(docs, numbers, text_col)
            weight = term_weights(held_items, total, held)
            latent = latent_terms(spark, [item_vector(x, weight) for x in held_items], len(numbers), rank)
            yield Search(numbers, held_items, weight, latent, limits)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 256, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, first_word, n_common, n_words, cosine of every leak."""
    out = "doc_id long, item_id long, first_word long, n_common long, n_words long, cosine double"
    found = docs.sparkSession.createDataFrame([], out)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for search in searches(docs, benchmark, rank, limits, text_col, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(search)  # bounded by BLOCK_ITEMS and rank

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for batch in batches:
                rows = []
                for part in sliced(batch):
                    for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                        rows += [(doc_id, held.items[i].item_id, first, common, len(held.items[i].words), score) for i, first, common, score in held.leaks(term_numbers(text, held.numbers))]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in out.split(", ")])

        found = found.union(with_small_batches(texts).mapInArrow(run, out))
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 256, limits: Limits = Limits(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns as they are."""
    let_go(docs.sparkSession)
    kept = with_small_batches(docs)
    for search in searches(docs, benchmark, rank, limits, text_col, item_col, item_text_col):
        kept = kept.filter(_clean(docs.sparkSession.sparkContext.broadcast(search))(F.coalesce(F.col(text_col), F.lit(""))))
    return kept


def _clean(shared):
    """A column function: whether a text holds none of the items of a search."""

    def clean(texts: pd.Series) -> pd.Series:
        held = shared.value
        return pd.Series([not held.leaks(term_numbers(t, held.numbers)) for t in texts], dtype="bool")

    clean.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(clean, "boolean")
