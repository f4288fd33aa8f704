"""Token counts by byte-pair merging with a heap over a linked list of symbols.

The lowest-rank adjacent pair is popped and merged until no ranked pair is left; the count is
the number of initial symbols less the number of merges, and no identifiers are emitted. The
vocabulary file is one for the ``tokenizers`` library; counts equal that library's, without
begin, end or added tokens, with its default handling of special strings inside texts.

Defined cases: a null text is an empty one and has 0 tokens; repeated rows are counted each on
their own; an empty table gives no rows; other columns are ignored; a text of any length is
read whole. Words are remembered in a bounded table, which changes speed and not results.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import map_batches, text_rows

#: Fixed values of the vocabulary file's kind: how text is split, and the word-end mark.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
REMEMBERED = 300_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = (b for b in range(256) if b not in set(shown))
    named = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [named[b] for b in range(256)]


def merged_length(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many symbols are left when the lowest-rank pair is merged again and again."""
    n = len(symbols)
    if n < 2:
        return n
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(*found, i) for i in range(n - 1) if (found := ranks.get((symbols[i], symbols[i + 1])))]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, made, i = heapq.heappop(heap)
        j = right[i]
        if symbols[i] < 0 or j < 0 or ranks.get((symbols[i], symbols[j])) != (rank, made):
            continue  # a part of this pair has been merged since
        merges += 1
        symbols[i], symbols[j] = made, -1
        right[i] = after = right[j]
        if after >= 0:
            left[after] = i
            if found := ranks.get((made, symbols[after])):
                heapq.heappush(heap, (*found, i))
        if (before := left[i]) >= 0 and (found := ranks.get((symbols[before], made))):
            heapq.heappush(heap, (*found, before))
    return n - merges


class Counter:
    """Counts the tokens of whole texts with one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + end] for c in alphabet]
        self.special = [t["content"] for t in held["added_tokens"]]
        self.split_special = regex.compile("|".join(map(regex.escape, self.special)))
        self.find = regex.compile(WORDS).findall
        self.words: dict[str, int] = {}
        self.chunks = _Remembered(self.chunk)

    def word(self, word: str) -> int:
        if (known := self.words.get(word)) is not None:
            return known
        data = word.encode()
        count = merged_length([*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]], self.ranks)
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = count
        return count

    def plain(self, text: str) -> int:
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return sum(map(self.word, self.find(text.lower())))

    def chunk(self, chunk: str) -> int:
        """Tokens of a run without U+0020; neither words nor special strings cross that."""
        if "<|" not in chunk:
            return self.plain(chunk)
        parts = self.split_special.split(chunk)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def text(self, text: str) -> int:
        return sum(map(self.chunks.__getitem__, text.split(" ")))


class _Remembered(dict):
    """Results of a function by its argument, forgotten all at once beyond a bound."""

    def __init__(self, function: Callable[[str], int]):
        super().__init__()
        self.function = function

    def __missing__(self, key: str) -> int:
        value = self.function(key)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter a process: loading a vocabulary takes longer than a small task."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; one narrow pass, no shuffle."""

    def make():
        count = counter(vocabulary).text

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = pa.array(map(count, batch.column("text").to_pylist()), pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

        return step

    rows = text_rows(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = map_batches(rows, make, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
