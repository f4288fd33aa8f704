"""Alignment of two tokenizers over the same texts, and how often their tokens are linked.

Both tokenizers encode a text with a space before it. Byte offsets where tokens of both end cut the
tokens into groups, and every token of one kind in a group is linked with every token of the other.
Offsets are running sums of token lengths, cuts their intersection, group labels a sorted search,
and links repeats of one side against the other, all in arrays over many texts at once.

Neither tokenizer joins what stands before a space and after it, unless white space precedes that
space. So texts are cut there, each distinct part is encoded and aligned once in a while, and texts
are sums over their parts. Where a library can't restore a part's bytes, its text has no tokens.

How many documents link a pair is summed in two stages: tasks count a pair once a batch of texts,
batches are salted so that a frequent pair lies in many groups, and the sums of those are summed.
Totals go back the same way, and each batch of texts reads its own pairs' totals.

Defined cases: null and empty texts and those that a library can't restore have zeros and an empty
hash; repeated rows, and rows of null or equal ids, are documents each; an empty table gives no
rows; other columns are ignored; a text of any length is read whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import discard, give_back, sliced, text_rows, with_small_batches, written
from lithic.llm.token_counts import byte_alphabet

#: Remembered parts and their bytes: beyond, all are forgotten, which changes speed and not results.
PARTS, PART_BYTES = 300_000, 32 << 20
#: Links that are expanded at a time, and batches of texts whose counts of a pair meet in a group.
LINKS, BATCHES = 4 << 20, 512

ALIGNED = "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, used array<int>, times array<long>, pairs array<long>, holders array<int>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_pieces(path: str) -> list[bytes]:
    """The bytes of each entry of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    value = {c: b for b, c in enumerate(byte_alphabet())}
    out = [b""] * (1 + max([*held["model"]["vocab"].values(), *(t["id"] for t in held["added_tokens"])]))
    for name, i in held["model"]["vocab"].items():
        out[i] = bytes(value[c] for c in name) if all(c in value for c in name) else name.encode()
    for t in held["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


def model_pieces(model) -> list[bytes]:
    """The bytes of each piece of a sentencepiece model: a byte piece's byte, else its text."""
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ..., n - 1 for each n of ``lengths``, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values, first)


def counts(lists: list) -> np.ndarray:
    return np.fromiter(map(len, lists), np.int64, len(lists))


def flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64)


def joined(values: pa.Array) -> np.ndarray:
    """The bytes of all values of a new binary or string array, one after the other."""
    size = int(pc.sum(pc.binary_length(values)).as_py() or 0)
    return np.frombuffer(values.buffers()[2], np.uint8)[:size] if size else np.zeros(0, np.uint8)


def listed(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)


def shown(in_a: np.ndarray, ids_a: np.ndarray, in_b: np.ndarray, ids_b: np.ndarray, n_groups: np.ndarray) -> pa.Array:
    """The groups of each part as text: ids of both sides, in order."""
    total = int(n_groups.sum())
    sides = [pc.binary_join(listed(pa.array(ids).cast(pa.string()), np.bincount(group, minlength=total)), ",") for group, ids in ((in_a, ids_a), (in_b, ids_b))]
    return pc.binary_join(listed(pc.binary_join_element_wise(*sides, "|"), n_groups), ";")


def grouped(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The common ends of tokens of these lengths, and the group of each token."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    cuts = np.intersect1d(a_end, b_end)
    return cuts, np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)


def linked(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray, n_b: int, part: np.ndarray, n_pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """part * n_pairs + a * n_b + b of all links, and how often each occurs.

    Equal ids of a group are counted before they are expanded; ``part`` is each group's part.
    """
    size = 1 + max(int(ids_a.max(initial=0)), int(ids_b.max(initial=0)))
    ones = np.ones(max(len(ids_a), len(ids_b)), np.int64)
    key_a, many_a = summed(group_a * size + ids_a, ones[: len(ids_a)])
    key_b, many_b = summed(group_b * size + ids_b, ones[: len(ids_b)])
    in_a, in_b = key_a // size, key_b // size
    wide = np.bincount(in_b, minlength=len(part))
    first = np.cumsum(wide) - wide
    repeats = wide[in_a]
    ends = np.cumsum(repeats)
    keys, times, done = [], [], 0
    while done < len(key_a):
        until = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + LINKS, "right")))
        n = repeats[done:until]
        left = np.repeat(np.arange(done, until), n)
        right = np.repeat(first[in_a[done:until]], n) + runs(n)
        made = summed(part[in_a[left]] * n_pairs + key_a[left] % size * n_b + key_b[right] % size, many_a[left] * many_b[right])
        keys.append(made[0])
        times.append(made[1])
        done = until
    return summed(np.concatenate(keys), np.concatenate(times)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Aligner:
    """Two vocabularies and the aligned parts that were met lately."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.a_bytes, self.b_bytes = byte_pieces(path_a), model_pieces(self.b)
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_held, self.b_held = (pa.array(x, pa.binary()) for x in (self.a_bytes, self.b_bytes))
        self.n_b = len(self.b_bytes)
        self.n_pairs = len(self.a_bytes) * self.n_b
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.bytes = 0
        self.shown = pa.array([], pa.string())
        #: of each part: whether it is restored, tokens of both, groups, links, where its pairs begin and how many there are
        self.facts = np.zeros((0, 7), np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, parts: list[bytes]) -> np.ndarray:
        """The number of each part; parts that are not known are aligned."""
        if len(self.known) > PARTS or self.bytes > PART_BYTES:
            self.forget()
        if new := [p for p in parts if p not in self.known]:
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def learn(self, parts: list[bytes]) -> None:
        texts = [p.decode() for p in parts]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)  # the model puts a space before each
        good = self._restored(parts, a, b)
        if not good.all():
            a, b = ([ids if fine else [] for ids, fine in zip(side, good, strict=True)] for side in (a, b))
        n_a, n_b, flat_a, flat_b = *map(counts, (a, b)), *map(flat, (a, b))
        cuts, in_a, in_b = grouped(self.a_len[flat_a], self.b_len[flat_b])
        ends = np.cumsum(counts(parts) * good)
        part = np.searchsorted(ends, cuts)  # parts that aren't restored take no bytes, and come after an end
        keys, times = linked(in_a, flat_a, in_b, flat_b, self.n_b, part, self.n_pairs)
        owner = keys // self.n_pairs
        n_groups, n_links, n_pairs = np.bincount(part, minlength=len(parts)), np.bincount(owner, times, len(parts)).astype(np.int64), np.bincount(owner, minlength=len(parts))
        begin = len(self.pairs) + np.cumsum(n_pairs) - n_pairs
        self.shown = pa.concat_arrays([self.shown, shown(in_a, flat_a, in_b, flat_b, n_groups)])
        self.known |= {p: len(self.facts) + i for i, p in enumerate(parts)}
        self.facts = np.concatenate([self.facts, np.stack([good, n_a, n_b, n_groups, n_links, begin, n_pairs], 1)])
        self.pairs, self.times = np.concatenate([self.pairs, keys % self.n_pairs]), np.concatenate([self.times, times])
        self.bytes += sum(map(len, parts))

    def _restored(self, parts: list[bytes], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Whether the tokens of both make the bytes of each part."""
        size, whole = counts(parts), b"".join(parts)
        good = np.ones(len(parts), bool)
        for ids, lengths, held, pieces in ((a, self.a_len, self.a_held, self.a_bytes), (b, self.b_len, self.b_held, self.b_bytes)):
            n, tokens = counts(ids), flat(ids)
            made = np.bincount(np.repeat(np.arange(len(parts)), n), lengths[tokens], len(parts))
            if not ((made == size).all() and joined(held.take(pa.array(tokens))).tobytes() == whole):
                good &= np.array([b"".join(map(pieces.__getitem__, x)) == p for p, x in zip(parts, ids, strict=True)], bool)
        return good

    def batch(self, number: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        """A row of ALIGNED for each text; the batch's pairs stand in its first row."""
        n = len(texts)
        data, place, doc = cut(texts)
        encoded = pa.Array.from_buffers(pa.binary(), len(place) - 1, [None, pa.py_buffer(place.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        part = self.places(encoded.dictionary.to_pylist())[np.asarray(encoded.indices)] if len(doc) else np.zeros(0, np.int64)
        bad = np.bincount(doc, self.facts[part, 0] == 0, n) > 0
        part, doc = part[~bad[doc]], doc[~bad[doc]]
        sums = [np.bincount(doc, self.facts[part, k], n).astype(np.int64) for k in range(1, 5)]
        texts_ = pc.binary_join(listed(self.shown.take(pa.array(part)), np.bincount(doc, minlength=n)), ";")
        hashes = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in texts_.to_pylist()]
        once, many = np.unique(doc * len(self.facts) + part, return_counts=True)
        part, doc = once % max(1, len(self.facts)), once // max(1, len(self.facts))
        wide = self.facts[part, 6]
        at = np.repeat(self.facts[part, 5], wide) + runs(wide)
        keys, times = summed(np.repeat(doc, wide) * self.n_pairs + self.pairs[at], np.repeat(many, wide) * self.times[at])
        pairs, used = np.unique(keys % self.n_pairs, return_inverse=True)
        own = pa.array(np.searchsorted(keys // self.n_pairs, np.arange(n + 1)), pa.int32())
        whole = pa.array([0, *[len(pairs)] * n], pa.int32())
        columns = [
            pa.array([number] * n, pa.int64()), ids, *map(pa.array, sums), pa.array(hashes, pa.string()),
            pa.ListArray.from_arrays(own, pa.array(used.astype(np.int32))), pa.ListArray.from_arrays(own, pa.array(times)),
            pa.ListArray.from_arrays(whole, pa.array(pairs)), pa.ListArray.from_arrays(whole, pa.array(np.bincount(used, minlength=len(pairs)).astype(np.int32))),
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ALIGNED.split(", ")])


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts that aren't empty, each with a space before it; where parts begin (and the
    end); the text of each part. A part begins with a text, or at a space after no white space."""
    held = texts.filter(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False))
    which = np.flatnonzero(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
    spaced = pc.binary_join_element_wise(pa.scalar(" "), held, pa.scalar("")) if len(held) else pa.array([], pa.string())
    data = joined(spaced)
    starts = np.r_[0, np.cumsum(np.asarray(pc.binary_length(spaced)).astype(np.int64))]
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    at = np.flatnonzero(data == 32)
    at = at[(at > 1) & ~first[at] & ~first[at + 1]]
    before, earlier = data[at - 1], data[at - 2]
    # white space beyond ASCII ends in these bytes; other characters that do are merely not cut after
    white = (before <= 32) | (before >= 128) & np.isin(earlier, (0xC2, 0x9A, 0x80, 0x81))
    first[at[~white]] = True
    place = np.flatnonzero(first)
    return data, place, which[np.searchsorted(starts, place[:-1], "right") - 1]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One a process: loading vocabularies takes longer than a small task."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _valued(rows: pa.Table, totals: pa.Table) -> pa.Table:
    """Rows of a batch with sums over the totals of their links."""
    order = np.argsort(np.asarray(totals["place"]))
    count, best = np.asarray(totals["count"])[order], np.asarray(totals["best"]).astype(np.int64)[order]
    used, times = rows["used"].combine_chunks(), rows["times"].combine_chunks()
    at, many = np.asarray(used.flatten()), np.asarray(times.flatten())
    owner = np.repeat(np.arange(len(used)), np.asarray(used.value_lengths()))
    sums = np.zeros((2, len(used)), np.int64)
    np.add.at(sums[0], owner, many * best[at])
    np.add.at(sums[1], owner, many * count[at])
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([*(rows[c] for c in names), pa.array(sums[0]), pa.array(sums[1]), rows["groups_sha256"]], [*names, "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT of every row: tokens, groups and links, links to the best partner, sum of the links' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in sliced(batch):
                yield made.batch(number, part.column("doc_id"), part.column("text"))
                number += 1
        give_back()

    held = written(with_small_batches(text_rows(docs, id_col, text_col)).mapInArrow(run, ALIGNED))
    salts = max(1, -(-(held.agg(F.count_distinct("batch")).first()[0] or 0) // BATCHES))
    first = held.select("batch", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "pair"))
    rows = first.select("batch", "place", F.col("pair.pairs").alias("pair"), F.col("pair.holders").alias("holders"), F.pmod(F.xxhash64("batch"), F.lit(salts)).alias("salt"))
    partial = written(rows.groupBy("pair", "salt").agg(F.sum("holders").alias("n")))
    totals = partial.groupBy("pair").agg(F.sum("n").alias("count"))
    n_b = aligner(path_a, path_b).n_b
    highest = totals.groupBy(F.floor(F.col("pair") / n_b).alias("a")).agg(F.max("count").alias("most"))
    judged = totals.withColumn("a", F.floor(F.col("pair") / n_b)).join(highest, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    salted = partial.select("pair", "salt").join(judged, "pair")
    told = rows.join(salted, ["pair", "salt"]).select(F.col("batch").alias("whose"), "place", "count", "best")
    out = held.drop("pairs", "holders").groupBy("batch").cogroup(told.groupBy("whose")).applyInArrow(_valued, RESULT)
    done = written(out)
    discard(held, partial)
    return done
