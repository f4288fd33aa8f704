"""Removal of long repeated byte strings: repeated anchors choose positions, prefix doubling decides.

Lengths grow from ``passage`` to ``length`` bytes; texts without a repeated string of the shorter
length are dropped before the longer one is looked at.

A row for every byte would be 24 times the input in each sort, so anchors leave out what cannot
occur again. Every string of a level's length has one anchor: the first of the least names of BLOCK
bytes in it (the greatest power of two within two thirds of the length). Neighbouring starts with
the same anchor are a *stretch*; ``inner`` names the anchor's bytes and ``outer`` all bytes that the
strings of the stretch cover together. Names are 64-bit keys put together from those of halves.

1. inner unique: no string that starts in the stretch occurs again; dropped.
2. outer found twice: all of them do, and one stretch stands for the others, those of its own text as well.
3. else the stretch is open: it and those that stand for others are cut into runs of at most GRAIN
   starts, by their distance from the anchor, so that equal strings fall in equal runs. A run's
   inner and outer are again what all its strings share and what they cover; steps 1 and 2 are done again.
4. all positions of the runs that are still open, and of those that stand for others, go to distributed
   prefix doubling (``prefix_doubling``), which ranks them at a half and then the whole of the length.

One of equal texts stands for all of them, so copies cost a row each and no more. All steps count
names with partial sums; names found twice are written before rows are joined with them, by
broadcast up to a counted bound and beyond it in a join whose hot keys are split. Beyond the bound
the distinct texts are dealt once into buckets by their key, where every round meets them.

Defined cases: a null text is an empty one; texts shorter than ``length`` lose nothing; a text
that repeats itself loses those bytes too; repeated rows are further texts; an empty table gives
no rows; other columns are ignored. Texts are told apart by 128-bit keys, and names count together
with the inner name, so a chance collision needs 128 equal bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import discard, give_back, map_batches, shared_folder, with_small_batches, written
from lithic.llm.prefix_doubling import halved, repeated_positions

#: Open stretches are cut into runs of so many starts, at most, before positions are ranked.
GRAIN = 12
#: Tables of names or found places are broadcast up to so many entries (16 to 40 bytes each).
BROADCAST_ENTRIES = 1_000_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTES = np.random.default_rng(400).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = left ^ (left >> np.uint64(32))
    mixed *= _A
    mixed += right * _B
    mixed ^= mixed >> np.uint64(29)
    return mixed


class Names:
    """Names of all strings of a text whose length is a power of two, doubled as needed."""

    def __init__(self, data: bytes, block: int):
        self.of, self.block = {1: _BYTES[np.frombuffer(data, np.uint8)]}, block

    def power(self, size: int) -> np.ndarray:
        if size not in self.of:
            half = self.power(size // 2)
            self.of[size] = _paired(half[: -(size // 2)], half[size // 2 :])
            if size <= self.block:
                del self.of[size // 2]  # longer names come from a block on
        return self.of[size]

    def at(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Names of strings of a block or more: two overlapping powers of two, and the length."""
        self.power(self.block)
        out = np.empty(len(starts), np.uint64)
        exponents = np.frexp(lengths.astype(np.float64))[1] - 1
        for e in np.unique(exponents):
            size, mine = 1 << int(e), exponents == e
            names, s, n = self.power(size), starts[mine], lengths[mine]
            out[mine] = _paired(_paired(names[s], names[s + n - size]), n.astype(np.uint64))
        return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    low, done = values, 1
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    return low


def ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def block_of(length: int) -> int:
    return 1 << (max(1, 2 * length // 3).bit_length() - 1)


def stretches(texts: list[bytes], rows: pa.RecordBatch | None, length: int) -> tuple[np.ndarray, ...]:
    """(text, first start, starts, anchor less first, inner, outer) of every stretch of the texts.

    Texts are laid end to end, so that short ones share the array operations; only starts whose
    string ends within its own text are kept.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    names = Names(b"".join(texts), block_of(length))
    block = names.power(names.block)
    window = length - names.block + 1
    low = sliding_least(block, window)
    room = np.maximum(sizes - length + 1, 0)
    of = np.repeat(np.arange(len(texts)), room)
    starts = ranges(room) + begin[of]
    least = low[starts]
    # The first place at or after each start that holds its window's least name.
    lead = np.flatnonzero(_is_least(block, low, window))
    nxt = np.searchsorted(lead, starts)
    anchor = lead[nxt]
    wrong = np.flatnonzero(block[anchor] != least)
    while len(wrong):  # a least of another window came first
        nxt[wrong] += 1
        anchor[wrong] = lead[nxt[wrong]]
        wrong = wrong[block[anchor[wrong]] != least[wrong]]
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
    count = np.diff(new, append=len(anchor))
    first, at, text = starts[new], anchor[new], of[new]
    outer = _paired(names.at(first, count - 1 + length), (at - first).astype(np.uint64))
    return text, first - begin[text], count, at - first, block[at].view(np.int64), outer.view(np.int64)


def _is_least(block: np.ndarray, low: np.ndarray, window: int) -> np.ndarray:
    """Whether a place holds the least name of some window that it lies in."""
    pad = np.zeros(window - 1, np.uint64)
    highest = ~sliding_least(~np.concatenate([pad, low, pad]), window)
    return highest == block


def finer_runs(texts: list[bytes], rows: pa.RecordBatch, size: int, length: int) -> tuple[np.ndarray, ...]:
    """The same values for runs cut into at most ``size`` starts, by distance from the anchor.

    Only the bytes that the runs' strings cover are named, laid end to end.
    """
    runs = rows.column("runs")
    text = np.repeat(np.arange(len(texts)), runs.value_lengths().to_numpy())
    first, count, back, inner = (x.to_numpy() for x in runs.flatten().flatten())
    ends = first + count - 1 + length
    pieces = [texts[i][f:e] for i, f, e in zip(text.tolist(), first.tolist(), ends.tolist(), strict=True)]
    sizes = np.array([len(x) for x in pieces], np.int64)
    moved = np.cumsum(sizes) - sizes - first  # from a place in the text to one in the pieces
    lo, hi = (back - count + 1) // size, back // size
    many = hi - lo + 1
    of = np.repeat(np.arange(len(pieces)), many)
    k = ranges(many) + lo[of]
    far, near = np.minimum(k * size + size - 1, back[of]), np.maximum(k * size, (back - count + 1)[of])
    anchor = (first + back)[of]
    begin, n = anchor - far, far - near + 1
    names = Names(b"".join(pieces), block_of(length))
    # What all strings of the uncut run share, which lies within any of them.
    share = names.at(anchor - k * size + moved[of], np.full(len(k), length - size + 1))
    mixed = _paired(_paired(inner[of].view(np.uint64), share), k.astype(np.uint64))
    outer = _paired(names.at(begin + moved[of], n - 1 + length), far.astype(np.uint64))
    return text[of], begin, n, far, mixed.view(np.int64), outer.view(np.int64)


def merged(of: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, stop) of the maximal covered byte runs of runs (text, first start, starts)."""
    order = np.lexsort((first, of))
    of, start, stop = of[order], first[order], (first + count - 1 + length)[order]
    # Ends of one text never reach into the next: texts are laid apart by more than any length.
    apart = of * (int(stop.max(initial=0)) + 1)
    reach = np.maximum.accumulate(stop + apart)
    opens = np.flatnonzero(np.concatenate([[True], (start + apart)[1:] > reach[:-1]]) | (np.diff(of, prepend=-1) != 0))
    closes = np.concatenate([opens[1:] - 1, [len(of) - 1]]) if len(of) else opens
    return of[opens], start[opens], (reach - apart)[closes]


CONTENT = ["content", "second"]


def byte_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("data"), F.xxhash64(data).alias("content"), F.xxhash64(F.lit("second"), data).alias("second"))


def few(table: DataFrame, entries: int) -> DataFrame:
    return F.broadcast(table) if entries <= BROADCAST_ENTRIES else table


class Texts:
    """The distinct texts, met with what was found by their keys; moved once, beyond the bound only."""

    def __init__(self, rows: DataFrame):
        self.rows, self.dealt = rows, None

    def met(self, found: DataFrame, entries: int) -> DataFrame:
        if entries <= BROADCAST_ENTRIES:
            return self.rows.join(F.broadcast(found), CONTENT)
        if self.dealt is None:
            spark, name = self.rows.sparkSession, f"texts_{uuid.uuid4().hex}"
            buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
            dealt = self.rows.repartition(buckets, *CONTENT).write.bucketBy(buckets, *CONTENT).format("parquet")
            dealt.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
            self.dealt = spark.table(name)
        return self.dealt.join(found, CONTENT)


RUN = ["first", "starts", "back", "inner", "outer"]


#: Bytes of texts that are named together.
TOGETHER = 1 << 17


def run_rows(texts: DataFrame, cut, columns: list[str]) -> DataFrame:
    """CONTENT and RUN of what ``cut`` makes of texts and the rows that they stand in."""

    def parts(data: list[bytes]) -> Iterator[slice]:
        begin = size = 0
        for i, d in enumerate(data):
            size += len(d)
            if size >= TOGETHER or i == len(data) - 1:
                yield slice(begin, i + 1)
                begin, size = i + 1, 0

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            data = batch.column("data").to_pylist()
            keys = [batch.column(c).to_numpy() for c in CONTENT]
            found = []
            for part in parts(data):
                text, *values = cut(data[part], batch.slice(part.start, part.stop - part.start))
                found.append([*(k[part][text] for k in keys), *values])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], [*CONTENT, *RUN])

        return step

    return map_batches(texts.select(*CONTENT, *columns), make, ", ".join(f"{c} long" for c in [*CONTENT, *RUN]))


def resolved(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of runs: those whose strings all occur again (``cross``: in another text), and the open ones."""
    every = written(rows)
    cross = (F.min("content") != F.max("content")).alias("cross")
    twice = written(every.groupBy("inner").agg(F.count("*").alias("times"), (F.min("outer") == F.max("outer")).alias("one"), cross).filter("times > 1").select("inner", "one", "cross"))
    again = written(every.join(few(twice, twice.count()), "inner"), every, twice)
    mixed = again.filter("not one").drop("one", "cross")
    at = F.xxhash64(*CONTENT, "first")  # one run stands for all; if hashes agree by chance, two do
    outers = written(mixed.groupBy("inner", "outer").agg(F.count("*").alias("times"), F.min(at).alias("sample"), cross).filter("times > 1").drop("times"))
    told = written(mixed.join(few(outers, outers.count()), ["inner", "outer"], "left"))
    place = [*CONTENT, "first", "starts", "cross"]
    sure = written(again.filter("one").select(*place).union(told.filter("sample is not null").select(*place)).distinct(), again, outers)
    still = written(told.filter(F.col("sample").isNull() | (at == F.col("sample"))).select(*CONTENT, "first", "starts", "back", "inner").distinct(), told)
    return sure, still


def unsettled(still: DataFrame, sure: DataFrame) -> DataFrame:
    """Open runs whose inner name stands in some text that is not yet known to share a string."""
    known = written(sure.filter("cross").select(*CONTENT).distinct())
    names = written(still.join(few(known, known.count()), CONTENT, "left_anti").select("inner").distinct(), known)
    return written(still.join(few(names, names.count()), "inner", "left_semi"), still, names)


def named_positions(met: DataFrame, length: int) -> DataFrame:
    """What ``repeated_positions`` takes, of the starts in ``runs`` of each text.

    Only the bytes that the runs' strings cover are named, a bounded number of them at a time.
    """
    half, quarter = halved(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, data = batch.column("text")[row].as_py(), batch.column("data")[row].as_py()
                first, count = (x.to_numpy() for x in batch.column("runs")[row].values.flatten())
                group = np.cumsum(count + length) // TOGETHER
                for mine in np.split(np.arange(len(first)), np.flatnonzero(np.diff(group)) + 1):
                    yield quarters(key, data, first[mine], count[mine])
        give_back()

    def quarters(key: int, data: bytes, first: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        sizes = count - 1 + length
        names = Names(b"".join(data[f : f + n] for f, n in zip(first.tolist(), sizes.tolist(), strict=True)), 1 << (quarter.bit_length() - 1))
        moved = np.repeat(np.cumsum(sizes) - sizes - first, count)
        starts = np.repeat(first, count) + ranges(count)
        at, place = np.unique(np.concatenate([starts, starts + length - half]), return_index=True)
        inside = at + np.concatenate([moved, moved])[place]
        full = np.full(len(at), quarter)
        r1, r2 = names.at(inside, full), names.at(inside + half - quarter, full)
        flags = [pa.array(np.isin(at, starts)), pa.array(np.isin(at, starts + length - half))]
        columns = [pa.array(np.full(len(at), key)), pa.array(at), pa.array(r1.view(np.int64)), pa.array(r2.view(np.int64)), *flags]
        return pa.RecordBatch.from_arrays(columns, ["text", "pos", "r1", "r2", "starts", "ends"])

    return with_small_batches(met.select("text", "data", "runs")).mapInArrow(run, "text long, pos long, r1 long, r2 long, starts boolean, ends boolean")


def repeated_runs(texts: Texts, rows: DataFrame, length: int, flags: bool = False) -> DataFrame:
    """CONTENT, first, starts, cross: starts of strings that also start anywhere else.

    With ``flags``, runs of a text that is known to share a string with another may be left out.
    """
    sure, still = resolved(run_rows(rows.filter(F.octet_length("data") >= length), lambda data, _: stretches(data, None, length), ["data"]))
    if flags:
        still = unsettled(still, sure)
    by_text = written(still.groupBy(*CONTENT).agg(F.collect_list(F.struct("first", "starts", "back", "inner")).alias("runs")), still)
    size, entries = min(GRAIN, length - block_of(length) + 1), by_text.agg(F.sum(F.size("runs"))).first()[0] or 0
    more, still = resolved(run_rows(texts.met(by_text, entries), lambda data, runs: finer_runs(data, runs, size, length), ["data", "runs"]))
    discard(by_text)
    sure = written(sure.union(more), sure, more)
    if flags:
        still = unsettled(still, sure)
    runs = still.groupBy(*CONTENT).agg(F.collect_list(F.struct("first", "starts")).alias("runs"))
    by_text = written(runs.withColumn("text", F.monotonically_increasing_id()), still)
    entries = by_text.agg(F.sum(F.size("runs"))).first()[0] or 0
    found = repeated_positions(written(named_positions(texts.met(by_text, entries), length)), length)
    places = found.groupBy("text").agg(F.collect_list("pos").alias("places"), F.max("crossed").alias("cross"))
    keys = by_text.select("text", *CONTENT)
    more = places.join(keys, "text").select(*CONTENT, F.explode("places").alias("first"), F.lit(1).cast("long").alias("starts"), "cross")
    return written(sure.union(more), sure, found, by_text)


def covered_spans(docs: DataFrame, length: int = 400, passage: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, data (the text's bytes), shared, spans (maximal runs to remove, ends exclusive) of every row."""
    if passage > length:
        raise ValueError("passage must not be longer than length")
    rows = byte_rows(docs, id_col, text_col)
    copied = written(rows.groupBy(*CONTENT).agg(F.count("*").alias("copies"), F.min("doc_id").alias("one")).filter("copies > 1"))
    marked = rows.join(few(copied, n_copied := copied.count()), CONTENT, "left")
    texts = Texts(marked.filter("copies is null or doc_id <=> one").select(*CONTENT, "data"))

    shorter = repeated_runs(texts, texts.rows, passage, flags=True)
    flags = written(shorter.groupBy(*CONTENT).agg(F.max("cross").alias("shared")), shorter)
    n_flags = flags.count()
    runs = repeated_runs(texts, texts.met(flags.select(*CONTENT), n_flags), length)
    found = written(runs.groupBy(*CONTENT).agg(F.collect_list(F.struct("first", "starts")).alias("runs")), runs)
    spans = written(map_batches(found, lambda: _merge_step(length), "content long, second long, spans array<struct<start:bigint,stop:bigint>>"), found)
    entries = (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) + n_flags + n_copied
    known = flags.join(spans, CONTENT, "left").join(copied.select(*CONTENT, "copies"), CONTENT, "full")
    out = rows.join(few(written(known, flags, spans, copied), entries), CONTENT, "left")
    size = F.octet_length("data").cast("long")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("stop")))
    copies = F.col("copies").isNotNull()
    shared = F.coalesce(F.col("shared"), F.lit(False)) | (copies & (size >= passage))
    return out.select("doc_id", "data", shared.alias("shared"), F.when(copies & (size >= length), whole).otherwise(F.col("spans")).alias("spans"))


def _merge_step(length: int):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs = batch.column("runs")
        sizes = runs.value_lengths().to_numpy().astype(np.int64)
        first, count = (x.to_numpy() for x in runs.flatten().flatten())
        of, start, stop = merged(np.repeat(np.arange(len(sizes)), sizes), first, count, length)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(sizes)))]).astype(np.int32)
        spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], ["start", "stop"]))
        return pa.RecordBatch.from_arrays([batch.column("content"), batch.column("second"), spans], [*CONTENT, "spans"])

    return step


def remove_repeats(docs: DataFrame, length: int = 400, passage: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that are left), shared of every row.

    ``shared`` tells whether a string of ``passage`` bytes also stands in another row's text."""

    def make():
        def cut(data: bytes, spans: list[dict] | None) -> bytes:
            ends = [0, *(x for s in spans or () for x in (s["start"], s["stop"])), len(data)]
            return b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, spans = batch.column("data").to_pylist(), batch.column("spans").to_pylist()
            kept = [cut(d, s) for d, s in zip(data, spans, strict=True)]
            arrays = [batch.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array([len(d) - len(k) for d, k in zip(data, kept, strict=True)], pa.int64()), pa.array([len(s or ()) for s in spans], pa.int64()), pa.array(kept, pa.binary()), batch.column("shared")]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "shared"])

        return step

    return map_batches(covered_spans(docs, length, passage, id_col, text_col), make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, shared boolean")
