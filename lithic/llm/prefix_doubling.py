"""Distributed prefix doubling over chosen positions of many texts.

A position's rank at some length tells its string of that length apart from others. Ranks of twice
the length come from pairs: the rank at the position, and the rank at the position one offset on. In
each round Spark sorts the rows (pair, text, position) over ranges; a pair's new rank is the place
of its first row in the whole order, and rows whose pair stands once are dropped. The first
ranks are names of a quarter of the length, so rounds run at offsets of a quarter and of a half.

Ranges are cut by text and position as well, so a pair that a third of all rows show is dealt over
as many tasks as its rows need. Of a range, only its two ends reach the driver: it tells
which groups run on over a border. Sorted rows are written, and ties don't exist (text and position
are unique), so a lost task comes out the same when it runs again.

Defined cases: no positions give no rows; a text may repeat its own strings; lengths that don't halve
evenly overlap in their middle. First ranks are 64-bit names and pairs hold two, so two different
strings are only taken for equal if 128 bits agree by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lithic.llm.common import discard, with_small_batches, written

PAIR = ["r1", "r2"]
EDGE = "struct<rows:bigint,head:bigint,first:array<bigint>,last:array<bigint>>"
_EDGE = pa.struct([("rows", pa.int64()), ("head", pa.int64()), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64()))])


class _Marker:
    """Walks through one sorted range: which rows stand with their neighbours, a batch behind."""

    def __init__(self, keep: list[str]):
        self.keep, self.rows, self.head = keep, 0, 0
        self.first = self.last = self.held = None

    def take(self, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        r1, r2, text = (batch.column(c).to_numpy() for c in (*PAIR, "text"))
        n, before = len(text), self.last if self.last is not None else [None] * 3
        same = np.concatenate([[before[:2] == [r1[0], r2[0]]], (r1[1:] == r1[:-1]) & (r2[1:] == r2[:-1])])
        apart = same & np.concatenate([[before[2] != text[0]], text[1:] != text[:-1]])
        heads = np.maximum.accumulate(np.where(same, self.head, np.arange(self.rows, self.rows + n)))
        done = self.out(bool(same[0]), bool(apart[0]), False) if self.held else None
        if self.first is None:
            self.first = [int(r1[0]), int(r2[0]), int(text[0])]
        self.held = (batch, same, apart, heads, self.rows == 0)
        self.last, self.head = [int(r1[-1]), int(r2[-1]), int(text[-1])], int(heads[-1])
        self.rows += n
        return done

    def out(self, joined: bool, parted: bool, end: bool) -> pa.RecordBatch:
        batch, same, apart, heads, begin = self.held
        after, parts = np.append(same[1:], joined), np.append(apart[1:], parted)
        opens, closes = np.zeros(len(same), bool), np.zeros(len(same), bool)
        opens[0], closes[-1] = begin, end
        alone = ~same & ~after
        kept = ~alone | opens | closes
        columns = [batch.column(c).filter(pa.array(kept)) for c in self.keep]
        marks = [pa.array(x[kept]) for x in (heads, alone, apart | parts, opens, closes)]
        return pa.RecordBatch.from_arrays([*columns, *self.ends(int(kept.sum()), None), *marks], [*self.keep, "part", "edge", *MARKS])

    def ends(self, n: int, edge: dict | None) -> list[pa.Array]:
        part = TaskContext.get().partitionId()
        return [pa.array(np.full(n, part, np.int32)), pa.array([edge], _EDGE) if edge else pa.nulls(n, _EDGE)]

    def rest(self, types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield self.out(False, False, True)
            edge = {"rows": self.rows, "head": self.head, "first": self.first, "last": self.last}
            columns = [pa.nulls(1, t) for t in types]
            marks = [pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.bool_()) for _ in MARKS[1:])]
            yield pa.RecordBatch.from_arrays([*columns, *self.ends(1, edge), *marks], [*self.keep, "part", "edge", *MARKS])


MARKS = ["head", "alone", "crossed", "opens", "closes"]


def ranked(rows: DataFrame, keep: list[str] = ()) -> DataFrame:
    """text, pos, ``keep``, rank, crossed of the rows whose pair (r1, r2) stands more than once.

    ``crossed``: a neighbour in the group is of another text. In a group of several texts each of
    them has such a row. ``rows`` should be a written table: cutting the ranges reads it first.
    """
    columns = ["text", "pos", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker, types = _Marker(columns), []
        for batch in batches:
            if batch.num_rows:
                types = [batch.schema.field(c).type for c in columns]
                done = marker.take(batch)
                if done:
                    yield done
        yield from marker.rest(types)

    order = [*PAIR, "text", "pos"]
    dealt = rows.select(*order, *keep).repartitionByRange(*order).sortWithinPartitions(*order)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*columns).schema]
    schema = ", ".join([*fields, "part int", f"edge {EDGE}", "head long", *(f"{m} boolean" for m in MARKS[1:])])
    marked = written(with_small_batches(dealt).mapInArrow(run, schema))
    ends = marked.filter("edge is not null").select("part", "edge.*").orderBy("part").collect()  # a row a range
    borders = F.broadcast(rows.sparkSession.createDataFrame(list(_borders(ends)), "part int, base long, opening long, before boolean, before_crossed boolean, after boolean, after_crossed boolean"))
    known = marked.filter("edge is null").join(borders, "part")
    here = known.filter("not alone or (opens and before) or (closes and after)")
    rank = F.when(F.col("head") == 0, F.col("opening")).otherwise(F.col("base") + F.col("head"))
    crossed = F.expr("crossed or (opens and before_crossed) or (closes and after_crossed)")
    out = here.select(*columns, rank.alias("rank"), crossed.alias("crossed"))
    out.held_in = marked.held_in
    return out


def _borders(ends: list[Row]) -> Iterator[tuple]:
    """Of each range: rows before it, the rank of its first group, and whether its end groups run on."""
    base = closing = 0
    for i, e in enumerate(ends):
        last, following = ends[i - 1].last if i else None, ends[i + 1].first if i + 1 < len(ends) else None
        before, after = last is not None and last[:2] == e.first[:2], following is not None and following[:2] == e.last[:2]
        opening = closing if before else base
        yield e.part, base, opening, before, before and last[2] != e.first[2], after, after and following[2] != e.last[2]
        closing = opening if e.head == 0 else base + e.head
        base += e.rows


def halved(length: int) -> tuple[int, int]:
    """A half and a quarter of a length, rounded up."""
    half = (length + 1) // 2
    return half, (half + 1) // 2


def repeated_positions(quarters: DataFrame, length: int) -> DataFrame:
    """text, pos, crossed of the starts whose strings of ``length`` stand at another start too.

    ``quarters`` is a written table of text, pos, r1 and r2 (the names of a quarter of the length at
    the position, and so far on that both cover a half), starts (the position is asked about), ends
    (the position holds the second half of one that is); it is deleted once read.
    """
    half, _ = halved(length)
    halves = ranked(quarters, ["starts", "ends"])
    first = F.when(F.col("starts"), F.struct("pos", F.col("rank").alias("r1"), F.lit(None).cast("long").alias("r2")))
    second = F.when(F.col("ends"), F.struct((F.col("pos") - (length - half)).alias("pos"), F.lit(None).cast("long").alias("r1"), F.col("rank").alias("r2")))
    sides = halves.select("text", F.explode(F.filter(F.array(first, second), lambda s: s.isNotNull())).alias("s")).select("text", "s.*")
    pairs = sides.groupBy("text", "pos").agg(F.max("r1").alias("r1"), F.max("r2").alias("r2")).filter("r1 is not null and r2 is not null")
    wholes = written(pairs, quarters)
    discard(halves)
    out = written(ranked(wholes).select("text", "pos", "crossed"), wholes)
    return out
