"""Sharding by best-fit-decreasing bin packing.

Indivisible groups, sorted by size, each enter the bin whose remaining capacity is the tightest
that still holds them; bins are kept in a balanced tree by remaining capacity. ``pack`` does
this for a list of sizes; ``shard_documents`` for a table, whose groups are equal texts.

At scale: sizes are summed a group before anything else moves, and texts are never shuffled.
Groups of less than ``grain`` of a bin are first joined by hash into bundles of about
that size, so the list that is packed in one place has at most ``bins * (2 / grain + 1)``
entries however large the table is. A group larger than a bin is cut into bin-sized pieces, the
only case in which equal texts part; a bin that cannot be met within capacity is the emptiest.

Defined cases: a null text is an empty one of size 1; repeated rows count each and stay together;
ties go by size, then key, then bin; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithic.llm.common import checkpointed, content_key


class _Node:
    __slots__ = ("key", "left", "priority", "right")

    def __init__(self, key: tuple[int, int], priority: float):
        self.key, self.priority, self.left, self.right = key, priority, None, None


class BalancedTree:
    """A treap of unique keys with logarithmic insert, delete and ceiling search."""

    def __init__(self) -> None:
        self.root: _Node | None = None
        self.random = random.Random(7)

    def _split(self, node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        if node is None:
            return None, None
        if node.key < key:
            node.right, more = self._split(node.right, key)
            return node, more
        less, node.left = self._split(node.left, key)
        return less, node

    def _join(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if a.priority > b.priority:
            a.right = self._join(a.right, b)
            return a
        b.left = self._join(a, b.left)
        return b

    def add(self, key: tuple[int, int]) -> None:
        less, more = self._split(self.root, key)
        self.root = self._join(self._join(less, _Node(key, self.random.random())), more)

    def remove(self, key: tuple[int, int]) -> None:
        less, rest = self._split(self.root, key)
        _, more = self._split(rest, (key[0], key[1] + 1))
        self.root = self._join(less, more)

    def ceiling(self, key: tuple[int, int]) -> tuple[int, int] | None:
        """The least key that is not below ``key``."""
        node, best = self.root, None
        while node:
            if node.key >= key:
                best, node = node.key, node.left
            else:
                node = node.right
        return best

    def last(self) -> tuple[int, int]:
        node = self.root
        while node.right:
            node = node.right
        return node.key


def pack(sizes: Iterable[int], capacity: int, bins: int | None = None) -> Iterator[int]:
    """A bin for each size of a decreasing sequence; ``bins`` None opens bins as needed.

    With a fixed number of bins, a size that fits nowhere enters the bin with the most room.
    """
    tree = BalancedTree()
    opened = bins or 0
    for b in range(opened):
        tree.add((capacity, b))
    for size in sizes:
        found = tree.ceiling((size, -1))
        if found is None and bins is None:
            found = (capacity, opened)
            opened += 1
        elif found is None:
            found = tree.last()
            tree.remove(found)
        else:
            tree.remove(found)
        tree.add((found[0] - size, found[1]))
        yield found[1]


def shard_documents(docs: DataFrame, shards: int = 16, grain: float = 1 / 1024, rows_a_run: int = 5_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; ``bytes`` is the law that holds."""
    spark = docs.sparkSession
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), content_key(data).alias("group"))
    rows = checkpointed(rows)  # a few bytes a row; the texts are read once
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.first("size").alias("one"))
    total, n_rows = groups.agg(F.sum("bytes"), F.sum("n")).first()
    capacity = -(-(total or 0) // shards) or 1
    least = max(1, int(capacity * grain))
    bundles = max(1, int(shards / grain))

    # A piece of a group is what one bin can hold; only groups beyond a bin have more than one.
    a_piece = F.greatest(F.lit(1), F.floor(F.lit(capacity) / F.col("one"))).cast("long")
    pieces = F.when(F.col("bytes") > capacity, F.ceil(F.col("n") / a_piece)).otherwise(1).cast("long")
    sized = groups.withColumn("pieces", pieces)
    item = F.when(F.col("bytes") < least, F.concat(F.lit("b"), F.pmod(F.xxhash64("group"), F.lit(bundles)).cast("string"))).otherwise(F.col("group"))
    sized = sized.withColumn("item", item)
    items = sized.groupBy("item").agg(F.sum("bytes").alias("bytes"), F.max("pieces").alias("pieces"), F.max("n").alias("n"), F.max("one").alias("one")).collect()

    listed = []
    for item_row in items:
        share, more = divmod(item_row["n"], item_row["pieces"])
        for k in range(item_row["pieces"]):
            size = item_row["bytes"] if item_row["pieces"] == 1 else (share + (k < more)) * item_row["one"]
            listed.append((-size, item_row["item"], k))
    listed.sort()
    placed = [(key, k, b) for (_, key, k), b in zip(listed, pack((-s for s, _, _ in listed), capacity, shards), strict=True)]
    plan = spark.createDataFrame(placed, "item string, piece long, shard int")

    # Which piece a row of a cut group is in: copies are dealt by hash of their id, so shares are even.
    where = sized.select("group", "item", "pieces")
    cut = where.filter("pieces > 1").select("group", "pieces").collect()  # fewer than ``shards`` groups
    piece = F.lit(0).cast("long")
    for r in cut:
        piece = F.when(F.col("group") == r["group"], F.pmod(F.xxhash64("doc_id"), F.lit(r["pieces"]))).otherwise(piece)
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("group"), F.lit(bundles)).cast("string"))
    big = sized.filter(F.col("bytes") >= least).select(F.col("group").alias("item"))
    # At most ``2 * bins / grain`` names, so both tables may be broadcast.
    known = F.broadcast(big.withColumn("big", F.lit(True)))
    keyed = rows.join(known, rows["group"] == known["item"], "left").select("doc_id", "size", "text_crc32", F.when(F.col("big"), F.col("group")).otherwise(bundle).alias("item"), piece.alias("piece"))
    sharded = keyed.join(F.broadcast(plan), ["item", "piece"]).select("doc_id", "size", "text_crc32", "shard")
    return with_slots(sharded, max(1, -(-(n_rows or 0) // rows_a_run)))


def with_slots(sharded: DataFrame, runs: int) -> DataFrame:
    """Gapless numbers from 0 within each shard, without gathering a shard in one task."""
    run = F.pmod(F.xxhash64("doc_id"), F.lit(runs))
    keyed = sharded.withColumn("run", run)
    counts = keyed.groupBy("shard", "run").count()
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    numbered = keyed.withColumn("n", F.row_number().over(within))
    return numbered.join(offsets, ["shard", "run"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("n") - 1).alias("slot"))
