"""A Merkle manifest of a table: roots of sources, one root of all, and a proof for every row.

A row's leaf is the sha256 of its columns. Within a group (a source) leaves stand in the order of
their ids; every 16 consecutive nodes, level by level, become the sha256 of their concatenation
until one is left. The roots of the groups, in the order of the groups, become one root likewise.

Spark numbers the leaves of a group over range partitions, so that a group may hold any share of the
rows, and deals nodes in aligned buckets of 16 ** 3. Executors hand whole buckets, as Arrow tables,
to DuckDB, whose ordered ``string_agg`` and ``sha256`` make the levels within a bucket. Spark
carries the buckets' roots to the next round, and joins the proofs of the rounds above back to
buckets on the way down.

Defined cases: null columns count as ``-``, a null group is a group of its own and comes first; rows
of equal or null id stand in the order null first, then by leaf, and repeated rows are leaves each;
an empty text is not a null one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.llm.common import discard, give_back, with_small_batches, written

FAN = 16
#: Levels that are made within a bucket, and the nodes of a bucket: FAN ** LEVELS.
LEVELS = 3
BUCKET = FAN**LEVELS
#: Bytes that DuckDB may use in a task: far more than a bucket needs.
MEMORY = "256MB"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups as text that sorts null first and is never null.
GROUP = "group_"


def field(value: Column) -> Column:
    """``-`` if null, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def hashed(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def levels(count: str) -> Column:
    """How often ``count`` nodes become fewer by FAN until one is left: hexadecimal digits of count - 1."""
    return F.when(F.col(count) > 1, F.length(F.hex(F.col(count) - 1))).otherwise(F.lit(0)).cast("int")


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with pos, from 0 in each tree, and how many rows the tree has.

    Rows are ranged by tree and order, so a large tree lies in many partitions; a partition's first
    number in a tree comes from counts, of which there is one a tree and partition.
    """
    ranged = rows.repartitionByRange(tree, *(F.asc_nulls_first(c) for c in order)).sortWithinPartitions(tree, *(F.asc_nulls_first(c) for c in order))
    placed = written(ranged.withColumn("at_", F.monotonically_increasing_id()).withColumn("part_", F.shiftright("at_", 33)))
    counts = placed.groupBy(tree, "part_").agg(F.count("*").alias("here_"), F.min("at_").alias("first_"))
    whole = Window.partitionBy(tree)
    before = whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(tree, "part_", "first_", F.coalesce(F.sum("here_").over(before), F.lit(0)).alias("before_"), F.sum("here_").over(whole).alias("count"))
    out = placed.join(offsets, [tree, "part_"]).withColumn("pos", F.col("at_") - F.col("first_") + F.col("before_"))
    return written(out.drop("at_", "part_", "first_", "before_"), placed)


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole buckets from batches that are sorted by tree and pos, a few buckets at a time."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return batch.column("tree")[i].as_py(), batch.column("pos")[i].as_py() // BUCKET

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and sum(b.num_rows for b in held) >= BUCKET:
            # where the bucket ends that is open, if it ends in this batch
            open_, low, high = key(held[-1], held[-1].num_rows - 1), 0, batch.num_rows
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if key(batch, mid) == open_ else (low, mid)
            if low < batch.num_rows:
                yield pa.Table.from_batches([*held, batch.slice(0, low)])
                held, batch = [], batch.slice(low)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


class Engine:
    """DuckDB over the nodes of whole buckets: tree, pos, node, depth (levels to make here)."""

    def __init__(self):
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": False})

    def climb(self, nodes: pa.Table) -> None:
        """Tables level_0 to level_LEVELS, and run_k: the text of each run of level k."""
        self.db.register("given", nodes)
        self.db.execute("CREATE OR REPLACE TEMP TABLE level_0 AS SELECT tree, pos, node, depth FROM given")
        for k in range(LEVELS):
            self.db.execute(
                f"""CREATE OR REPLACE TEMP TABLE run_{k} AS
                SELECT tree, pos // {FAN} AS pos, depth, string_agg(node, '' ORDER BY pos) AS run FROM level_{k} WHERE depth > {k} GROUP BY tree, pos // {FAN}, depth"""
            )
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE level_{k + 1} AS SELECT tree, pos, sha256(run) AS node, depth FROM run_{k}")

    def roots(self, nodes: pa.Table) -> pa.Table:
        """The root of each bucket: tree, pos (the bucket's), node."""
        self.climb(nodes)
        tops = " UNION ALL ".join(f"SELECT tree, pos // {FAN ** (LEVELS - k)} AS pos, node FROM level_{k} WHERE depth = {k}" for k in range(LEVELS + 1))
        return self.db.sql(tops).to_arrow_table()

    def proofs(self, nodes: pa.Table, carried: str) -> pa.Table:
        """Every node with the texts left and right of it, level by level up to the root of all.

        The proof above a bucket (lefts, rights, root, subroot) stands with the bucket's first node.
        """
        self.climb(nodes)
        joins = " ".join(f"LEFT JOIN run_{k} ON run_{k}.tree = n.tree AND run_{k}.pos = n.pos // {FAN ** (k + 1)}" for k in range(LEVELS))
        within = [(f"run_{k}.run", f"CAST(64 * ((n.pos // {FAN**k}) % {FAN}) AS BIGINT)") for k in range(LEVELS)]
        lefts = ", ".join(f"CASE WHEN {k} < n.depth THEN [substr({run}, 1, {at})] ELSE [] END" for k, (run, at) in enumerate(within))
        rights = ", ".join(f"CASE WHEN {k} < n.depth THEN [substr({run}, {at} + 65)] ELSE [] END" for k, (run, at) in enumerate(within))
        return self.db.sql(
            f"""SELECT n.tree, n.pos, n.node, {carried}, o.root, o.subroot,
            list_concat({lefts}, o.lefts) AS lefts, list_concat({rights}, o.rights) AS rights
            FROM given n JOIN (SELECT tree, pos // {BUCKET} AS bucket, lefts, rights, root, subroot FROM given WHERE pos % {BUCKET} = 0) o
            ON o.tree = n.tree AND o.bucket = n.pos // {BUCKET} {joins}"""
        ).to_arrow_table()

    def folded(self, proofs: pa.Table, most: int) -> pa.Table:
        """What a row's own leaf (``kept``) and its proof make of the root, and the digest of the proof."""
        self.db.register("proved", proofs)
        step = "SELECT *, kept AS made FROM proved"
        for k in range(1, most + 1):
            step = f"SELECT * REPLACE (CASE WHEN len(lefts) >= {k} THEN sha256(lefts[{k}] || made || rights[{k}]) ELSE made END AS made) FROM ({step})"
        return self.db.sql(
            f"""SELECT id, node AS leaf, subroot, root,
            sha256(list_aggregate(list_concat([''], list_transform(lefts, lambda x, i: x || rights[i])), 'string_agg', '')) AS proof_sha256,
            made AS folded_root FROM ({step})"""
        ).to_arrow_table()


def _dealt(nodes: DataFrame) -> DataFrame:
    bucket = F.floor(F.col("pos") / BUCKET)
    return with_small_batches(nodes.repartition("tree", bucket).sortWithinPartitions("tree", "pos"))


def _with_depth(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("depth", F.least(levels("count"), F.lit(LEVELS)))


def _run(table: DataFrame, step, schema: str) -> DataFrame:
    """``step(engine, nodes)`` over whole buckets; its columns in the order of ``schema``."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = Engine()
        for nodes in whole_buckets(batches):
            yield from step(engine, nodes).select(names).to_batches(max_chunksize=BUCKET)
        engine.db.close()
        give_back()

    return _dealt(table).mapInArrow(run, schema)


class Tree:
    """Nodes of many trees, climbed in rounds until every tree has one node."""

    def __init__(self, nodes: DataFrame):
        """``nodes``: tree, pos, node, count and other columns."""
        most = nodes.agg(F.max("count")).first()[0] or 1
        self.rounds = [nodes]
        while most > 1:
            up = _run(_with_depth(self.rounds[-1].select("tree", "pos", "node", "count")), lambda engine, block: engine.roots(block), "tree string, pos long, node string")
            # every tree of more than one bucket has a count of its buckets; what is one node stays so
            counts = self.rounds[-1].filter("pos = 0").select("tree", F.ceil(F.col("count") / BUCKET).alias("count"))
            self.rounds.append(written(up.join(counts, "tree")))
            most = -(-most // BUCKET)

    def tops(self) -> DataFrame:
        return self.rounds[-1].select("tree", "node")

    def proved(self, above: DataFrame, k: int) -> DataFrame:
        """The nodes of round ``k`` with the proofs of the buckets that they are in (tree, pos, ...)."""
        first = above.withColumn("pos", F.col("pos") * BUCKET)
        return _with_depth(self.rounds[k]).join(first, ["tree", "pos"], "left")


PROOF = "tree string, pos long, lefts array<string>, rights array<string>, root string, subroot string"


def _descend(tree: Tree, above: DataFrame, last: int) -> DataFrame:
    """Proofs of the nodes of round ``last``, from those of the single nodes on top."""
    for k in range(len(tree.rounds) - 2, last - 1, -1):
        above = _run(tree.proved(above, k), lambda engine, block: engine.proofs(block, "NULL AS none"), PROOF)
    return above


def manifest(rows: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Where ``tampered`` holds, A-Z of the text are lower-cased before the root is folded again from
    the row's leaf and the siblings of its place. Texts are read once and not shuffled.
    """
    own = [F.col(c) for c in columns]
    changed = hashed(*(F.translate(F.col(c), UPPER, LOWER) if c == text_col else F.col(c) for c in columns))
    leaf = hashed(*own)
    kept = leaf if tampered is None else F.when(tampered, changed).otherwise(leaf)
    tree = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    hashes = written(rows.select(tree.alias("tree"), F.col(id_col).cast("long").alias("id"), leaf.alias("node"), kept.alias("kept")))
    leaves = numbered(hashes, "tree", "id", "node")
    discard(hashes)
    groups = Tree(leaves)
    # the roots of the groups are the leaves of one tree
    tops = groups.tops().withColumnRenamed("tree", GROUP).withColumn("tree", F.lit("all"))
    sources = numbered(tops, "tree", GROUP)
    over = Tree(sources)
    none = F.array().cast("array<string>")
    top = over.tops().select("tree", F.lit(0).cast("long").alias("pos"), none.alias("lefts"), none.alias("rights"), F.col("node").alias("root"), F.lit(None).cast("string").alias("subroot"))
    roots = _descend(over, top, 0)
    proofs = roots.join(sources.select("tree", "pos", GROUP, F.col("node").alias("own")), ["tree", "pos"])
    above = proofs.select(F.col(GROUP).alias("tree"), F.lit(0).cast("long").alias("pos"), "lefts", "rights", "root", F.col("own").alias("subroot"))
    above = _descend(groups, above, 1)
    most = LEVELS * (len(groups.rounds) + len(over.rounds) - 2)
    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    out = _run(groups.proved(above, 0), lambda engine, block: engine.folded(engine.proofs(block, "n.id, n.kept"), most), schema)
    done = written(out.withColumnRenamed("id", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root")))
    discard(*groups.rounds, *over.rounds)
    return done
