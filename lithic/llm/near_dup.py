"""Near-duplicate documents by an LSH forest over MinHash signatures.

Each text's set of distinct word shingles is signed with HASHES minima. A tree of the forest is
one order of the signature's values (a rotation of them); texts that share the first ``depth``
values of an order are a region of that tree. Candidates are found in rounds, and every link is
confirmed on the full shingle sets:

1. texts with equal sets are one class; what follows sees one text a class;
2. the texts of regions are sorted by every tree's order, and each text meets its neighbours there:
   those with the longest common prefix, however deep the region is just there. Of a text's
   neighbours over all trees the NEIGHBOURS with the longest prefixes in sum are confirmed;
3. in every region that still holds several components, of any size, all pairs of texts in
   different components meet: the texts outside the main component against all others. Their
   signatures are compared in arrays, BLOCK texts against BLOCK; pairs whose signatures leave the
   threshold within reach are confirmed in groups that hold each text's full set once, the closest
   of each text first. No pair becomes a row but a link that was found.

The second round is linear in the texts and joins what is plainly alike; the last one leaves no
pair of a region open, so the neighbours chosen change the work and not the result. The chance
that a pair at the threshold s meets in no tree is (1 - s**depth)**trees: 7e-6 at 0.85 with the
defaults. A candidate whose sizes cannot reach s, or whose signatures agree in far fewer values
than s (five standard errors), is not carried to the full sets.

Components are found by alternating large-star and small-star steps on tables, or in one task
where the links have been counted and are few; no link, set or label is collected. Defined cases: a null, empty or blank text has no shingles and is linked
with nothing; fewer words than a shingle make one shingle of the whole sequence; repeated rows
come back as often as they went in; rows without an id get no component and are kept; texts that
share an id are linked through it, each with its own set; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithic.llm.common import checkpointed, give_back, let_go, map_batches, with_small_batches, written

HASHES = 64
#: Values of an order that texts are sorted by, and neighbours of a text that are confirmed at once.
SORTED, NEIGHBOURS = 16, 3
#: Ids that may be broadcast at once (16 MB), and bytes of signatures or shingle sets: the driver holds
#: a table some four times while it makes a broadcast of it.
BROADCAST_IDS, BROADCAST_BYTES = 300_000, 16 << 20
#: Texts of a region whose signatures are compared at once, pairs of a text confirmed first, and
#: shingles on either side of a group that is confirmed at once.
BLOCK, CLOSEST, SETS_AT_ONCE = 4096, 4, 1 << 18
#: Texts a task where links between them are handled, and edges that one task may join.
ROWS_A_TASK, EDGES_A_TASK = 8_000, 500_000

_rng = np.random.default_rng(20240229)
_ODD = _rng.integers(1 << 62, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(1 << 63, size=HASHES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit keys of a text's distinct shingles; A-Z lower-cased, ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(keys) - width + 1
    mixed = keys[:n].copy()
    for k in range(1, width):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _STEP + keys[k : k + n]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The HASHES minima of a set, in slices so that long texts need little memory."""
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        part = (shingles[i : i + 4096, None] ^ _XOR) * _ODD
        np.minimum(best, part.min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def prefix_keys(signed: np.ndarray, tree_at: list[int], depth: int) -> list[int]:
    """For each tree, a key of the first ``depth`` values of its order."""
    twice = np.concatenate([signed, signed]).tobytes()
    return [xxhash.xxh3_64_intdigest(twice[4 * at : 4 * (at + depth)], at) - (1 << 63) for at in tree_at]


class Forest:
    """The parameters of one run."""

    def __init__(self, width: int = 3, percent: int = 85, trees: int = 16, depth: int = 4):
        self.width, self.percent, self.trees, self.depth = width, percent, trees, depth
        self.tree_at = [t * HASHES // trees for t in range(trees)]
        self.parts = 1
        s = percent / 100
        self.least_agree = math.floor(HASHES * (s - 5 * math.sqrt(s * (1 - s) / HASHES)))


    def gathered(self, df: DataFrame) -> DataFrame:
        """A checkpoint of pairs, links or labels, in tasks for ROWS_A_TASK texts each: these tables
        are far smaller than the texts, and the number of their partitions follows the input."""
        return checkpointed(df.coalesce(self.parts))


def sign_texts(docs: DataFrame, forest: Forest, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (set size), set_key, signed, keys of every row."""
    width, tree_at, depth = forest.width, forest.tree_at, forest.depth
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, keys, signs, trees = [], [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, width)
                sizes.append(len(shingles))
                if not len(shingles):
                    keys.append(None), signs.append(None), trees.append(None)
                    continue
                signed = signature(shingles)
                keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                signs.append(signed.tobytes())
                trees.append(prefix_keys(signed, tree_at, depth))
            arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary()), pa.array(trees, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "set_key", "signed", "keys"])

        return step

    return map_batches(rows, make, "doc_id long, n long, set_key binary, signed binary, keys array<bigint>")


def shared(rows: DataFrame) -> DataFrame:
    """The rows of regions with two texts or more, and how many there are."""
    return rows.join(rows.groupBy("tree", "key").agg(F.count("*").alias("many")).filter("many > 1"), ["tree", "key"])


def neighbours(regions: DataFrame, nodes: DataFrame, forest: Forest) -> DataFrame:
    """(a, b): texts that stand side by side in the order of a tree, the closest of each text.

    Orders are dealt by range with the text last, so that texts of one signature part evenly; a pair
    that the end of a range parts is an open pair of its region, however small, in the last round."""
    depth, start = forest.depth, f"int(tree * {HASHES} / {forest.trees}) * 4"
    turned = F.expr(f"substring(concat(substring(signed, {start} + 1), substring(signed, 1, {start})), 1, {4 * SORTED})")
    rows = regions.select("tree", "node").join(nodes.select("node", "signed"), "node").select("tree", turned.alias("order"), "node")
    ranged = rows.repartitionByRange("tree", "order", "node").sortWithinPartitions("tree", "order", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, node = (batch.column(c).to_numpy() for c in ("tree", "node"))
            order = np.frombuffer(b"".join(batch.column("order").to_pylist()), np.uint32).reshape(-1, SORTED)
            if before is not None:
                tree, node, order = np.concatenate([before[0], tree]), np.concatenate([before[1], node]), np.concatenate([before[2], order])
            same = (order[1:] == order[:-1]) & (tree[1:] == tree[:-1])[:, None]
            prefix = np.where(same.all(axis=1), SORTED, same.argmin(axis=1))
            at = np.flatnonzero((prefix >= depth) & (node[1:] != node[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(node[at + 1]), pa.array(node[at]), pa.array(prefix[at], pa.int64())], ["a", "b", "prefix"])
            before = tree[-1:], node[-1:], order[-1:]
        give_back()

    pairs = with_small_batches(ranged).mapInArrow(run, "a long, b long, prefix long")
    met = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "prefix").groupBy("a", "b").agg(F.sum("prefix").alias("prefix"))
    best = Window.partitionBy("a").orderBy(F.desc("prefix"), "b")
    return met.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= NEIGHBOURS).select("a", "b")


def if_small(df: DataFrame, size: int) -> DataFrame:
    """Broadcast a table whose bytes have been counted, or else leave it to be shuffled."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def candidates(pairs: DataFrame, nodes: DataFrame, forest: Forest) -> DataFrame:
    """Distinct pairs (text, head) whose sizes and signatures leave the threshold within reach."""
    pairs = forest.gathered(pairs.filter("a != b").distinct())
    heads = forest.gathered(pairs.select(F.col("b").alias("node")).distinct())
    held = nodes.join(heads, "node").select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("signed").alias("s_b"))
    both = pairs.join(if_small(held, heads.count() * (4 * HASHES + 32)), "b").join(nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("signed").alias("s_a")), "a")
    near = both.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * forest.percent)
    least = forest.least_agree

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint32).reshape(-1, HASHES) for x in ("s_a", "s_b"))
            near = pa.array((a == b).sum(axis=1) >= least)
            return pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], ["a", "b"])

        return step

    return map_batches(near.select("a", "b", "s_a", "s_b"), make, "a long, b long")


def full_sets(ids: DataFrame, docs: DataFrame, nodes: DataFrame, forest: Forest, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the wanted nodes: the sorted keys of each of their sets, as bytes."""
    ids = forest.gathered(ids.distinct().join(nodes.select("node", "set_key"), "node"))
    width = forest.width
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    wanted = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "node")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, width).tobytes() for t in batch.column("text").to_pylist()]
            right = pa.array([hashlib.blake2b(s, digest_size=16).digest() == k for s, k in zip(sets, batch.column("set_key").to_pylist(), strict=True)])
            return pa.RecordBatch.from_arrays([batch.column("node").filter(right), pa.array(sets, pa.binary()).filter(right)], ["node", "shingles"])

        return step

    return written(map_batches(wanted, make, "node long, shingles binary").dropDuplicates(["node", "shingles"]).coalesce(forest.parts))


def bytes_of(sets: DataFrame) -> int:
    return sets.agg(F.sum(F.octet_length("shingles") + 16)).first()[0] or 0


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, forest: Forest, id_col: str, text_col: str) -> DataFrame:
    """Those pairs whose full shingle sets are similar enough."""
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs, nodes, forest, id_col, text_col)
    heads = sets.join(pairs.select(F.col("b").alias("node")).distinct(), "node")
    side = lambda x, of: of.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = pairs.join(if_small(side("b", heads), bytes_of(heads)), "b").join(if_small(side("a", sets), bytes_of(sets)), "a")
    percent = forest.percent

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = ([np.frombuffer(s, np.uint64) for s in batch.column(c).to_pylist()] for c in ("s_a", "s_b"))
            keep = pa.array([similar(x, y, percent) for x, y in zip(*sets, strict=True)], pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

        return step

    return map_batches(both.select("a", "b", "s_a", "s_b"), make, "a long, b long").distinct()


def linked(groups: DataFrame, docs: DataFrame, nodes: DataFrame, forest: Forest, id_col: str, text_col: str) -> DataFrame:
    """(a, b): links that full sets confirm within groups; of a text's links with texts of a region's
    main component, which are in one component already, one a group."""
    sets = full_sets(groups.select("node"), docs, nodes, forest, id_col, text_col)
    held = groups.join(if_small(sets, bytes_of(sets)), "node").select("group", "node", "main", "others", "shingles")
    percent = forest.percent

    def links(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("node", "main", "others", "shingles")), strict=True))
        own: dict[int, list[np.ndarray]] = {}
        for node, _, others, shingles in rows:
            if others is None:
                own.setdefault(node, []).append(np.frombuffer(shingles, np.uint64))
        found, done = [], set()
        for node, main, others, shingles in rows:
            mine = np.frombuffer(shingles, np.uint64)
            for a in others or ():
                if not (main and a in done) and any(similar(mine, x, percent) for x in own[a]):
                    found.append((a, node))
                    if main:
                        done.add(a)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return held.groupBy("group").applyInArrow(links, "a long, b long")


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, component) of every node of these edges but the least one of its component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        above = root.copy()
        np.minimum.at(above, root[x], low)
        np.minimum.at(above, root[y], low)
        while (above != above[above]).any():
            above = above[above]
        root = above
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def components_in_a_task(edges: DataFrame) -> DataFrame:
    """``components`` of edges that have been counted: one task holds them as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
        a, b = (np.concatenate([np.empty(0, np.int64), *side]) for side in (zip(*ends, strict=True) if ends else ((), ())))
        node, component = least_reachable(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(component, pa.int64())], ["node", "component"])

    return checkpointed(edges.coalesce(1).mapInArrow(run, "node long, component long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of the edges but that least one.

    Edges that one task can hold are joined there; the others by alternating star steps on tables."""
    now, mark = checkpointed(edges.select("a", "b").filter("a != b").distinct()), None
    if now.count() <= EDGES_A_TASK:
        return components_in_a_task(now)
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.explode(F.array("a", "b")).alias("a"), "m").filter("a != m").select("a", F.col("m").alias("b"))
        now = checkpointed(small.distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            let_go(edges.sparkSession)
            return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
        mark = seen


REGION = ["tree", "key"]


def open_groups(regions: DataFrame, labels: DataFrame, nodes: DataFrame, forest: Forest, closest: int = 0) -> DataFrame:
    """(group, node, main, others): all pairs of texts that share a region, lie in different components,
    and whose sizes and signatures leave the threshold within reach; each once, in the first tree they
    share. A group names some texts outside the main component (others null) and the texts that are
    to be compared with them. With ``closest``, only so many of each text in a unit, those whose
    signatures agree most.

    A region is dealt in blocks and every pair of its blocks is a row of its own, so a region of
    any size is spread over tasks."""
    placed = regions.select(*REGION, "node", "many").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    held = placed.groupBy(*REGION, "component").agg(F.count("*").alias("times"))
    mixed = held.groupBy(*REGION).agg(F.count("*").alias("several"), F.max_by("component", F.struct("times", "component")).alias("main")).filter("several > 1")
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    rows = placed.join(checkpointed(mixed.select(*REGION, "main")), REGION)
    rows = rows.join(nodes.select("node", "n", "signed"), "node").withColumn("i", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = rows.withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    units = dealt.groupBy(*REGION, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(
        F.first("main").alias("main"), F.collect_list(F.struct("node", "component", "n", F.col("i").alias("block"), "signed")).alias("texts")
    )
    least, percent, tree_at, depth = forest.least_agree, forest.percent, forest.tree_at, forest.depth
    orders = [np.arange(at, at + depth) % HASHES for at in tree_at]

    def unit_rows(tree: int, key: int, i: int, j: int, main: int, texts: list[dict]) -> list[tuple]:
        node, component, n, block = (np.array([t[c] for t in texts], np.int64) for c in ("node", "component", "n", "block"))
        signed = np.frombuffer(b"".join(t["signed"] for t in texts), np.uint32).reshape(-1, HASHES)
        stray = component != main
        pairs = []
        for k in np.flatnonzero(stray):
            # Of two strays the one with the lower number looks, a stray looks at all of the main component.
            at = np.flatnonzero((component != component[k]) & (~stray | (node > node[k])) & (np.minimum(n, n[k]) * 100 >= np.maximum(n, n[k]) * percent))
            if i != j:
                at = at[block[at] != block[k]]
            if not len(at):
                continue
            same = signed[at] == signed[k]
            agree = same.sum(axis=1)
            near = agree >= least
            for order in orders[:tree]:
                near &= ~same[:, order].all(axis=1)
            if near.any():
                most = at[near][np.argsort(-agree[near], kind="stable")[: closest or None]]
                pairs.append(np.stack([np.full(len(most), k), most]))
        if not pairs:
            return []
        a, b = np.concatenate(pairs, axis=1)
        part = [(np.cumsum(n[some]) // SETS_AT_ONCE)[at] for some, at in (np.unique(x, return_inverse=True) for x in (a, b))]
        order = np.lexsort((a, b, part[1], part[0]))
        a, b, left, right = a[order], b[order], part[0][order], part[1][order]
        out = []
        new = lambda *keys: np.flatnonzero(np.any([np.diff(k, prepend=-1) != 0 for k in keys], axis=0)).tolist()
        groups = new(left, right)
        for lo, hi in zip(groups, [*groups[1:], len(a)], strict=True):
            name = f"{tree}.{key}.{i}.{j}.{left[lo]}.{right[lo]}"
            out += [(name, x, False, None) for x in np.unique(node[a[lo:hi]]).tolist()]
            firsts = [lo + x for x in new(b[lo:hi])]
            out += [(name, int(node[b[x]]), not bool(stray[b[x]]), node[a[x:y]].tolist()) for x, y in zip(firsts, [*firsts[1:], hi], strict=True)]
        return out

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [row for k in range(batch.num_rows) for row in unit_rows(*(batch.column(c)[k].as_py() for c in ("tree", "key", "i", "j", "main", "texts")))]
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["group", "node", "main", "others"])

        return step

    return map_batches(units, make, "group string, node long, main boolean, others array<bigint>")


def one_id(known: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): classes that hold texts of one document."""
    of = known.select("doc_id", "set_key").distinct().groupBy("doc_id").agg(F.count("*").alias("many"), F.min("set_key").alias("one")).filter("many > 1")
    ids = known.join(checkpointed(of), "doc_id").select("set_key", "one").distinct()
    first = classes.select(F.col("set_key").alias("one"), F.col("node").alias("b"))
    return ids.join(classes, "set_key").join(first, "one").filter("node != b").select(F.col("node").alias("a"), "b")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, trees: int = 16, depth: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; links need ``percent`` similarity."""
    forest = Forest(width, percent, trees, depth)
    signed = checkpointed(sign_texts(docs, forest, id_col, text_col))
    forest.parts = max(6, signed.count() // ROWS_A_TASK)
    known = signed.filter("set_key is not null and doc_id is not null")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    nodes = checkpointed(known.join(classes, "set_key").filter("doc_id = node").dropDuplicates(["node", "set_key"]).select("node", "n", "set_key", "signed", "keys"))

    rows = nodes.select("node", F.posexplode("keys").alias("tree", "key"))
    regions = checkpointed(shared(rows))
    let_go(docs.sparkSession)
    near = forest.gathered(candidates(neighbours(regions, nodes, forest), nodes, forest))
    links = forest.gathered(confirmed(near, docs, nodes, forest, id_col, text_col).union(one_id(known, classes)))
    labels = components(links)

    # Each text's closest open pairs join most; then all pairs that are still open are confirmed.
    for closest in (CLOSEST, 0):
        groups = forest.gathered(open_groups(regions, labels, nodes, forest, closest))
        if groups.limit(1).count() == 0:
            break
        let_go(docs.sparkSession)
        links = forest.gathered(links.union(linked(groups, docs, nodes, forest, id_col, text_col)))
        labels = components(links)

    of_class = classes.join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("class_component"))
    out = signed.select("doc_id", "n", "set_key").join(of_class, "set_key", "left")
    component = F.coalesce("class_component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, trees: int = 20, depth: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their near-duplicate group, columns as they are."""
    drop = near_duplicates(docs, width, percent, trees, depth, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(drop, id_col, "left_anti")
