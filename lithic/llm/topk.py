"""Exact top-k search by inner product with distributed histogram selection.

Components x become floor(256 * x), so scores are integers. Vectors are packed in chunks once;
chunks of queries meet chunks of candidates in the cells of a grid, so that neither side is ever
whole in a task or on the driver. All pairs are scored in every round: a round counts scores in the
bins of a range, Spark sums the counts, and the bin that holds a query's kth score is the next
round's range, until bins are one score wide. A chunk sends its bins from the top down to its own
kth score only, as no bin below can hold the kth score of all. The last round keeps what reaches the
kth score, each chunk its k best, and ties go to the smaller id.

Defined cases: a vector that is null or has a null or non-finite component takes no part, as query
or candidate; a vector is compared with those of its own length; a query is never its own candidate,
but a repeated row is another row, and each repeat of a query gives its own ranks; a null id is no
query and comes after all others in ties; scores beyond a long stay at its ends; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.llm.common import discard, give_back, with_small_batches, written

SCALE = 256
#: Rows and bytes of a chunk, and bins of a round.
QUERY_ROWS, CANDIDATE_ROWS, CHUNK_BYTES, BINS = 512, 2048, 1 << 20, 1024
MOST = (1 << 63) - 1
EXACT = float(1 << 53)

PACKED = "query boolean, dim int, turn long, n int, rids binary, ids binary, missing binary, parts binary, norm double"


def _whole(values: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(256 x) of all components, the offset of each row, and which rows take part."""
    flat = values.flatten()
    ends = np.r_[0, np.cumsum(np.asarray(values.value_lengths().fill_null(0)))]
    with np.errstate(over="ignore", invalid="ignore"):
        parts = np.floor(SCALE * np.asarray(flat.cast(pa.float64()).fill_null(math.nan)))
    bad = np.r_[0, np.cumsum(~np.isfinite(parts))]
    return parts, ends, np.asarray(values.is_valid()) & (bad[ends[1:]] == bad[ends[:-1]])


def _chunk(query: bool, dim: int, turn: int, rids, ids, missing, rows) -> dict:
    norm = float(np.sqrt((rows * rows).sum(axis=1)).max()) if dim else 0.0
    return {"query": query, "dim": dim, "turn": turn, "n": len(rids), "rids": rids.tobytes(), "ids": ids.tobytes(), "missing": missing.tobytes(), "parts": rows.tobytes(), "norm": norm}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    turn = TaskContext.get().partitionId()
    for batch in batches:
        parts, starts, good = _whole(batch.column("vector"))
        rids, asks = np.asarray(batch.column("rid")), np.asarray(batch.column("asks").fill_null(False))
        ids, missing = np.asarray(batch.column("id").fill_null(0)), np.asarray(batch.column("id").is_null())
        length = np.diff(starts)
        for dim in map(int, np.unique(length[good])):
            here = np.flatnonzero(good & (length == dim))
            for query, at, most in ((True, here[asks[here]], QUERY_ROWS), (False, here, CANDIDATE_ROWS)):
                step = max(1, min(most, CHUNK_BYTES // max(1, 8 * dim)))
                chunks = []
                for i in range(0, len(at), step):
                    some = at[i : i + step]
                    chunks.append(_chunk(query, dim, turn, rids[some], ids[some], missing[some], parts[starts[some][:, None] + np.arange(dim)]))
                    turn += 1
                    if len(chunks) == 4:
                        yield _packed(chunks)
                        chunks = []
                if chunks:
                    yield _packed(chunks)
    give_back()


def _packed(chunks: list[dict]) -> pa.RecordBatch:
    kinds = {"query": pa.bool_(), "dim": pa.int32(), "turn": pa.int64(), "n": pa.int32(), "norm": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([c[k] for c in chunks], kinds.get(k, pa.binary())) for k in chunks[0]], list(chunks[0]))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; sums that a double can't hold are made with whole numbers."""
    dim = q.shape[1]
    if not dim or dim * np.abs(q).max() * np.abs(c).max() < EXACT:
        return (q @ c.T).astype(np.int64)
    long = [[int(x) for x in row] for row in c]
    made = [[max(-MOST, min(MOST, sum(map(int.__mul__, row, other)))) for other in long] for row in ([int(x) for x in r] for r in q)]
    return np.array(made, np.int64)


class _Pair:
    """A chunk of queries against a chunk of candidates: scores, and which of them reach a query's floor."""

    def __init__(self, row: dict, least: int):
        n, dim = row["n"], row["dim"]
        self.qids = np.frombuffer(row["ids"], np.int64)
        self.rids, own = np.frombuffer(row["rids"], np.int64), np.frombuffer(row["c_rids"], np.int64)
        self.cids, self.missing = np.frombuffer(row["c_ids"], np.int64), np.frombuffer(row["c_missing"], bool)
        self.scores = _scores(np.frombuffer(row["parts"], np.float64).reshape(n, dim), np.frombuffer(row["c_parts"], np.float64).reshape(len(own), dim))
        self.floor = np.full(n, least, np.int64)
        for found in row["floors"] or ():
            self.floor[found["slot"]] = found["floor"]
        self.ok = self.scores >= self.floor[:, None]
        at = np.minimum(np.searchsorted(own, self.rids), len(own) - 1)
        same = np.flatnonzero(own[at] == self.rids)
        self.ok[same, at[same]] = False


def _counted(pair: _Pair, width: int, k: int) -> dict:
    """slot, old floor, floor of a bin and count, from the top down to the chunk's own kth score."""
    rows, cols = np.nonzero(pair.ok)
    with np.errstate(over="ignore"):
        apart = pair.scores[rows, cols].view(np.uint64) - pair.floor[rows].view(np.uint64)
    bins = np.minimum(apart // np.uint64(width), np.uint64(BINS)).astype(np.int64)
    counts = np.bincount(rows * (BINS + 1) + bins, minlength=len(pair.floor) * (BINS + 1)).reshape(-1, BINS + 1)
    above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
    slot, which = np.nonzero((counts > 0) & (above < k))
    with np.errstate(over="ignore"):
        low = (pair.floor[slot].view(np.uint64) + which.astype(np.uint64) * np.uint64(width)).view(np.int64)
    return {"slot": slot.astype(np.int32), "old": pair.floor[slot], "low": np.where(which == BINS, MOST, low), "times": counts[slot, which]}


def _best(pair: _Pair, k: int) -> dict:
    """The k best candidates of the chunk that reach the kth score, ties to the smaller id."""
    rows, cols = np.nonzero(pair.ok)
    score = pair.scores[rows, cols]
    order = np.lexsort((pair.cids[cols], pair.missing[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    first = np.searchsorted(rows, np.arange(len(pair.floor)))
    kept = np.arange(len(rows)) - first[rows] < k
    rows, cols = rows[kept], cols[kept]
    return {"query_rid": pair.rids[rows], "query_id": pair.qids[rows], "vec_id": pa.array(pair.cids[cols], mask=pair.missing[cols]), "score": score[kept]}


def _per_pair(cells: DataFrame, make, least: int, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                made = make(_Pair(row, least))
                n = len(next(iter(made.values())))
                if n:
                    yield pa.RecordBatch.from_pydict({name: (pa.array([row["chunk"]] * n, pa.int64()) if name == "chunk" else made[name]) for name in (x.split()[0] for x in schema.split(", "))})
        give_back()

    return with_small_batches(cells).mapInArrow(run, schema)


def _grid(queries: DataFrame, candidates: DataFrame, n_queries: int, n_candidates: int, cells: int) -> DataFrame:
    """Each chunk of queries with each of candidates, once: rows of cells hold a share of the queries,
    columns a share of the candidates, and only whole rows or columns are copied."""
    down = max(1, min(n_queries, round(math.sqrt(cells * n_queries / n_candidates))))
    along = max(1, min(n_candidates, math.ceil(cells / down)))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.withColumn("down", F.pmod("chunk", F.lit(down)).cast("int")).withColumn("along", every(along))
    right = candidates.withColumn("along", F.pmod("turn", F.lit(along)).cast("int")).withColumn("down", every(down))
    right = right.select("dim", "down", "along", *(F.col(c).alias(f"c_{c}") for c in ("rids", "ids", "missing", "parts")))
    return left.hint("merge").join(right, ["dim", "down", "along"])


def top_k(vectors: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each row that ``asks``.

    Candidates are all rows of ``vectors`` but the query's own. Rounds depend on the range of scores,
    and each shuffles chunks and at most k counts a query and chunk.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), asks.alias("asks"), F.col(vector_col).cast("array<double>").alias("vector"))
    packed = written(with_small_batches(rows).mapInArrow(_pack, PACKED))
    facts = packed.agg(F.count_if("query").alias("q"), F.count_if(~F.col("query")).alias("c"), F.max(F.when(F.col("query"), F.col("norm"))).alias("qn"), F.max("norm").alias("cn")).first()
    if not facts["q"]:
        discard(packed)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # a unique number of each chunk of queries: its partition and place in it are in its first row's id
    queries = packed.filter("query").withColumn("chunk", F.conv(F.hex(F.reverse(F.substring("rids", 1, 8))), 16, 10).cast("long"))
    candidates = packed.filter("not query")
    cells = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    reach = min(MOST, int(facts["qn"] * facts["cn"] * (1 + 1e-9)) + 1) if math.isfinite(facts["qn"] * facts["cn"]) else MOST
    width, floors = 2 * reach + 1, spark.createDataFrame([], "chunk long, floors array<struct<slot:int,floor:long>>")
    spent: list[DataFrame] = []
    while True:
        pairs = _grid(queries.join(floors, "chunk", "left"), candidates, facts["q"], facts["c"], cells)
        if width == 1:
            break
        width = -(-width // BINS)
        counted = _per_pair(pairs, lambda pair, w=width: _counted(pair, w, k), -reach, "chunk long, slot int, old long, low long, times long")
        summed = counted.groupBy("chunk", "slot", "low").agg(F.sum("times").alias("times"), F.min("old").alias("old"))
        from_top = Window.partitionBy("chunk", "slot").orderBy(F.desc("low"))
        running = summed.withColumn("reached", F.sum("times").over(from_top) >= k)
        found = running.groupBy("chunk", "slot").agg(F.coalesce(F.max(F.when(F.col("reached"), F.col("low"))), F.min("old")).alias("floor"))
        floors = written(found.groupBy("chunk").agg(F.collect_list(F.struct("slot", "floor")).alias("floors")), *spent)
        spent = [floors]
    best = _per_pair(pairs, lambda pair: _best(pair, k), -reach, "query_rid long, query_id long, vec_id long, score long")
    by_score = Window.partitionBy("query_rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return written(ranked.select("query_id", "rank", "vec_id", "score"), packed, *spent)
