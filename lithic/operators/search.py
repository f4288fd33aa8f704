"""Lexical and dense search, fusion and rescoring (A-LX*, A-EM5, A-EM6, A-FU*, A-RR*).

Scores are rounded before they are ranked, since sums of doubles depend on their order, and ties go
by id. Statistics are over the whole corpus; facets filter after lexical scoring and before dense
ranking, as the two arms need.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.functions.text import TOKEN, tokens

K1, B, FLOOR = 1.5, 0.75, 0.25
DIGITS = 6
#: Query vectors that are held by every task at once.
QUERY_BLOCK = 2048
#: Scores of queries with rows that a task holds at once.
SCORE_CELLS = 1_000_000


def top(df: DataFrame, part: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each part with their 0-based rank; cut per task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1).filter(F.col(rank) < k)


def postings(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf, dl): one row a document and token, with the document's length."""
    split = corpus.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("token"))
    return split.groupBy(key, "token", "dl").agg(F.count("*").alias("tf"))


def corpus_stats(corpus: DataFrame, text: str) -> DataFrame:
    """One row: documents and mean length in tokens."""
    return corpus.agg(F.count("*").alias("N"), F.avg(F.size(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("avgdl"))


def term_weights(posted: DataFrame, stats: DataFrame, counted: bool = False) -> DataFrame:
    """(token, idf): negative weights become a quarter of the mean weight of the vocabulary."""
    df = posted if counted else posted.groupBy("token").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(stats)).select("token", (F.ln(F.col("N") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg((F.avg("raw") * FLOOR).alias("floor"))
    return raw.join(F.broadcast(mean)).select("token", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def bm25(questions: DataFrame, corpus: DataFrame, qkey: str, qtext: str, key: str, text: str) -> DataFrame:
    """(qkey, key, score) of every document that shares a token with a question (A-LX3).

    Only postings of tokens that some question asks for are joined; a question's repeated tokens
    count as often as they occur.
    """
    asked = questions.select(qkey, F.explode(tokens(F.coalesce(F.col(qtext), F.lit("")))).alias("token")).groupBy(qkey, "token").agg(F.count("*").alias("times"))
    stats = corpus_stats(corpus, text)
    posted = postings(corpus, key, text)
    weights = term_weights(posted, stats)
    wanted = asked.select("token").distinct()
    met = posted.join(wanted, "token", "left_semi").join(weights, "token").join(F.broadcast(stats))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    parts = met.select(key, "token", part.alias("part"))
    return parts.join(asked, "token").groupBy(qkey, key).agg(F.round(F.sum(F.col("part") * F.col("times")), DIGITS).alias("score"))


#: Terms of a block of questions that every task holds, and documents whose bounds are taken together.
BLOCK_TERMS, BLOCK_DOCS = 200_000, 512
#: Documents whose tokens are Python objects in a task at a time.
SLICE_DOCS = 256
#: Scores of documents for questions, or terms of documents beside questions, that a task holds at once.
BLOCK_CELLS = 1_000_000


def tokenised(corpus: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep``, dl, terms and times: the different tokens of each document and how often they occur.

    The same tokens as ``functions.text.tokens`` gives, made in one pass over Arrow batches."""
    schema = corpus.select(*keep).schema.add("dl", T.IntegerType()).add("terms", T.ArrayType(T.StringType())).add("times", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        from collections import Counter

        find, split = re.compile(TOKEN).findall, re.compile(r"[.\-/]").split
        for batch in (b.slice(i, SLICE_DOCS) for b in batches for i in range(0, b.num_rows, SLICE_DOCS)):
            lengths, ends, terms, times = [], [0], [], []
            for t in batch.column("text_").to_pylist():
                found = find(t.lower()) if t else []
                for x in [x for x in found if "." in x or "-" in x or "/" in x]:
                    found += [p for p in split(x) if p]
                held = Counter(found)
                lengths.append(len(found))
                terms += held.keys()
                times += held.values()
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            made = [pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.string())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, "dl", "terms", "times"])

    return corpus.select(*keep, F.col(text).alias("text_")).mapInArrow(run, schema)


def lexical_arms(questions: DataFrame, corpus: DataFrame, qkey: str, qtext: str, key: str, text: str, k: int = 20, cell: str | None = None, allowed: str | None = None) -> DataFrame:
    """(qkey, key, score, cover): a superset of the best k documents of each question by BM25 and by
    the weighted share of its different tokens, with both scores (A-LX3).

    The corpus is tokenised once and stored. Questions are taken in blocks of at most BLOCK_TERMS
    terms, which every task holds; a task scores blocks of its documents, skips those that bounds keep
    from the best k, and hands on its best k a question and arm, so that neither postings nor
    pairs are shuffled. With ``cell``, a string column of the corpus, and ``allowed``, a list column of
    the questions, a question ranks only documents of its cells; statistics stay the whole corpus's.
    """
    from lithic.sources.shared import stored

    spark = questions.sparkSession
    documents = stored(tokenised(corpus, text, key, *([cell] if cell else [])))
    stats = documents.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))
    df = documents.select(F.explode("terms").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    weights = term_weights(df, stats, counted=True)
    cells = [allowed] if allowed else []
    asked = questions.select(qkey, *cells, F.explode(tokens(F.coalesce(F.col(qtext), F.lit("")))).alias("token")).groupBy(qkey, "token", *cells).agg(F.count("*").alias("times"))
    told = stored(asked.join(weights, "token").select(qkey, "token", "times", "idf", *cells))
    mean = stats.first()["avgdl"]
    out = None
    for low, high in _blocks(told.groupBy(qkey).agg(F.count("*").alias("n")), qkey):
        rows = told.filter(F.col(qkey).between(low, high)).orderBy(qkey, "token").collect()  # at most BLOCK_TERMS, or one question's
        found = _lexical_block(rows, documents, float(mean), k, qkey, key, cell, allowed)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], f"{qkey} long, {key} long, score double, cover double")


def _blocks(sizes: DataFrame, qkey: str) -> Iterator[tuple[int, int]]:
    """Ranges of questions, in order, that hold at most BLOCK_TERMS terms, or one question."""
    low = high = None
    held = 0
    for row in sizes.orderBy(qkey).toLocalIterator():
        if low is not None and held + row["n"] > BLOCK_TERMS:
            yield low, high
            low, held = None, 0
        low, high, held = row[qkey] if low is None else low, row[qkey], held + row["n"]
    if low is not None:
        yield low, high


def _runs(n: np.ndarray) -> np.ndarray:
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)


def _pieces(n: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches of ``n`` that each sum up to ``most``, or hold one entry."""
    held = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(held, (held[lo - 1] if lo else 0) + most, "right")))
        yield slice(lo, hi)
        lo = hi


class _Best:
    """The k best documents of each question by one score, with the other score."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.other, self.name = k, np.full((n, k), -np.inf), np.zeros((n, k)), np.zeros((n, k), np.int64)

    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def put(self, q: np.ndarray, names: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        open_ = (score > 0) & (score >= self.floor()[q])
        q, names, score, other = q[open_], names[open_], score[open_], other[open_]
        for i in np.unique(q):
            at = q == i
            s, o, n = np.r_[self.score[i], score[at]], np.r_[self.other[i], other[at]], np.r_[self.name[i], names[at]]
            order = np.lexsort((n, -s))[: self.k]
            self.score[i], self.other[i], self.name[i] = s[order], o[order], n[order]


def _lexical_block(rows: list, documents: DataFrame, mean: float, k: int, qkey: str, key: str, cell: str | None, allowed: str | None) -> DataFrame:
    ids, q = np.unique(np.array([r[qkey] for r in rows], np.int64), return_inverse=True)
    terms = sorted({r["token"] for r in rows})
    number = {x: i for i, x in enumerate(terms)}
    term, idf, times = (np.array([f(r) for r in rows]) for f in (lambda r: number[r["token"]], lambda r: r["idf"], lambda r: r["times"]))
    whole = np.bincount(q, weights=idf, minlength=len(ids))
    order = np.lexsort((q, term))
    term, q = term[order], q[order]
    weights = (idf * times)[order], (idf[order] / np.where(whole == 0, 1.0, whole)[q])
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    wanted = sorted({c for r in rows for c in r[allowed] if c is not None}) if allowed else []
    place = {c: i for i, c in enumerate(wanted)}
    open_to = np.zeros((len(ids), len(wanted) + 1), bool)  # the last column is for cells that nobody asks for
    for i, r in zip(np.searchsorted(ids, [r[qkey] for r in rows]), rows, strict=True):
        for c in r[allowed] if allowed else ():
            if c is not None:
                open_to[i, place[c]] = True

    def optional(bounds: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Terms of a question that can't reach its floor even together: the weakest ones, while their sum stays below."""
        by = np.lexsort((bounds, q))
        run = np.cumsum(bounds[by])
        start = np.searchsorted(q[by], np.arange(len(ids)))
        before = np.where(start > 0, run[start - 1], 0.0)
        out = np.zeros(len(q), bool)
        out[by] = run - before[q[by]] < floor[q[by]] - 2 * 10.0**-DIGITS
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        vocabulary, best = pa.array(terms), (_Best(len(ids), k), _Best(len(ids), k))
        step = min(BLOCK_DOCS, max(1, BLOCK_CELLS // len(ids)))
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            lists, keys, length = batch.column("terms"), batch.column(key).to_numpy(), np.asarray(batch.column("dl"))
            found = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1)).astype(np.int64)
            doc, tf = np.repeat(np.arange(len(keys)), np.asarray(lists.value_lengths())), np.asarray(batch.column("times").flatten())
            cells = doc[found >= 0] * len(terms) + found[found >= 0]
            by = np.argsort(cells)
            cells, tf = cells[by], tf[found >= 0][by]
            d, at = cells // len(terms), cells % len(terms)
            value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[d] / mean))
            most, held = np.zeros(len(terms)), np.zeros(len(terms))
            np.maximum.at(most, at, value)
            held[at] = 1.0
            # a document is looked at for a question if it has a term that the question can't do without, for either score
            spare = optional(np.maximum(weights[0], 0) * most[term], best[0].floor()) & optional(np.maximum(weights[1], 0) * held[term], best[1].floor())
            n = np.add.reduceat(np.r_[~spare, False].astype(np.int64), first[:-1])
            n[first[1:] == first[:-1]] = 0
            needed = np.flatnonzero(~spare)
            begin = np.cumsum(n) - n
            looked = np.zeros(len(keys) * len(ids), bool)
            for some in _pieces(n[at], BLOCK_CELLS):
                wide = n[at[some]]
                looked[np.repeat(d[some], wide) * len(ids) + q[needed[np.repeat(begin[at[some]], wide) + _runs(wide)]]] = True
            pairs = np.flatnonzero(looked)
            if cell:
                at_cell = np.asarray(pc.fill_null(pc.index_in(batch.column(cell), value_set=pa.array(wanted, pa.string())), -1))
                pairs = pairs[open_to[pairs % len(ids), at_cell[pairs // len(ids)]]]
            scores = np.zeros((2, len(pairs)))
            dense = np.full(len(keys) * len(ids), -1, np.int64)
            dense[pairs] = np.arange(len(pairs))
            wide = first[at + 1] - first[at]
            for some in _pieces(wide, BLOCK_CELLS):
                ask = np.repeat(first[at[some]], wide[some]) + _runs(wide[some])
                to = dense[np.repeat(d[some], wide[some]) * len(ids) + q[ask]]
                ok = to >= 0
                ask, to, v = ask[ok], to[ok], np.repeat(value[some], wide[some])[ok]
                scores[0] += np.bincount(to, v * weights[0][ask], len(pairs))
                scores[1] += np.bincount(to, weights[1][ask], len(pairs))
            scores = np.round(scores, DIGITS)
            for arm in (0, 1):
                best[arm].put(pairs % len(ids), keys[pairs // len(ids)], scores[arm], scores[1 - arm])
        out: dict[tuple[int, int], tuple[float, float]] = {}
        for arm in (0, 1):
            for i, j in zip(*np.nonzero(best[arm].score > -np.inf), strict=True):
                both = float(best[arm].score[i, j]), float(best[arm].other[i, j])
                out[int(ids[i]), int(best[arm].name[i, j])] = both if arm == 0 else both[::-1]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[0] for x in out.values()], pa.float64()), pa.array([x[1] for x in out.values()], pa.float64())], [qkey, key, "score", "cover"])

    return documents.mapInArrow(run, f"{qkey} long, {key} long, score double, cover double")


def located_ranks(questions: DataFrame, corpus: DataFrame, wanted: DataFrame, qkey: str, qtext: str, key: str, text: str, locator: str) -> DataFrame:
    """(qkey, before, after): the rank from 0 of the wanted document of each question by BM25 over
    texts, and over locators and texts; null where it shares no token (E25).

    Every document that shares a token with a question is scored, and neither postings nor pairs are
    shuffled: tasks hold a block of questions with the scores of their wanted documents, and hand on how
    many of their documents stand before these.
    """
    out = wanted.select(qkey)
    for name, read in (("before", F.col(text)), ("after", F.concat_ws(" ", locator, text))):
        out = out.join(_ranked(questions, corpus.select(key, read.alias("read_")), wanted, qkey, qtext, key, "read_").withColumnRenamed("rank", name), qkey, "left")
    return out


def _ranked(questions: DataFrame, corpus: DataFrame, wanted: DataFrame, qkey: str, qtext: str, key: str, text: str) -> DataFrame:
    """(qkey, rank) of the wanted document of each question that shares a token with it."""
    from lithic.sources.shared import stored

    documents = stored(tokenised(corpus, text, key))
    stats = documents.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))
    df = documents.select(F.explode("terms").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    asked = questions.select(qkey, F.explode(tokens(F.coalesce(F.col(qtext), F.lit("")))).alias("token")).groupBy(qkey, "token").agg(F.count("*").alias("times"))
    weights = term_weights(df, stats, counted=True)
    told = stored(asked.join(weights, "token").join(wanted.select(qkey, F.col(key).alias("want")), qkey).select(qkey, "want", "token", "times", "idf"))
    mean = stats.first()["avgdl"]
    out = None
    for low, high in _blocks(told.groupBy(qkey).agg(F.count("*").alias("n")), qkey):
        rows = told.filter(F.col(qkey).between(low, high)).orderBy(qkey, "token").collect()  # at most BLOCK_TERMS, or one question's
        found = _rank_block(rows, documents, float(mean), qkey, key)
        out = found if out is None else out.union(found)
    return out if out is not None else questions.sparkSession.createDataFrame([], f"{qkey} long, rank long")


def _rank_block(rows: list, documents: DataFrame, mean: float, qkey: str, key: str) -> DataFrame:
    ids, opens, q = np.unique(np.array([r[qkey] for r in rows], np.int64), return_index=True, return_inverse=True)
    want = np.array([rows[i]["want"] for i in opens], np.int64)
    terms = sorted({r["token"] for r in rows})
    number = {x: i for i, x in enumerate(terms)}
    term, weight = np.array([number[r["token"]] for r in rows]), np.array([r["idf"] * r["times"] for r in rows])
    order = np.lexsort((q, term))
    term, q, weight = term[order], q[order], weight[order]
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    wide = np.diff(first)
    step = max(1, BLOCK_CELLS // len(ids))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of some documents and their scores for all questions, -inf where no token is shared."""
        import pyarrow.compute as pc

        vocabulary = pa.array(terms)
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            lists, keys, length = batch.column("terms"), batch.column(key).to_numpy(), np.asarray(batch.column("dl"))
            found = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1)).astype(np.int64)
            doc, tf = np.repeat(np.arange(len(keys)), np.asarray(lists.value_lengths())), np.asarray(batch.column("times").flatten())
            doc, tf, at = doc[found >= 0], tf[found >= 0], found[found >= 0]
            by = np.lexsort((at, doc))  # a document's terms always in the same order, so that equal scores are equal
            doc, tf, at = doc[by], tf[by], at[by]
            value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
            total, met = np.zeros(len(keys) * len(ids)), np.zeros(len(keys) * len(ids), bool)
            for some in _pieces(wide[at], BLOCK_CELLS):
                n = wide[at[some]]
                ask = np.repeat(first[at[some]], n) + _runs(n)
                to = np.repeat(doc[some], n) * len(ids) + q[ask]
                np.add.at(total, to, np.repeat(value[some], n) * weight[ask])
                met[to] = True
            yield keys, np.where(met, np.round(total, DIGITS), -np.inf).reshape(len(keys), len(ids))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, scores in scored(batches):
            d, i = np.nonzero((keys[:, None] == want[None, :]) & (scores > -np.inf))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(scores[d, i], pa.float64())], ["at", "score"])

    spark = documents.sparkSession
    named = spark.createDataFrame([(int(x),) for x in np.unique(want)], f"{key} long")
    floor = np.full(len(ids), np.inf)
    for r in documents.join(F.broadcast(named), key, "left_semi").mapInArrow(own, "at long, score double").collect():  # a row a question
        floor[r["at"]] = r["score"]

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(ids), np.int64)
        for keys, scores in scored(batches):
            n += ((scores > floor) | ((scores == floor) & (keys[:, None] < want[None, :]))).sum(axis=0)
        open_ = floor < np.inf
        yield pa.RecordBatch.from_arrays([pa.array(ids[open_]), pa.array(n[open_])], [qkey, "n"])

    return documents.mapInArrow(ahead, f"{qkey} long, n long").groupBy(qkey).agg(F.sum("n").alias("rank"))


def first_found(questions: DataFrame, corpus: DataFrame, qkey: str, qtext: str, key: str, text: str) -> DataFrame:
    """(qkey, key): the least key of the documents whose BM25 is above 0, of each question that has one.

    Tasks hold a block of questions and leave a question alone while their documents' keys lie above
    what they have found for it, so neither postings nor pairs are shuffled."""
    from lithic.sources.shared import stored

    documents = stored(tokenised(corpus, text, key))
    stats = documents.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))
    df = documents.select(F.explode("terms").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    asked = questions.select(qkey, F.explode(tokens(F.coalesce(F.col(qtext), F.lit("")))).alias("token")).groupBy(qkey, "token").agg(F.count("*").alias("times"))
    told = stored(asked.join(term_weights(df, stats, counted=True), "token").select(qkey, "token", "times", "idf"))
    mean = stats.first()["avgdl"]
    out = None
    for low, high in _blocks(told.groupBy(qkey).agg(F.count("*").alias("n")), qkey):
        rows = told.filter(F.col(qkey).between(low, high)).orderBy(qkey, "token").collect()  # at most BLOCK_TERMS, or one question's
        found = _first_block(rows, documents, float(mean), qkey, key)
        out = found if out is None else out.union(found)
    return out if out is not None else questions.sparkSession.createDataFrame([], f"{qkey} long, {key} long")


def _first_block(rows: list, documents: DataFrame, mean: float, qkey: str, key: str) -> DataFrame:
    ids, q = np.unique(np.array([r[qkey] for r in rows], np.int64), return_inverse=True)
    terms = sorted({r["token"] for r in rows})
    number = {x: i for i, x in enumerate(terms)}
    term, weight = np.array([number[r["token"]] for r in rows]), np.array([r["idf"] * r["times"] for r in rows])
    order = np.lexsort((q, term))
    term, q, weight = term[order], q[order], weight[order]
    step, far = max(1, BLOCK_CELLS // len(ids)), np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        vocabulary, best = pa.array(terms), np.full(len(ids), far)
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            lists, keys, length = batch.column("terms"), batch.column(key).to_numpy(), np.asarray(batch.column("dl"))
            live = best[q] > keys.min()
            t, asks, w = term[live], q[live], weight[live]
            first = np.searchsorted(t, np.arange(len(terms) + 1))
            found = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1)).astype(np.int64)
            doc, tf = np.repeat(np.arange(len(keys)), np.asarray(lists.value_lengths())), np.asarray(batch.column("times").flatten())
            doc, tf, at = doc[found >= 0], tf[found >= 0], found[found >= 0]
            value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
            total, wide = np.zeros(len(keys) * len(ids)), np.diff(first)
            for some in _pieces(wide[at], BLOCK_CELLS):
                n = wide[at[some]]
                ask = np.repeat(first[at[some]], n) + _runs(n)
                np.add.at(total, np.repeat(doc[some], n) * len(ids) + asks[ask], np.repeat(value[some], n) * w[ask])
            hit = np.round(total, DIGITS).reshape(len(keys), len(ids)) > 0
            best = np.minimum(best, np.where(hit, keys[:, None], far).min(axis=0))
        some = best < far
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(best[some])], [qkey, key])

    return documents.mapInArrow(run, f"{qkey} long, {key} long").groupBy(qkey).agg(F.min(key).alias(key))


def lexical_top(scores: DataFrame, qkey: str, key: str, k: int = 20) -> DataFrame:
    """The best k of each question, none with a score of 0 or less (A-LX4)."""
    return top(scores.filter("score > 0"), [qkey], [F.desc("score"), F.col(key)], k)


def dense_top(queries: DataFrame, corpus: DataFrame, k: int = 20, same: Sequence[str] = (), qkey: str = "qid", key: str = "id", vector: str = "vec") -> DataFrame:
    """(qkey, key, score, rank): exact largest dot products among rows that agree on ``same`` (A-EM5).

    Queries are taken in blocks of QUERY_BLOCK; a task holds a block, scores its rows with matrix
    products of SCORE_CELLS cells and hands on its best k a query, so what is shuffled is k rows a query and task.
    """
    ordered = queries.select(qkey, *same, vector).orderBy(qkey)
    out = None
    for begin in range(0, queries.count(), QUERY_BLOCK):
        rows = ordered.offset(begin).limit(QUERY_BLOCK).collect()
        found = _score_block(rows, corpus, k, same, qkey, key, vector)
        out = found if out is None else out.union(found)
    if out is None:
        out = queries.sparkSession.createDataFrame([], f"{qkey} long, {key} long, score double")
    return top(out, [qkey], [F.desc("score"), F.col(key)], k)


def _score_block(rows: list, corpus: DataFrame, k: int, same: Sequence[str], qkey: str, key: str, vector: str) -> DataFrame:
    ids = np.array([r[qkey] for r in rows], np.int64)
    matrix = np.array([r[vector] for r in rows], np.float64)
    groups: dict[tuple, list[int]] = {}
    for i, r in enumerate(rows):
        groups.setdefault(tuple(r[c] for c in same), []).append(i)
    step = max(1, SCORE_CELLS // len(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_s, best_i = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            vectors = np.array(batch.column(vector).to_pylist(), np.float64)
            keys = batch.column(key).to_numpy()
            held = list(zip(*(batch.column(c).to_pylist() for c in same), strict=True)) if same else [()] * len(keys)
            at: dict[tuple, list[int]] = {}
            for i, h in enumerate(held):
                if h in groups:
                    at.setdefault(h, []).append(i)
            for h, members in at.items():
                q = np.array(groups[h])
                scores = np.round(matrix[q] @ vectors[members].T, DIGITS)
                both_s = np.concatenate([best_s[q], scores], axis=1)
                both_i = np.concatenate([best_i[q], np.broadcast_to(keys[members], scores.shape)], axis=1)
                order = np.lexsort((both_i, -both_s), axis=1)[:, :k]
                best_s[q], best_i[q] = np.take_along_axis(both_s, order, 1), np.take_along_axis(both_i, order, 1)
        q, j = np.nonzero(best_s > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best_i[q, j]), pa.array(best_s[q, j])], [qkey, key, "score"])

    return corpus.select(key, *same, vector).mapInArrow(run, f"{qkey} long, {key} long, score double")


def fuse(arms: dict[str, DataFrame], part: Sequence[str], key: str, k: int = 60, keep: int = 20, carry: Sequence[str] = ()) -> DataFrame:
    """Reciprocal rank fusion of ranked arms; ties go by the arms' ranks in their order, then key (A-FU1, 2).

    Columns named in ``carry`` are the same in all arms and pass through."""
    rows = None
    for name, arm in arms.items():
        one = arm.select(*part, key, *carry, *(F.col("rank").alias(f"{n}_rank") if n == name else F.lit(None).cast("int").alias(f"{n}_rank") for n in arms))
        rows = one if rows is None else rows.unionByName(one)
    ranks = [f"{n}_rank" for n in arms]
    joined = rows.groupBy(*part, key).agg(*(F.min(r).alias(r) for r in ranks), *(F.first(c).alias(c) for c in carry))
    total = sum((F.coalesce(1.0 / (k + F.col(r) + 1), F.lit(0.0)) for r in ranks), F.lit(0.0))
    scored = joined.withColumn("rrf", F.round(total, 9))
    return top(scored, part, [F.desc("rrf"), *(F.asc_nulls_last(r) for r in ranks), F.col(key)], keep)


def pair_text(locator: Column, heading: Column, text: Column) -> Column:
    """What a pairwise scorer reads: locator, heading if it says more, text (A-RR1)."""
    return F.concat_ws(". ", F.nullif(locator, F.lit("")), F.when(heading != F.coalesce(locator, F.lit("")), F.nullif(heading, F.lit(""))), text)
