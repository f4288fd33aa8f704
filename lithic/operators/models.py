"""Models behind plain functions of a batch, with offline stand-ins that are named as such (A-EM*, A-RR*).

An embedder maps texts to vectors, a scorer maps pairs of texts to numbers. The stand-ins hash tokens
and weigh shared tokens; their scores are their own and no model's.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Embedder = Callable[[Sequence[str]], np.ndarray]
Scorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def hashed_embedder(dim: int = 384) -> Embedder:
    """Stand-in: signed counts of hashed tokens, of length 1."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for token in re.findall(r"[a-z0-9]+", text.lower()):
                h = zlib.crc32(token.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def shared_token_scorer() -> Scorer:
    """Stand-in: share of a question's tokens in a text, from -6 to 6."""

    def score(questions: Sequence[str], texts: Sequence[str]) -> list[float]:
        out = []
        for q, t in zip(questions, texts, strict=True):
            asked, held = (set(re.findall(r"[a-z0-9]+", x.lower())) for x in (q, t))
            out.append(12 * len(asked & held) / len(asked) - 6 if asked else -6.0)
        return out

    return score


def embedded(df: DataFrame, text: Column, embed: Embedder, out: str = "vec", batch: int = 32) -> DataFrame:
    """``df`` with vectors of length 1; documents take no prefix (A-EM1)."""

    def run(texts: pd.Series) -> pd.Series:
        rows = texts.fillna("").tolist()
        vectors = [v for i in range(0, len(rows), batch) for v in embed(rows[i : i + batch])]
        return pd.Series([list(map(float, v)) for v in vectors])

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return df.withColumn(out, F.pandas_udf(run, "array<double>")(text))


def embed_query(text: str, embed: Embedder, prefix: str = QUERY_PREFIX) -> list[float]:
    """A question's vector, with the instruction that questions take (A-EM2)."""
    return list(map(float, embed([prefix + text])[0]))


def throughput(embed: Embedder, texts: Sequence[str]) -> dict[str, float]:
    """Texts and characters a second (A-EM3)."""
    began = time.perf_counter()
    embed(texts)
    took = max(time.perf_counter() - began, 1e-9)
    return {"texts_a_second": len(texts) / took, "chars_a_second": sum(map(len, texts)) / took}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def asymmetry(embed: Embedder, question: str, right: str, wrong: str) -> bool:
    """Whether a question lies nearer to its passage than to another (A-EM4)."""
    q, a, b = (np.asarray(v) for v in (embed_query(question, embed), *embed([right, wrong])))
    return float(q @ a) > float(q @ b)


def batching_drift(embed: Embedder, texts: Sequence[str], sizes: Sequence[int] = (1, 8, 32)) -> float:
    """The largest difference that batching makes to a vector (A-EM8)."""
    whole = np.asarray(embed(texts))
    return max(float(np.abs(whole - np.concatenate([embed(texts[i : i + n]) for i in range(0, len(texts), n)])).max()) for n in sizes)


def rescored(hits: DataFrame, question: str, text: str, score: Scorer | None, out: str = "rerank") -> DataFrame:
    """``hits`` with a pair score, NULL where there is no scorer, so fused order stays (A-RR2, A-RR3)."""
    if score is None:
        return hits.withColumn(out, F.lit(None).cast("double"))

    def run(questions: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(list(score(questions.fillna("").tolist(), texts.fillna("").tolist())), dtype="float64")

    run.__annotations__ = {"questions": pd.Series, "texts": pd.Series, "return": pd.Series}
    return hits.withColumn(out, F.pandas_udf(run, "double")(question, text))


def best_rescored(hits: DataFrame, k: int = 5) -> DataFrame:
    """The first k of each question by the pair score alone (A-RR4)."""
    order = Window.partitionBy("qid").orderBy(F.desc("rerank"), "chunk_id")
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def compared(arms: dict[str, DataFrame]) -> DataFrame:
    """Ranked results of several chunkings side by side, a row a question and rank (A-EM7, A-FU3)."""
    out = None
    for name, arm in arms.items():
        one = arm.select("qid", "rank", F.col("chunk_id").alias(name))
        out = one if out is None else out.join(one, ["qid", "rank"], "full")
    return out
