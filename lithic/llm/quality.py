"""Quality rules: text statistics and compression bands.

A text fails the base rules with fewer than ``min_words`` words, or when more than
``max_repeat_percent`` per cent of its words lie in eight-word windows found twice or more.
Compression bands then judge what is left: the zstandard ratio of the whole text against limits
for its length, and the ratios of its fixed chunks; below the band a text is repetitive, above it
incompressible. A text also fails when too large a share of its full chunks lies outside.

Defined cases: a null text has no words and fails; repeated rows are judged each on their own; an
empty table gives no rows; a text of any length is read whole, chunk by chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import map_batches, text_rows, with_small_batches

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Least and greatest ratio of compressed to plain bytes, for texts up to so many bytes. The greatest
#: ones lie between the measured range of good text and the ratios of base64 and alphanumeric words.
BANDS = (
    (64, 0.0, 9.0),
    (128, 0.25, 0.97),
    (192, 0.25, 0.915),
    (256, 0.25, 0.87),
    (512, 0.20, 0.79),
    (1024, 0.20, 0.74),
    (2048, 0.18, 0.68),
    (4096, 0.18, 0.62),
    (16384, 0.15, 0.57),
    (1 << 62, 0.12, 0.52),
)
CHUNK_BYTES, CHUNK_BAND, BAD_CHUNK_SHARE = 2048, (0.18, 0.63), 0.2


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in an eight-word window which occurs at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = ids * np.uint64(0x9E3779B97F4A7C15)
    for step in (1, 2, 4):  # windows of 2, 4 and 8 words
        mixed = (mixed[:-step] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (mixed[step:] + (mixed[:-step] >> np.uint64(29)))
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0  # equal windows have equal hashes
    return int(_covered(exact_ids(words)).sum())


def exact_ids(words: list[bytes]) -> np.ndarray:
    """A number for each eight-word window, equal for equal windows only."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    for step in (1, 2, 4):
        _, ids = np.unique(ids[:-step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)
    return ids


def _covered(windows: np.ndarray) -> np.ndarray:
    _, at, times = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[at] > 1)
    edge = np.zeros(len(windows) + WINDOW, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return edge.cumsum() > 0


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def band_verdict(data: bytes, press: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole, share of full chunks outside their band, and whether both pass."""
    n = len(data)
    if not n:
        return 0.0, 0.0, False
    ratio = len(press.compress(data)) / n
    low, high = next((a, b) for most, a, b in BANDS if n <= most)
    full = n // CHUNK_BYTES
    bad = sum(not CHUNK_BAND[0] <= len(press.compress(data[i * CHUNK_BYTES : (i + 1) * CHUNK_BYTES])) / CHUNK_BYTES <= CHUNK_BAND[1] for i in range(full))
    share = bad / full if full else 0.0
    return ratio, share, low <= ratio <= high and share <= BAD_CHUNK_SHARE


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, zstd_ratio double, bad_chunk_share double, base_failed boolean, kept boolean"


def judge_text(text: str, press: zstandard.ZstdCompressor, min_words: int, max_repeat_percent: int) -> tuple:
    """The values of FIELDS for one text."""
    data = text.encode()
    words = data.split()  # of bytes: splits at the six ASCII spaces and nowhere else
    n, repeats = len(words), repeated_words(words)
    failed = n < min_words or 100 * repeats > max_repeat_percent * n
    ratio, share, passes = band_verdict(data, press)
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats, ratio, share, failed, passes and not failed)


def judge_quality(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and FIELDS of every row; one narrow pass, no shuffle."""

    def make():
        press = zstandard.ZstdCompressor(level=level)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [judge_text(t, press, min_words, max_repeat_percent) for t in batch.column("text").to_pylist()]
            kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *(x.split()[0] for x in FIELDS.split(", "))])

        return step

    return map_batches(text_rows(docs, id_col, text_col), make, f"doc_id long, {FIELDS}")


def keep_good(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, level: int = 3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns as they are."""

    def passes(texts: pd.Series) -> pd.Series:
        press = zstandard.ZstdCompressor(level=level)
        return pd.Series([judge_text(t, press, min_words, max_repeat_percent)[-1] for t in texts], dtype="bool")

    passes.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return with_small_batches(docs).filter(F.pandas_udf(passes, "boolean")(F.coalesce(F.col(text_col), F.lit(""))))
