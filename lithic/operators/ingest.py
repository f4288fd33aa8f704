"""From parsed items to clean items, sections, parents and children (A-CL*, A-SE*, A-CH*).

Items are rows (doc_id, idx, text, orig, label, page). Order is always that of ``idx``. Steps that
only compare neighbours are windows over a document; the three that carry state which depends on
what was decided before (letters in sequence, sentence repair, recursive splitting) run once a
document in Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.functions import text as tx

DROPPED = ("PAGE_FOOTER", "PAGE_HEADER")
CHILD = ("TEXT", "LIST_ITEM", "PARAGRAPH", "FOOTNOTE", "CAPTION", "FORMULA")
MERGE_CEILING, CHILD_MAX, STAMP_WINDOW = 700, 1_800, 20


def reading_order(body: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, idx, ref) of all leaves, depth first, each group once (A-CL2).

    body(doc_id, pos, ref) and groups(doc_id, ref, children); a path of positions is carried down.
    """
    spark = body.sparkSession
    now = body.select("doc_id", F.array("pos").alias("path"), "ref")
    kids = groups.select("doc_id", F.col("ref").alias("parent"), F.posexplode("children").alias("k", "child"))
    leaves = spark.createDataFrame([], "doc_id string, path array<int>, ref string")
    while True:
        first = Window.partitionBy("doc_id", "ref").orderBy("path")
        met = now.withColumn("n_", F.row_number().over(first)).join(groups.select("doc_id", "ref", F.lit(True).alias("group_")), ["doc_id", "ref"], "left")
        leaves = leaves.unionByName(met.filter("group_ is null").select("doc_id", "path", "ref"))
        inner = met.filter("group_ and n_ = 1").select("doc_id", "path", F.col("ref").alias("parent"))
        now = inner.join(kids, ["doc_id", "parent"]).select("doc_id", F.concat("path", F.array(F.col("k"))).alias("path"), F.col("child").alias("ref"))
        if now.limit(1).count() == 0:
            break
    order = Window.partitionBy("doc_id").orderBy("path")
    return leaves.select("doc_id", (F.row_number().over(order) - 1).alias("idx"), "ref")


def source_text(text: Column, orig: Column) -> Column:
    """The original wherever it says something else (A-CL4)."""
    kept = tx.strip(orig)
    return F.when((kept != "") & (kept != tx.strip(text)), kept).otherwise(text)


def clean(items: DataFrame) -> DataFrame:
    """Items that are left, renumbered, with whether each is a footnote (A-CL1, 3 to 12)."""
    texts = items.filter(~F.col("label").isin(*DROPPED)).withColumn("text", source_text(F.col("text"), F.col("orig")))
    done = texts.withColumn("text", tx.squeezed(tx.fold(tx.plain_characters(tx.unbraced(tx.unmarked(F.col("text")))))))
    order = Window.partitionBy("doc_id").orderBy("idx")
    left = done.filter(F.length("text") > 0)
    return left.withColumns({"orig_idx": F.col("idx"), "is_footnote": F.col("label") == "FOOTNOTE"}).withColumn("idx", F.row_number().over(order) - 1)


def upper_median(values: Column) -> Column:
    """The element at n div 2 of the sorted values (A-CL15)."""
    s = F.sort_array(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def nearest_rank(values: Column, q: float) -> Column:
    """The element at int(q * n) of the sorted values (A-CH14)."""
    s = F.sort_array(values)
    return F.get(s, F.least(F.size(s) - 1, F.floor(F.size(s) * q).cast("int")))


def is_prose_table(cells: Column, n_cols: Column) -> Column:
    """A table of running text: few columns, a long cell, hardly any dotted leaders (A-CL13)."""
    leaders = F.size(F.filter(cells, lambda c: c.rlike(r"\.{4,}|(?:\. ){4,}")))
    return (n_cols <= 3) & F.exists(cells, lambda c: F.length(c) > 120) & (leaders < F.greatest(F.lit(2), F.floor(F.size(cells) / 4)))


def table_line(cells: Column) -> Column:
    """A table row as a line; a cell that repeats the last one that held text is left out (A-CL14)."""
    start = F.struct(F.lit("").alias("seen"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, cell: Column) -> Column:
        c = tx.strip(F.coalesce(cell, F.lit("")))
        new = (c != "") & (c != state["seen"])
        return F.struct(F.when(c != "", c).otherwise(state["seen"]).alias("seen"), F.when(new, F.concat(state["out"], F.array(c))).otherwise(state["out"]).alias("out"))

    return F.array_join(F.aggregate(cells, start, step)["out"], " ")


def sections(items: DataFrame, starts: Column, code: Column) -> DataFrame:
    """Half-open intervals of items, one a start, up to the next or the end (A-SE1)."""
    total = items.groupBy("doc_id").agg((F.max("idx") + 1).alias("n_"))
    flagged = items.filter(starts).select("doc_id", F.col("idx").alias("start_idx"), code.alias("code"))
    nxt = F.lead("start_idx").over(Window.partitionBy("doc_id").orderBy("start_idx"))
    return flagged.join(total, "doc_id").select("doc_id", "code", "start_idx", F.coalesce(nxt, F.col("n_")).alias("end_idx"))


def stamps(items: DataFrame, sections_: DataFrame, phrase: str, date: str = r"(\d{1,2} [A-Z][a-z]{2} \d{4})") -> DataFrame:
    """A section's date: in its first stamp within STAMP_WINDOW items, or in the four after it (A-SE4, 5)."""
    near = sections_.join(items.select("doc_id", "idx", "text"), "doc_id").filter((F.col("idx") >= F.col("start_idx")) & (F.col("idx") < F.least("end_idx", F.col("start_idx") + STAMP_WINDOW)))
    first = near.filter(F.col("text").rlike(phrase)).groupBy("doc_id", "start_idx").agg(F.min("idx").alias("stamp"))
    found = near.join(first, ["doc_id", "start_idx"]).filter(F.col("idx").between(F.col("stamp"), F.col("stamp") + 4))
    dated = found.withColumn("date", F.try_to_date(F.nullif(F.regexp_extract("text", date, 1), F.lit("")), "d MMM yyyy")).filter("date is not null")
    return sections_.join(dated.groupBy("doc_id", "start_idx").agg(F.min_by("date", "idx").alias("effective_from")), ["doc_id", "start_idx"], "left")


def coverage_faults(sections_: DataFrame, items: DataFrame) -> DataFrame:
    """Documents whose sections leave a gap, overlap or stop short (A-SE7)."""
    nxt = F.lead("start_idx").over(Window.partitionBy("doc_id").orderBy("start_idx"))
    ends = items.groupBy("doc_id").agg((F.max("idx") + 1).alias("n_"))
    rows = sections_.withColumn("next_", nxt).join(ends, "doc_id")
    return rows.filter(F.coalesce("next_", "n_") != F.col("end_idx")).select("doc_id").distinct()


def carried(items: DataFrame, header: Column, name: str = "header") -> DataFrame:
    """Each item with the last header at or before it (A-SE12)."""
    order = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn(name, F.last(header, ignorenulls=True).over(order))


def heading_spans(items: DataFrame, heading: Column) -> DataFrame:
    """Parents that headings open: one row a span, number 0 being what stands before the first (A-CH1, 3, 4)."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    numbered = items.withColumn("span", F.sum(heading.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = numbered.groupBy("doc_id", "span").agg(F.min("idx").alias("start_idx"), (F.max("idx") + 1).alias("end_idx"), F.sum(F.length("text")).alias("n_chars"), F.min_by("text", "idx").alias("head"))
    return rows.filter("n_chars > 0").select("doc_id", F.col("span").cast("int").alias("span"), "start_idx", "end_idx", "n_chars", F.when(F.col("span") == 0, "").otherwise(F.substring("head", 1, 120)).alias("heading"))


def accepted_letters(markers: list[str | None]) -> list[bool]:
    """Which of ``(a)``, ``(b)`` ... stand in sequence; ``(a)`` starts anew, None resets (A-CH2)."""
    out, due = [], "a"
    for m in markers:
        if m is None:
            due = "a"
            out.append(False)
            continue
        letter = m.strip("()")
        ok = letter == due or letter == "a"
        if ok:
            due = chr(ord(letter) + 1)
        out.append(ok)
    return out


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def opened(marks: pd.Series) -> pd.Series:
    """Which lines of each document continue its sequence; '' is a line without a letter."""

    def one(found: list[str | None]) -> list[bool]:
        live = [i for i, m in enumerate(found) if m != ""]
        out = [False] * len(found)
        for i, ok in zip(live, accepted_letters([found[i] for i in live]), strict=True):
            out[i] = ok
        return out

    return marks.map(one)


def letter_parents(items: DataFrame, reset: str = "is_heading") -> DataFrame:
    """``items`` with ``opens``: lines whose letter continues the sequence of their document (A-CH2).

    Only letters go to Python, many documents at a time."""
    mark = F.when(F.coalesce(reset, F.lit(False)), None).otherwise(F.regexp_extract(F.coalesce("text", F.lit("")), r"^\([a-z]\)", 0))
    rows = items.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", mark.alias("mark_"), F.struct(*items.columns).alias("row_")))).alias("rows_"))
    told = rows.select(F.col("rows_.row_").alias("row_"), opened(F.col("rows_.mark_")).alias("opens"))
    return told.select(F.explode(F.arrays_zip("row_", "opens")).alias("x_")).select("x_.row_.*", "x_.opens")


def repair(parts: list[str], ceiling: int = MERGE_CEILING) -> list[str]:
    """Fragments of a sentence joined: open end, lower-case start, and still short enough (A-CH9)."""
    out: list[str] = []
    for part in parts:
        last = out[-1] if out else ""
        if last and not last.endswith((".", "?", "!", ";", ":")) and part[:1].islower() and len(last) + len(part) <= ceiling:
            out[-1] = f"{last} {part}"
        else:
            out.append(part)
    return out


def split_long(text: str, limit: int = CHILD_MAX) -> list[str]:
    """Whole sentences up to a limit; one that is longer alone is cut (A-CH10)."""
    if len(text) <= limit:
        return [text]
    packed: list[str] = []
    for piece in re.split(r"(?<=[.;:])\s+", text):
        if packed and len(packed[-1]) + 1 + len(piece) <= limit:
            packed[-1] += f" {piece}"
        else:
            packed.append(piece)
    return [p[i : i + limit] for p in map(str.strip, packed) for i in range(0, len(p), limit)]


def split_recursively(text: str, size: int = 800, overlap: int = 100, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Chunks of up to ``size`` characters at the coarsest separator that helps, with overlap (A-CH16)."""
    mark = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(mark) + 1 :]
    pieces = list(text) if mark == "" else [p for p in text.split(mark) if p]
    out: list[str] = []
    held: list[str] = []

    def width(parts: list[str]) -> int:
        return sum(map(len, parts)) + len(mark) * max(0, len(parts) - 1)

    def flush() -> None:
        if held and (chunk := mark.join(held).strip()):
            out.append(chunk)

    for piece in pieces:
        if len(piece) > size:
            flush()
            held.clear()
            out += split_recursively(piece, size, overlap, finer) if finer else [piece]
            continue
        if held and width([*held, piece]) > size:
            flush()
            while held and (width(held) > overlap or width([*held, piece]) > size):
                held.pop(0)
        held.append(piece)
    flush()
    return out


def semantic_groups(vectors: list[list[float]], percentile: float = 90) -> list[int]:
    """A group number for each sentence: a new one after distances above the percentile (A-CH17)."""
    import numpy as np

    if len(vectors) < 2:
        return [0] * len(vectors)
    v = np.array(vectors, float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    gaps = 1 - (v[1:] * v[:-1]).sum(axis=1)
    return [0, *np.cumsum(gaps > np.percentile(gaps, percentile)).tolist()]


def children(items: DataFrame, ceiling: int = MERGE_CEILING, limit: int = CHILD_MAX) -> DataFrame:
    """(doc_id, child_no, text): noise dropped, sentences repaired, long ones split (A-CH5, 7, 9, 10)."""
    usable = items.filter(F.col("label").isin(*CHILD) & ~tx.is_noise(tx.strip(F.col("text")))) if "label" in items.columns else items.filter(~tx.is_noise(tx.strip(F.col("text"))))

    def cut(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: [x for y in repair([t.strip() for t in p if t.strip()], ceiling) for x in split_long(y, limit)])

    cut.__annotations__ = {"parts": pd.Series, "return": pd.Series}
    ordered = usable.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("parts"))
    return ordered.select("doc_id", F.posexplode(F.pandas_udf(cut, "array<string>")("parts")).alias("child_no", "text"))


def chapter_starts(items: DataFrame, volume: str) -> DataFrame:
    """(doc_id, start_idx, code): lines that open a chapter of a volume (A-SE2).

    A volume whose own name ends in a digit is one chapter, which its first mention opens (A-SE3).
    """
    if volume[-1:].isdigit():
        return items.filter(F.contains("text", F.lit(volume))).groupBy("doc_id").agg(F.min("idx").alias("start_idx")).withColumn("code", F.lit(volume))
    code = F.regexp_extract("text", rf"^\s*({re.escape(volume)}\d{{2}})(?![\w.])", 1)
    return items.withColumn("code", code).filter("code <> ''").select("doc_id", F.col("idx").alias("start_idx"), "code")


def without_chapters(documents: DataFrame, starts: DataFrame) -> DataFrame:
    """Documents that should have chapters and have none (A-SE8)."""
    return documents.join(starts.select("doc_id").distinct(), "doc_id", "left_anti")


def page_spans(items: DataFrame, sections_: DataFrame) -> DataFrame:
    """``sections_`` with the pages they reach over (A-SE6)."""
    within = sections_.join(items.select("doc_id", "idx", "page"), "doc_id").filter((F.col("idx") >= F.col("start_idx")) & (F.col("idx") < F.col("end_idx")))
    return sections_.join(within.groupBy("doc_id", "start_idx").agg(F.min("page").alias("page_from"), F.max("page").alias("page_to")), ["doc_id", "start_idx"], "left")


def overlaid(sections_: DataFrame, documents: DataFrame) -> DataFrame:
    """A section's date over its document's; a missing one never wipes a date (A-SE9)."""
    own = documents.select("doc_id", F.col("effective_from").alias("whole_"))
    return sections_.join(own, "doc_id", "left").withColumn("effective_from", F.coalesce("effective_from", "whole_")).drop("whole_")


def sections_report(sections_: DataFrame) -> DataFrame:
    """Codes, different dates and covered items of each document (A-SE10)."""
    return sections_.groupBy("doc_id").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.count_distinct("effective_from").alias("n_dates"), F.sum(F.col("end_idx") - F.col("start_idx")).alias("covered"))


def without_heading_line(items: DataFrame, part: list[str]) -> DataFrame:
    """Parts without a short first line, where they have other lines (A-CH6)."""
    order = Window.partitionBy(*part).orderBy("idx")
    n = F.count("*").over(Window.partitionBy(*part))
    return items.withColumns({"k_": F.row_number().over(order), "n_": n}).filter(~((F.col("k_") == 1) & (F.col("n_") > 1) & (F.length("text") < 120))).drop("k_", "n_")


def streams(items: DataFrame, part: list[str]) -> DataFrame:
    """(part, first_idx, is_footnote, text): body and footnotes repaired apart, merged by place (A-CH8)."""

    def join(rows: pd.Series) -> pd.Series:
        def one(found: list) -> list:
            out: list[list] = []
            for r in found:
                last = out[-1][1] if out else ""
                if last and not last.endswith((".", "?", "!", ";", ":")) and r["text"][:1].islower() and len(last) + len(r["text"]) <= MERGE_CEILING:
                    out[-1][1] = f"{last} {r['text']}"
                else:
                    out.append([r["idx"], r["text"]])
            return [{"first_idx": i, "text": t} for i, t in out]

        return rows.map(one)

    join.__annotations__ = {"rows": pd.Series, "return": pd.Series}
    grouped = items.groupBy(*part, "is_footnote").agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("rows"))
    made = F.pandas_udf(join, "array<struct<first_idx:int,text:string>>")
    return grouped.select(*part, "is_footnote", F.inline(made("rows")))


def assembled(items: DataFrame, spans: DataFrame, children_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and chunks with their ids (A-CH12, A-CH13).

    spans(doc_id, chapter, start_idx, end_idx, heading); children_(doc_id, idx, text). A parent's
    number counts all spans of its chapter; its text is all its items, with blank lines between.
    """
    number = F.row_number().over(Window.partitionBy("doc_id", "chapter").orderBy("start_idx")) - 1
    named = spans.withColumn("parent_id", F.format_string("%s::%s::%04d", F.col("doc_id").cast("string"), F.coalesce("chapter", F.lit("doc")), number))
    inside = lambda df: df.join(named.select("doc_id", "parent_id", "start_idx", "end_idx"), "doc_id").filter((F.col("idx") >= F.col("start_idx")) & (F.col("idx") < F.col("end_idx")))
    kids = inside(children_).withColumn("c_", F.row_number().over(Window.partitionBy("parent_id").orderBy("idx")) - 1)
    chunks = kids.select(F.format_string("%s::%03d", "parent_id", "c_").alias("chunk_id"), "doc_id", "parent_id", "idx", "text")
    whole = inside(items.filter(tx.strip(F.col("text")) != "")).groupBy("parent_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    counts = chunks.groupBy("parent_id").agg(F.count("*").alias("n_children"))
    parents = named.join(whole, "parent_id").join(counts, "parent_id").select("parent_id", "doc_id", "chapter", "heading", "text", F.length("text").alias("n_chars"), "n_children")
    return parents, chunks


def parents_report(parents: DataFrame) -> DataFrame:
    """Sizes of parents against their caps (A-CH15)."""
    sizes = F.collect_list("n_chars")
    return parents.groupBy("doc_id").agg(F.count("*").alias("n"), nearest_rank(sizes, 0.5).alias("p50"), nearest_rank(sizes, 0.9).alias("p90"), F.max("n_chars").alias("longest"), F.count_if(F.col("n_chars") > 8_000).alias("over_8000"), F.count_if(F.col("n_chars") > 12_000).alias("over_12000"))


STRATEGIES = ("recursive", "semantic", "parentdoc")


def collection_name(strategy: str, version: str = "v1") -> str:
    """The table that a chunking strategy writes to (A-CH19)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"{strategy!r} is none of {STRATEGIES}")
    return f"chunks_{strategy}_{version}"
