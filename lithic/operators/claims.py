"""Answers: claims held against passages, aligned with paragraphs, and rendered (A-GE*, A-OB1).

Claims are rows (qid, claim_no, text, label); units are the paragraphs of a label's passage,
(qid, label, pos, locator, text).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.functions.text import content_tokens, overlap, strip

FLOOR, MARGIN, WEAK, UNIT_CHARS = 0.65, 0.05, 0.45, 40


def paragraph_units(passages: DataFrame, children: DataFrame, text: str) -> DataFrame:
    """(qid, label, pos, locator, text) of each passage's units (A-GE11).

    Units are paragraphs of 40 characters or more; one that a marker opens has the marker for a
    locator, after the letters of the first child's locator that has such letters. A passage none of
    whose paragraphs gets a locator takes its children that have one instead, if there are any.
    ``passages``: qid, label and the text; ``children``: qid, label, pos, locator, text.
    """
    place = ["qid", "label"]
    lettered = F.regexp_extract(strip(F.coalesce("locator", F.lit(""))), r"^([A-Z]{2,6})\d+\.\d+[a-z]?$", 1)
    prefix = children.withColumn("prefix_", lettered).filter("prefix_ != ''").groupBy(*place).agg(F.min_by("prefix_", "pos").alias("prefix_"))
    parts = passages.select(*place, F.posexplode(F.split(text, r"\n\s*\n")).alias("pos", "part")).withColumn("text", strip(F.col("part"))).filter(F.length("text") >= UNIT_CHARS)
    own = F.regexp_extract("text", r"^(\d+\.\d+[a-z]?)\b", 1)
    units = parts.join(prefix, place, "left").select(*place, "pos", F.when((own != "") & F.col("prefix_").isNotNull(), F.concat("prefix_", own)).otherwise("").alias("locator"), "text")
    kids = children.filter(strip(F.coalesce("locator", F.lit(""))) != "").select(*place, "pos", "locator", F.coalesce("text", F.lit("")).alias("text"))
    told = units.filter("locator != ''").select(*place).distinct()
    of_children = kids.join(told, place, "left_anti")
    return units.join(of_children.select(*place).distinct(), place, "left_anti").unionByName(of_children)


def half_up(x: float) -> float:
    """``x`` to six digits, halves upwards, as SQL rounds: binary fractions are exact halves now and then."""
    y = x * 1e6
    down = math.floor(y)
    if abs(y - down - 0.5) < 1e-4:
        return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return (down + (y - down > 0.5)) / 1e6


def similarities(said: list[str], held: list[str]) -> list[tuple[float, int, float]]:
    """(score, unit, second score) of each claim: the weighted share of its tokens in the unit that has most.

    Texts are tokens with spaces between. Weights are inverse frequencies within the passage; a
    token that no unit has weighs 1, and a claim's repeated tokens count each time (A-GE9, A-GE10). Of
    equal scores the first unit's stands; a claim without a token in common has the first unit, at 0.
    """
    holders: dict[str, list[int]] = {}
    for i, unit in enumerate(held):
        for token in set(unit.split()):
            holders.setdefault(token, []).append(i)
    weight = {token: math.log((len(held) + 1) / (len(units) + 0.5)) for token, units in holders.items()}
    out = []
    for claim in said:
        whole, shares = 0.0, {}
        for token, times in Counter(claim.split()).items():
            w = weight.get(token, 1.0) * times
            whole += w
            for i in holders.get(token, ()):
                shares[i] = shares.get(i, 0.0) + w
        ranked = nsmallest(2, ((half_up(x / whole), i) for i, x in shares.items()), key=lambda x: (-x[0], x[1]))
        (best, at), (second, _) = [*ranked, (0.0, 0), (0.0, 0)][:2]
        out.append((best, at, second))
    return out


#: Answers that are Python objects in a task at a time.
SLICE = 64


def align(claims: DataFrame, units: DataFrame, floor: float = FLOOR, margin: float = MARGIN) -> DataFrame:
    """Each claim's verdict, score and runner-up: EMPTY, FLOOR, TIE, NOLOC or MATCH (A-GE12).

    Tokens meet as one row an answer and passage, so each text is shuffled once and pairs of tokens
    never are. A claim that shares no token with its passage stands with the passage's first unit, at 0.
    """
    place = ["qid", "label"]
    words = F.coalesce(F.array_join(content_tokens(F.col("text")), " "), F.lit("")).alias("words")
    said = claims.groupBy(*place).agg(F.collect_list(F.struct("claim_no", words)).alias("said"))
    held = units.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("pos", "locator", words))).alias("held"))
    kinds = claims.schema
    schema = T.StructType([kinds["qid"], kinds["claim_no"], T.StructField("n_units", T.IntegerType()), T.StructField("best_", T.DoubleType()), T.StructField("second_", T.DoubleType()), T.StructField("locator", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            each = part.column("said").flatten()
            rows, ends = [], np.cumsum([0, *part.column("said").value_lengths().to_pylist()])
            told = each.field("words").to_pylist()
            for k, there in enumerate(part.column("held").to_pylist()):
                mine = told[ends[k] : ends[k + 1]]
                if there is None:
                    rows += [(None, 0.0, 0.0, None)] * len(mine)
                else:
                    rows += [(len(there), best, second, there[i]["locator"]) for best, i, second in similarities(mine, [u["words"] for u in there])]
            qid = part.column("qid").take(pa.array(np.repeat(np.arange(part.num_rows), np.diff(ends))))
            made = zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.float64(), pa.string()), strict=True)
            yield pa.RecordBatch.from_arrays([qid, each.field("claim_no"), *(pa.array(c, t) for c, t in made)], schema.names)

    met = said.join(held, place, "left").select("qid", "said", "held").mapInArrow(run, schema)
    empty, alone, best, second = F.col("n_units").isNull(), F.col("n_units") == 1, F.col("best_"), F.col("second_")
    verdict = (
        F.when(empty, "EMPTY").when(best < floor, "FLOOR").when(~alone & (best - second < margin), "TIE")
        .when(F.coalesce("locator", F.lit("")) == "", "NOLOC").otherwise("MATCH")
    )
    return met.select("qid", "claim_no", verdict.alias("verdict"), best.alias("best"), second.alias("runner_up"), F.when(verdict == "MATCH", F.col("locator")).alias("moved_to"))


def marked(text: Column, mark: Column) -> Column:
    """A sentence with a mark inside its full stop."""
    t = F.trim(text)
    ends = F.substring(t, -1, 1).isin(".", "!", "?")
    return F.when(ends, F.concat(F.regexp_replace(t, r".$", ""), F.lit(" ["), mark, F.lit("]"), F.substring(t, -1, 1))).otherwise(F.concat(t, F.lit(" ["), mark, F.lit("].")))


def format_answers(claims: DataFrame) -> DataFrame:
    """(qid, body, sources): numbered by first appearance of a citation, unattributed ones said (A-GE13).

    Claims are (qid, claim_no, text, citation), citation null where there is none.
    """
    said = claims.filter(F.trim("text") != "")
    first = said.filter("citation is not null").groupBy("qid", "citation").agg(F.min("claim_no").alias("at"))
    numbered = first.withColumn("no", F.row_number().over(Window.partitionBy("qid").orderBy("at", "citation")))
    rows = said.join(numbered, ["qid", "citation"], "left").withColumn("line", marked(F.col("text"), F.coalesce(F.col("no").cast("string"), F.lit("unattributed"))))
    bodies = rows.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("claim_no", "line"))), lambda x: x["line"]), " ").alias("body"))
    listed = numbered.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "citation"))), lambda x: F.concat(F.lit("["), x["no"].cast("string"), F.lit("] "), x["citation"])), "\n").alias("sources"))
    return bodies.join(listed, "qid", "left").select("qid", "body", F.coalesce("sources", F.lit("")).alias("sources"))


def render_context(passages: DataFrame, order: str, citation: str, text: str, most: int = 30_000) -> DataFrame:
    """(qid, context, too_large): labelled passages in order, joined by rules (A-GE1)."""
    block = F.concat(F.lit("[S"), (F.col(order) + 1).cast("string"), F.lit("] "), F.col(citation), F.lit("\n"), F.col(text))
    grouped = passages.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))), lambda x: x["b"]), "\n\n---\n\n").alias("context"))
    return grouped.withColumn("too_large", F.length("context") > most)


def parsed_claims(replies: DataFrame, text: str) -> DataFrame:
    """(qid, claim_no, text, label): a model's JSON as rows; malformed replies give none (A-GE4)."""
    shape = "struct<claims:array<struct<text:string,source:string>>>"
    read = replies.select("qid", F.from_json(text, shape).alias("j"))
    return read.select("qid", F.posexplode("j.claims").alias("claim_no", "c")).select("qid", "claim_no", F.col("c.text").alias("text"), F.col("c.source").alias("label"))


def user_message(question: Column, context: Column) -> Column:
    """A-GE3."""
    return F.concat(F.lit("EXCERPTS\n\n"), context, F.lit("\n\n---\n\nQUESTION\n"), question)


def labelled(claims: DataFrame, labels: DataFrame) -> DataFrame:
    """``claims`` with ``valid``: labels of the right form that stand in the table (A-GE5)."""
    known = labels.select("qid", "label", F.lit(True).alias("known_")).distinct()
    return claims.join(known, ["qid", "label"], "left").withColumn("valid", F.col("label").rlike(r"^S\d+$") & F.coalesce("known_", F.lit(False))).drop("known_")


def screened(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """``claims`` (with ``valid``) with the overlap with their label's passage, and ``weak``: valid ones
    under WEAK (A-GE6, A-GE7). A claim without a passage overlaps with nothing."""
    met = claims.join(passages.select("qid", "label", "passage"), ["qid", "label"], "left")
    share = overlap(F.col("text"), F.coalesce("passage", F.lit("")))
    return met.withColumn("overlap", share).withColumn("weak", F.col("valid") & (F.col("overlap") < WEAK)).drop("passage")


def truncated(prompt_tokens: Column, context_tokens: int) -> Column:
    """Whether a prompt came so near the window that its end may be lost (A-GE16)."""
    return prompt_tokens >= context_tokens - 64


def filled(body: str, sources: str, width: int = 92) -> str:
    """An answer as plain text (A-GE17)."""
    import textwrap

    text = textwrap.fill(body, width)
    return f"{text}\n\nSOURCES\n{textwrap.indent(sources, '  ')}" if sources else text


def answers(claims: DataFrame, units: DataFrame, citations: DataFrame) -> DataFrame:
    """From claims to rendered answers: aligned, cited by what they moved to, numbered (A-GE7, A-GE15)."""
    aligned = align(claims, units).select("qid", "claim_no", "moved_to")
    cited = claims.join(aligned, ["qid", "claim_no"]).join(citations.select("qid", "label", "citation"), ["qid", "label"], "left")
    whole = F.when(F.col("moved_to").isNotNull(), F.concat_ws(", ", "citation", "moved_to")).otherwise(F.col("citation"))
    return format_answers(cited.select("qid", "claim_no", "text", whole.alias("citation")))
