"""Text expressions: tokens, overlap, whole-word terms, locators and noise (A-LX1, A-PL1, A-GE*, A-CH*).

All are built-in column expressions but for Unicode folding, for which Spark has none.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*"

#: Words that never count as content when claims are screened against passages.
STOP = (
    "the a an of to in for and or is are be as that this which with on by must should may not from at it its their under section any all such other than when where have "
    "has been were was will can could would each both same these those there here into over more most less about after before during between within without upon"
).split()
#: Further words that do not count when claims are aligned with paragraphs.
ALIGN_STOP = [*STOP, "shall", "bank", "banks"]

#: What a line that carries no meaning of its own looks like.
NOISE = r"(?i)^(?:FAQ\s*\d*|Footnotes?|Page\s+\d+|\d{1,4}|[·■•\-–—]|n/?a\.?|\(?[a-zA-Z]\)?|[ivxlc]{1,5}\.?)$"

#: Ligatures, quotes, dashes and the hard space, as plain characters.
PLAIN = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " "}


def tokens(text: Column) -> Column:
    """Lower-case compound tokens, each followed by its parts if it is compound (A-LX1)."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    parts = lambda t: F.filter(F.split(t, r"[.\-/]"), lambda p: p != "")
    return F.flatten(F.transform(found, lambda t: F.when(t.rlike(r"[.\-/]"), F.concat(F.array(t), parts(t))).otherwise(F.array(t))))


def content_tokens(text: Column) -> Column:
    """Tokens of three characters or more that are no stop words, with their multiplicity (A-GE8)."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*ALIGN_STOP))


def long_words(text: Column) -> Column:
    """Words of four letters or more that are no stop words (A-GE6)."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin(*STOP))


def overlap(claim: Column, passage: Column) -> Column:
    """Share of the claim's long words that stand, as substrings, in the passage (A-GE6)."""
    words = long_words(claim)
    lowered = F.lower(passage)
    return F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: F.contains(lowered, w))), F.nullif(F.size(words), F.lit(0))), F.lit(0.0))


def term_pattern(terms) -> str:
    """One pattern for whole-word occurrence of any of the terms (A-PL1)."""
    return r"(?<![a-z0-9])(?:" + "|".join(re.escape(t).replace(r"\ ", " ").replace(r"\-", "-").replace("'", "'") for t in terms) + r")(?![a-z0-9])"


def has_term(lowered: Column, terms) -> Column:
    return lowered.rlike(term_pattern(terms))


def terms_in(lowered: Column, terms) -> Column:
    """Those of the terms that occur as whole words, in their own order."""
    held = F.array(*(F.lit(t) for t in terms))
    return F.filter(held, lambda t: F.regexp_like(lowered, F.concat(F.lit(r"(?<![a-z0-9])\Q"), t, F.lit(r"\E(?![a-z0-9])"))))


def strip(text: Column) -> Column:
    """All white space off both ends, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def plain_characters(text: Column) -> Column:
    for found, plain in PLAIN.items():
        text = F.replace(text, F.lit(found), F.lit(plain))
    return text


@F.pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    """NFKC normal form (A-CL9)."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def residue(texts: pd.Series) -> pd.Series:
    """Unknown footnote marks with 20 characters before and 30 after; contexts may overlap (A-CL6)."""
    mark = re.compile(r"\[F\s*o", re.IGNORECASE)
    return texts.map(lambda t: [] if t is None else [t[max(0, m.start() - 20) : m.start() + 30] for m in mark.finditer(t)])


def unmarked(text: Column) -> Column:
    """Footnote marks out, first the intact and then the mangled ones (A-CL5)."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)\d*\[Footnote\s*", " "), r"(?i)\[F\s*o\s*t?\s*n\s*\d*\s*o?\s*e\s*", " ")


def unbraced(text: Column) -> Column:
    """``{{x}}`` to ``x``, for up to 40 characters without braces (A-CL7)."""
    return F.regexp_replace(text, r"\{\{\s*([^{}]{1,40}?)\s*\}\}", "$1")


def squeezed(text: Column) -> Column:
    """Runs of spaces and tabs to one space, ends stripped (A-CL10)."""
    return strip(F.regexp_replace(text, r"[ \t]{2,}", " "))


def cleaned(text: Column) -> Column:
    """A line through all cleaning steps that are expressions (A-CL5, 7, 8, 10)."""
    return squeezed(plain_characters(unbraced(unmarked(text))))


def is_noise(text: Column) -> Column:
    return text.rlike(NOISE)


def locator(text: Column, chapter: Column) -> Column:
    """The paragraph number that opens a line; two-part ones take the chapter's letters (A-CH11)."""
    three, two, one = F.regexp_extract(text, r"^(\d{1,3}\.\d{1,3}\.\d{1,3})\s", 1), F.regexp_extract(text, r"^(\d{1,3}\.\d{1,3})\.?\s", 1), F.regexp_extract(text, r"^(\d{1,3})\.\s+\S", 1)
    prefix = F.coalesce(F.regexp_replace(chapter, r"\d+$", ""), F.lit(""))
    return F.when(three != "", three).when(two != "", F.concat(prefix, two)).when(one != "", one)


def enumerated_locator(text: Column, parent: Column) -> Column:
    """Marker of an enumerated line joined to its parent's (A-CH11)."""
    own = F.nullif(F.regexp_extract(text, r"^(\([a-zA-Z0-9ivx]{1,4}\))\s", 1), F.lit(""))
    return F.when(own.isNotNull() & parent.isNotNull() & (own != parent), F.concat(parent, own)).otherwise(F.coalesce(own, parent))


def is_bin(heading: Column) -> Column:
    """A heading that opens a bag of unrelated notes (A-AS13)."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(heading, F.lit(""))), "[^a-z0-9 ]+", " "))
    return plain.isin("footnotes", "footnote", "notes", "table", "tables", "") | (F.length(F.coalesce(heading, F.lit(""))) > 90)


def point_id(name: Column, namespace: str) -> Column:
    """The name-based (version 5) UUID of a name within a namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def word_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased: the prototypes' tokenizer (A-LX5)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def one_line(text: Column) -> Column:
    """All white space runs to one space, ends stripped: the prototypes' normaliser (A-CL18)."""
    return strip(F.regexp_replace(text, r"\s+", " "))


def indexed_text(locator_: Column, text: Column) -> Column:
    """What the lexical index reads of a chunk: its locator and its text (A-LX2)."""
    return F.concat_ws(" ", F.nullif(locator_, F.lit("")), text)
