"""Secret scans with linking of credentials that come in several parts.

Strong parts stand on their own: assignments of a value to a secret's name (``assign``), access
identifiers (``access``) and long hexadecimal runs (``hex``). Weak candidates are reported only
when complementary parts lie within the same scope, an interval of ``scope`` code points around
a part: a mixed-case run (``loose``) that overlaps no other part needs an identifier in scope, a
named identifier (``ident``) needs a secret, and an endpoint (``endpoint``) needs both. Scopes are
joined with parts sorted by start and the greatest end so far, so the cost is n log n in a
document's parts, however long they are.

Defined cases: a null text is an empty one, without parts; rows are scanned each on their own,
whole; an empty table gives no rows; other columns are ignored. Spans that tie on their start
keep the order of KINDS. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from lithic.llm.common import map_batches, text_rows

KINDS = ("assign", "access", "hex", "loose", "ident", "endpoint")
BASE = KINDS[:3]

#: Patterns of the strong parts and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_MIN, ACCESS_MIN = 12, 18

LOOSE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_-])")
IDENT = re.compile(r"""(?:client|user|account|access)[_-]?(?:id|name|key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}""", re.I | re.A)
ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>]{4,}")

Span = tuple[int, int, str]


def strong_parts(text: str) -> list[Span]:
    """Matches of the three strong kinds, leftmost and non-overlapping within each kind."""
    found: list[Span] = []
    lowered = text.lower()  # only to see whether a keyword can occur at all
    if "pass" in lowered or "secret" in lowered or "token" in lowered or "api" in lowered:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def _mixed(token: str) -> bool:
    return any(c.islower() for c in token) and any(c.isupper() for c in token) and any(c.isdigit() for c in token)


class Intervals:
    """Spans sorted by start, each with the greatest end up to it."""

    def __init__(self, spans: list[Span]):
        spans = sorted(spans)
        self.starts = [s[0] for s in spans]
        self.reach = list(accumulate((s[1] for s in spans), max))

    def meets(self, low: int, high: int) -> bool:
        """Whether a span starts at ``high`` or before and ends at ``low`` or after."""
        i = bisect_right(self.starts, high)
        return i > 0 and self.reach[i - 1] >= low

    def overlaps(self, low: int, high: int) -> bool:
        """Whether a span shares a character with [low, high)."""
        i = bisect_left(self.starts, high)
        return i > 0 and self.reach[i - 1] > low


def joined(parts: list[Span], others: list[Span], scope: int) -> list[Span]:
    """Those of ``parts`` that have one of ``others``, which are of other kinds, within their scope."""
    held = Intervals(others)
    return [p for p in parts if held.meets(p[0] - scope, p[1] + scope)]


def weak_parts(text: str, strong: list[Span], scope: int) -> list[Span]:
    """Loose secrets, named identifiers and endpoints with their complements in scope."""
    access = [s for s in strong if s[2] == "access"]
    secrets = [s for s in strong if s[2] != "access"]
    lowered = text.lower()
    named = [(*m.span(), "ident") for m in IDENT.finditer(text)] if any(w in lowered for w in ("client", "user", "account", "access")) else []
    if not access and not named:
        return []
    taken = Intervals(strong + named)
    loose = [(*m.span(), "loose") for m in LOOSE.finditer(text) if _mixed(m[0]) and not taken.overlaps(*m.span())]
    loose = joined(loose, access + named, scope)
    named = joined(named, secrets + loose, scope)
    ends = [(*m.span(), "endpoint") for m in ENDPOINT.finditer(text)] if "://" in text else []
    ends = joined(joined(ends, access + named, scope), secrets + loose, scope)
    return loose + named + ends


def find_spans(text: str, scope: int) -> tuple[list[Span], list[Span]]:
    """Strong spans and the weak ones they bear out, each by start and then kind."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    strong = sorted(strong_parts(text), key=order)
    return strong, sorted(strong + weak_parts(text, strong, scope), key=order)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame, scope: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the found spans as arrays: strong ones, and all with the linked weak ones."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [find_spans(t, scope) for t in batch.column("text").to_pylist()]
            named = lambda spans: [{"start": a, "stop": b, "kind": k} for a, b, k in spans]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([named(s) for s, _ in found], kind), pa.array([named(s) for _, s in found], kind)], ["doc_id", "strong", "spans"])

        return step

    shape = "array<struct<start:bigint,stop:bigint,kind:string>>"
    return map_batches(text_rows(docs, id_col, text_col), make, f"doc_id long, strong {shape}, spans {shape}")


__all__ = ["BASE", "KINDS", "find_spans", "listed", "scan_secrets"]
