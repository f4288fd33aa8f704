"""Spans of a request: named steps with their seconds, or nothing at all (A-AS18, A-OB2)."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SPANS = "trace_id string, place int, parent int, name string, seconds double, note string"


class Tracer:
    """Takes down the spans of one request; a tracer that is off takes down nothing and has no id.

    A span that fails is kept with the error's name as its note, and the error goes on."""

    def __init__(self, on: bool = True, clock: Callable[[], float] = time.perf_counter):
        self.on, self.clock = on, clock
        self.trace_id = uuid.uuid4().hex if on else None
        self.rows: list[list] = []
        self._open: list[int] = []

    @contextmanager
    def span(self, name: str, note: str | None = None) -> Iterator[None]:
        if not self.on:
            yield
            return
        row = [self.trace_id, len(self.rows), self._open[-1] if self._open else None, name, None, note]
        self.rows.append(row)
        self._open.append(row[1])
        began = self.clock()
        try:
            yield
        except Exception as error:
            row[5] = type(error).__name__
            raise
        finally:
            row[4] = self.clock() - began
            self._open.pop()

    def timings(self) -> dict[str, float]:
        """Seconds by the names of steps, repeated ones in sum."""
        out: dict[str, float] = {}
        for _, _, _, name, seconds, _ in self.rows:
            out[name] = out.get(name, 0.0) + (seconds or 0.0)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """The spans as rows, for the audit sink."""
        return spark.createDataFrame([tuple(r) for r in self.rows], SPANS)
