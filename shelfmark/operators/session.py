"""Searches as a user types them: one at a time, the newest only, figures in the same pass.

A request takes the next generation. Requests that come while a search runs are coalesced: all but the newest are dropped
unseen. The jobs of a search carry a tag of its own, and a newer request interrupts what carries the older one. A response is
accepted only if its generation is the newest. Tasks that run are told to end and do so between rows; interrupting their threads
would close channels that later tasks use. Total and elapsed time come with the rows: the total is observed while the
rows are ranked, so the catalog is read once.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.search import DEFAULT_RESULTS, HITS, found


def one_pass(matched: DataFrame, k: int) -> tuple[DataFrame, Observation]:
    """The best k rows, and an observation of ``total`` that is complete when an action on them is.

    A top-k reads every match, so the count of what enters it is the total.
    """
    seen = Observation(f"total-{uuid.uuid4().hex}")
    counted = matched.observe(seen, F.count(F.lit(1)).alias("total"))
    return counted.orderBy(F.desc("score"), F.asc("entry_id")).limit(k), seen


@dataclass(frozen=True)
class Response:
    """The shown rows (at most k of them, as a window shows), and what a status line says of them."""

    generation: int
    rows: list[Row]
    total: int
    truncated: bool
    elapsed: float

    @property
    def status(self) -> str:
        shown = f"{len(self.rows):,} of {self.total:,} shown" if self.truncated else f"{self.total:,} results"
        return f"{shown} in {self.elapsed * 1000:.0f} ms"


class SearchSession:
    """Searches of one user. ``submit`` returns at once; ``on_response`` is called for accepted responses, in a thread.

    ``arguments`` of ``submit`` are those of ``search``: catalog, spec, category, texts, documents, and limits.
    """

    def __init__(self, spark: SparkSession, on_response: Callable[[Response], None] | None = None, on_error: Callable[[int, Exception], None] | None = None):
        self.spark, self.on_response, self.on_error = spark, on_response, on_error
        self.name = uuid.uuid4().hex
        self.generation = 0
        self.latest: Response | None = None
        self._waiting: tuple[int, dict] | None = None
        self._running: int | None = None
        self._changed = threading.Condition()
        self._closed = False
        self._worker = threading.Thread(target=self._work, name=f"search-{self.name}", daemon=True)
        self._worker.start()

    def _tag(self, generation: int) -> str:
        return f"shelfmark-{self.name}-{generation}"

    def submit(self, **arguments) -> int:  # noqa: ANN003
        """Ask for a search; what was asked before is superseded. The generation of this one."""
        with self._changed:
            if self._closed:
                raise RuntimeError("the session is closed")
            self.generation += 1
            generation, self._waiting, running = self.generation, (self.generation, arguments), self._running
            self._changed.notify_all()
        if running is not None:
            self.spark.sparkContext.cancelJobsWithTag(self._tag(running))
        return generation

    def cancel(self) -> None:
        """Supersede what runs or waits by nothing."""
        with self._changed:
            self.generation += 1
            self._waiting, running = None, self._running
        if running is not None:
            self.spark.sparkContext.cancelJobsWithTag(self._tag(running))

    def wait(self, timeout: float | None = None) -> Response | None:
        """Until nothing runs or waits: the newest accepted response."""
        with self._changed:
            self._changed.wait_for(lambda: self._waiting is None and self._running is None, timeout)
            return self.latest

    def close(self) -> None:
        self.cancel()
        with self._changed:
            self._closed = True
            self._changed.notify_all()
        self._worker.join()

    def _current(self, generation: int) -> bool:
        return generation == self.generation

    def _work(self) -> None:
        interrupted = False
        while True:
            with self._changed:
                self._changed.wait_for(lambda: self._waiting is not None or self._closed)
                if self._waiting is None:
                    return
                (generation, arguments), self._waiting = self._waiting, None
                self._running = generation
            response, error = None, None
            # Workers of an interrupted search may still be closing when the next one asks for theirs, so it may try again.
            for _ in range(3 if interrupted else 1):
                self.spark.sparkContext.addJobTag(self._tag(generation))
                try:
                    response, error = self._search(generation, **arguments), None
                except Exception as e:  # noqa: BLE001 - an interrupted search fails in many ways
                    error = e
                finally:
                    self.spark.sparkContext.removeJobTag(self._tag(generation))
                if error is None or not self._current(generation):
                    break
            with self._changed:
                accepted = self._current(generation)
                interrupted = not accepted
                if accepted and response is not None:
                    self.latest = response
            if accepted and response is not None and self.on_response is not None:
                self.on_response(response)
            if accepted and error is not None and self.on_error is not None:
                self.on_error(generation, error)
            with self._changed:
                self._running = None
                self._changed.notify_all()

    def _search(self, generation: int, k: int = DEFAULT_RESULTS, **arguments) -> Response | None:  # noqa: ANN003
        began = time.monotonic()
        matched = found(**arguments)
        # Between two jobs nothing can be interrupted, so the generation is looked at.
        if not self._current(generation):
            return None
        rows, seen = one_pass(matched, k)
        shown = rows.select(*(c for c in (*HITS, "line_no", "line") if c in matched.columns)).collect()
        total = int(seen.get["total"])
        return Response(generation, shown, total, total > len(shown), time.monotonic() - began)
