"""Progress of streams: marks every so many rows, from the events that Spark posts after each micro-batch."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql.streaming import StreamingQueryListener


@dataclass(frozen=True)
class Mark:
    """`rows` rows are done: the query's number `number` mark, reached in micro-batch `batch` with `seen` rows in all."""

    query: str
    number: int
    rows: int
    seen: int
    batch: int
    rate: float


class ProgressMarks(StreamingQueryListener):
    """Calls `tell` at every `every` rows of each query and keeps the last `held` marks.

    A micro-batch that goes past several marks gives each of them. Rows count from the query's start in
    this session; a batch that Spark reports twice (it reports idle ones again) counts once.
    """

    def __init__(self, every: int = 25, tell: Callable[[Mark], None] | None = None, held: int = 1_000):
        self.every, self.tell = every, tell
        self.marks: deque[Mark] = deque(maxlen=held)
        self.ended: dict[str, str | None] = {}
        self._seen: dict[str, int] = {}
        self._batch: dict[str, int] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._seen[str(event.runId)] = 0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        run, batch = str(p.runId), p.batchId
        with self._lock:
            if self._batch.get(run, -1) >= batch:
                return
            before = self._seen.get(run, 0)
            self._batch[run], self._seen[run] = batch, before + p.numInputRows
            new = [Mark(p.name or str(p.id), n, n * self.every, self._seen[run], batch, p.processedRowsPerSecond) for n in range(before // self.every + 1, self._seen[run] // self.every + 1)]
            self.marks.extend(new)
        for mark in new if self.tell else ():
            self.tell(mark)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self.ended[str(event.runId)] = event.exception
            self._seen.pop(str(event.runId), None)
            self._batch.pop(str(event.runId), None)
