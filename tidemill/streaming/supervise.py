"""Restarts of failed queries: so many, so far apart, then the query stays stopped. What they did is recorded by a listener."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: As the log layer's job has them.
RESTARTS, PAUSE_S = 3, 3.0


@dataclass
class Record(StreamingQueryListener):
    """Starts, batches (id, rows) and ends of the queries with an id; the last of them, up to kept."""

    kept: int = 1000
    ids: set[str] = field(default_factory=set)
    events: deque = field(default_factory=deque)

    def _add(self, query: object, what: tuple) -> None:
        if str(query) in self.ids:
            self.events.append(what)
            while len(self.events) > self.kept:
                self.events.popleft()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.ids.add(str(event.id)) if not self.ids else None
        self._add(event.id, ("started", str(event.runId)))

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self._add(event.progress.id, ("batch", event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self._add(event.id, ("failed" if event.exception else "ended", str(event.runId)))


class GaveUp(RuntimeError):
    """A query that failed after its last restart."""


def supervised(spark: SparkSession, start: Callable[[], StreamingQuery], restarts: int = RESTARTS, pause_s: float = PAUSE_S, record: Record | None = None) -> int:
    """Run a query to its end, starting it again after failures; the restarts it took. start begins it from its checkpoint.

    After restarts failures more, GaveUp. A query that somebody stopped has ended.
    """
    if record is not None:
        spark.streams.addListener(record)
    try:
        for failures in range(restarts + 1):
            query = start()
            if record is not None:
                record.ids.add(str(query.id))
            try:
                query.awaitTermination()
                return failures
            except StreamingQueryException as e:
                if failures == restarts:
                    raise GaveUp(f"failed {failures + 1} times") from e
                time.sleep(pause_s)
        raise AssertionError
    finally:
        if record is not None:
            spark.streams.removeListener(record)
