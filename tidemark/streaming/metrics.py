"""Figures of running streams, for a monitor to read."""

from __future__ import annotations

from threading import Lock

from pyspark.sql.streaming import StreamingQueryListener


class Metrics(StreamingQueryListener):
    """Sums over the streams of a session, by query id; ``session.streams.addListener(Metrics())`` starts them."""

    def __init__(self):
        self._lock, self._queries = Lock(), {}

    def _of(self, id) -> dict:
        return self._queries.setdefault(str(id), {"running": True, "batches": 0, "rows": 0, "milliseconds": 0, "rows_per_second": 0.0, "error": None})

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._of(event.id)["running"] = True

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            q = self._of(p.id)
            q["batches"] += 1
            q["rows"] += p.numInputRows
            q["milliseconds"] += p.batchDuration
            q["rows_per_second"] = p.processedRowsPerSecond

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            q = self._of(event.id)
            q["running"], q["error"] = False, event.exception

    def snapshot(self) -> dict[str, dict]:
        """A copy of the figures of each query."""
        with self._lock:
            return {k: dict(q) for k, q in self._queries.items()}
