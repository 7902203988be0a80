"""Log file, progress line and graceful stop of a run."""

from __future__ import annotations

import logging
import signal
import sys
import threading
from collections import Counter
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql.streaming import StreamingQueryListener


class _Lines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        return f"{at} [{ {'WARNING': 'WARN', 'CRITICAL': 'ERROR'}.get(record.levelname, record.levelname) }] {record.getMessage()}"


def open_log(folder: str | Path | None, level: str = "info", name: str = "quellwerk") -> logging.Logger:
    """Logger whose lines all go to a new file in `folder` (none if null), those from `level` on to the console too.

    Warnings and errors go to stderr, the others to stdout; an unknown level is info.
    """
    log = logging.getLogger(name)
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    log.setLevel(logging.DEBUG)
    log.propagate = False
    least = getattr(logging, level.upper(), logging.INFO)
    out, err = logging.StreamHandler(sys.stdout), logging.StreamHandler(sys.stderr)
    out.addFilter(lambda r: r.levelno < logging.WARNING)
    out.setLevel(least)
    err.setLevel(max(least, logging.WARNING))
    handlers: list[logging.Handler] = [out, err]
    if folder is not None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        stamp = datetime.now(UTC).isoformat(timespec="milliseconds").replace(":", "-").replace(".", "-").replace("+00-00", "Z")
        handlers.append(logging.FileHandler(Path(folder) / f"harvest-{stamp}.log", "a", "utf-8"))
    for h in handlers:
        h.setFormatter(_Lines())
        log.addHandler(h)
    return log


class Stop:
    """A wish to stop: the first SIGINT or SIGTERM sets it, the work at hand is finished, a second one ends the process."""

    def __init__(self, log: logging.Logger):
        self.log, self.asked, self.before = log, False, {}

    def __enter__(self) -> Stop:
        if threading.current_thread() is threading.main_thread():
            self.before = {s: signal.signal(s, self._on) for s in (signal.SIGINT, signal.SIGTERM)}
        return self

    def _on(self, number: int, frame) -> None:
        self.asked = True
        self.log.warning("received %s; finishing the work at hand", signal.Signals(number).name)
        self.__exit__()

    def __exit__(self, *_) -> None:
        for s, handler in self.before.items():
            signal.signal(s, handler)
        self.before = {}


class Progress:
    """Counters of a run, logged in one line at each interval and at the end."""

    def __init__(self, log: logging.Logger, seconds: float = 10.0):
        self.log, self.seconds, self.counts, self._ended = log, seconds, Counter(), threading.Event()

    def line(self) -> str:
        return " ".join(f"{k}={v}" for k, v in sorted(self.counts.items())) or "nothing yet"

    def _run(self) -> None:
        while not self._ended.wait(self.seconds):
            self.log.info("progress: %s", self.line())

    def __enter__(self) -> Progress:
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._ended.set()
        self._thread.join()
        self.log.info("done: %s", self.line())


class StreamLog(StreamingQueryListener):
    """Logs the progress of streams: rows in, rows a second, batch."""

    def __init__(self, say: Callable[[str], None]):
        self.say = say

    def onQueryStarted(self, event) -> None:
        self.say(f"stream {event.id} started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.say(f"stream {p.id}: batch={p.batchId} rows={p.numInputRows} rows_per_second={p.processedRowsPerSecond:.1f}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.say(f"stream {event.id} ended{': ' + event.exception if event.exception else ''}")
