"""Watching ingestion: severities and observers."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from dataclasses import dataclass
from enum import IntEnum
from pathlib import Path


class IngestSeverity(IntEnum):
    INFO = 0
    WARNING = 1
    ERROR = 2
    CRITICAL = 3

    @classmethod
    def parse(cls, text: "str | IngestSeverity") -> "IngestSeverity":
        if isinstance(text, cls):
            return text
        # Names of severities.
        found = {"info": cls.INFO, "warning": cls.WARNING, "warn": cls.WARNING, "error": cls.ERROR, "critical": cls.CRITICAL}.get(text.lower())
        if found is None:
            raise ValueError("alert_at_or_above must be 'info', 'warning', 'error', or 'critical'")
        return found


def severity_of(error: BaseException | None) -> IngestSeverity:
    """IO failures anywhere in the chain of causes are critical, others errors."""
    while error is not None:
        if isinstance(error, OSError):
            return IngestSeverity.CRITICAL
        error = error.__cause__
    return IngestSeverity.ERROR


@dataclass(frozen=True)
class IngestContext:
    path: str
    format: str


class Observer:
    """Base of observers. An alert is passed on as a failure unless overridden, so an observer that only watches
    failures hears of an alerting one twice."""

    def on_success(self, context: IngestContext, rows: int) -> None: ...

    def on_failure(self, context: IngestContext, severity: IngestSeverity, error: BaseException) -> None: ...

    def on_alert(self, context: IngestContext, severity: IngestSeverity, error: BaseException) -> None:
        self.on_failure(context, severity, error)


class CompositeObserver(Observer):
    def __init__(self, observers: list[Observer]):
        self.observers = observers

    def on_success(self, context, rows):
        for o in self.observers:
            o.on_success(context, rows)

    def on_failure(self, context, severity, error):
        for o in self.observers:
            o.on_failure(context, severity, error)

    def on_alert(self, context, severity, error):
        for o in self.observers:
            o.on_alert(context, severity, error)


class _Lines(Observer):
    def write(self, line: str) -> None:
        raise NotImplementedError

    def on_success(self, context, rows):
        self.write(f"ok {context.format} {context.path} rows={rows}")

    def on_failure(self, context, severity, error):
        self.write(f"failure [{severity.name}] {context.format} {context.path}: {error}")

    def on_alert(self, context, severity, error):
        self.write(f"ALERT [{severity.name}] {context.format} {context.path}: {error}")


class StderrObserver(_Lines):
    def write(self, line):
        print(line, file=sys.stderr)


class FileObserver(_Lines):
    """Appends lines with unix times to a file; failures to write are ignored."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def write(self, line):
        try:
            with self.path.open("a") as out:
                out.write(f"{int(time.time())} {line}\n")
        except OSError:
            pass


class CallbackObserver(Observer):
    """An observer from a dict of functions; exceptions in them are ignored."""

    def __init__(self, callbacks: dict[str, Callable]):
        self.callbacks = callbacks

    def _call(self, name: str, *args) -> bool:
        fn = self.callbacks.get(name)
        if fn is None:
            return False
        try:
            fn(*args)
        except Exception:  # noqa: S110
            pass
        return True

    def on_success(self, context, rows):
        self._call("on_success", context, rows)

    def on_failure(self, context, severity, error):
        self._call("on_failure", context, severity, error)

    def on_alert(self, context, severity, error):
        if not self._call("on_alert", context, severity, error):
            self.on_failure(context, severity, error)
