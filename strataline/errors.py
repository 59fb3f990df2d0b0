"""Exceptions. IO failures are OSErrors, all others ValueErrors."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException, PySparkException


class EngineError(ValueError):
    """A failure of the engine; the cause is chained."""


class SchemaMismatch(EngineError):
    """Data or a request does not fit the schema."""

    def __init__(self, message: str):
        super().__init__(f"schema mismatch: {message}")


class ParseError(EngineError):
    """A cell cannot be read as its field's type."""

    def __init__(self, row: int, column: str, raw: str | None, message: str):
        super().__init__(f"failed to parse value at row {row} column '{column}' ({raw!r}): {message}")
        self.row, self.column, self.raw = row, column, raw


class IngestIOError(OSError):
    """A source cannot be opened or read."""


def is_missing_path(error: BaseException) -> bool:
    return "PATH_NOT_FOUND" in str(getattr(error, "getCondition", lambda: "")() or "") or "PATH_NOT_FOUND" in str(error)


@contextmanager
def translated(what: str):
    """Turn Spark's errors into ours, keeping them as the cause."""
    try:
        yield
    except (EngineError, OSError):
        raise
    except AnalysisException as e:
        if is_missing_path(e):
            raise IngestIOError(f"{what}: path not found") from e
        raise EngineError(f"{what}: {str(e).splitlines()[0]}") from e
    except PySparkException as e:
        raise EngineError(f"{what}: {str(e).splitlines()[0]}") from e
