"""SQL over named frames."""

from __future__ import annotations

from uuid import uuid4

from strataline.errors import EngineError, translated
from strataline.operators.frame import Frame
from strataline.types import quote


class SqlContext:
    """Named frames. Views exist only while a statement is analysed, so contexts do not see each other's names."""

    def __init__(self):
        self.frames: dict[str, Frame] = {}

    def register(self, name: str, frame: Frame) -> None:
        """Registering a name again replaces it."""
        if not name.strip():
            raise EngineError("a table needs a name")
        self.frames[name] = frame

    def execute(self, sql: str) -> Frame:
        """The lazy result of a query."""
        if not self.frames:
            raise EngineError("no table is registered")
        spark = next(iter(self.frames.values())).df.sparkSession
        held = f"strataline_hold_{uuid4().hex[:8]}"
        names, shadowed = list(self.frames), {}
        try:
            for n in names:
                if spark.catalog.tableExists(quote(n)):
                    spark.table(quote(n)).createOrReplaceTempView(f"{held}_{len(shadowed)}")
                    shadowed[n] = f"{held}_{len(shadowed)}"
                self.frames[n].df.createOrReplaceTempView(quote(n))
            with translated("SQL"):
                return Frame(spark.sql(sql))
        finally:
            for n in names:
                spark.catalog.dropTempView(n)
            for n, kept in shadowed.items():
                spark.table(kept).createOrReplaceTempView(quote(n))
                spark.catalog.dropTempView(kept)


def query(frame: Frame, sql: str) -> Frame:
    """A query over one frame, named ``df``."""
    context = SqlContext()
    context.register("df", frame)
    return context.execute(sql)
