"""Order-dependent rules as folds over sorted rows, in a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 4096


def streamed(df: DataFrame, by: list[str], order: list[str], fold: Callable[[], object], schema: StructType) -> DataFrame:
    """Rows of `schema` that a fold makes of each group of df in its order.

    `fold()` begins a group: an object whose row(dict) gives the tuples to emit for a row, and whose end(dict) gives
    those at the group's end, from its last row. Groups are sorted by Spark, which spills, and read batch by batch; what
    is held is one batch and the fold's own state, whatever a group's size.
    """
    kind = to_arrow_schema(schema)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kind.types)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, last, out = None, None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or tuple(row[c] for c in by) != key:
                    if now is not None:
                        out += now.end(last)
                    key, now = tuple(row[c] for c in by), fold()
                out += now.row(row)
                last = row
                if len(out) >= ROWS:
                    yield packed(out)
                    out = []
        if now is not None:
            out += now.end(last)
        if out:
            yield packed(out)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


class Spaced:
    """Keeps the first row and each at least `least` after the last one kept; a null place is kept as the first only."""

    def __init__(self, at: str, least: int, columns: list[str]):
        self.at, self.least, self.columns = at, least, columns
        self.any, self.kept = False, None

    def row(self, row: dict) -> list[tuple]:
        at = row[self.at]
        if self.any and (at is None or self.kept is None or at - self.kept < self.least):
            return []
        self.any, self.kept = True, at
        return [tuple(row[c] for c in self.columns)]

    def end(self, last: dict) -> list[tuple]:
        return []
