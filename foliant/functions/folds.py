"""Folds over sorted groups in plain Python, streamed: a partition's groups go through one call, not one call each."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS_AT_ONCE = 4096


def fold_groups(rows: DataFrame, key: list[str], order: list[str], fold: Callable[[list[dict]], list[tuple]], schema: str | StructType) -> DataFrame:
    """fold(rows of one group, in order) -> output rows; a null key is a group like others.

    Only the group at hand and a batch of output are held.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names, arrow = [f.name for f in kind], to_arrow_schema(kind)

    def batch(out):
        columns = list(zip(*out)) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, arrow.field(i).type) for i, c in enumerate(columns)], schema=arrow)

    def run(batches):
        held: list[dict] = []
        out: list[tuple] = []
        now = None
        for b in batches:
            for row in b.to_pylist():
                mine = tuple(row[k] for k in key)
                if held and mine != now:
                    out += fold(held)
                    held = []
                    if len(out) >= ROWS_AT_ONCE:
                        yield batch(out)
                        out = []
                now = mine
                held.append(row)
        if held:
            out += fold(held)
        if out:
            yield batch(out)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, kind)
