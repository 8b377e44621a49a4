"""Ordered groups through Arrow: many groups a task, each seen once, in order.

A group's rows arrive sorted, so what a recursion makes of them is linear in their number. Small
groups share batches; a group is held only while it is worked on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

ROWS = 65_536


def _flat(columns: list[pa.Array]) -> list[pa.Array]:
    """The columns, and for structs those of their fields."""
    return [f for c in columns for f in (_flat(c.flatten()) if pa.types.is_struct(c.type) else [c])]


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of rows that agree in the first n_keys columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []

    def same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
        return all(a.column(k)[i].as_py() == b.column(k)[j].as_py() for k in range(n_keys))

    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        change = np.zeros(n - 1, bool)
        for column in _flat([batch.column(k) for k in range(n_keys)]):
            codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change |= codes[1:] != codes[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        if held and not same(held[-1], held[-1].num_rows - 1, batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            held.append(batch.slice(lo, hi - lo))
            if hi < n:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def grouped_map(df: DataFrame, keys: list[str], order: list[str], columns: list[str], run: Callable[[pa.Table], dict | None], schema: str) -> DataFrame:
    """keys and the columns of schema that run makes of each group, sorted by order.

    run gets a table of keys, order and columns (once each) and returns arrays of one length by name, or None
    for no rows. Groups of null keys are groups.
    """
    names = [*keys, *(c for c in dict.fromkeys([*order, *columns]) if c not in keys)]
    rows = df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order)
    kinds = dict(df.dtypes)
    ddl = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), schema])
    out = to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)

    def apply(batches):
        parts: list[pa.Table] = []
        n = 0
        for group in _groups(batches, len(keys)):
            made = run(group)
            if made is None:
                continue
            size = len(next(iter(made.values())))
            if size == 0:
                continue
            own = [pa.array([group.column(k)[0].as_py()] * size, out.field(k).type) for k in range(len(keys))]
            parts.append(pa.table([*own, *(pa.array(made[f.name], f.type) for f in list(out)[len(keys) :])], schema=out))
            n += size
            if n >= ROWS:
                yield from pa.concat_tables(parts).combine_chunks().to_batches(ROWS)
                parts, n = [], 0
        if parts:
            yield from pa.concat_tables(parts).combine_chunks().to_batches(ROWS)

    return rows.mapInArrow(apply, ddl)


def numbers(group: pa.Table, column: str) -> np.ndarray:
    return group[column].to_numpy().astype(float)
