"""Streams of rows dealt out by a key and sorted: work on whole groups, and decisions that depend on earlier rows.

Spark deals and sorts the rows (and spills where it must); a task reads its share once, so small groups cost no call
each and a decision's state is all that a large group holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def _dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int | None) -> DataFrame:
    dealt = df.repartition(n, *keys) if n else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order)


def _marks(batch: pa.RecordBatch, columns: Sequence[str]) -> list[tuple]:
    return list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)))


def new_keys(rows: pa.RecordBatch | pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether a row's keys aren't those of the row before; the first row counts as new."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for k in keys if rows.num_rows > 1 else ():
        a, b = rows.column(k).slice(1), rows.column(k).slice(0, rows.num_rows - 1)
        unlike = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= unlike.to_numpy(zero_copy_only=False) if isinstance(unlike, pa.Array) else unlike.to_numpy()
    return new


def key_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema, n: int | None = None, least: int = 1) -> DataFrame:
    """work() on whole groups of equal keys in order: one group at a time, or several of at least `least` rows together.
    The caller bounds the size of a group."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            begin, heads = 0, _marks(batch.slice(0, 1), keys)[0]
            at = np.flatnonzero(new_keys(batch, keys))
            for i in at[1:].tolist() if heads == last else at.tolist():
                if rows + i - begin >= least:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    if held:
                        yield from work(pa.Table.from_batches(held))
                    held, rows, begin = [], 0, i
            last = _marks(batch.slice(batch.num_rows - 1), keys)[0]
            held.append(batch.slice(begin))
            rows += batch.num_rows - begin
        if rows:
            yield from work(pa.Table.from_batches(held))

    return _dealt(df, keys, order, n).mapInArrow(run, schema)


def decided(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], start: Callable[[], Callable[..., bool]], n: int | None = None) -> DataFrame:
    """Rows that stand: start() makes a key's decider, which is asked with the columns' values of each row in order. It
    remembers what it needs of the rows before."""

    def run(batches):
        last, ask = None, None
        for batch in batches:
            keep = []
            for key, values in zip(_marks(batch, keys), _marks(batch, columns)):
                if ask is None or key != last:
                    last, ask = key, start()
                keep.append(bool(ask(*values)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return _dealt(df, keys, order, n).mapInArrow(run, df.schema)
