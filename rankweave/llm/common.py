"""Texts through Python in Arrow batches, with the key column untouched."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARROW = {
    "string": pa.string(),
    "double": pa.float64(),
    "int": pa.int32(),
    "long": pa.int64(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
}

# Rows of an Arrow batch whose texts and results are Python objects at one time.
SLICE = 512

# What a batch function returns: for each output row the number of its input row (None:
# one output row for each input row, in order), and the output columns.
Rows = tuple[Sequence[int] | None, Sequence[Sequence]]


def map_texts(
    df: DataFrame, keys: list[str], text: str, fields: dict[str, str], start: Callable[[], Callable[[list[str | None]], Rows | Iterator[Rows]]]
) -> DataFrame:
    """``keys`` and the columns that a function makes of the batches of ``text``.

    ``start`` runs once in each task and gives the function; where it returns an iterator,
    each part becomes a batch of its own. Keys stay in Arrow, so nulls and large numbers
    pass through unchanged, whatever their type.
    """
    names = [*keys, *fields]
    types = [ARROW[kind] for kind in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for begin in range(0, max(batch.num_rows, 1), SLICE):
                part = batch.slice(begin, SLICE)
                whole = work(part.column(len(keys)).to_pylist())
                for at, columns in [whole] if isinstance(whole, tuple) else whole:
                    held = [part.column(i) for i in range(len(keys))]
                    if at is not None:
                        rows = pa.array(at, pa.int64())
                        held = [h.take(rows) for h in held]
                    made = [pa.array(c, t) for c, t in zip(columns, types)]
                    yield pa.RecordBatch.from_arrays(held + made, names)

    schema = ", ".join(
        [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"`{k}` {t}" for k, t in fields.items()]
    )
    read = df.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))
    return read.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], schema: str, start: Callable[[], Callable[[pa.Table], pa.RecordBatch | None]]) -> DataFrame:
    """A function of all rows of each group of ``keys``, the groups of a task in one stream.

    Rows are shuffled by the keys and sorted within tasks, so a task holds one group at a
    time. It is for many small groups; the caller bounds the size of a group.
    """
    count = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        held: list[pa.RecordBatch] = []
        current = None

        def finished():
            if held:
                made = work(pa.Table.from_batches(held))
                held.clear()
                if made is not None and made.num_rows:
                    yield made

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_pylist() for i in range(count)]
            rows = list(zip(*columns))
            begin = 0
            for i in range(len(rows) + 1):
                if i < len(rows) and rows[i] == rows[begin]:
                    continue
                if rows[begin] != current:
                    yield from finished()
                    current = rows[begin]
                held.append(batch.slice(begin, i - begin))
                begin = i
                if i == len(rows):
                    break
        yield from finished()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
