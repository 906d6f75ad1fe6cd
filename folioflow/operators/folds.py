"""Ordered folds: what the next row does depends on what was decided before.

Rows are put in order once, keys and positions together, and cut into stretches of about as many
rows each, however many keys they hold and however far apart their positions are; only the columns
that decide are moved, never texts. Stretches are folded at once, as they stream by, in constant
memory, each as if a key began there. One in which another key begins ends as it does however it
began; one that lies within a key is folded again from the state its predecessor leaves. As a fold
forgets where it began at the next cut that does not depend on it, one more turn mostly does. What
is open after TURNS turns streams by once, a key in a task. The driver holds a row a stretch.
"""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.context import checkpoint

TURNS = 3


def stream_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable, start: Callable, out: str, kind: str = "int") -> DataFrame:
    """Adds a column: ``state, value = step(state, row)`` over each key's ordered rows.

    ``start()`` makes a key's first state. Nulls come as None."""
    columns = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for frame in frames:
            values = []
            key_of = list(zip(*(frame[k] for k in keys))) if len(frame) else []
            clean = frame.astype(object).where(frame.notna(), None)
            for key, row in zip(key_of, clean.itertuples(index=False)):
                if key != last:
                    last, state = key, start()
                state, value = step(state, row)
                values.append(value)
            frame[out] = values
            yield frame[[*columns, out]]

    spread = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return spread.mapInPandas(run, f"{fields}, `{out}` {kind}")


def stretched_fold(df: DataFrame, keys: Sequence[str], position: str, ties: Sequence[str], step: Callable, start: Callable, out: str, number: bool = False, stretch: int | None = None) -> DataFrame:
    """Adds a column: ``state, value = step(state, row)`` over each key's rows in the order of
    (position, ties), where value is true or false; with ``number`` how many were true so far.

    ``start()`` makes a key's first state; states are tuples of numbers, truth values and None.
    Nulls come as None. ``stretch`` is the number of rows of a stretch; without it there are as
    many stretches as the session shuffles into."""
    columns = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    key_at = [columns.index(k) for k in keys]
    order = [*keys, position, *ties]
    parts = [] if stretch is None else [max(1, -(-df.count() // stretch))]
    placed = df.repartitionByRange(*parts, *order).sortWithinPartitions(*order)
    rows = checkpoint(placed.withColumn("_at", F.monotonically_increasing_id()))
    stretch_of = F.shiftright("_at", 33)  # the partition, as it was when the rows were numbered

    def scan(batches: Iterator[pa.RecordBatch], entries: dict) -> Iterator[tuple]:
        """Each batch with its values and the stretches that ended in it: (stretch, first key,
        last key, first state, last state, last key's number of true ones)."""
        make = namedtuple("Row", columns, rename=True)._make
        part = first = key = begun = state = None
        count = 0
        for batch in batches:
            *cells, ats = (c.to_pylist() for c in batch.columns)
            values, ended = [], []
            for k, at, row in zip(zip(*(cells[i] for i in key_at)), ats, map(make, zip(*cells))):
                if at >> 33 != part:
                    if part is not None:
                        ended.append((part, first, key, begun, state, count))
                    before, part = part, at >> 33
                    if part in entries:
                        state, count = entries[part]
                    elif before is None or k != key:
                        state, count = start(), 0
                    else:  # a key goes on, where several stretches stream by
                        count = 0
                    first, key, begun = k, k, state
                elif k != key:
                    key, state, count = k, start(), 0
                state, value = step(state, row)
                count += bool(value)
                values.append(count if number else bool(value))
            yield batch, values, ended
        if part is not None:
            yield None, [], [(part, first, key, begun, state, count)]

    def ends(of: DataFrame, entries: dict) -> list[tuple]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, ended in scan(batches, entries):
                if ended:
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(x) for x in ended], pa.binary())], ["end"])

        return sorted((pickle.loads(r.end) for r in of.mapInArrow(run, "end binary").collect()), key=lambda x: x[0])

    known = ends(rows, {})
    seen = {part: {begun: (state, count)} for part, _, _, begun, state, count in known}
    turn = 0
    while True:
        # Entries by what is known; behind a stretch that is not known from its entry they are guesses.
        entries, todo, chains = {}, {}, {}
        last, state, count, chain = None, None, 0, None
        for part, first, key, _, end, n in known:
            inner = last is not None and first == last[0]
            if inner:
                entries[part] = (state, count)
            if not inner or first != key:
                state, count, chain = end, n, None
            else:
                if state not in seen[part]:
                    todo[part] = (state, 0)
                    chain = part if chain is None else chain
                if chain is not None:
                    chains[part] = chain
                state, more = seen[part].get(state) or list(seen[part].values())[-1]
                count += more
            last = (key,)
        if not todo:
            break
        turn += 1
        if turn <= TURNS:
            again = ends(rows.where(stretch_of.isin(list(todo))), todo)
        else:
            again = ends(rows.where(stretch_of.isin(list(chains))).repartition(*keys).sortWithinPartitions(*keys, "_at"), {c: todo[c] for c in chains.values()})
        for part, _, _, begun, state, count in again:
            seen[part][begun] = (state, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values, _ in scan(batches, entries):
            if batch is not None:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.int32() if number else pa.bool_())], [*columns, out])

    return rows.mapInArrow(run, f"{fields}, `{out}` {'int' if number else 'boolean'}")
