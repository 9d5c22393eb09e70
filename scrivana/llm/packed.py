"""Flat rows of numbers packed for a shuffle: a row for what a batch sends to one partition, each column's values as bytes.

A batch is a fixed number of values, so there is at most a row for each value, and as a rule one for hundreds or thousands; the JVM then moves bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Values that are packed at once.
BATCH = 1 << 18
_TYPES = {"long": np.int64, "int": np.int32, "boolean": np.uint8}

Columns = dict[str, np.ndarray]


def kinds(ddl: str) -> dict[str, str]:
    return dict(c.split() for c in ddl.split(", "))


def _rows(columns: list[np.ndarray], to: np.ndarray, name: str, names: list[str]) -> pa.RecordBatch:
    order = np.argsort(to, kind="stable")
    to = to[order]
    first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    ends = np.append(first, len(to))
    out = [pa.array(to[first].astype(np.int32))]
    for c in columns:
        c = np.ascontiguousarray(c[order])
        offsets = (ends * c.itemsize).astype(np.int32)
        out.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(c)]))
    return pa.RecordBatch.from_arrays(out, names=[name, *names])


def pack(parts: Iterator[Columns], ddl: str, deal: Callable[[Columns], np.ndarray], name: str = "to") -> Iterator[pa.RecordBatch]:
    """Rows (``name`` int, the columns of ``ddl`` binary) from parts of columns, dealt by ``deal`` (a partition for each value)."""
    types = {c: _TYPES[k] for c, k in kinds(ddl).items()}
    held: list[Columns] = []
    size = 0

    def sent() -> pa.RecordBatch:
        whole = {c: np.concatenate([h[c] for h in held]).astype(t, copy=False) for c, t in types.items()}
        return _rows(list(whole.values()), deal(whole), name, list(whole))

    for part in parts:
        n = len(part[next(iter(types))])
        for at in range(0, n, BATCH):
            held.append({c: part[c][at : at + BATCH] for c in types} if n > BATCH else part)
            size += len(held[-1][next(iter(types))])
            if size >= BATCH:
                yield sent()
                held, size = [], 0
    if size:
        yield sent()


def packed_ddl(ddl: str, name: str = "to") -> str:
    return f"{name} int, " + ", ".join(f"{c} binary" for c in kinds(ddl))


def values(column: pa.Array, kind: str) -> np.ndarray:
    """The numbers of a packed column, all rows in a row."""
    t = np.dtype(_TYPES[kind])
    if not len(column):
        return np.empty(0, t)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, t, int(at[-1] - at[0]) // t.itemsize, int(at[0])) if at[-1] > at[0] else np.empty(0, t)


def unpack(batches: Iterator[pa.RecordBatch], ddl: str) -> Columns | None:
    """All values that a partition was sent, None if there are none."""
    want = kinds(ddl)
    held = [{c: values(b.column(c), k) for c, k in want.items()} for b in batches if b.num_rows]
    return {c: np.concatenate([h[c] for h in held]) for c in want} if held else None
