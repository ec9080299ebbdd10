"""Work on sorted partitions: whole runs of equal keys, without a group per call."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal first ``keys`` columns (integers), from a
    sorted partition.  Only a run that crosses batches is held back."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        first, end = ([c[at] for c in columns] for at in (0, -1))
        same = np.logical_and.reduce([c == c[-1] for c in columns])
        cut = 0 if same.all() else b.num_rows - int(np.argmin(same[::-1]))
        if held and (cut or first != last or first != end):
            if first != last:
                yield pa.Table.from_batches(held)
                held = []
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
        last = end
    if held:
        yield pa.Table.from_batches(held)


def bounds(t: pa.Table, keys: int) -> np.ndarray:
    """Row numbers at which runs of equal keys begin, and the number of rows."""
    change = np.zeros(t.num_rows, bool)
    change[0] = True
    for k in range(keys):
        col = t.column(k).to_numpy()
        change[1:] |= col[1:] != col[:-1]
    return np.append(np.flatnonzero(change), t.num_rows)


def matrix(t: pa.Table, column: int, dtype, width: int | None = None) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    flat = t.column(column).combine_chunks().flatten().to_numpy().astype(dtype, copy=False)
    return flat.reshape(t.num_rows, -1 if width is None else width)


class Forest:
    """Union of numbers 0..n-1, the smaller number stays the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b
