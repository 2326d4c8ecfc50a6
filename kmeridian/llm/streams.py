"""Reading sorted Arrow batches group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal non-null integer keys of batches that are sorted by them, each as a table."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changes = np.zeros(b.num_rows, bool)
        changes[0] = True
        for c in columns:
            changes[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(changes).tolist()
        for i, j in zip(starts, [*starts[1:], b.num_rows], strict=True):
            key = tuple(int(c[i]) for c in columns)
            if key != current and held:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(b.slice(i, j - i))
    if held:
        yield current, pa.Table.from_batches(held)
