"""Record batches in pieces that bound what Python holds at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def pieces(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes in order; a larger row is one by itself."""
    if batch.nbytes <= most or batch.num_rows <= 1:
        yield batch
        return
    half = batch.num_rows // 2
    yield from pieces(batch.slice(0, half), most)
    yield from pieces(batch.slice(half), most)
