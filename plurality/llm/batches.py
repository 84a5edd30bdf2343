"""Texts of Arrow batches, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text turned into Python strings at a time; one longer text comes alone.
SLICE_BYTES = 1 << 20


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[list[str | None]]:
    """The texts in order, as lists of about ``most`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield texts.slice(at, upto - at).to_pylist()
        at = upto
    # What Arrow held for the batches before this one goes back to the system.
    pa.default_memory_pool().release_unused()
