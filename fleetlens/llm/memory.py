"""Memory of the Python workers: freed arrays go back to the system."""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Arrays from this size on are mapped one by one and unmapped when freed.
MAPPED_BYTES = 4 << 20
_M_MMAP_THRESHOLD = -3  # of mallopt(3)

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def sparing(run: Run) -> Run:
    """A function for ``mapInArrow`` whose worker does not hold on to what it has freed.

    The C library raises its threshold for mapping with every large array that is freed, up to 32 MB,
    and keeps smaller ones; and a worker stays for the next tasks.  So the threshold is fixed, and what
    is free after the last batch is released.
    """

    @functools.wraps(run)
    def spared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = ctypes.CDLL(None) if sys.platform == "linux" else None
        if hasattr(libc, "mallopt"):
            libc.mallopt(_M_MMAP_THRESHOLD, MAPPED_BYTES)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return spared
