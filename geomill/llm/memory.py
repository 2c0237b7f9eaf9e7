"""Memory of Python workers, which live on between tasks beside the executor's heap."""

from __future__ import annotations

import ctypes


#: What operators keep in a worker for their next tasks, by operator.
kept: dict[str, dict] = {}


def give_back(keep: str = "") -> None:
    """At a task's end, return what Arrow's pool and the C library hold unused to the system, and what other operators kept."""
    import pyarrow as pa

    for name, cache in kept.items():
        if name != keep:
            cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
