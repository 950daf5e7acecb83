"""What a Python worker keeps between tasks: parsed vocabularies and caches of bounded size."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import sys
import types

import pyarrow as pa

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PLACE = "_slotledger_worker_state"


def kept(key: object, make: object) -> object:
    """``make()`` of the first call with this key in this process."""
    state = sys.modules.setdefault(_PLACE, types.ModuleType(_PLACE)).__dict__.setdefault("state", {})
    if key not in state:
        state[key] = make()
    return state[key]


def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL(ctypes.util.find_library("c") or "libc.so.6")
        libc.malloc_trim  # glibc only
        return libc
    except (OSError, AttributeError):
        return None


def release() -> None:
    """Give the memory this process has freed back to the system.

    A worker stays alive between tasks and steps; without this, it holds the most
    memory any of its tasks took (Python objects, numpy arrays, Arrow buffers).
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = kept("libc", _libc)
    if libc is not None:
        libc.malloc_trim(0)
