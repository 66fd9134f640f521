"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from itertools import islice
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.tables import release, workspace, written

__all__ = ["Memo", "SteadyMemo", "free_name", "make_room", "release", "resident", "slices", "workspace", "written"]

Kept = TypeVar("Kept")


class Memo(dict):
    """``fn(key)`` remembered for keys of at most ``longest`` characters, in bounded memory.

    Once ``limit`` keys are held the memo starts afresh, so a worker's memory stays bounded whatever the
    corpus. Longer keys are computed each time.
    """

    def __init__(self, fn: Callable, limit: int = 120_000, longest: int = 48):
        super().__init__()
        self.fn, self.limit, self.longest = fn, limit, longest

    def __missing__(self, key):
        value = self.fn(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class SteadyMemo(dict):
    """``fn(key)`` remembered as by ``Memo``, for corpora with a long tail of rare keys.

    A key is on trial until it comes a second time within the last ``limit / 8`` to ``limit / 4`` new keys; only then it is kept, and
    the oldest of those kept make room. So rare keys never push out frequent ones, and at most ``limit`` keys are held in all.
    """

    def __init__(self, fn: Callable, limit: int = 120_000, longest: int = 48):
        super().__init__()
        self.fn, self.longest, self.trial, self.limit = fn, longest, max(1, limit // 8), max(1, limit * 3 // 4)
        self.new: dict = {}
        self.before: dict = {}

    def __missing__(self, key):
        value = self.new.pop(key, None)
        if value is None:
            value = self.before.pop(key, None)
        if value is not None:
            if len(self) >= self.limit:
                for k in list(islice(self, 1 + self.limit // 16)):
                    del self[k]
            self[key] = value
            return value
        value = self.fn(key)
        if len(key) <= self.longest:
            if len(self.new) >= self.trial:
                self.before, self.new = self.new, {}
            self.new[key] = value
        return value


_resident: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], Kept]) -> Kept:
    """What a Python worker keeps from task to task: one thing at a time.

    Workers outlive an operator, so what the last one kept (tokenizers, memos) goes when the next one begins.
    """
    if key not in _resident:
        _resident.clear()
        trim()
        _resident[key] = make()
    return _resident[key]


def trim() -> None:
    """Gives the memory that this process has freed back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, rows: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most ``rows`` rows, as documents can be long.

    Spark bounds its own batches by bytes; no session setting is touched. After the last one, freed memory is given back: workers are kept for other tasks.
    """
    for b in batches:
        for first in range(0, b.num_rows, rows):
            yield b.slice(first, rows)
    del batches
    trim()


def free_name(name: str, taken) -> str:
    """``name``, with underscores before it until no column has it (names of columns don't mind case)."""
    taken = {x.lower() for x in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def make_room(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` without columns of these names, and the new names of those it had: they get underscores before them."""
    moved: dict[str, str] = {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            moved[c] = free_name(c, [*df.columns, *moved.values(), *names])
    return df.withColumnsRenamed(moved), moved
