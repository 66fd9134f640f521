"""What user-defined parts of the training loop have to offer; the built-in ones do."""

from __future__ import annotations

from typing import Any, Protocol, runtime_checkable


@runtime_checkable
class LanguageModel(Protocol):
    """Counts words and gives them ids; ``sketch.SpaceSaving`` is one."""

    total: int

    def increment(self, word: str) -> tuple[int, str]: ...

    def lookup(self, word: str) -> int: ...

    def count(self, word: str) -> int: ...


@runtime_checkable
class NegativeSampler(Protocol):
    """Draws ids of negatives; ``sampling.EmpiricalSampler`` is one."""

    def sample(self, rng: Any, n: int) -> Any: ...

    def step(self) -> None: ...


@runtime_checkable
class ContextStrategy(Protocol):
    """Sizes of a window with so many words on each side; ``sgns.dynamic_reach`` makes one."""

    def __call__(self, left: int, right: int) -> tuple[int, int]: ...


@runtime_checkable
class RateSchedule(Protocol):
    """Rates of words; ``sgns.Schedule`` is one."""

    def rate(self, ids: Any) -> Any: ...

    def step(self, ids: Any) -> None: ...

    def reset(self, i: int) -> None: ...
