"""A layer: write-once frames of axes, members, connections, inputs and outputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class Frames(Mapping[str, DataFrame]):
    """Frames by key.  Listing and ``in`` build none; each lookup builds one."""

    def __init__(self, keys: Callable[[], tuple[str, ...]] | tuple[str, ...], build: Callable[[str], DataFrame]):
        self._keys, self._build = keys, build

    def _names(self) -> tuple[str, ...]:
        if callable(self._keys):
            self._keys = tuple(self._keys())
        return self._keys

    def __getitem__(self, key: str) -> DataFrame:
        if key not in self._names():
            raise KeyError(key)
        return self._build(key)

    def __contains__(self, key: object) -> bool:
        return key in self._names()

    def __iter__(self) -> Iterator[str]:
        return iter(self._names())

    def __len__(self) -> int:
        return len(self._names())


EMPTY: Mapping[str, DataFrame] = Frames((), lambda k: None)  # type: ignore[arg-type, return-value]


@dataclass(frozen=True)
class Layer:
    """Axis, member and connection frames may carry ``_row``, their order; without it names order."""

    id: str
    dims: Mapping[str, DataFrame] = field(default_factory=dict)
    components: Mapping[str, DataFrame] = field(default_factory=dict)
    connections: Mapping[str, DataFrame] = field(default_factory=dict)
    inputs: Mapping[str, DataFrame] = field(default_factory=dict)
    outputs: Mapping[str, DataFrame] = field(default_factory=dict)
