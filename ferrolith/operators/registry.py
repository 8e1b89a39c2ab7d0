"""Named transforms: readers by kind of element, methods by id; an unknown name is an error."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Method:
    id: str
    label: str
    kinds: tuple[str, ...]
    run: Callable[[DataFrame], DataFrame]


class Registry:
    def __init__(self, methods: Iterable[Method] = ()):
        self._methods: dict[str, Method] = {}
        for m in methods:
            self.add(m)

    def add(self, method: Method) -> None:
        if method.id in self._methods:
            raise ValueError(f"{method.id} is there already")
        self._methods[method.id] = method

    def get(self, name: str) -> Method:
        if name not in self._methods:
            raise KeyError(f"no method {name}; there are {', '.join(sorted(self._methods))}")
        return self._methods[name]

    def apply(self, rows: DataFrame, kind_column: str = "type_element") -> DataFrame:
        """Every method over the rows of its kinds, put together by name."""
        parts = [m.run(rows.filter(rows[kind_column].isin(*m.kinds))) for m in self._methods.values()]
        if not parts:
            raise ValueError("no methods")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out
