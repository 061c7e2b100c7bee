"""Named plug-ins: tokenizers and embedding tables."""

from __future__ import annotations

from typing import Any


class Plugins(dict):
    """Plug-ins of one kind by name. `add` is a decorator, or takes the item at once."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def __missing__(self, name: str) -> Any:
        raise LookupError(f"unknown {self.kind} {name!r} (there are: {', '.join(sorted(self)) or 'none'})")

    def add(self, *names: str, item: Any = None) -> Any:
        if taken := [n for n in names if n in self]:
            raise LookupError(f"{self.kind} {taken[0]!r} is there already")
        if item is None:
            return lambda found: self.add(*names, item=found)
        self.update(dict.fromkeys(names, item))
        return item
