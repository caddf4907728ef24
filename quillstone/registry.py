"""Replaceable capabilities (chunker, parser, scorer, renderer, ...): the highest priority wins. Plans ask for their parts when they are made."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from typing import Any

_known: dict[str, list[tuple[int, int, Any]]] = {}


def register(name: str, implementation: Any, priority: int = 100) -> None:
    """Of equal priorities the later one wins. What Spark ships to tasks must be serialisable."""
    entries = _known.setdefault(name, [])
    entries.append((priority, 1 + max((e[1] for e in entries), default=-1), implementation))
    entries.sort(key=lambda e: e[:2], reverse=True)


def get(name: str) -> Any:
    if name not in _known:
        raise KeyError(f"nothing is registered as {name}")
    return _known[name][0][2]


def resolve(name: str, default: Any) -> Any:
    """What is registered under a name, else the default."""
    return _known[name][0][2] if name in _known else default


@contextlib.contextmanager
def replaced(name: str, implementation: Any) -> Iterator[None]:
    """An implementation above all others within the block."""
    register(name, implementation, 1 + max((e[0] for e in _known.get(name, ())), default=0))
    mine = _known[name][0]
    try:
        yield
    finally:
        _known[name].remove(mine)
        if not _known[name]:
            del _known[name]


def names() -> list[str]:
    return sorted(_known)
