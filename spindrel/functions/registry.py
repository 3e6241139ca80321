"""A registry of operators by dotted names, and flattening of nested settings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce


class Registry:
    """Names like ``readout.mean``; ``search`` also finds a name by its end where only one fits."""

    def __init__(self) -> None:
        self.items: dict[str, Callable] = {}

    def register(self, name: str, f: Callable | None = None):
        if f is None:
            return lambda g: self.register(name, g)
        if name in self.items:
            raise KeyError(f"{name} is registered already")
        self.items[name] = f
        return f

    def get(self, name: str) -> Callable:
        return self.items[name]

    def search(self, name: str) -> Callable:
        hits = [k for k in self.items if k == name] or [k for k in self.items if k.endswith(f".{name}")]
        if len(hits) != 1:
            raise KeyError(f"{name}: {'several' if hits else 'no'} such operators {hits}")
        return self.items[hits[0]]


def flatten(tree: dict, prefix: str = "") -> dict:
    """Nested settings by dotted keys."""
    out = {}
    for k, v in tree.items():
        key = f"{prefix}.{k}" if prefix else str(k)
        out |= flatten(v, key) if isinstance(v, dict) else {key: v}
    return out


def nested(flat: dict) -> dict:
    out: dict = {}
    for key, v in flat.items():
        *path, last = key.split(".")
        reduce(lambda d, k: d.setdefault(k, {}), path, out)[last] = v
    return out


def means(records: list[dict]) -> dict:
    """Mean of each number over nested records of one shape."""
    flat = [flatten(r) for r in records]
    return nested({k: sum(r[k] for r in flat) / len(flat) for k in (flat[0] if flat else {})})


def duration(seconds: float) -> str:
    """A length of time in the largest unit that it fills."""
    for unit, n in (("days", 86400), ("hours", 3600), ("mins", 60)):
        if seconds >= n:
            return f"{seconds / n:.2f} {unit}"
    return f"{seconds:.2f} secs"


def columns(cells: list[list[str]]) -> Iterator[str]:
    """Lines of a table with aligned columns."""
    width = [max(map(len, c)) for c in zip(*cells)]
    for r in cells:
        yield "  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip()


remembered = lru_cache(maxsize=1)
OPERATORS = Registry()


def register_all() -> Registry:
    """All public functions of the operators, sources and streams under ``module.function``; those there already stay."""
    import importlib
    import inspect
    import pkgutil

    for package in ("functions", "operators", "sources", "streaming"):
        root = importlib.import_module(f"spindrel.{package}")
        for info in pkgutil.iter_modules(root.__path__):
            module = importlib.import_module(f"{root.__name__}.{info.name}")
            for name, f in inspect.getmembers(module, inspect.isfunction):
                if f.__module__ == module.__name__ and not name.startswith("_") and f"{info.name}.{name}" not in OPERATORS.items:
                    OPERATORS.register(f"{info.name}.{name}", f)
    return OPERATORS
