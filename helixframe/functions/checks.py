"""Checks of parameters.  They run when an operator is called, before any data is read."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from numbers import Real


def at_least(name: str, value: int, least: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be an integer of {least} or more, not {value!r}")
    return value


def share(name: str, value: float, above_zero: bool = False) -> float:
    fits = isinstance(value, Real) and not isinstance(value, bool) and 0 <= value <= 1 and not (above_zero and value == 0)
    if not fits:
        raise ValueError(f"{name} must be a number {'above 0 and up' if above_zero else 'from 0'} to 1, not {value!r}")
    return float(value)


def number(name: str, value: float) -> float:
    if isinstance(value, bool) or not isinstance(value, Real):
        raise TypeError(f"{name} must be a number, not {value!r}")
    return float(value)


def one_of(name: str, value: str, known: Iterable[str]) -> str:
    known = tuple(known)
    if value not in known:
        raise ValueError(f"{name} must be one of {', '.join(known)}, not {value!r}")
    return value


def term(name: str, value: str) -> str:
    if not isinstance(value, str) or not value:
        raise ValueError(f"{name} must be a non-empty string, not {value!r}")
    return value


def columns(df, *needed: str) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; found: {', '.join(df.columns)}")


def properties(props: Mapping[str, Iterable[float]]) -> dict[str, tuple[float, ...]]:
    """A property table: dinucleotides to equally many numbers."""
    if not props:
        raise ValueError("props is empty")
    table = {d: tuple(float(x) for x in v) for d, v in props.items()}
    bad = [d for d in table if not isinstance(d, str) or len(d) != 2 or set(d) - set("ACGU")]
    if bad:
        raise ValueError(f"not dinucleotides over ACGU: {bad[:5]}")
    if len({len(v) for v in table.values()}) != 1 or not next(iter(table.values())):
        raise ValueError("all dinucleotides need equally many properties, one at least")
    return table
