"""Names of operators, and the functions that carry them out."""

from __future__ import annotations

from collections.abc import Callable

OPERATORS: dict[str, list[Callable]] = {}


def operator(*codes: str) -> Callable[[Callable], Callable]:
    """Register a function under the inventory's codes."""

    def put(f: Callable) -> Callable:
        for code in codes:
            OPERATORS.setdefault(code, []).append(f)
        return f

    return put
