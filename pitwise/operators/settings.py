"""Ranges of numeric settings."""

from __future__ import annotations

from collections.abc import Callable

Range = tuple[str, Callable[[float], bool]]

ABOVE_ZERO: Range = ("above 0", lambda v: v > 0)
FROM_ZERO: Range = ("0 or more", lambda v: v >= 0)
SHARE: Range = ("from 0 to 1", lambda v: 0 <= v <= 1)
INNER_SHARE: Range = ("between 0 and 1, both excluded", lambda v: 0 < v < 1)


def bounded(settings: object, **ranges: Range) -> None:
    """Refuse settings whose named fields lie outside their ranges, naming all of them."""
    wrong = [
        f"{name}={getattr(settings, name)!r} (expected {words})"
        for name, (words, holds) in ranges.items()
        if not holds(getattr(settings, name))
    ]
    if wrong:
        raise ValueError("; ".join(wrong))
