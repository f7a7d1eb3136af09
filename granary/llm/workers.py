"""What a Python worker keeps between batches: one model at a time, whichever operator it is of.

Workers outlive their stages, so that without this a later operator would run beside
the memory of all earlier ones.
"""

from __future__ import annotations

from collections.abc import Callable

_HELD: dict = {}


def held(key, make: Callable):
    """What ``make()`` gave for this key, made again if something else was held since."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Give up what is held: for operators that hold nothing themselves."""
    _HELD.clear()
