"""Many chains of different length worked on together, position by position."""

from __future__ import annotations

import numpy as np


def by_position(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The tokens of chains in order of their position, at each position by falling chain length; and the range of
    every position, so that the tokens of a position continue the first ones of the position before."""
    order = np.argsort(-sizes, kind="stable")
    many = np.bincount(sizes, minlength=int(sizes.max(initial=0)) + 1)[::-1].cumsum()[::-1][1:]
    ends = many.cumsum()
    at = np.arange(int(ends[-1])) if len(ends) else np.zeros(0, np.int64)
    position = np.repeat(np.arange(len(many)), many)
    token = starts[order][at - np.repeat(ends - many, many)] + position
    return token, list(zip((ends - many).tolist(), ends.tolist()))
