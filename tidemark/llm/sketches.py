"""Parity sketches: a bound on how much two sets differ that never rules out a pair in error; and marks of lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SKETCH_BITS = 1024
#: The columns of a sketch, 64 bits each.
SKETCH = [f"o{k}" for k in range(SKETCH_BITS // 64)]


def parity_sketch(own: np.ndarray) -> np.ndarray:
    """Per bit, whether an odd number of the set's hashes falls on it; one signed number per column.

    What two sets share cancels out of the sketches' difference, so no more
    bits differ than members do.
    """
    return np.packbits(np.bincount((own & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1).view("<i8")


def parity_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of columns per set."""
    return np.array([parity_sketch(own) for own in sets], np.int64).reshape(len(sets), len(SKETCH))


def members(name: str = "id") -> dict[str, Column]:
    """Aggregates that are equal for lists with the same members: their number and 128 bits of their hashes."""
    return {"members": F.count(F.lit(1)), "mark_a": F.bit_xor(F.xxhash64(name)), "mark_b": F.bit_xor(F.xxhash64(name, F.lit(7)))}


def sketches_allow(a: str, b: str, percent: int) -> Column:
    """Two sets of sizes ``n`` may reach a similarity of ``percent``, for all that their sketches show.

    ``a`` and ``b`` are prefixes of the columns. The sets differ in at most
    ``(100 - percent) / (100 + percent)`` of the sum of their sizes if they do.
    """
    differ = " + ".join(f"bit_count({a}{name} ^ {b}{name})" for name in SKETCH)
    return F.expr(f"({differ}) * {100 + percent} <= {100 - percent} * ({a}n + {b}n)")
