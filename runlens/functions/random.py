"""Random numbers as columns: each is a function of a row's key and a counter, so results do not depend on partitions or order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_P = (1 << 31) - 1


def uniform(key: Column, counter: Column, seed: int = 0) -> Column:
    """A number between 0 and 1 (both out) for an integer key and a counter below 2^31: three rounds of multiplying modulo 2^31 - 1 and folding high bits into low ones."""
    key = key.cast("long")
    low, high = key.bitwiseAND(F.lit(_P)), F.shiftrightunsigned(key, 31).bitwiseAND(F.lit(_P))
    # every product stays below 2^63
    h = (low * 48271 + high * 69621 + counter.cast("long") * 40692 + (seed * 16807 + 1)) % _P
    for shift, factor in ((13, 1103515245), (11, 1597334677), (15, 630360016)):
        h = (h.bitwiseXOR(F.shiftright(h, shift)) * factor) % _P
    return (h + 0.5) / float(_P)


#: Draws of a Poisson variable of mean 1 above this many have a chance below 1e-12.
_MOST = 14
_STEPS = [sum(math.exp(-1) / math.factorial(k) for k in range(j + 1)) for j in range(_MOST)]


def poisson_one(u: Column) -> Column:
    """The Poisson variable of mean 1 at a uniform number, by its distribution's steps."""
    n = F.lit(_MOST)
    for k in reversed(range(_MOST)):
        n = F.when(u < _STEPS[k], k).otherwise(n)
    return n
