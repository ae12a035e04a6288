"""Reproducible randomness as column expressions: the same for every partitioning and engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(seed: str, *parts: Column | str) -> Column:
    cols = [F.lit(seed)]
    for p in parts:
        cols += [F.lit(":"), (F.col(p) if isinstance(p, str) else p).cast("string")]
    return F.concat(*cols)


def shuffle_key(seed: str, *parts: Column | str) -> Column:
    """A sort key that is a random permutation for each seed."""
    return F.md5(_key(seed, *parts))


def uniform(seed: str, *parts: Column | str) -> Column:
    """A number in (0, 1) from the first 32 bits of a digest."""
    return (F.conv(F.substring(F.md5(_key(seed, *parts)), 1, 8), 16, 10).cast("double") + 1.0) / F.lit(4294967297.0)


def normal(seed: str, mean: float, std: float, *parts: Column | str) -> Column:
    """Box-Muller from two uniform numbers."""
    r = F.sqrt(F.lit(-2.0) * F.log(uniform(seed + "/r", *parts)))
    return F.lit(mean) + F.lit(std) * r * F.cos(F.lit(2 * math.pi) * uniform(seed + "/a", *parts))


def choice(u: Column, weights: list[tuple[str, float]]) -> Column:
    """The label whose share of the cumulative weights holds u; weights are normalised if off by over 0.01."""
    total = sum(w for _, w in weights)
    scale = total if abs(total - 1.0) > 0.01 else 1.0
    out, upto = None, 0.0
    for label, w in weights[:-1]:
        upto += w / scale
        out = F.when(u < upto, label) if out is None else out.when(u < upto, label)
    return F.lit(weights[-1][0]) if out is None else out.otherwise(weights[-1][0])
