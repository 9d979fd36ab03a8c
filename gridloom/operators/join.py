"""Joining the bands of cubes on one grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import functions as F

from ..cube import DIMS, Cube


def join_bands(cubes: Sequence[Cube] | Mapping[str, Cube]) -> Cube:
    """All bands of two or more cubes of equal grids, cell by cell; what one cube lacks is missing. Bands are named
    prefix.band; cubes without names have the prefixes X1, X2 and so on."""
    named = dict(cubes) if isinstance(cubes, Mapping) else {f"X{i + 1}": c for i, c in enumerate(cubes)}
    if len(named) < 2:
        raise ValueError("there must be two cubes at least")
    first = next(iter(named.values()))
    for c in named.values():
        if (c.grid.labels is None) != (first.grid.labels is None) or not c.grid.same_cells(first.grid):
            raise ValueError("the cubes have different grids")
    frames = [c.df.select(*DIMS, *[c.band(b).alias(f"{p}.{b}") for b in c.bands]) for p, c in named.items()]
    # a union and one aggregation: one shuffle for any number of cubes
    bands = [f"{p}.{b}" for p, c in named.items() for b in c.bands]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    df = rows.groupBy(*DIMS).agg(*[F.first(F.col(f"`{b}`"), ignorenulls=True).alias(b) for b in bands])
    return Cube.make(df, first.grid, bands, {"cube_type": "join_bands", "in_cubes": [c.plan for c in named.values()], "prefixes": list(named)})
