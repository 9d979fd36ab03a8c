"""Reduction over all of time, or all of space."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cube import Cube, collapsed_time
from ..functions import reducers as R


def _calls(cube: Cube, calls: Sequence[str], allowed: tuple[str, ...], names: Sequence[str] | None) -> list[tuple[str, str, str]]:
    """Reducer, band and name of the result; a name may be given for each call."""
    parsed = [R.parse_call(c, allowed) for c in calls]
    for _, band in parsed:
        if band not in cube.bands:
            raise ValueError(f"there is no band {band!r}")
    own = list(names) if names else [f"{band}_{name}" for name, band in parsed]
    if len(own) != len(parsed) or len(set(own)) < len(own):
        raise ValueError("there must be a different name for each result")
    return [(name, band, out) for (name, band), out in zip(parsed, own, strict=True)]


def _passed(cube: Cube, calls: list[tuple[str, str, str]], kind: str, texts: list[str]) -> Cube:
    """A cube that is reduced already keeps the values and names of the bands asked for."""
    bands = list(dict.fromkeys(band for _, band, _ in calls))
    return Cube.make(cube.df, cube.grid, bands, {"cube_type": kind, "reducer_bands": texts}, cube)


def reduce_time(cube: Cube, calls: Sequence[str], names: Sequence[str] | None = None) -> Cube:
    parsed = _calls(cube, calls, R.REDUCE, names)
    if cube.nt == 1:
        return _passed(cube, parsed, "reduce_time", list(calls))

    def column(name: str, band: str) -> Column:
        v = cube.band(band)
        return R.which(name, v, F.col("it")) if name.startswith("which") else R.neutral(name, v)

    df = cube.df.groupBy("iy", "ix").agg(*[column(n, b).alias(o) for n, b, o in parsed]).withColumn("it", F.lit(0))
    for n, _, o in parsed:
        if n.startswith("which"):
            df = df.withColumn(o, cube.step_digits(F.col(f"`{o}`")))
    return Cube.make(df, collapsed_time(cube.grid), [o for *_, o in parsed], {"cube_type": "reduce_time", "reducer_bands": list(calls), "names": [o for *_, o in parsed]}, cube)


def reduce_space(cube: Cube, calls: Sequence[str], names: Sequence[str] | None = None) -> Cube:
    parsed = _calls(cube, calls, R.SPACE, names)
    if cube.nx == cube.ny == 1:
        return _passed(cube, parsed, "reduce_space", list(calls))
    df = cube.df.groupBy("it").agg(*[R.neutral(n, cube.band(b)).alias(o) for n, b, o in parsed]).withColumns({"iy": F.lit(0), "ix": F.lit(0)})
    return Cube.make(df, replace(cube.grid, nx=1, ny=1), [o for *_, o in parsed], {"cube_type": "reduce_space", "reducer_bands": list(calls), "names": [o for *_, o in parsed]}, cube)
