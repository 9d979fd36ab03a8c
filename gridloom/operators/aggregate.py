"""Re-aggregation to coarser cells."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..cube import Cube
from ..functions import reducers as R
from ..grid import Grid, _cells, _time_axis
from ..timeaxis import Duration


def _plan(kind: str, **settings) -> dict:
    return {"cube_type": kind, **{k: v for k, v in settings.items() if v is not None}}


def aggregate_time(cube: Cube, dt: str | None = None, method: str = "mean", fact: int | None = None) -> Cube:
    """Steps go to the longer step that holds their start."""
    g = cube.grid
    if (dt is None) == (fact is None):
        raise ValueError("give either dt or fact")
    if fact is not None and (g.labels is not None or fact < 1):
        raise ValueError("a factor needs regular time and is at least 1")
    step = Duration.parse(dt) if dt else Duration(g.dt.n * fact, g.unit)
    if step.unit < g.unit:
        raise ValueError("the new step has a finer unit than the old")
    first, last = (g.t0, g.t1) if g.labels is None else (min(g.labels, key=lambda t: t.at), max(g.labels, key=lambda t: t.at))
    t0, t1, step = _time_axis(first, last, step)
    grid = replace(g, t0=t0, t1=t1, dt=step, labels=None)
    # a step for each of the old ones, known when the query is built
    to = [grid.time_index(t.floor(step.unit)) for t in g.times()]
    index = F.element_at(F.array(*map(F.lit, to)), F.col("it") + 1)
    df = cube.df.groupBy(index.alias("it"), "iy", "ix").agg(*[R.plain(method, cube.band(b)).alias(b) for b in cube.bands])
    return Cube.make(df, grid, cube.bands, _plan("aggregate_time", dt=dt, method=method, fact=fact), cube)


def aggregate_space(cube: Cube, dx: float | None = None, dy: float | None = None, method: str = "mean", fact: int | None = None) -> Cube:
    """Cells go to the larger cell that holds their centre; the extent grows on all sides to whole cells."""
    g = cube.grid
    if fact is not None:
        dx, dy = g.dx * fact, g.dy * fact
    if dx is None or dy is None or dx < g.dx * (1 - 1e-9) or dy < g.dy * (1 - 1e-9):
        raise ValueError("give fact, or dx and dy that are not smaller than the cells")
    left, right, nx = _cells(g.left, g.right, dx)
    bottom, top, ny = _cells(g.bottom, g.top, dy)
    grid: Grid = replace(g, left=left, right=right, bottom=bottom, top=top, nx=nx, ny=ny)
    ix = F.floor((g.left + (F.col("ix") + 0.5) * g.dx - left) / grid.dx + 1e-9).cast("int")
    iy = F.floor((top - (g.top - (F.col("iy") + 0.5) * g.dy)) / grid.dy + 1e-9).cast("int")
    df = cube.df.groupBy("it", iy.alias("iy"), ix.alias("ix")).agg(*[R.plain(method, cube.band(b)).alias(b) for b in cube.bands])
    return Cube.make(df, grid, cube.bands, _plan("aggregate_space", dx=dx if fact is None else None, dy=dy if fact is None else None, method=method, fact=fact), cube)
