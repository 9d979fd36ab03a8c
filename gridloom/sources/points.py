"""Cubes from rows of a table: points, events or pixels with a time and a place."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import Cube
from ..functions import reducers as R
from ..functions.srs import transform_columns
from ..grid import Grid
from ..timeaxis import SECONDS, Unit


def time_bin(ts: Column, grid: Grid) -> Column:
    """The step of a time: whole calendar units since the start, by the length of a step."""
    g, u = grid, grid.unit
    if g.labels is not None:
        raise ValueError("times fall into steps of regular axes only")
    day = F.datediff(ts.cast("date"), F.lit(g.t0.at.date().isoformat()).cast("date"))
    if u == Unit.YEAR:
        n = F.year(ts) - g.t0.at.year
    elif u == Unit.MONTH:
        n = F.year(ts) * 12 + F.month(ts) - (g.t0.at.year * 12 + g.t0.at.month)
    elif u in (Unit.DAY, Unit.WEEK):
        n = F.floor(day / (7 if u == Unit.WEEK else 1))
    else:
        seconds = day.cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts).cast("long") - (g.t0.epoch() - g.t0.floor(Unit.DAY).epoch())
        n = F.floor(seconds / SECONDS[u])
    return F.floor(n / g.dt.n).cast("int")


def in_range(ts: Column, grid: Grid) -> Column:
    """A range of the time column itself, which reaches a Parquet scan: a predicate on a computed step does not."""
    end = grid.time(grid.nt) if grid.labels is None else grid.labels[-1]
    return (ts >= F.lit(grid.t0.at).cast("timestamp_ntz")) & (ts < F.lit(end.at).cast("timestamp_ntz"))


def clean(v: Column) -> Column:
    """NaN is a missing value."""
    v = v.cast("double")
    return F.when(~F.isnan(v), v)


def points_to_cube(
    table: DataFrame, grid: Grid, time: str | Column, x: str | Column, y: str | Column, bands: Mapping[str, tuple[str, str | Column]], srs: str | None = None, path: str | None = None,
) -> Cube:
    """bands: for each name a reducer and a column. x and y are coordinates in srs (the grid's, if absent). Texts are
    names of columns or SQL expressions. With path, where the table is stored, the plan alone can make the cube again."""
    own = set(table.columns)
    col = lambda c: c if not isinstance(c, str) else F.col(f"`{c}`") if c in own else F.expr(c)
    given = {"time": time, "x": x, "y": y, **{f"band {b}": c for b, (_, c) in bands.items()}}
    if path is not None and not all(isinstance(c, str) for c in given.values()):
        raise ValueError("a plan that names its table takes columns as text")
    g = grid
    px, py = transform_columns(srs or g.srs, g.srs, col(x).cast("double"), col(y).cast("double"))
    rows = table.where(in_range(col(time), g)).select(
        time_bin(col(time), g).alias("it"), F.floor((g.top - py) / g.dy).cast("int").alias("iy"), F.floor((px - g.left) / g.dx).cast("int").alias("ix"),
        *[clean(col(c)).alias(f"_{b}") for b, (_, c) in bands.items()],
    )
    rows = rows.where(F.col("iy").between(0, g.ny - 1) & F.col("ix").between(0, g.nx - 1) & F.col("it").between(0, g.nt - 1))
    df = rows.groupBy("it", "iy", "ix").agg(*[R.plain(r, F.col(f"_{b}")).alias(b) for b, (r, _) in bands.items()])
    plan = {"cube_type": "points", "view": g.to_json(), "bands": {b: r for b, (r, _) in bands.items()}}
    if path is not None:
        plan |= {"path": path, "time": time, "x": x, "y": y, "columns": {b: c for b, (_, c) in bands.items()}, "srs": srs}
    return Cube.make(df, g, list(bands), plan)
