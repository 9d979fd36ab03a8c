"""Geometries: masks by polygon, and values and statistics of cells by feature.

Geometries are plain lists of rings, lines or points, resolved to cells on the driver for a single mask, and for tables
of features on the executors, row by row, to the cells of their bounding boxes. Cells meet cubes by equality of
(iy, ix). A cell belongs to a polygon if its centre lies in it (holes by the even-odd rule).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import Cube
from ..functions import reducers as R
from ..functions.srs import transform
from ..grid import Grid

Ring = Sequence[tuple[float, float]]


#: Spans of a mask, 12 bytes each, up to which they are broadcast.
BROADCAST_SPANS = 1_000_000


def polygon_spans(grid: Grid, rings: Sequence[Ring]) -> list[tuple[int, int, int]]:
    """(iy, first ix, last ix) of the runs of cells whose centres lie inside: crossings of each row's centre line, taken
    in pairs."""
    out = []
    ys = [p[1] for r in rings for p in r]
    low = max(0, int((grid.top - max(ys)) / grid.dy) - 1)
    high = min(grid.ny - 1, int((grid.top - min(ys)) / grid.dy) + 1)
    for iy in range(low, high + 1):
        y, cuts = grid.y(iy), []
        for r in rings:
            for (x0, y0), (x1, y1) in zip(r, [*r[1:], r[0]], strict=True):
                if (y0 > y) != (y1 > y):
                    cuts.append(x0 + (y - y0) * (x1 - x0) / (y1 - y0))
        cuts.sort()
        for a, b in zip(cuts[::2], cuts[1::2], strict=True):
            first = max(0, int(-((grid.left + 0.5 * grid.dx - a) // grid.dx)))
            last = min(grid.nx - 1, int((b - grid.left - 0.5 * grid.dx) // grid.dx))
            # the ends of a run are decided by centres, as quotients are rounded
            while first <= last and not a <= grid.x(first) < b:
                first += 1
            while first <= last and not a <= grid.x(last) < b:
                last -= 1
            if first <= last:
                out.append((iy, first, last))
    return out


def polygon_cells(grid: Grid, rings: Sequence[Ring]) -> list[tuple[int, int]]:
    return [(iy, ix) for iy, first, last in polygon_spans(grid, rings) for ix in range(first, last + 1)]


def line_cells(grid: Grid, line: Ring) -> list[tuple[int, int]]:
    """Cells that a line passes through, by the borders that each of its segments crosses."""
    out: dict[tuple[int, int], None] = {}
    for (x0, y0), (x1, y1) in zip(line, line[1:], strict=False):
        cuts = {0.0, 1.0}
        for a, b, start, size, n in ((x0, x1, grid.left, grid.dx, grid.nx), (y0, y1, grid.bottom, grid.dy, grid.ny)):
            if a != b:
                i, j = sorted(((a - start) / size, (b - start) / size))
                cuts |= {(start + k * size - a) / (b - a) for k in range(max(0, int(i)), min(n, int(j) + 1) + 1)}
        steps = sorted(c for c in cuts if 0 <= c <= 1)
        for a, b in zip(steps, steps[1:], strict=False):
            m = (a + b) / 2
            out.update(dict.fromkeys(point_cells(grid, [(x0 + m * (x1 - x0), y0 + m * (y1 - y0))])))
    return list(out)


def point_cells(grid: Grid, points: Ring) -> list[tuple[int, int]]:
    out = {}
    for x, y in points:
        ix, iy = int((x - grid.left) // grid.dx), int((grid.top - y) // grid.dy)
        # a point on the outer border belongs to the last cell
        ix, iy = ix - (x == grid.right), iy - (y == grid.bottom)
        if 0 <= ix < grid.nx and 0 <= iy < grid.ny:
            out[iy, ix] = None
    return list(out)


def geometry_cells(grid: Grid, kind: str, rings: Sequence[Ring]) -> list[tuple[int, int]]:
    kind = kind.upper()
    if "POLYGON" in kind:
        return polygon_cells(grid, rings)
    if "LINE" in kind:
        return list(dict.fromkeys(c for r in rings for c in line_cells(grid, r)))
    if "POINT" in kind:
        return list(dict.fromkeys(c for r in rings for c in point_cells(grid, r)))
    raise ValueError(f"unknown geometry {kind!r}")


def filter_geom(cube: Cube, rings: Sequence[Ring], srs: str | None = None) -> Cube:
    """Cells inside a polygon (all rings of a multipolygon), which must lie within the cube."""
    g = cube.grid
    own = [[transform(srs or g.srs, g.srs, x, y) for x, y in r] for r in rings]
    if any(not (g.left <= x <= g.right and g.bottom <= y <= g.top) for r in own for x, y in r):
        raise ValueError("the polygon is not within the cube")
    # a row of a polygon is a few runs of cells, whatever its width
    spans = polygon_spans(g, own)
    if spans:
        mask = cube.spark.createDataFrame(spans, "_iy int, _a int, _b int")
        mask = F.broadcast(mask) if len(spans) <= BROADCAST_SPANS else mask
        df = cube.df.join(mask, (F.col("iy") == F.col("_iy")) & F.col("ix").between(F.col("_a"), F.col("_b")), "left_semi")
    else:
        df = cube.df.where(F.lit(False))
    return Cube.make(df, g, cube.bands, {"cube_type": "filter_geom", "rings": [[list(p) for p in r] for r in rings], "srs": srs or g.srs}, cube)


def feature_cells(features: DataFrame, grid: Grid, srs: str | None = None) -> DataFrame:
    """fid, time, iy, ix for features (fid, time, geom_type, rings array<array<struct<x, y>>>)."""

    def cells(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                rings = [[transform(srs or grid.srs, grid.srs, p["x"], p["y"]) for p in ring] for ring in r.rings]
                rows += [(r.fid, r.time, iy, ix) for iy, ix in geometry_cells(grid, r.geom_type, rings)]
            yield pd.DataFrame(rows, columns=["fid", "time", "iy", "ix"])

    return features.selectExpr("fid", "cast(time AS string) AS time", "geom_type", "rings").mapInPandas(cells, "fid int, time string, iy int, ix int")


def _step(grid: Grid, time: Column) -> Column:
    """The step of a time, as text that begins with year, month and day."""
    if grid.labels is not None:
        labels = F.create_map(*[x for i, t in enumerate(grid.labels) for x in (F.lit(str(t)), F.lit(i))])
        return labels[F.substring(time, 1, len(str(grid.labels[0])))]
    from ..sources.points import time_bin

    return time_bin(F.to_timestamp_ntz(F.replace(time, F.lit("T"), F.lit(" "))), grid)


def extract_geom(
    cube: Cube, features: DataFrame, srs: str | None = None, datetime: str | None = None, time_column: str | None = None, fun: str | Sequence[str] | None = None, reduce_time: bool = False,
    merge: bool = False,
) -> DataFrame:
    """FID, time and bands of every cell that a feature covers; of all steps, or of the step of each feature's time.
    Cells without any value are left out. With fun, statistics by feature and time, or by feature alone."""
    g = cube.grid
    own = features.withColumn("time", F.col(time_column) if time_column else F.lit(datetime).cast("string"))
    at = feature_cells(own, g, srs)
    if time_column or datetime:
        # a time at midnight may be given as a date alone
        at = at.withColumn("it", _step(g, F.when(F.length("time") == 10, F.concat("time", F.lit(" 00:00:00"))).otherwise(F.col("time"))))
        joined = at.drop("time").join(cube.df, ["it", "iy", "ix"])
    else:
        joined = at.drop("time").join(cube.df, ["iy", "ix"])
    labels = F.element_at(F.array(*[F.lit(str(t)) for t in g.times()]), F.col("it") + 1)
    rows = joined.where(~cube.missing_all()).select(F.col("fid").alias("FID"), labels.alias("time"), *[cube.band(b) for b in cube.bands])
    if fun:
        names = [fun] if isinstance(fun, str) else list(fun)
        suffix = (lambda b, n: b) if len(names) == 1 else (lambda b, n: f"{b}_{n}")
        rows = rows.groupBy("FID", *([] if reduce_time else ["time"])).agg(*[R.plain(n, F.col(f"`{b}`")).alias(suffix(b, n)) for b in cube.bands for n in names])
    if merge:
        rows = features.withColumnRenamed("fid", "FID").drop("time").join(rows, "FID")
    return rows


def zonal_statistics(cube: Cube, features: DataFrame, fun: str | Sequence[str] = "mean", **kwargs) -> DataFrame:
    return extract_geom(cube, features, fun=fun, **kwargs)
