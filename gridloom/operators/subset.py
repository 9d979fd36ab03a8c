"""Crops, slices and selections: bounds are found when the query is built, and become plain range predicates."""

from __future__ import annotations

import bisect
import math
import warnings
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cube import Cube
from ..grid import Grid
from ..timeaxis import DateTime


def _snapped(low: float, high: float, snap: str) -> tuple[int, int]:
    nearest = lambda v: math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1)
    low, high = round(low, 9), round(high, 9)
    ways = {"near": (nearest, nearest), "in": (math.ceil, math.floor), "out": (math.floor, math.ceil)}
    if snap not in ways:
        raise ValueError("snap is one of near, in, out")
    return ways[snap][0](low), ways[snap][1](high)


def _moved(grid: Grid, x: tuple[int, int], y: tuple[int, int], t: tuple[int, int]) -> Grid:
    """The grid of index ranges, which may reach beyond the old ones in space and, if regular, in time."""
    out = replace(
        grid, left=grid.left + x[0] * grid.dx, right=grid.left + (x[1] + 1) * grid.dx, nx=x[1] - x[0] + 1, top=grid.top - y[0] * grid.dy, bottom=grid.top - (y[1] + 1) * grid.dy, ny=y[1] - y[0] + 1,
    )
    if grid.labels is not None:
        return replace(out, labels=grid.labels[t[0] : t[1] + 1])
    t0 = grid.time(t[0])
    return replace(out, t0=t0, t1=(t0 + replace(grid.dt, n=grid.dt.n * (t[1] - t[0] + 1) - 1)).floor(grid.unit))


def _shifted(name: str, low: int) -> Column:
    return (F.col(name) - F.lit(low)).alias(name)


def _labels_between(times: list, t0, t1, snap: str) -> tuple[int, int]:
    """The first and last of the labels for a range of times: those nearest to its ends (of two as near, the later), those
    inside it, or those that enclose it. Labels must be in order of time, and both ends lie between them."""
    if any(a > b for a, b in zip(times, times[1:], strict=False)):
        raise ValueError("the labels are not in order of time")
    if t0 > t1 or t0 < times[0] or t1 > times[-1]:
        raise ValueError("the range of times reaches beyond the cube")
    after = lambda end: bisect.bisect_left(times, end)
    before = lambda end: bisect.bisect_right(times, end) - 1
    if snap == "in":
        return after(t0), before(t1)
    if snap == "out":
        return after(t0) if times[after(t0)] == t0 else before(t0), before(t1) if times[before(t1)] == t1 else after(t1)

    def near(end, exact):
        a, b = after(end), before(end)
        return exact if times[exact] == end else (a if end - times[b] >= times[a] - end else b)

    return near(t0, after(t0)), near(t1, before(t1))


def crop(cube: Cube, extent: dict | None = None, iextent: dict | None = None, snap: str = "near") -> Cube:
    """By extent (left, right, bottom, top, t0, t1; any may be absent), or by index ranges x, y, t from 0, ends included."""
    g = cube.grid
    if (extent is None) == (iextent is None):
        raise ValueError("give either extent or iextent")
    if iextent is not None:
        ranges = {k: tuple(sorted(iextent.get(k, (0, n - 1)))) for k, n in (("x", g.nx), ("y", g.ny), ("t", g.nt))}
    else:
        e = {**{k: v for k, v in g.extent().items() if k not in ("t0", "t1")}, **extent}
        if e["left"] > e["right"] or e["bottom"] > e["top"]:
            raise ValueError("the extent is empty")
        ranges = {"x": _snapped((e["left"] - g.left) / g.dx, (e["right"] - g.left) / g.dx - 1, snap), "y": _snapped((g.top - e["top"]) / g.dy, (g.top - e["bottom"]) / g.dy - 1, snap)}
        t0 = DateTime.parse(e["t0"]) if "t0" in e else g.time(0)
        t1 = DateTime.parse(e["t1"]) if "t1" in e else g.time(g.nt - 1)
        if t0.unit != g.unit or t1.unit != g.unit:
            raise ValueError(f"times must be given as {g.unit.name.lower()}s")
        if g.labels is not None and "t0" not in e and "t1" not in e:
            ranges["t"] = (0, g.nt - 1)
        elif g.labels is None:
            steps = [t.since(g.t0, g.unit) / g.dt.n for t in (t0, t1)]
            ranges["t"] = _snapped(*steps, snap)
        else:
            ranges["t"] = _labels_between([t.floor(g.unit).at for t in g.labels], t0.at, t1.at, snap)
    for k, n in (("x", g.nx), ("y", g.ny), ("t", g.nt)):
        if ranges[k][1] < 0 or ranges[k][0] >= n or ranges[k][0] > ranges[k][1]:
            raise ValueError(f"nothing of {k} is left")
    (x, y, t) = (ranges[k] for k in "xyt")
    if g.labels is not None:
        t = (max(t[0], 0), min(t[1], g.nt - 1))
    df = cube.df.where(F.col("ix").between(*x) & F.col("iy").between(*y) & F.col("it").between(*t))
    df = df.select(_shifted("it", t[0]), _shifted("iy", y[0]), _shifted("ix", x[0]), *[cube.band(b) for b in cube.bands])
    return Cube.make(df, _moved(g, x, y, t), cube.bands, {"cube_type": "crop", "ix": list(x), "iy": list(y), "it": list(t)}, cube)


def slice_time(cube: Cube, datetime: str | None = None, it: int | None = None) -> Cube:
    g = cube.grid
    i = g.time_index(DateTime.parse(datetime)) if datetime is not None else it
    if i is None or not 0 <= i < g.nt:
        raise ValueError("the time is not in the cube")
    df = cube.df.where(F.col("it") == i).withColumn("it", F.lit(0))
    return Cube.make(df, _moved(g, (0, g.nx - 1), (0, g.ny - 1), (i, i)), cube.bands, {"cube_type": "slice_time", "it": i}, cube)


def slice_space(cube: Cube, loc: Sequence[float] | None = None, i: Sequence[int] | None = None) -> Cube:
    """The series of one pixel, by coordinates (x, y) or indices (ix, iy)."""
    g = cube.grid
    if (loc is None) == (i is None):
        raise ValueError("give either loc or i")
    ix, iy = (math.floor((loc[0] - g.left) / g.dx), math.floor((g.top - loc[1]) / g.dy)) if loc is not None else i
    if not (0 <= ix < g.nx and 0 <= iy < g.ny):
        raise ValueError("the place is not in the cube")
    df = cube.df.where((F.col("ix") == ix) & (F.col("iy") == iy)).withColumns({"ix": F.lit(0), "iy": F.lit(0)})
    return Cube.make(df, _moved(g, (ix, ix), (iy, iy), (0, g.nt - 1)), cube.bands, {"cube_type": "slice_space", "ix": ix, "iy": iy}, cube)


def select_time(cube: Cube, labels: Sequence[str]) -> Cube:
    """A cube with just these times, in their order. Times outside the cube are left out with a warning."""
    g = cube.grid
    found = [(DateTime.parse(v), g.time_index(DateTime.parse(v))) for v in labels]
    inside = [(t, i) for t, i in found if 0 <= i < g.nt]
    if not inside:
        raise ValueError("none of the times is in the cube")
    if len(inside) < len(found):
        warnings.warn("times outside the cube are left out", stacklevel=3)
    # positions of each old step among the new ones; the table has a row for each label
    places: dict[int, list[int]] = {}
    for new, (_, i) in enumerate(inside):
        places.setdefault(i, []).append(new)
    move = F.create_map(*[x for old, new in places.items() for x in (F.lit(old), F.array(*map(F.lit, new)))])
    df = cube.df.where(F.col("it").isin(list(places))).withColumn("it", F.explode(move[F.col("it")]))
    grid = replace(g, labels=tuple(t.floor(g.unit) for t, _ in inside))
    return Cube.make(df, grid, cube.bands, {"cube_type": "select_time", "t": [str(t) for t, _ in inside]}, cube)


_NAMES = {
    "b": ("b", "var", "band", "variable", "bands"), "t": ("t", "time", "datetime"), "xy": ("s", "bbox", "extent", "xy", "space"), "x": ("x", "lon"), "y": ("y", "lat"),
}


def getitem(cube: Cube, key) -> Cube:
    """cube[bands, t, y, x], or a dict by dimension. Bands count from 1, the others from 0; None and : mean all. A
    number or date takes a slice, two or more a range."""
    if isinstance(key, dict):
        named = {k: v for k, v in key.items() for kind in [next((n for n, own in _NAMES.items() if k in own), None)] if kind}
        if len(named) < len(key):
            raise ValueError(f"unknown dimension in {sorted(key)}")
        parts = {next(n for n, own in _NAMES.items() if k in own): v for k, v in key.items()}
        if isinstance(parts.get("xy"), dict):
            box = parts.pop("xy")
            cube = crop(cube, {k: box[k] for k in ("left", "right", "bottom", "top") if k in box})
    else:
        key = key if isinstance(key, tuple) else (key,)
        if len(key) > 4:
            raise ValueError("there are four dimensions")
        parts = dict(zip("btyx", key, strict=False))
    every = lambda v: v is None or v == slice(None)
    if not every(parts.get("b")):
        b = parts["b"]
        cube = cube.select_bands(*([b] if isinstance(b, (str, int)) else b))
    t = parts.get("t")
    if not every(t):
        if isinstance(t, (str, int)):
            cube = slice_time(cube, t if isinstance(t, str) else None, t if isinstance(t, int) else None)
        else:
            steps = list(range(*t.indices(cube.nt))) if isinstance(t, slice) else [v if isinstance(v, int) else cube.grid.time_index(DateTime.parse(v)) for v in t]
            cube = crop(cube, iextent={"t": (min(steps), max(steps))})
    ranges = {}
    for d, n in (("y", cube.ny), ("x", cube.nx)):
        v = parts.get(d)
        if not every(v):
            if isinstance(v, slice):
                v = list(range(*v.indices(n)))
            v = [v] if isinstance(v, (int, float)) else list(v)
            if any(isinstance(w, float) for w in v):
                g = cube.grid
                v = [math.floor((w - g.left) / g.dx) if d == "x" else math.floor((g.top - w) / g.dy) for w in v]
            ranges[d] = (min(v), max(v))
    return crop(cube, iextent=ranges) if ranges else cube
