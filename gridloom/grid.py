"""The regular grid of a cube, resolved when a query is built, and views that describe one."""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass, replace

from .timeaxis import DateTime, Duration, Unit

AGGREGATIONS = ("none", "min", "max", "mean", "median", "first", "last", "count_images", "count_values")
RESAMPLINGS = ("near", "bilinear", "cubic", "cubicspline", "lanczos", "average", "mode", "max", "min", "med", "q1", "q3")


def _cells(low: float, high: float, size: float) -> tuple[float, float, int]:
    """Bounds widened on both sides to a whole number of cells, and that number."""
    n = math.ceil(round((high - low) / size, 9))
    more = (n * size - (high - low)) / 2
    return low - more, high + more, n


@dataclass(frozen=True)
class Grid:
    """Space from left to right and, downwards, from top to bottom; time in steps of dt from t0 to t1, or at labels."""

    left: float
    right: float
    bottom: float
    top: float
    nx: int
    ny: int
    t0: DateTime
    t1: DateTime
    dt: Duration
    srs: str = "EPSG:4326"
    labels: tuple[DateTime, ...] | None = None

    @staticmethod
    def of(
        extent: dict, srs: str = "EPSG:4326", nx: int | None = None, ny: int | None = None, nt: int | None = None, dx: float | None = None, dy: float | None = None, dt: str | Duration | None = None,
        keep_asp: bool = True,
    ) -> Grid:
        """From an extent (left, right, bottom, top, t0, t1) and sizes or numbers of cells; numbers win over sizes, and
        one given for space gives the other at equal cell sizes."""
        left, right, bottom, top = (float(extent[k]) for k in ("left", "right", "bottom", "top"))
        if not left < right or not bottom < top:
            raise ValueError("the extent is empty")
        if nx:
            dx = (right - left) / nx
        if ny:
            dy = (top - bottom) / ny
        if dx is None and dy is None:
            raise ValueError("give the size or the number of cells")
        if keep_asp or dx is None or dy is None:
            dx, dy = dx if dx is not None else dy, dy if dy is not None else dx
        x = (left, right, nx) if nx else _cells(left, right, dx)
        y = (bottom, top, ny) if ny else _cells(bottom, top, dy)
        t = _time_axis(DateTime.parse(extent["t0"]), DateTime.parse(extent["t1"]), None if nt else dt, nt)
        return Grid(x[0], x[1], y[0], y[1], x[2], y[2], *t, srs)

    @property
    def dx(self) -> float:
        return (self.right - self.left) / self.nx

    @property
    def dy(self) -> float:
        return (self.top - self.bottom) / self.ny

    @property
    def nt(self) -> int:
        if self.labels is not None:
            return len(self.labels)
        return self.t1.since(self.t0, self.dt.unit) // self.dt.n + 1

    @property
    def unit(self) -> Unit:
        return self.dt.unit

    @property
    def cells(self) -> int:
        return self.nt * self.ny * self.nx

    def time(self, it: int) -> DateTime:
        """Start of a step."""
        if self.labels is not None:
            return self.labels[it]
        return (self.t0 + Duration(self.dt.n * it, self.dt.unit)).floor(self.unit)

    def time_index(self, t: DateTime) -> int:
        """The step that holds a time; of labels, the one that equals it, else -1."""
        if self.labels is not None:
            return next((i for i, x in enumerate(self.labels) if x.floor(self.unit) == t.floor(self.unit)), -1)
        return t.since(self.t0, self.unit) // self.dt.n

    def times(self) -> list[DateTime]:
        return [self.time(i) for i in range(self.nt)]

    def x(self, ix: int) -> float:
        return self.left + (ix + 0.5) * self.dx

    def y(self, iy: int) -> float:
        return self.top - (iy + 0.5) * self.dy

    def extent(self) -> dict:
        return {"left": self.left, "right": self.right, "bottom": self.bottom, "top": self.top, "t0": str(self.t0), "t1": str(self.t1)}

    def same_cells(self, other: Grid) -> bool:
        return replace(self, srs="") == replace(other, srs="") and self.srs == other.srs

    def to_json(self) -> dict:
        time = {"labels": [str(t) for t in self.labels], "dt": str(self.dt)} if self.labels is not None else {"t0": str(self.t0), "t1": str(self.t1), "dt": str(self.dt)}
        return {"space": {"left": self.left, "right": self.right, "bottom": self.bottom, "top": self.top, "nx": self.nx, "ny": self.ny, "srs": self.srs}, "time": time}

    @staticmethod
    def from_json(x: dict) -> Grid:
        s, t = x["space"], x["time"]
        d = Duration.parse(t["dt"])
        if "labels" in t:
            labels = tuple(DateTime.parse(v) for v in t["labels"])
            t0, t1 = labels[0], labels[-1]
        else:
            labels, t0, t1 = None, DateTime.parse(t["t0"]).floor(d.unit), DateTime.parse(t["t1"]).floor(d.unit)
        return Grid(s["left"], s["right"], s["bottom"], s["top"], s["nx"], s["ny"], t0, t1, d, s["srs"], labels)


def _time_axis(t0: DateTime, t1: DateTime, step: str | Duration | None, n: int | None = None) -> tuple[DateTime, DateTime, Duration]:
    """Bounds in the step's unit, the end moved so that the steps are whole."""
    if t0.unit != t1.unit:
        unit = max(t0.unit, t1.unit)
        warnings.warn(f"start and end have different units, {unit.name.lower()} is taken", stacklevel=3)
        t0, t1 = t0.floor(unit), t1.floor(unit)
    if step is None:
        if not n:
            raise ValueError("give the length or the number of time steps")
        step = Duration(-(-(t1.since(t0) + 1) // n), t0.unit)
    step = Duration.parse(step) if isinstance(step, str) else step
    if t0.unit > step.unit:
        t0, t1 = t0.floor(step.unit) if t0.unit == step.unit else DateTime(t0.floor().at, step.unit), t1.last(step.unit)
    else:
        t0, t1 = t0.floor(step.unit), t1.floor(step.unit)
    total = t1.since(t0, step.unit) + 1
    if total <= 0:
        raise ValueError("the time range is empty")
    if total % step.n:
        t1 = t0 + Duration(step.n * (total // step.n) + step.n - 1, step.unit)
    return t0, t1.floor(step.unit), step


@dataclass(frozen=True)
class View:
    """A grid, and how images become its cells."""

    grid: Grid
    aggregation: str = "first"
    resampling: str = "near"

    def __post_init__(self) -> None:
        # unknown names have defaults
        if self.aggregation not in AGGREGATIONS:
            object.__setattr__(self, "aggregation", "none")
        if self.resampling not in RESAMPLINGS:
            object.__setattr__(self, "resampling", "near")

    def update(self, **changes) -> View:
        """The view with other settings; a changed extent or cell size makes the axes anew."""
        g = self.grid
        extent = {**g.extent(), **changes.pop("extent", {})}
        kept = {k: changes.pop(k, getattr(self, k)) for k in ("aggregation", "resampling")}
        sizes = {k: changes.get(k) for k in ("nx", "ny", "nt", "dx", "dy", "dt")}
        if not any(sizes[k] for k in ("nx", "ny", "dx", "dy")):
            sizes |= {"dx": g.dx, "dy": g.dy}
        if not sizes["nt"] and not sizes["dt"]:
            sizes["dt"] = g.dt
        return View(Grid.of(extent, changes.get("srs", g.srs), **sizes), **kept)

    def to_json(self) -> dict:
        return {**self.grid.to_json(), "aggregation": self.aggregation, "resampling": self.resampling}

    @staticmethod
    def from_json(x: dict | str) -> View:
        x = json.loads(x) if isinstance(x, str) else x
        if "tile" in x:
            tile, half = x["tile"], 20037508.342789244
            size = 2 * half / 2 ** tile["z"]
            left, top = -half + tile["x"] * size, half - tile["y"] * size
            t0, t1, step = _time_axis(DateTime.parse(x["time"]["t0"]), DateTime.parse(x["time"]["t1"]), x["time"]["dt"])
            grid = Grid(left, left + size, top - size, top, 256, 256, t0, t1, step, "EPSG:3857")
        elif {"nx", "ny"} <= set(x["space"]):
            grid = Grid.from_json(x)
        else:
            s = x["space"]
            grid = Grid.of({**s, **x["time"]}, s.get("srs", "EPSG:4326"), **{k: s.get(k) for k in ("nx", "ny", "dx", "dy")}, **{k: x["time"].get(k) for k in ("nt", "dt")})
        return View(grid, x.get("aggregation", "none"), x.get("resampling", "near"))


def cube_view(view: View | None = None, extent: dict | None = None, srs: str | None = None, aggregation: str | None = None, resampling: str | None = None, **sizes) -> View:
    """Makes a view, or changes one."""
    named = {k: v for k, v in (("srs", srs), ("aggregation", aggregation), ("resampling", resampling)) if v is not None}
    if view is not None:
        return view.update(**({"extent": extent} if extent else {}), **named, **sizes)
    asp = {"keep_asp": sizes.pop("keep_asp")} if "keep_asp" in sizes else {}
    return View(Grid.of(extent or {}, srs or "EPSG:4326", **asp, **sizes), aggregation or "first", resampling or "near")
