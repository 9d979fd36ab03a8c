"""A cube: a lazy DataFrame with one row for each non-empty cell (it, iy, ix and a double column for each band), the
grid that the indices refer to, and the plan that made it. A cell without a row has no values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grid import Grid
from .timeaxis import SECONDS, Unit

DIMS = ("it", "iy", "ix")


@dataclass(frozen=True)
class Cube:
    df: DataFrame
    grid: Grid
    bands: tuple[str, ...]
    plan: dict = field(default_factory=dict, compare=False)

    @staticmethod
    def make(df: DataFrame, grid: Grid, bands: Sequence[str], plan: dict | None = None, origin: Cube | None = None) -> Cube:
        """Orders and types the columns; plan holds a node's settings, origin is the cube it works on."""
        node = dict(plan or {})
        if origin is not None:
            node["in_cube"] = origin.plan
        kinds = {"it": "int", "iy": "int", "ix": "int"}
        out = df.select(*[F.col(d).cast(kinds[d]).alias(d) for d in DIMS], *[F.col(f"`{b}`").cast("double").alias(b) for b in bands])
        return Cube(out, grid, tuple(bands), node)

    # ------------------------------------------------------------ metadata

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def shape(self) -> tuple[int, int, int, int]:
        return len(self.bands), self.grid.nt, self.grid.ny, self.grid.nx

    nt = property(lambda self: self.grid.nt)
    ny = property(lambda self: self.grid.ny)
    nx = property(lambda self: self.grid.nx)
    nbands = property(lambda self: len(self.bands))
    srs = property(lambda self: self.grid.srs)

    @property
    def memory_size(self) -> int:
        """Bytes of all cells as doubles."""
        return 8 * len(self.bands) * self.grid.cells

    def dimensions(self) -> dict:
        g = self.grid
        regular = g.labels is None
        return {
            "t": {"low": str(g.time(0)), "high": str(g.t1 if regular else g.labels[-1]), "count": g.nt, "size": str(g.dt) if regular else None},
            "y": {"low": g.bottom, "high": g.top, "count": g.ny, "size": g.dy}, "x": {"low": g.left, "high": g.right, "count": g.nx, "size": g.dx},
        }

    def dimension_values(self) -> dict:
        g = self.grid
        return {"t": [str(t) for t in g.times()], "y": [g.y(i) for i in range(g.ny)], "x": [g.x(i) for i in range(g.nx)]}

    def dimension_bounds(self) -> dict:
        g = self.grid
        t = g.times()
        ends = [str(g.time(i + 1)) for i in range(g.nt)] if g.labels is None else [str(v) for v in t]
        return {
            "t": list(zip(map(str, t), ends, strict=True)), "y": [(g.top - (i + 1) * g.dy, g.top - i * g.dy) for i in range(g.ny)],
            "x": [(g.left + i * g.dx, g.left + (i + 1) * g.dx) for i in range(g.nx)],
        }

    def __str__(self) -> str:
        rows = [f"{d}: {v['low']} … {v['high']}, {v['count']} of {v['size']}" for d, v in self.dimensions().items()]
        return "\n".join([f"cube of {', '.join(self.bands)}", *rows])

    # ------------------------------------------------------------ columns of cells

    def band(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def step_start(self, plus: int = 0) -> Column:
        """Seconds since 1970 of the start of a cell's step."""
        g = self.grid
        if g.labels is not None:
            ends = [t.epoch() for t in g.labels]
            return F.element_at(F.array(*[F.lit(float(e)) for e in [*ends, ends[-1]]]), F.col("it") + 1 + plus)
        if g.unit in SECONDS:
            return (F.lit(g.t0.epoch()) + (F.col("it") + plus) * g.dt.n * SECONDS[g.unit]).cast("double")
        months = (F.col("it") + plus) * g.dt.n * (12 if g.unit == Unit.YEAR else 1)
        start = F.add_months(F.to_date(F.lit(g.t0.at.date().isoformat())), months)
        return (F.unix_date(start).cast("double")) * 86400.0

    def step_digits(self, it: Column) -> Column:
        """The date of a step as a number of its digits."""
        return F.element_at(F.array(*[F.lit(t.digits()) for t in self.grid.times()]), it + 1)

    def variables(self) -> dict[str, Column]:
        """Dimension variables of expressions."""
        g, c = self.grid, F.col
        return {
            "ix": c("ix").cast("double"), "iy": c("iy").cast("double"), "it": c("it").cast("double"), "left": g.left + c("ix") * g.dx, "right": g.left + (c("ix") + 1) * g.dx,
            "top": g.top - c("iy") * g.dy, "bottom": g.top - (c("iy") + 1) * g.dy, "t0": self.step_start(), "t1": self.step_start(1),
        }

    def missing_all(self) -> Column:
        return reduce(lambda a, b: a & b, [self.band(b).isNull() for b in self.bands], F.lit(True))

    # ------------------------------------------------------------ dense forms

    def dense(self) -> DataFrame:
        """A row for every cell; made by arithmetic on one range, joined with the rows there are."""
        return every_cell(self.spark, self.grid).join(self.df, list(DIMS), "left")

    def dense_in_time(self) -> DataFrame:
        """A row for every step of each pixel that has a row at all: a pixel's rows are gathered once, and the steps that
        are not among them added. Windows over (iy, ix) find the rows where they are. A pixel has as many rows as there
        are steps, at most."""
        bands = [self.band(b) for b in self.bands]
        own = self.df.groupBy("iy", "ix").agg(F.collect_list(F.struct(F.col("it").cast("int").alias("it"), *bands)).alias("_rows"))
        missing = F.array_except(F.sequence(F.lit(0), F.lit(self.grid.nt - 1)), F.col("_rows.it"))
        empty = F.transform(missing, lambda t: F.struct(t.alias("it"), *[F.lit(None).cast(kind).alias(b) for b, kind in self._kinds()]))
        return own.select("iy", "ix", F.inline(F.concat("_rows", empty))).select(*DIMS, *bands)

    def _kinds(self) -> list[tuple[str, str]]:
        kinds = dict(self.df.dtypes)
        return [(b, kinds[b]) for b in self.bands]

    # ------------------------------------------------------------ operators

    def select_bands(self, *bands: str | int) -> Cube:
        from .operators import pixel

        return pixel.select_bands(self, bands)

    def rename_bands(self, **names: str) -> Cube:
        from .operators import pixel

        return pixel.rename_bands(self, names)

    def apply_pixel(self, expressions, names=None, keep_bands: bool = False, by_batch: bool = False) -> Cube:
        from .operators import pixel, udf

        if callable(expressions):
            return udf.apply_pixel(self, expressions, names, keep_bands, by_batch)
        return pixel.apply_pixel(self, expressions, names, keep_bands)

    def filter_pixel(self, predicate: str) -> Cube:
        from .operators import pixel

        return pixel.filter_pixel(self, predicate)

    def crop(self, extent: dict | None = None, iextent: dict | None = None, snap: str = "near") -> Cube:
        from .operators import subset

        return subset.crop(self, extent, iextent, snap)

    def slice_time(self, datetime: str | None = None, it: int | None = None) -> Cube:
        from .operators import subset

        return subset.slice_time(self, datetime, it)

    def slice_space(self, loc=None, i=None) -> Cube:
        from .operators import subset

        return subset.slice_space(self, loc, i)

    def select_time(self, labels: Sequence[str]) -> Cube:
        from .operators import subset

        return subset.select_time(self, labels)

    def __getitem__(self, key) -> Cube:
        from .operators import subset

        return subset.getitem(self, key)

    def reduce_time(self, *reducers, names=None, fun=None) -> Cube:
        from .operators import reduce as r
        from .operators import udf

        return udf.reduce_time(self, fun, names) if fun else r.reduce_time(self, reducers, names)

    def reduce_space(self, *reducers, names=None, fun=None) -> Cube:
        from .operators import reduce as r
        from .operators import udf

        return udf.reduce_space(self, fun, names) if fun else r.reduce_space(self, reducers, names)

    def aggregate_time(self, dt: str | None = None, method: str = "mean", fact: int | None = None) -> Cube:
        from .operators import aggregate

        return aggregate.aggregate_time(self, dt, method, fact)

    def aggregate_space(self, dx: float | None = None, dy: float | None = None, method: str = "mean", fact: int | None = None) -> Cube:
        from .operators import aggregate

        return aggregate.aggregate_space(self, dx, dy, method, fact)

    def window_time(self, *reducers, window=None, kernel=None) -> Cube:
        from .operators import window as w

        return w.window_time(self, reducers, window, kernel)

    def window_space(self, *reducers, window=None, kernel=None, keep_bands: bool = False, pad=None) -> Cube:
        from .operators import window as w

        return w.window_space(self, reducers, window, kernel, keep_bands, pad)

    def fill_time(self, method: str = "near") -> Cube:
        from .operators import fill

        return fill.fill_time(self, method)

    def filter_geom(self, geometry, srs: str | None = None) -> Cube:
        from .operators import geom

        return geom.filter_geom(self, geometry, srs)

    def extract_geom(self, features, **kwargs) -> DataFrame:
        from .operators import geom

        return geom.extract_geom(self, features, **kwargs)

    def apply_time(self, fun, names=None, keep_bands: bool = False) -> Cube:
        from .operators import udf

        return udf.apply_time(self, fun, names, keep_bands)

    def chunk_apply(self, fun, names, chunk=(1, 256, 256)) -> Cube:
        from .operators import udf

        return udf.chunk_apply(self, fun, names, chunk)

    def predict(self, model, names=("prediction",), keep_bands: bool = False) -> Cube:
        from .operators import udf

        return udf.predict(self, model, names, keep_bands)


def every_cell(spark: SparkSession, grid: Grid) -> DataFrame:
    """it, iy, ix of all cells of a grid."""
    plane = grid.ny * grid.nx
    return spark.range(grid.cells).selectExpr(f"int(id div {plane}) AS it", f"int((id % {plane}) div {grid.nx}) AS iy", f"int(id % {grid.nx}) AS ix")


def cell_schema(bands: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(d, T.IntegerType()) for d in DIMS] + [T.StructField(b, T.DoubleType()) for b in bands])


def collapsed_time(grid: Grid) -> Grid:
    """One step over the whole extent of time."""
    if grid.labels is not None:
        return replace(grid, labels=grid.labels[:1])
    total = grid.t1.since(grid.t0, grid.unit) + 1
    return replace(grid, dt=replace(grid.dt, n=total))
