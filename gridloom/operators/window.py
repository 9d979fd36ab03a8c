"""Moving windows over time and space.

Windows in time are range frames on the step index, partitioned by pixel. Windows in space scatter each cell to the
windows that hold it and add these up: one shuffle, with partial aggregation. Windows of more than nine cells, whose
reducers can be put together from parts, go by rows and then by columns: a cell is scattered to as many places as a
window has columns, and then rows, not to their product.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cube import Cube, every_cell
from ..functions import reducers as R
from .reduce import _calls

#: Reducers that parts of a window can be put together for: the parts they need.
PARTS = {"min": ("min",), "max": ("max",), "sum": ("sum",), "count": ("count",), "mean": ("sum", "count"), "prod": ("prod",)}
#: Cells of a window up to which one shuffle of all its cells is less work than two of a row's and a column's.
ONE_PASS = 9
PADDINGS = ("REPLICATE", "REFLECT", "REFLECT_PIXEL", "CONSTANT")
_SAME = {"EDGE": "REPLICATE", "SYMMETRIC": "REFLECT", "REFLECT101": "REFLECT_PIXEL"}


def window_time(cube: Cube, calls: Sequence[str] = (), window: Sequence[int] | None = None, kernel: Sequence[float] | None = None) -> Cube:
    """Reducers over the steps from window[0] before to window[1] after, or the sum of a kernel's products with them. A
    window with a missing value has no kernel result. An even kernel reaches one step farther back."""
    pixel = Window.partitionBy("iy", "ix").orderBy("it")
    dense = cube.dense_in_time()
    if kernel is not None:
        if window is None:
            before, after = len(kernel) // 2, (len(kernel) - 1) // 2
            if len(kernel) % 2 == 0:
                warnings.warn("a kernel of even length reaches one step farther back", stacklevel=3)
        else:
            before, after = window
        if len(kernel) != before + 1 + after:
            raise ValueError("the kernel does not fit the window")
        # one pass for all bands: after making dense, the step before is the row before
        terms = lambda b: [F.lag(cube.band(b), before - k).over(pixel) * F.lit(float(w)) for k, w in enumerate(kernel)]
        df = dense.select("it", "iy", "ix", *[reduce(lambda x, y: x + y, terms(b)).alias(b) for b in cube.bands])
        return Cube.make(df, cube.grid, cube.bands, {"cube_type": "window_time", "window": [before, after], "kernel": list(map(float, kernel))}, cube)
    if window is None:
        raise ValueError("give the window")
    frame = pixel.rangeBetween(-int(window[0]), int(window[1]))
    parsed = _calls(cube, calls, R.WINDOW_TIME, None)

    def over(name: str, band: str) -> Column:
        v = cube.band(band)
        if name == "median":
            return F.percentile(v, 0.5).over(frame)
        if name == "prod":
            return F.coalesce(F.product(v).over(frame), F.lit(1.0))
        out = R.plain(name, v).over(frame) if name != "count" else F.count(v).over(frame).cast("double")
        return F.coalesce(out, F.lit(0.0)) if name == "sum" else out

    df = dense.select("it", "iy", "ix", *[over(n, b).alias(o) for n, b, o in parsed])
    return Cube.make(df, cube.grid, [o for *_, o in parsed], {"cube_type": "window_time", "window": list(map(int, window)), "reducer_bands": list(calls)}, cube)


def _sources(target: int, n: int, pad: str | None) -> int | None:
    """The index inside 0..n-1 that an index outside stands for."""
    if 0 <= target < n:
        return target
    if pad == "REPLICATE":
        return min(max(target, 0), n - 1)
    if pad == "REFLECT":
        k = target % (2 * n)
        return k if k < n else 2 * n - 1 - k
    if pad == "REFLECT_PIXEL":
        if n == 1:
            return 0
        k = target % (2 * n - 2)
        return k if k < n else 2 * n - 2 - k
    return None


def _scattered(n: int, half: int, pad: str | None, name: str) -> Column:
    """For a cell's index, the windows that hold it: (centre, offset) pairs. Inside they are a plain range; near the
    borders, where padding repeats cells, they are listed."""
    c = F.col(name)
    plain = F.transform(F.sequence(F.greatest(c - half, F.lit(0)), F.least(c + half, F.lit(n - 1))), lambda t: F.struct(t.cast("int").alias("to"), (c - t).cast("int").alias("at")))
    if pad is None:
        return plain
    extra: dict[int, list[tuple[int, int]]] = {}
    for centre in {*range(min(half, n)), *range(max(0, n - half), n)}:
        for at in range(-half, half + 1):
            if not 0 <= centre + at < n:
                extra.setdefault(_sources(centre + at, n, pad), []).append((centre, at))
    out = plain
    for cell, more in extra.items():
        out = F.when(c == cell, F.concat(plain, F.array(*[F.struct(F.lit(t).alias("to"), F.lit(a).alias("at")) for t, a in more]))).otherwise(out)
    return out


def _padding(pad) -> tuple[str | None, float | None]:
    if pad is None:
        return None, None
    if isinstance(pad, (int, float)) and not isinstance(pad, bool):
        return "CONSTANT", float(pad)
    name = _SAME.get(str(pad).upper(), str(pad).upper())
    if name not in PADDINGS:
        warnings.warn(f"unknown padding {pad!r}: none is used", stacklevel=4)
        return None, None
    return (name, 0.0) if name == "CONSTANT" else (name, None)


def window_space(
    cube: Cube, calls: Sequence[str] = (), window: Sequence[int] | None = None, kernel: Sequence[Sequence[float]] | None = None, keep_bands: bool = False, pad: str | float | None = None,
) -> Cube:
    """Reducers over windows of window[0] rows and window[1] columns (odd numbers), or the sum of a kernel's products
    with them, which is missing where a value is. Cells beyond the border are missing, a constant, or those that the
    padding repeats. Reducers skip what is missing."""
    g = cube.grid
    if kernel is not None:
        kernel = [list(map(float, row)) for row in kernel]
        window = (len(kernel), len(kernel[0]))
        if any(len(row) != window[1] for row in kernel):
            raise ValueError("the kernel is not a matrix")
    if window is None or window[0] % 2 == 0 or window[1] % 2 == 0:
        raise ValueError("a window has an odd number of rows and columns")
    mode, constant = _padding(pad)
    half_y, half_x = window[0] // 2, window[1] // 2
    repeat = mode if mode != "CONSTANT" else None
    df = cube.df.withColumn("y", F.explode(_scattered(g.ny, half_y, repeat, "iy"))).withColumn("x", F.explode(_scattered(g.nx, half_x, repeat, "ix")))
    bands = [cube.band(b) for b in cube.bands]
    parts = df.select("it", F.col("y.to").alias("iy"), F.col("x.to").alias("ix"), F.col("y.at").alias("ay"), F.col("x.at").alias("ax"), *bands)
    size = window[0] * window[1]
    # how many cells of a window lie beyond the border, where the padding is a constant
    inside = lambda name, n, half: F.least(F.col(name) + half, F.lit(n - 1)) - F.greatest(F.col(name) - half, F.lit(0)) + 1
    outside = F.lit(size) - inside("iy", g.ny, half_y) * inside("ix", g.nx, half_x)
    plan = {"cube_type": "window_space", "window": list(map(int, window)), "pad": pad}
    if kernel is not None:
        flat = F.array(*[F.lit(w) for row in kernel for w in row])
        weight = F.element_at(flat, (F.col("ay") + half_y) * window[1] + F.col("ax") + half_x + 1)
        sums = [F.sum(weight * cube.band(b)).alias(f"_s{i}") for i, b in enumerate(cube.bands)] + [F.count(cube.band(b)).alias(f"_n{i}") for i, b in enumerate(cube.bands)]
        got = parts.groupBy("it", "iy", "ix").agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_c"), *sums)
        whole = float(sum(map(sum, kernel)))
        if mode == "CONSTANT":
            # what the window's inner cells weigh is known from its place alone
            total = _inner_weight(kernel, g.ny, g.nx, half_y, half_x)
            value = lambda i: F.when(F.col(f"_n{i}") + outside == size, F.col(f"_s{i}") + constant * (F.lit(whole) - total))
        else:
            value = lambda i: F.when(F.col(f"_n{i}") == size, F.col(f"_s{i}"))
        out = got.select("it", "iy", "ix", *[value(i).alias(b) for i, b in enumerate(cube.bands)])
        return Cube.make(out, g, cube.bands, {**plan, "kernel": kernel}, cube)
    parsed = _calls(cube, calls, R.WINDOW_SPACE, None)
    if size > ONE_PASS and half_y and half_x and all(n in PARTS for n, *_ in parsed):
        got = _by_rows_and_columns(cube, parsed, half_y, half_x, repeat, constant if mode == "CONSTANT" else None, outside)
    else:
        if mode == "CONSTANT":
            # the border's copies of the constant join the cells as rows of their windows
            rim = _rim(cube, outside).withColumn("_k", F.explode(F.array_repeat(F.lit(constant), outside.cast("int"))))
            parts = parts.select("it", "iy", "ix", *bands).unionByName(rim.select("it", "iy", "ix", *[F.col("_k").alias(b) for b in cube.bands]))
        got = parts.groupBy("it", "iy", "ix").agg(*[R.neutral(n, cube.band(b)).alias(o) for n, b, o in parsed])
    names = [o for *_, o in parsed]
    # count, sum and prod have a value in windows that hold no cell at all
    empty = {o: {"count": 0.0, "sum": 0.0, "prod": 1.0}[n] for n, _, o in parsed if n in ("count", "sum", "prod")}
    if empty:
        got = every_cell(cube.spark, g).join(got, ["it", "iy", "ix"], "left")
        got = got.select("it", "iy", "ix", *[F.coalesce(F.col(f"`{o}`"), F.lit(empty[o])).alias(o) if o in empty else F.col(f"`{o}`") for *_, o in parsed])
    if keep_bands:
        got = got.join(cube.df, ["it", "iy", "ix"], "full_outer")
        names = [*cube.bands, *names]
    return Cube.make(got, g, names, {**plan, "reducer_bands": list(calls), "keep_bands": keep_bands}, cube)


def _rim(cube: Cube, outside: Column) -> DataFrame:
    """Cells whose windows reach beyond the border, in steps that have a row."""
    return every_cell(cube.spark, cube.grid).where(outside > 0).join(cube.df.select("it").distinct(), "it", "left_semi")


def _by_rows_and_columns(cube: Cube, parsed: list[tuple[str, str, str]], half_y: int, half_x: int, repeat: str | None, constant: float | None, outside: Column) -> DataFrame:
    """Windows put together from parts: of each row first, and of the rows then. Copies of a constant beyond the border
    are not rows, but added by their number."""
    g = cube.grid
    wanted = list(dict.fromkeys((part, b) for n, b, _ in parsed for part in PARTS[n]))
    name = {p: f"_p{i}" for i, p in enumerate(wanted)}
    first = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "prod": F.product}
    again = {**first, "count": F.sum}
    rows = cube.df.withColumn("x", F.explode(_scattered(g.nx, half_x, repeat, "ix"))).select("it", "iy", F.col("x.to").alias("ix"), *[cube.band(b) for b in cube.bands])
    rows = rows.groupBy("it", "iy", "ix").agg(*[first[part](cube.band(b)).alias(name[part, b]) for part, b in wanted])
    cells = rows.withColumn("y", F.explode(_scattered(g.ny, half_y, repeat, "iy"))).select("it", F.col("y.to").alias("iy"), "ix", *name.values())
    if constant is not None:
        kinds = dict(cells.dtypes)
        cells = cells.unionByName(_rim(cube, outside).select("it", "iy", "ix", *[F.lit(None).cast(kinds[c]).alias(c) for c in name.values()]))
    got = cells.groupBy("it", "iy", "ix").agg(*[again[part](F.col(c)).alias(c) for (part, _), c in name.items()])
    beyond = outside if constant is not None else F.lit(0)
    copies = F.when(beyond > 0, F.lit(constant)) if constant is not None else F.lit(None).cast("double")

    def value(n: str, b: str) -> Column:
        part = lambda p: F.col(name[p, b])
        if n in ("min", "max"):
            return (F.least if n == "min" else F.greatest)(part(n), copies)
        if n == "prod":
            return F.coalesce(part(n), F.lit(1.0)) * F.pow(F.lit(constant or 0.0), beyond)
        if n == "count":
            return (F.coalesce(part(n), F.lit(0)) + beyond).cast("double")
        total = F.coalesce(part("sum"), F.lit(0.0)) + beyond * F.lit(constant or 0.0)
        return total if n == "sum" else F.try_divide(total, (F.coalesce(part("count"), F.lit(0)) + beyond).cast("double"))

    return got.select("it", "iy", "ix", *[value(n, b).alias(o) for n, b, o in parsed])


def _inner_weight(kernel: list[list[float]], ny: int, nx: int, half_y: int, half_x: int) -> Column:
    """The weights of a window's cells inside the grid, by its place: a prefix sum of the kernel."""
    rows, columns = len(kernel), len(kernel[0])
    prefix = [[0.0] * (columns + 1) for _ in range(rows + 1)]
    for i in range(rows):
        for j in range(columns):
            prefix[i + 1][j + 1] = kernel[i][j] + prefix[i][j + 1] + prefix[i + 1][j] - prefix[i][j]
    flat = F.array(*[F.lit(v) for row in prefix for v in row])
    low = lambda name, half: F.greatest(F.lit(half) - F.col(name), F.lit(0))
    high = lambda name, n, half: F.least(F.lit(n - 1 + half) - F.col(name), F.lit(2 * half)) + 1
    at = lambda y, x: F.element_at(flat, (y * (columns + 1) + x + 1).cast("int"))
    y0, y1, x0, x1 = low("iy", half_y), high("iy", ny, half_y), low("ix", half_x), high("ix", nx, half_x)
    return at(y1, x1) - at(y0, x1) - at(y1, x0) + at(y0, x0)
