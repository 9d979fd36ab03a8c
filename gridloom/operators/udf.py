"""User functions, always over Arrow batches: by pixel in mapInPandas, by series, slice or chunk in applyInPandas.

Arrays are numpy arrays of doubles, NaN where there is no value. Functions get what their form names: a dict of band
values (or of arrays of them), a (band, time) or (band, y * x) matrix, or a (band, t, y, x) block. Output names may be left out; the function is then
tried on made-up values.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd

from ..cube import Cube, cell_schema, collapsed_time


def _arity(result: object) -> int:
    return int(np.atleast_1d(np.asarray(result, float)).shape[0])


def _named(names: Sequence[str] | str | None, n: int) -> list[str]:
    if names is None:
        return [f"band{i + 1}" for i in range(n)]
    out = [names] if isinstance(names, str) else list(names)
    if len(out) != n:
        raise ValueError(f"the function gives {n} values, there are {len(out)} names")
    return out


def apply_pixel(cube: Cube, fun: Callable, names=None, keep_bands: bool = False, by_batch: bool = False) -> Cube:
    """fun gets the bands' values of a cell; by batch, arrays of the bands' values of many cells, and gives an array (or
    one number) for each name: one call for a batch in place of one for a cell."""
    trial = fun({b: np.ones(1) for b in cube.bands} if by_batch else dict.fromkeys(cube.bands, 1.0))
    own = _named(names, len(trial) if by_batch else _arity(trial))
    kept, bands = ([b for b in cube.bands if b not in own] if keep_bands else []), cube.bands

    def run(batches):
        for pdf in batches:
            values = pdf[list(bands)].to_numpy(float)
            if by_batch:
                given = fun({b: values[:, k] for k, b in enumerate(bands)})
                got = np.stack([np.broadcast_to(np.asarray(v, float), len(pdf)) for v in given], axis=1)
            else:
                got = np.array([np.atleast_1d(np.asarray(fun(dict(zip(bands, row, strict=True))), float)) for row in values]).reshape(len(pdf), len(own))
            yield pd.concat([pdf[["it", "iy", "ix", *kept]].reset_index(drop=True), pd.DataFrame(got, columns=own)], axis=1)

    out = [*kept, *own]
    plan = {"cube_type": "apply_pixel_function", "band_names": own, "keep_bands": keep_bands, "by_batch": by_batch}
    return Cube.make(cube.df.mapInPandas(run, cell_schema(out)), cube.grid, out, plan, cube)


def _matrix(pdf: pd.DataFrame, bands: Sequence[str], place: np.ndarray, size: int) -> np.ndarray:
    out = np.full((len(bands), size), np.nan)
    out[:, place] = pdf[list(bands)].to_numpy(float).T
    return out


def reduce_time(cube: Cube, fun: Callable[[np.ndarray], Sequence[float]], names=None) -> Cube:
    """fun gets the (band, time) matrix of a pixel."""
    bands, nt = cube.bands, cube.nt
    own = _named(names, _arity(fun(np.ones((len(bands), nt)))))

    def run(key, pdf):
        got = np.atleast_1d(np.asarray(fun(_matrix(pdf, bands, pdf["it"].to_numpy(), nt)), float))
        return pd.DataFrame([[0, *map(int, key), *got]], columns=["it", "iy", "ix", *own])

    return Cube.make(cube.df.groupBy("iy", "ix").applyInPandas(run, cell_schema(own)), collapsed_time(cube.grid), own, {"cube_type": "reduce_time_function", "names": own}, cube)


def reduce_space(cube: Cube, fun: Callable[[np.ndarray], Sequence[float]], names=None) -> Cube:
    """fun gets the (band, y * x) matrix of a step. A step must fit in a task's memory: the function sees all of it."""
    bands, nx, ny = cube.bands, cube.nx, cube.ny
    own = _named(names, _arity(fun(np.ones((len(bands), ny * nx)))))

    def run(key, pdf):
        got = np.atleast_1d(np.asarray(fun(_matrix(pdf, bands, (pdf["iy"] * nx + pdf["ix"]).to_numpy(), ny * nx)), float))
        return pd.DataFrame([[int(key[0]), 0, 0, *got]], columns=["it", "iy", "ix", *own])

    return Cube.make(cube.df.groupBy("it").applyInPandas(run, cell_schema(own)), replace(cube.grid, nx=1, ny=1), own, {"cube_type": "reduce_space_function", "names": own}, cube)


def apply_time(cube: Cube, fun: Callable[[np.ndarray], np.ndarray], names=None, keep_bands: bool = False) -> Cube:
    """fun gets the (band, time) matrix of a pixel, and gives one of as many steps."""
    bands, nt = cube.bands, cube.nt
    shape = lambda x: np.atleast_2d(np.asarray(x, float))
    own = _named(names, shape(fun(np.ones((len(bands), nt)))).shape[0])
    kept = [b for b in bands if b not in own] if keep_bands else []

    def run(key, pdf):
        series = _matrix(pdf, bands, pdf["it"].to_numpy(), nt)
        got = shape(fun(series))
        if got.shape[1] != nt:
            raise ValueError("the function must keep the number of steps")
        out = {"it": np.arange(nt), "iy": int(key[0]), "ix": int(key[1])}
        return pd.DataFrame(out | {b: series[bands.index(b)] for b in kept} | dict(zip(own, got, strict=True)))

    out = [*kept, *own]
    return Cube.make(cube.df.groupBy("iy", "ix").applyInPandas(run, cell_schema(out)), cube.grid, out, {"cube_type": "apply_time_function", "names": own, "keep_bands": keep_bands}, cube)


def _fitted(got: np.ndarray, n: int, shape: tuple[int, int, int]) -> np.ndarray:
    """A function's block as one of n bands and the chunk's own shape. A dimension may come back with a length of one,
    whose values then stand for all of it."""
    got = got.reshape((n, *got.shape[-3:]) if got.ndim >= 3 else (n, 1, 1, 1))
    if any(a not in (1, b) for a, b in zip(got.shape[1:], shape, strict=True)):
        raise ValueError(f"the function gives a block of {got.shape[1:]} for a chunk of {shape}")
    return np.broadcast_to(got, (n, *shape))


def chunk_apply(cube: Cube, fun: Callable, names: Sequence[str], chunk: tuple[int, int, int] = (1, 256, 256)) -> Cube:
    """fun gets blocks (band, t, y, x) and gives blocks of the same steps, rows and columns, or of one of them for all.
    A function of two arguments also gets what the block is of: bands, srs, and the times, y and x of its cells (centres).
    Chunks without a row are not seen."""
    from pyspark.sql import functions as F

    bands, own, g, (ct, cy, cx) = cube.bands, list(names), cube.grid, chunk
    told = len(inspect.signature(fun).parameters) > 1

    def run(key, pdf):
        t0, y0, x0 = int(key[0]) * ct, int(key[1]) * cy, int(key[2]) * cx
        shape = min(ct, g.nt - t0), min(cy, g.ny - y0), min(cx, g.nx - x0)
        block = np.full((len(bands), *shape), np.nan)
        block[:, pdf["it"] - t0, pdf["iy"] - y0, pdf["ix"] - x0] = pdf[list(bands)].to_numpy(float).T
        if told:
            of = {
                "bands": list(bands), "srs": g.srs, "t": [str(g.time(t0 + i)) for i in range(shape[0])], "y": g.top - (y0 + np.arange(shape[1]) + 0.5) * g.dy,
                "x": g.left + (x0 + np.arange(shape[2]) + 0.5) * g.dx,
            }
        got = _fitted(np.asarray(fun(block, of) if told else fun(block), float), len(own), shape)
        t, y, x = np.indices(shape).reshape(3, -1)
        return pd.DataFrame({"it": t + t0, "iy": y + y0, "ix": x + x0, **dict(zip(own, got.reshape(len(own), -1), strict=True))})

    groups = [F.floor(F.col(d) / n).alias(f"_{d}") for d, n in (("it", ct), ("iy", cy), ("ix", cx))]
    return Cube.make(cube.df.groupBy(*groups).applyInPandas(run, cell_schema(own)), g, own, {"cube_type": "chunk_apply", "names": own, "chunk": list(chunk)}, cube)


def predict(cube: Cube, model, names: Sequence[str] = ("prediction",), keep_bands: bool = False) -> Cube:
    """model.predict(frame of bands), or model itself if it is a function, over cells whose bands all have values. A
    name that does not begin with a letter or digit gets an X before it."""
    bands = list(cube.bands)
    own = [n if n[:1].isalnum() else f"X{n}" for n in ([names] if isinstance(names, str) else names)]
    kept = [b for b in bands if b not in own] if keep_bands else []
    score = model.predict if hasattr(model, "predict") else model

    def run(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            whole = pdf[bands].notna().all(axis=1).to_numpy()
            out = pdf[["it", "iy", "ix", *kept]].copy()
            got = np.full((len(pdf), len(own)), np.nan)
            if whole.any():
                got[whole] = np.asarray(score(pdf.loc[whole, bands]), float).reshape(int(whole.sum()), len(own))
            out[own] = got
            yield out

    out = [*kept, *own]
    return Cube.make(cube.df.mapInPandas(run, cell_schema(out)), cube.grid, out, {"cube_type": "predict", "names": own, "keep_bands": keep_bands}, cube)


# ---------------------------------------------------------------- arrays in memory


def apply_pixel_array(x: np.ndarray, fun: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """fun of the bands of each pixel of (b, t, y, x)."""
    return np.apply_along_axis(lambda v: np.atleast_1d(fun(v)), 0, x)


def reduce_time_array(x: np.ndarray, fun: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    b, _, ny, nx = x.shape
    cells = [np.atleast_1d(fun(x[:, :, i, j])) for i in range(ny) for j in range(nx)]
    return np.array(cells).T.reshape(-1, 1, ny, nx)


def reduce_space_array(x: np.ndarray, fun: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    b, nt, _, _ = x.shape
    return np.array([np.atleast_1d(fun(x[:, k].reshape(b, -1))) for k in range(nt)]).T.reshape(-1, nt, 1, 1)


def apply_time_array(x: np.ndarray, fun: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    b, nt, ny, nx = x.shape
    cells = [np.atleast_2d(fun(x[:, :, i, j])) for i in range(ny) for j in range(nx)]
    return np.array(cells).transpose(1, 2, 0).reshape(-1, nt, ny, nx)
