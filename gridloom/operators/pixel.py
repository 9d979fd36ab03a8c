"""Operators on single cells: projection, naming, expressions, predicates and masks."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cube import Cube
from ..functions.expr import compile_expression


def named_bands(cube: Cube, bands: Sequence[str | int]) -> list[str]:
    """Names from names or positions, the first being 1."""
    out = []
    for b in bands:
        if isinstance(b, int):
            if not 1 <= b <= len(cube.bands):
                raise ValueError(f"there is no band {b}")
            b = cube.bands[b - 1]
        if b not in cube.bands:
            raise ValueError(f"there is no band {b!r}")
        out.append(b)
    return out


def select_bands(cube: Cube, bands: Sequence[str | int]) -> Cube:
    names = named_bands(cube, bands)
    return Cube.make(cube.df, cube.grid, names, {"cube_type": "select_bands", "bands": names}, cube)


def rename_bands(cube: Cube, names: dict[str, str]) -> Cube:
    for old in names:
        if old not in cube.bands:
            warnings.warn(f"there is no band {old!r} to rename", stacklevel=3)
    known = {k: v for k, v in names.items() if k in cube.bands}
    bands = [known.get(b, b) for b in cube.bands]
    if len(set(bands)) < len(bands):
        raise ValueError("two bands would have one name")
    return Cube.make(cube.df.withColumnsRenamed(known), cube.grid, bands, {"cube_type": "rename_bands", "names": names}, cube)


def apply_pixel(cube: Cube, expressions: str | Sequence[str], names: Sequence[str] | str | None = None, keep_bands: bool = False) -> Cube:
    """New bands from expressions over bands and dimension variables. An expression without a band has a value in every
    cell, so that the cube is made dense for it."""
    texts = [expressions] if isinstance(expressions, str) else list(expressions)
    names = [names] if isinstance(names, str) else list(names or [f"band{i + 1}" for i in range(len(texts))])
    if len(names) != len(texts):
        raise ValueError("there must be a name for each expression")
    scope = {**cube.variables(), **{b.lower(): cube.band(b) for b in cube.bands}}
    bands = {b.lower() for b in cube.bands}
    compiled = [compile_expression(t, scope) for t in texts]
    df = cube.df if all(used & bands for _, used in compiled) else cube.dense()
    kept = [b for b in cube.bands if b not in names] if keep_bands else []
    out = df.select("it", "iy", "ix", *[cube.band(b) for b in kept], *[c.alias(n) for (c, _), n in zip(compiled, names, strict=True)])
    return Cube.make(out, cube.grid, [*kept, *names], {"cube_type": "apply_pixel", "expr": texts, "band_names": names, "keep_bands": keep_bands}, cube)


def filter_pixel(cube: Cube, predicate: str) -> Cube:
    """Cells whose predicate is neither 0 nor missing; the others lose all bands."""
    c, _ = compile_expression(predicate, {b.lower(): cube.band(b) for b in cube.bands})
    return Cube.make(cube.df.where(c != 0), cube.grid, cube.bands, {"cube_type": "filter_pixel", "predicate": predicate}, cube)


def image_mask(value: Column, values: Sequence[float] | None = None, min: float | None = None, max: float | None = None, bits: Sequence[int] | None = None, invert: bool = False) -> Column:  # noqa: A002
    """Whether a mask value hides a pixel: one of values, or from min to max; of some bits only, if these are given."""
    v = value
    if bits:
        v = v.cast("long").bitwiseAND(F.lit(sum(1 << b for b in bits))).cast("double")
    if values is not None:
        hit = v.isin([float(x) for x in values])
    elif min is not None and max is not None:
        hit = v.between(float(min), float(max))
    else:
        raise ValueError("give values, or min and max")
    hit = F.coalesce(hit, F.lit(False))
    return ~hit & v.isNotNull() if invert else hit


def mask_bands(cube: Cube, band: str, **mask) -> Cube:
    """All bands are lost where the mask band hides a cell."""
    return Cube.make(cube.df.where(~image_mask(cube.band(band), **mask)), cube.grid, cube.bands, {"cube_type": "mask_bands", "band": band, "mask": mask}, cube)
