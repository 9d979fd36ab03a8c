"""Plans as JSON: every operator notes its settings and the plans it works on; a cube is rebuilt from them.

Sources that read tables note where these are stored, if they are told; else a source must be given for them. User
functions cannot be stored, and must be given again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import SparkSession

from ..cube import Cube
from ..grid import Grid, View
from ..operators import geom, join, pixel
from ..sources import synthetic
from ..sources.catalog import Collection
from ..sources.images import raster_cube, stack_cube
from ..sources.points import points_to_cube


def to_json(cube: Cube) -> str:
    return json.dumps(cube.plan, default=str)


def plan_hash(cube: Cube) -> str:
    """Equal for equal plans; a key for what is kept of results."""
    import hashlib

    return hashlib.sha256(json.dumps(cube.plan, sort_keys=True, default=str).encode()).hexdigest()


def from_json(spark: SparkSession, text: str | dict, sources: Mapping[str, Callable[[dict], Cube]] | None = None, functions: Mapping[str, Callable] | None = None) -> Cube:
    """sources: by cube_type, what makes a cube of a node that reads tables. functions: user functions by cube_type."""
    node = json.loads(text) if isinstance(text, str) else text
    kind = node.get("cube_type")
    if sources and kind in sources:
        return sources[kind](node)
    build = _NODES.get(kind)
    if build is None:
        raise ValueError(f"unknown cube_type {kind!r}")
    if "in_cubes" in node:
        inputs = [from_json(spark, n, sources, functions) for n in node["in_cubes"]]
    elif "in_cube" in node:
        inputs = [from_json(spark, node["in_cube"], sources, functions)]
    else:
        inputs = []
    return build(spark, node, inputs, functions or {})


def _function(functions: Mapping[str, Callable], kind: str) -> Callable:
    if kind not in functions:
        raise ValueError(f"the function of {kind} must be given")
    return functions[kind]


def _file(spark: SparkSession, n: dict, c: list[Cube], f: Mapping) -> Cube:
    from ..sinks.files import read_cube

    return read_cube(spark, n["path"])


def _stored(n: dict, *keys: str) -> list:
    if not all(k in n for k in keys):
        raise ValueError(f"the plan of {n['cube_type']} does not say where its tables are; give a source for it")
    return [n[k] for k in keys]


def _points(spark: SparkSession, n: dict, c: list[Cube], f: Mapping) -> Cube:
    path, time, x, y, columns = _stored(n, "path", "time", "x", "y", "columns")
    return points_to_cube(spark.read.parquet(path), Grid.from_json(n["view"]), time, x, y, {b: (r, columns[b]) for b, r in n["bands"].items()}, n.get("srs"), path)


def _images(spark: SparkSession, n: dict, c: list[Cube], f: Mapping) -> Cube:
    file, pixels = _stored(n, "file", "pixels")
    return raster_cube(Collection.open(spark, file), spark.read.parquet(pixels), View.from_json(n["view"]) if n.get("view") else None, n.get("bands"), n.get("mask"), {"file": file, "pixels": pixels})


def _stack(spark: SparkSession, n: dict, c: list[Cube], f: Mapping) -> Cube:
    (images,) = _stored(n, "images")
    return stack_cube([(t, spark.read.parquet(p)) for t, p in images], Grid.from_json(n["view"]), n.get("bands"), [p for _, p in images])


_NODES: dict[str, Callable[[SparkSession, dict, list[Cube], Mapping[str, Callable]], Cube]] = {
    "dummy": lambda s, n, c, f: synthetic.dummy_cube(s, Grid.from_json(n["view"]), n["nbands"], n["fill"]),
    "empty": lambda s, n, c, f: synthetic.empty_cube(s, Grid.from_json(n["view"]), n["nbands"]),
    "file": _file, "points": _points, "image_collection": _images, "stack": _stack,
    "select_bands": lambda s, n, c, f: c[0].select_bands(*n["bands"]),
    "rename_bands": lambda s, n, c, f: c[0].rename_bands(**n["names"]),
    "apply_pixel": lambda s, n, c, f: c[0].apply_pixel(n["expr"], n["band_names"], n["keep_bands"]),
    "filter_pixel": lambda s, n, c, f: c[0].filter_pixel(n["predicate"]),
    "mask_bands": lambda s, n, c, f: pixel.mask_bands(c[0], n["band"], **n["mask"]),
    "filter_geom": lambda s, n, c, f: geom.filter_geom(c[0], n["rings"], n["srs"]),
    "crop": lambda s, n, c, f: c[0].crop(iextent={"x": n["ix"], "y": n["iy"], "t": n["it"]}),
    "slice_time": lambda s, n, c, f: c[0].slice_time(it=n["it"]),
    "slice_space": lambda s, n, c, f: c[0].slice_space(i=(n["ix"], n["iy"])),
    "select_time": lambda s, n, c, f: c[0].select_time(n["t"]),
    "reduce_time": lambda s, n, c, f: c[0].reduce_time(*n["reducer_bands"], names=n.get("names")),
    "reduce_space": lambda s, n, c, f: c[0].reduce_space(*n["reducer_bands"], names=n.get("names")),
    "aggregate_time": lambda s, n, c, f: c[0].aggregate_time(n.get("dt"), n["method"], n.get("fact")),
    "aggregate_space": lambda s, n, c, f: c[0].aggregate_space(n.get("dx"), n.get("dy"), n["method"], n.get("fact")),
    "window_time": lambda s, n, c, f: c[0].window_time(*n.get("reducer_bands", []), window=n["window"], kernel=n.get("kernel")),
    "window_space": lambda s, n, c, f: c[0].window_space(*n.get("reducer_bands", []), window=n["window"], kernel=n.get("kernel"), keep_bands=n.get("keep_bands", False), pad=n["pad"]),
    "fill_time": lambda s, n, c, f: c[0].fill_time(n["method"]),
    "join_bands": lambda s, n, c, f: join.join_bands(dict(zip(n["prefixes"], c, strict=True))),
    "apply_pixel_function": lambda s, n, c, f: c[0].apply_pixel(_function(f, n["cube_type"]), n["band_names"], n["keep_bands"], n.get("by_batch", False)),
    "reduce_time_function": lambda s, n, c, f: c[0].reduce_time(fun=_function(f, n["cube_type"]), names=n["names"]),
    "reduce_space_function": lambda s, n, c, f: c[0].reduce_space(fun=_function(f, n["cube_type"]), names=n["names"]),
    "apply_time_function": lambda s, n, c, f: c[0].apply_time(_function(f, n["cube_type"]), n["names"], n["keep_bands"]),
    "chunk_apply": lambda s, n, c, f: c[0].chunk_apply(_function(f, n["cube_type"]), n["names"], tuple(n["chunk"])),
    "predict": lambda s, n, c, f: c[0].predict(_function(f, n["cube_type"]), n["names"], n["keep_bands"]),
}
NODE_TYPES = tuple(_NODES)


def view_from_json(text: str | dict) -> View:
    return View.from_json(text)
