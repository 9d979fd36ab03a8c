"""Cubes from images: pixels are put on the grid (resampling), masked, and composed in time.

Pixels come as rows (image_id, band_name, x, y, value) in the image's coordinates. The catalogue's range query comes
first, so that only images that a view can show are read.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import replace
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import Cube
from ..functions.srs import transform, transform_columns
from ..grid import Grid, View
from ..operators.pixel import image_mask
from ..timeaxis import DateTime, Unit
from .catalog import Collection
from .points import clean, in_range, time_bin

#: Radius in target cells, and weight by distance, of methods that weigh neighbours.
_CUBIC = lambda t, a: F.when(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1).when(t < 2, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a).otherwise(0.0)
_SPLINE = lambda t: F.when(t <= 1, (3 * t**3 - 6 * t**2 + 4) / 6).when(t < 2, (2 - t) ** 3 / 6).otherwise(0.0)
_SINC = lambda t: F.when(t == 0, 1.0).otherwise(F.sin(t * math.pi) / (t * math.pi))
KERNELS = {
    "bilinear": (1, lambda t: F.greatest(F.lit(0.0), 1 - t)), "cubic": (2, lambda t: _CUBIC(t, -0.5)), "cubicspline": (2, _SPLINE),
    "lanczos": (3, lambda t: F.when(t < 3, _SINC(t) * _SINC(t / 3)).otherwise(0.0)),
}


def resample(rows: DataFrame, keys: Sequence[str], grid: Grid, method: str) -> DataFrame:
    """Pixels (keys, px, py, value) to one value for each cell and keys."""
    g = grid
    fx, fy = (F.col("px") - g.left) / g.dx, (g.top - F.col("py")) / g.dy
    if method in KERNELS:
        radius, weight = KERNELS[method]
        near = lambda f: F.sequence(F.ceil(f - 0.5 - radius).cast("int"), F.floor(f - 0.5 + radius).cast("int"))
        out = rows.where(F.col("value").isNotNull()).select(*keys, "value", fx.alias("fx"), fy.alias("fy")).withColumn("ix", F.explode(near(F.col("fx")))).withColumn("iy", F.explode(near(F.col("fy"))))
        w = weight(F.abs(F.col("fx") - 0.5 - F.col("ix"))) * weight(F.abs(F.col("fy") - 0.5 - F.col("iy")))
        return _inside(out, g).withColumn("w", w).groupBy(*keys, "iy", "ix").agg(F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("value"))
    cells = _inside(rows.select(*keys, "value", "px", "py", F.floor(fx).cast("int").alias("ix"), F.floor(fy).cast("int").alias("iy"), (F.pow(fx - 0.5 - F.floor(fx), 2) + F.pow(fy - 0.5 - F.floor(fy), 2)).alias("d")), g)
    v = F.col("value")
    agg = {
        "near": lambda: F.min(F.struct("d", "px", "py", "value"))["value"], "average": lambda: F.avg(v), "mode": lambda: F.mode(v, True), "max": lambda: F.max(v), "min": lambda: F.min(v),
        "med": lambda: F.median(v), "q1": lambda: F.percentile(v, 0.25), "q3": lambda: F.percentile(v, 0.75),
    }[method]()
    return cells.groupBy(*keys, "iy", "ix").agg(agg.alias("value"))


def _inside(df: DataFrame, g: Grid) -> DataFrame:
    return df.where(F.col("ix").between(0, g.nx - 1) & F.col("iy").between(0, g.ny - 1))


def composite(method: str, v: Column, order: Column) -> Column:
    """One value of the images of a cell and step; order tells first and last."""
    known = F.when(v.isNotNull(), F.struct(order.alias("o"), v.alias("v")))
    return {
        "first": lambda: F.min(known)["v"], "last": lambda: F.max(known)["v"], "none": lambda: F.max(F.struct(order.alias("o"), v.alias("v")))["v"], "min": lambda: F.min(v), "max": lambda: F.max(v),
        "mean": lambda: F.avg(v), "median": lambda: F.median(v), "count_values": lambda: F.count(v).cast("double"), "count_images": lambda: F.count_distinct(order).cast("double"),
    }[method]()


def raster_cube(collection: Collection, pixels: DataFrame, view: View | None = None, bands: Sequence[str] | None = None, mask: Mapping | None = None, paths: Mapping[str, str] | None = None) -> Cube:
    """mask: band, and what image_mask takes; the mask band is resampled to the nearest. With paths, where the catalogue
    (file) and the pixels (pixels) are stored, the plan alone can make the cube again."""
    view = view or collection.default_view()
    g = view.grid
    corners = [transform(g.srs, "EPSG:4326", x, y) for x in (g.left, g.right) for y in (g.bottom, g.top)]
    own = collection.bands
    names = list(bands) if bands else [r["name"] for r in own.orderBy("id").select("name").collect() if not mask or r["name"] != mask["band"]]
    wanted = [*names, *([mask["band"]] if mask else [])]
    end = g.time(g.nt) if g.labels is None else g.labels[-1]
    last = DateTime(end.at - timedelta(seconds=1), Unit.SECOND)
    found = collection.range_query(min(x for x, _ in corners), max(x for x, _ in corners), min(y for _, y in corners), max(y for _, y in corners), g.t0.at.strftime("%Y-%m-%dT%H:%M:%S"), str(last), wanted)
    refs = found.select("image_id", "band_name", "descriptor", "datetime", F.expr("try_cast(nullif(nodata, '') AS double)").alias("nodata"), "offset", "scale")
    rows = pixels.where(F.col("band_name").isin(wanted)).join(refs, ["image_id", "band_name"])
    raw = clean(F.col("value"))
    value = F.when(F.col("nodata").isNull() | (raw != F.col("nodata")), raw * F.coalesce("scale", F.lit(1.0)) + F.coalesce("offset", F.lit(0.0)))
    px, py = F.col("x"), F.col("y")
    when = F.col("datetime").cast("timestamp_ntz")
    rows = rows.where(in_range(when, g)).select("image_id", "descriptor", "band_name", time_bin(when, g).alias("it"), px.cast("double").alias("px"), py.cast("double").alias("py"), value.alias("value"))
    keys = ["it", "image_id", "descriptor", "band_name"]
    cells = resample(rows.where(F.col("band_name").isin(names)), keys, g, view.resampling)
    if mask:
        settings = {k: v for k, v in mask.items() if k != "band"}
        hidden = resample(rows.where(F.col("band_name") == mask["band"]), ["it", "image_id"], g, "near").where(image_mask(F.col("value"), **settings))
        cells = cells.join(hidden.select("image_id", "it", "iy", "ix", F.lit(True).alias("_hidden")), ["image_id", "it", "iy", "ix"], "left").withColumn("value", F.when(F.col("_hidden").isNull(), F.col("value")))
    order = F.struct("image_id", "descriptor")
    by_image = F.col("image_id") if view.aggregation == "count_images" else order
    columns = [composite(view.aggregation, F.when(F.col("band_name") == b, F.col("value")), F.when(F.col("band_name") == b, by_image)).alias(b) for b in names]
    if view.aggregation == "none":
        columns = [F.max(F.when(F.col("band_name") == b, F.struct(order.alias("o"), F.col("value").alias("v"))))["v"].alias(b) for b in names]
    df = cells.groupBy("it", "iy", "ix").agg(*columns)
    return Cube.make(df, g, names, {"cube_type": "image_collection", "view": view.to_json(), "bands": names, "mask": dict(mask) if mask else None, **(paths or {})})


def project_pixels(pixels: DataFrame, collection: Collection, srs: str) -> DataFrame:
    """Pixels with coordinates in another reference system, where their images have one of the closed-form ones."""
    both = pixels.join(collection.images.select(F.col("id").alias("image_id"), "proj"), "image_id")
    out = {}
    for k, i in (("x", 0), ("y", 1)):
        c = F.col(k)
        for source in ("EPSG:4326", "EPSG:3857"):
            if source != srs:
                c = F.when(F.col("proj") == source, transform_columns(source, srs, F.col("x"), F.col("y"))[i]).otherwise(c)
        out[k] = c
    return both.withColumns(out).drop("proj")


def stack_cube(images: Sequence[tuple[str, DataFrame]], grid: Grid, band_names: Sequence[str] | None = None, paths: Sequence[str] | None = None) -> Cube:
    """A cube at the images' own times: (datetime, DataFrame iy, ix and a column for each band), on one grid, in order
    of time. Bands are x1, x2 and so on, if they have no names. With paths, where the images are stored, the plan alone
    can make the cube again."""
    parsed = sorted(((DateTime.parse(t), df) for t, df in images), key=lambda p: p[0].at)
    labels = list(dict.fromkeys(t.floor() for t, _ in parsed))
    first = [c for c in parsed[0][1].columns if c not in ("iy", "ix")]
    names = list(band_names) if band_names else [f"x{i + 1}" for i in range(len(first))]
    frames = [df.select(F.lit(labels.index(t.floor())).alias("it"), "iy", "ix", *[clean(F.col(f"`{c}`")).alias(n) for c, n in zip(first, names, strict=True)]) for t, df in parsed]
    return Cube.make(reduce(DataFrame.unionByName, frames), replace(grid, labels=tuple(labels)), names, {"cube_type": "stack", "view": grid.to_json(), "bands": names, **({"images": [[t, p] for (t, _), p in zip(images, paths, strict=True)]} if paths else {})})
