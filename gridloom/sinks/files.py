"""Cubes as files and arrays. The stored form is Parquet beside a JSON description, whole, by chunk or by step; values
may be packed into small integers."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import DIMS, Cube
from ..grid import Grid

#: Number type of Spark that holds a packed type, its least and greatest value.
PACKED = {
    "uint8": ("short", 0, 255), "uint16": ("int", 0, 65535), "uint32": ("long", 0, 4294967295), "int16": ("short", -32768, 32767), "int32": ("int", -2147483648, 2147483647),
    "float32": ("float", None, None),
}


@dataclass(frozen=True)
class Packing:
    """stored = round((value - offset) / scale), nodata where there is no value."""

    type: str
    scale: float = 1.0
    offset: float = 0.0
    nodata: float | None = None

    def pack(self, v: Column) -> Column:
        kind, low, high = PACKED[self.type]
        x = (v - self.offset) / self.scale
        if kind != "float":
            x = F.greatest(F.least(F.round(x), F.lit(float(high))), F.lit(float(low)))
        return F.coalesce(x, F.lit(self.nodata)).cast(kind)

    def unpack(self, v: Column) -> Column:
        x = v.cast("double")
        own = x * self.scale + self.offset
        return own if self.nodata is None else F.when(x != self.nodata, own)


def pack_minmax(type: str, min: float, max: float, simplify: bool = False) -> Packing:  # noqa: A002
    """A packing that uses a type's range for values from min to max; one stored value is for missing ones. Simplified,
    the scale is the power of ten below it (values near max may then be cut off at the type's greatest)."""
    kind, low, high = PACKED[type]
    if kind == "float":
        return Packing(type)
    scale = (max - min) / (high - low - 1)
    offset = min - (low + 1) * scale
    return Packing(type, 10.0 ** math.floor(math.log10(scale)) if simplify else scale, offset, float(low))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_cube(cube: Cube, path: str, overwrite: bool = False, pack: Packing | None = None, chunk: tuple[int, int, int] | None = None, by_step: bool = False) -> None:
    """Parquet in path/data and a description in path/cube.json. With chunk, rows are kept by chunk, with by_step by
    step of time, so that crops read what they need."""
    if pack and chunk:
        raise ValueError("only a single output is packed")
    df = cube.df.select(*DIMS, *[(pack.pack(cube.band(b)) if pack else cube.band(b)).alias(b) for b in cube.bands])
    by = []
    if chunk:
        df = df.withColumns({f"c{d[1]}": F.floor(F.col(d) / n).cast("int") for d, n in zip(DIMS, chunk, strict=True)})
        by = ["ct", "cy", "cx"]
    elif by_step:
        # the step is a directory; a copy of it stays readable as the column
        df, by = df.withColumn("step", F.col("it")), ["step"]
    writer = (df.repartition(*by) if by else df).write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/data")
    meta = {"grid": cube.grid.to_json(), "bands": list(cube.bands), "pack": vars(pack) if pack else None, "chunk": chunk, "plan": cube.plan}
    _write_text(cube.spark, f"{path}/cube.json", json.dumps(meta, default=str))


def read_cube(spark: SparkSession, path: str, auto_unpack: bool = True) -> Cube:
    meta = json.loads(_read_text(spark, f"{path}/cube.json"))
    grid, bands = Grid.from_json(meta["grid"]), meta["bands"]
    pack = Packing(**meta["pack"]) if meta["pack"] and auto_unpack else None
    df = spark.read.parquet(f"{path}/data")
    df = df.select(*DIMS, *[(pack.unpack(F.col(f"`{b}`")) if pack else F.col(f"`{b}`")).alias(b) for b in bands])
    return Cube.make(df, grid, bands, {"cube_type": "file", "path": path})


def write_images(cube: Cube, path: str, prefix: str = "cube_", overviews: int = 0, pack: Packing | None = None) -> None:
    """A folder for each step, named by its time, and coarser levels of cells (2, 4, 8 and so on) if asked for. Each level
    has a description beside it."""
    from ..operators.aggregate import aggregate_space

    name = F.element_at(F.array(*[F.lit(f"{prefix}{t}") for t in cube.grid.times()]), F.col("it") + 1)
    for level in range(overviews + 1):
        c = aggregate_space(cube, fact=2**level, method="mean") if level else cube
        df = c.df.select(*DIMS, *[(pack.pack(c.band(b)) if pack else c.band(b)).alias(b) for b in c.bands])
        df.withColumn("image", name).write.mode("overwrite").partitionBy("image").parquet(f"{path}/level={level}")
        meta = {"grid": c.grid.to_json(), "bands": list(c.bands), "pack": vars(pack) if pack else None, "prefix": prefix, "plan": c.plan}
        _write_text(cube.spark, f"{path}/level={level}.json", json.dumps(meta, default=str))


def as_array(cube: Cube) -> np.ndarray:
    """(band, t, y, x) with NaN for missing values, on the driver."""
    out = np.full(cube.shape, np.nan)
    pdf = cube.df.toPandas()
    for k, b in enumerate(cube.bands):
        out[k, pdf["it"], pdf["iy"], pdf["ix"]] = pdf[b].to_numpy(float)
    return out


def as_table(cube: Cube, complete_only: bool = False) -> DataFrame:
    """A row of bands for each cell, or for each cell whose bands all have values."""
    if complete_only:
        return cube.df.select(*[cube.band(b) for b in cube.bands]).dropna()
    return cube.dense().select(*[cube.band(b) for b in cube.bands])


def plot_data(cube: Cube, band: str | int = 1, it: int | None = None, downsample: int = 512) -> DataFrame:
    """What a picture of one band shows: coordinates and values of at most downsample cells a side."""
    from ..operators.aggregate import aggregate_space

    c = cube.select_bands(band)
    c = c.slice_time(it=it) if it is not None else c
    fact = max(1, -(-max(c.nx, c.ny) // downsample))
    c = aggregate_space(c, fact=fact, method="mean") if fact > 1 else c
    g = c.grid
    return c.df.select("it", (g.left + (F.col("ix") + 0.5) * g.dx).alias("x"), (g.top - (F.col("iy") + 0.5) * g.dy).alias("y"), c.band(c.bands[0]).alias("value"))
