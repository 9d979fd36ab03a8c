"""Cubes without data: one value everywhere, or none anywhere."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..cube import Cube, cell_schema, every_cell
from ..grid import Grid, View


def dummy_cube(spark: SparkSession, view: View | Grid, nbands: int = 1, fill: float = 1.0) -> Cube:
    g = view.grid if isinstance(view, View) else view
    bands = [f"band{i + 1}" for i in range(nbands)]
    df = every_cell(spark, g).withColumns({b: F.lit(float(fill)) for b in bands})
    return Cube.make(df, g, bands, {"cube_type": "dummy", "view": g.to_json(), "nbands": nbands, "fill": fill})


def empty_cube(spark: SparkSession, view: View | Grid, nbands: int = 1) -> Cube:
    g = view.grid if isinstance(view, View) else view
    bands = [f"band{i + 1}" for i in range(nbands)]
    return Cube.make(spark.createDataFrame([], cell_schema(bands)), g, bands, {"cube_type": "empty", "view": g.to_json(), "nbands": nbands})
