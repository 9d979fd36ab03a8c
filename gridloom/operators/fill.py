"""Gap filling along time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..cube import Cube

METHODS = ("near", "linear", "locf", "nocb")


def fill_time(cube: Cube, method: str = "near") -> Cube:
    """Missing values from the values before and after at the same pixel, each band by itself. The nearer of the two
    (the earlier, if equally near), a linear interpolation by steps, the one before or the one after. Where there is a
    value on one side only, near and linear take that."""
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    pixel = Window.partitionBy("iy", "ix").orderBy("it")
    before, after = pixel.rowsBetween(Window.unboundedPreceding, 0), pixel.rowsBetween(0, Window.unboundedFollowing)

    def filled(band: str):
        v = cube.band(band)
        known = F.when(v.isNotNull(), F.struct(F.col("it").alias("it"), v.alias("v")))
        a, b = F.last(known, True).over(before), F.first(known, True).over(after)
        if method == "locf":
            return a["v"]
        if method == "nocb":
            return b["v"]
        left, right = F.col("it") - a["it"], b["it"] - F.col("it")
        if method == "near":
            both = F.when(left <= right, a["v"]).otherwise(b["v"])
        else:
            both = F.when(left + right == 0, v).otherwise(a["v"] + (b["v"] - a["v"]) * left / (left + right))
        return F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(both)

    df = cube.dense_in_time().select("it", "iy", "ix", *[filled(b).alias(b) for b in cube.bands])
    return Cube.make(df, cube.grid, cube.bands, {"cube_type": "fill_time", "method": method}, cube)
