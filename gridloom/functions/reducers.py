"""Reducers as Spark aggregates. Missing values never count.

Two families differ in what nothing but missing values gives: reducing gives 0 for sum and count and 1 for prod, while
aggregating to coarser cells gives a missing sum and prod.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

REDUCE = ("min", "max", "mean", "median", "sum", "count", "prod", "var", "sd", "q1", "q3", "which_min", "which_max")
SPACE = ("min", "max", "mean", "median", "sum", "count", "prod", "var", "sd")
AGGREGATE = SPACE
WINDOW_TIME = ("min", "max", "mean", "median", "sum", "count", "prod")
WINDOW_SPACE = SPACE
_CALL = re.compile(r"\s*([A-Za-z_0-9]+)\s*\(\s*([^()]+?)\s*\)\s*")


def parse_call(text: str, allowed: tuple[str, ...]) -> tuple[str, str]:
    """Splits "reducer(band)"."""
    m = _CALL.fullmatch(text)
    if not m:
        raise ValueError(f"not of the form reducer(band): {text!r}")
    name = m[1].lower()
    if name not in allowed:
        raise ValueError(f"unknown reducer {m[1]!r}; there are {', '.join(allowed)}")
    return name, m[2]


def plain(name: str, v: Column) -> Column:
    """Missing where there is no value (count: 0)."""
    return {
        "min": lambda: F.min(v), "max": lambda: F.max(v), "mean": lambda: F.avg(v), "median": lambda: F.median(v), "sum": lambda: F.sum(v), "count": lambda: F.count(v).cast("double"),
        "prod": lambda: F.product(v), "var": lambda: F.var_samp(v), "sd": lambda: F.stddev_samp(v), "q1": lambda: F.percentile(v, 0.25), "q3": lambda: F.percentile(v, 0.75),
    }[name]()


def neutral(name: str, v: Column) -> Column:
    """0 or 1 where there is no value, for sum, count and prod."""
    out = plain(name, v)
    return F.coalesce(out, F.lit({"sum": 0.0, "prod": 1.0}[name])) if name in ("sum", "prod") else out


def which(name: str, v: Column, it: Column) -> Column:
    """The first step of the least or greatest value."""
    if name == "which_min":
        return F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), it.alias("it"))))["it"]
    return -F.max(F.when(v.isNotNull(), F.struct(v.alias("v"), (-it).alias("it"))))["it"]
