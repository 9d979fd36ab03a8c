"""Queries over the supplied tables, one for each operator, and SQL for DuckDB to hold them against.

Cube E has the days of January 2024 as steps, hours of the day as rows and user_id modulo 15 as columns. Cube L has
months as steps, discounts as rows and quantities as columns. Doubles are rounded to six places on both sides, as sums
depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cube import Cube
from .functions import reducers as R
from .grid import Grid, View
from .operators import join, pixel
from .operators.geom import extract_geom, zonal_statistics
from .plans import codec
from .sinks.files import Packing
from .sources.catalog import Collection, create_collection, stac_collection
from .sources.images import raster_cube, stack_cube
from .sources.points import points_to_cube
from .sources.synthetic import dummy_cube

E_GRID = Grid.of({"left": 0, "right": 15, "bottom": 0, "top": 24, "t0": "2024-01-01", "t1": "2024-01-30"}, dx=1, dy=1, dt="P1D")
L_GRID = Grid.of({"left": 0, "right": 50, "bottom": 0, "top": 11, "t0": "1995-01", "t1": "2001-11"}, dx=1, dy=1, dt="P1M")


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cube_e(spark: SparkSession, d: str) -> Cube:
    return points_to_cube(read(spark, d, "events"), E_GRID, "ts", F.col("user_id") % 15 + 0.5, 23.5 - F.hour("ts"), {"value": ("mean", "value"), "n": ("count", "value")})


def cube_l(spark: SparkSession, d: str) -> Cube:
    rows = read(spark, d, "lineitem")
    bands = {"price": ("mean", "l_extendedprice"), "discount": ("mean", F.col("l_discount") + 0.0), "tax": ("mean", "l_tax")}
    return points_to_cube(rows, L_GRID, "l_shipdate", F.col("l_quantity") - 0.5, 10.5 - F.round(F.col("l_discount") * 100), bands)


def shown(cube: Cube) -> DataFrame:
    """Indices as long, bands rounded."""
    return cube.df.select(*[F.col(i).cast("long").alias(i) for i in ("it", "iy", "ix")], *[rounded(cube.band(b)).alias(b.replace(".", "_")) for b in cube.bands])


def rounded(c: Column) -> Column:
    return F.round(c.cast("double"), 6) + 0.0


E_SQL = """WITH c AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS it, hour(ts) AS iy, user_id % 15 AS ix,
  avg(value) AS value, CAST(count(value) AS DOUBLE) AS n FROM events WHERE ts >= '2024-01-01' AND ts < '2024-01-31' GROUP BY ALL),
p AS (SELECT DISTINCT iy, ix FROM c),
g AS (SELECT it, iy, ix FROM range(30) AS a(it), range(24) AS b(iy), range(15) AS x(ix)),
d AS (SELECT t.it, p.iy, p.ix, value, n FROM p CROSS JOIN range(30) AS t(it) LEFT JOIN c ON c.it = t.it AND c.iy = p.iy AND c.ix = p.ix)
"""
L_SQL = """WITH c AS (SELECT (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS it, CAST(round(l_discount * 100) AS BIGINT) AS iy,
  CAST(l_quantity AS BIGINT) - 1 AS ix, avg(l_extendedprice) AS price, avg(l_discount + 0.0) AS discount, avg(l_tax) AS tax
  FROM lineitem WHERE l_shipdate >= '1995-01-01' AND l_shipdate < '2001-12-01' GROUP BY ALL)
"""


def _sql(base: str, keys: str, bands: dict[str, str], rest: str) -> str:
    """Keys are expressions for it, iy and ix."""
    k = ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in zip(("it", "iy", "ix"), keys.split(";"), strict=True))
    return f"{base}SELECT {k}, {', '.join(f'round(CAST({e} AS DOUBLE), 6) + 0.0 AS {n}' for n, e in bands.items())} {rest}"


_AGG = {
    "min": "min({v})", "max": "max({v})", "mean": "avg({v})", "median": "median({v})", "sum": "sum({v})", "count": "count({v})", "prod": "product({v})", "var": "var_samp({v})", "sd": "stddev_samp({v})",
    "q1": "quantile_cont({v}, 0.25)", "q3": "quantile_cont({v}, 0.75)",
    "which_min": "CAST(strftime(DATE '2024-01-01' + CAST(arg_min(it, {{'v': {v}, 'it': it}}) AS INTEGER), '%Y%m%d') AS DOUBLE)",
    "which_max": "CAST(strftime(DATE '2024-01-01' + CAST(arg_max(it, {{'v': {v}, 'it': -it}}) AS INTEGER), '%Y%m%d') AS DOUBLE)",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


# ---------------------------------------------------------------- sources

_add("points_mean", lambda s, d: shown(cube_e(s, d)), _sql(E_SQL, "it;iy;ix", {"value": "value", "n": "n"}, "FROM c"))
_add("points_months", lambda s, d: shown(cube_l(s, d)), _sql(L_SQL, "it;iy;ix", {"price": "price", "discount": "discount", "tax": "tax"}, "FROM c"))
_add("dummy", lambda s, d: shown(dummy_cube(s, Grid.of({"left": 0, "right": 4, "bottom": 0, "top": 3, "t0": "2021-01-01", "t1": "2021-01-05"}, dx=1, dy=1, dt="P1D"), 2, 2.0)), "SELECT it, iy, ix, CAST(2 AS DOUBLE) AS band1, CAST(2 AS DOUBLE) AS band2 FROM range(5) AS a(it), range(3) AS b(iy), range(4) AS x(ix)")

# ---------------------------------------------------------------- reducers

# products of all values overflow doubles: they are taken of values near one
_NEAR_ONE = "(1 + value / 1000000)"
# a root is no short decimal, whose mean could be a tie when rounded
_ROOT = "sqrt(abs(value) / 7)"
for _r in R.REDUCE:
    _v = {"prod": _NEAR_ONE, "mean": _ROOT}.get(_r, "value")
    _add(
        f"rt_{_r}", lambda s, d, r=_r, v=_v: shown(cube_e(s, d).apply_pixel(v, "v").reduce_time(f"{r}(v)", names=["out"])),
        _sql(E_SQL, "0;iy;ix", {"out": _AGG[_r].format(v=_v)}, "FROM c GROUP BY iy, ix"),
    )
for _r in R.SPACE:
    _v = {"prod": _NEAR_ONE, "mean": _ROOT}.get(_r, "value")
    _add(
        f"rs_{_r}", lambda s, d, r=_r, v=_v: shown(cube_e(s, d).apply_pixel(v, "v").reduce_space(f"{r}(v)", names=["out"])),
        _sql(E_SQL, "it;0;0", {"out": _AGG[_r].format(v=_v)}, "FROM c GROUP BY it"),
    )
for _r in R.AGGREGATE:
    _p = {"prod": "(1 + price / 1000000000)", "var": "(price / 1000)", "sd": "(price / 1000)"}.get(_r, "price")
    _add(
        f"at_p3m_{_r}", lambda s, d, r=_r, v=_p: shown(cube_l(s, d).apply_pixel(v, "v").aggregate_time("P3M", r)),
        _sql(L_SQL, "it // 3;iy;ix", {"v": _AGG[_r].format(v=_p)}, "FROM c GROUP BY it // 3, iy, ix"),
    )
    _add(
        f"as_2x_{_r}", lambda s, d, r=_r, v=_p: shown(cube_l(s, d).apply_pixel(v, "v").aggregate_space(fact=2, method=r)),
        # eleven rows become six, and half a row is added on both sides
        _sql(L_SQL, "it;CAST(floor((iy + 1) / 2) AS BIGINT);ix // 2", {"v": _AGG[_r].format(v=_p)}, "FROM c GROUP BY it, CAST(floor((iy + 1) / 2) AS BIGINT), ix // 2"),
    )
_add("at_fact_year", lambda s, d: shown(cube_l(s, d).select_bands("price").aggregate_time(fact=12, method="sum")), _sql(L_SQL, "it // 12;iy;ix", {"price": "sum(price)"}, "FROM c GROUP BY it // 12, iy, ix"))

# ---------------------------------------------------------------- cells

_add("select_bands", lambda s, d: shown(cube_l(s, d).select_bands("tax", 1)), _sql(L_SQL, "it;iy;ix", {"tax": "tax", "price": "price"}, "FROM c"))
_add("rename_bands", lambda s, d: shown(cube_e(s, d).rename_bands(value="mean", n="size")), _sql(E_SQL, "it;iy;ix", {"mean": "value", "size": "n"}, "FROM c"))
_add(
    "apply_pixel", lambda s, d: shown(cube_l(s, d).apply_pixel(["(price - tax * 1000) / (price + tax * 1000)", "sqrt(price) * (discount > 0.045) + ix", "2 ^ iy % 7"], ["ratio", "root", "power"], keep_bands=True)),
    _sql(L_SQL, "it;iy;ix", {"price": "price", "discount": "discount", "tax": "tax", "ratio": "(price - tax * 1000) / (price + tax * 1000)", "root": "sqrt(price) * CAST(discount > 0.045 AS INTEGER) + ix", "power": "pow(2, iy) % 7"}, """FROM
    (SELECT t.it, y.iy, x.ix, price, discount, tax FROM range(83) AS t(it) CROSS JOIN range(11) AS y(iy) CROSS JOIN range(50) AS x(ix) LEFT JOIN c ON c.it = t.it AND c.iy = y.iy AND c.ix = x.ix)"""),
)
_add("apply_pixel_dims", lambda s, d: shown(cube_e(s, d).apply_pixel(["t0 / 86400", "left + right", "top - bottom"], ["day", "across", "high"])), _sql(E_SQL, "it;iy;ix", {"day": "19723 + it", "across": "2 * ix + 1", "high": "1"}, "FROM g"))
_add("filter_pixel", lambda s, d: shown(cube_e(s, d).filter_pixel("value > 40 && n <= 2 || n == 5")), _sql(E_SQL, "it;iy;ix", {"value": "value", "n": "n"}, "FROM c WHERE value > 40 AND n <= 2 OR n = 5"))
_add("mask_values", lambda s, d: shown(pixel.mask_bands(cube_e(s, d), "n", values=[1, 3])), _sql(E_SQL, "it;iy;ix", {"value": "value", "n": "n"}, "FROM c WHERE n NOT IN (1, 3)"))
_add("mask_range_inverted", lambda s, d: shown(pixel.mask_bands(cube_e(s, d), "n", min=2, max=4, invert=True)), _sql(E_SQL, "it;iy;ix", {"value": "value", "n": "n"}, "FROM c WHERE n BETWEEN 2 AND 4"))
_add("mask_bits", lambda s, d: shown(pixel.mask_bands(cube_e(s, d), "n", values=[2], bits=[0, 1])), _sql(E_SQL, "it;iy;ix", {"value": "value", "n": "n"}, "FROM c WHERE CAST(n AS BIGINT) & 3 <> 2"))

# ---------------------------------------------------------------- subsets

_BOX = {"left": 2.4, "right": 9.7, "bottom": 3.6, "top": 20.2, "t0": "2024-01-05", "t1": "2024-01-20"}
for _snap, (_x0, _x1, _y0, _y1) in {"near": (2, 9, 4, 19), "in": (3, 8, 4, 19), "out": (2, 9, 3, 20)}.items():
    _add(
        f"crop_snap_{_snap}", lambda s, d, snap=_snap: shown(cube_e(s, d).crop(_BOX, snap=snap)),
        _sql(E_SQL, f"it - 4;iy - {_y0};ix - {_x0}", {"value": "value", "n": "n"}, f"FROM c WHERE it BETWEEN 4 AND 19 AND iy BETWEEN {_y0} AND {_y1} AND ix BETWEEN {_x0} AND {_x1}"),
    )
_add("slice_time", lambda s, d: shown(cube_e(s, d).slice_time("2024-01-11")), _sql(E_SQL, "0;iy;ix", {"value": "value", "n": "n"}, "FROM c WHERE it = 10"))
_add("slice_space", lambda s, d: shown(cube_e(s, d).slice_space(loc=(3.2, 10.9))), _sql(E_SQL, "it;0;0", {"value": "value", "n": "n"}, "FROM c WHERE ix = 3 AND iy = 13"))
_add("select_time", lambda s, d: shown(cube_e(s, d).select_time(["2024-01-20", "2024-01-03", "2024-01-04"])), _sql(E_SQL, "CASE it WHEN 19 THEN 0 WHEN 2 THEN 1 ELSE 2 END;iy;ix", {"value": "value", "n": "n"}, "FROM c WHERE it IN (19, 2, 3)"))
_add("getitem", lambda s, d: shown(cube_e(s, d)["value", "2024-01-08", 3:9, (2, 6)]), _sql(E_SQL, "0;iy - 3;ix - 2", {"value": "value"}, "FROM c WHERE it = 7 AND iy BETWEEN 3 AND 8 AND ix BETWEEN 2 AND 6"))

# ---------------------------------------------------------------- windows and gaps

_FRAME = "OVER (PARTITION BY iy, ix ORDER BY it ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)"
for _r in R.WINDOW_TIME:
    _w = {"sum": f"coalesce(sum(value) {_FRAME}, 0)", "prod": f"coalesce(product(1 + value / 1000000) {_FRAME}, 1)"}.get(_r, _AGG[_r].format(v="value") + f" {_FRAME}")
    _add(
        f"wt_{_r}", lambda s, d, r=_r: shown((cube_e(s, d).apply_pixel("1 + value / 1000000", "value") if r == "prod" else cube_e(s, d)).window_time(f"{r}(value)", window=(2, 1))),
        _sql(E_SQL, "it;iy;ix", {f"value_{_r}": _w}, "FROM d"),
    )
_add("wt_kernel", lambda s, d: shown(cube_e(s, d).select_bands("value").window_time(kernel=[0.25, 0.5, 0.25])), _sql(E_SQL, "it;iy;ix", {"value": "0.25 * lag(value) OVER w + 0.5 * value + 0.25 * lead(value) OVER w"}, "FROM d WINDOW w AS (PARTITION BY iy, ix ORDER BY it)"))
_NEAR = "FROM g JOIN c ON c.it = g.it AND abs(c.iy - g.iy) <= 1 AND abs(c.ix - g.ix) <= 1 GROUP BY g.it, g.iy, g.ix"
for _r in R.WINDOW_SPACE:
    _v = _NEAR_ONE if _r == "prod" else _ROOT
    _w = {"sum": f"coalesce(sum({_v}), 0)", "prod": f"coalesce(product({_v}), 1)"}.get(_r, _AGG[_r].format(v=_v))
    _left = _NEAR.replace("JOIN c", "LEFT JOIN c") if _r in ("sum", "count", "prod") else _NEAR
    _add(
        f"ws_{_r}", lambda s, d, r=_r, v=_v: shown(cube_e(s, d).apply_pixel(v, "value").window_space(f"{r}(value)", window=(3, 3))),
        _sql(E_SQL, "g.it;g.iy;g.ix", {f"value_{_r}": _w}, _left),
    )
for _r in ("max", "sum", "count", "mean"):
    # a window of 15 cells goes by rows and columns
    _w = f"coalesce(sum({_ROOT}), 0)" if _r == "sum" else _AGG[_r].format(v=_ROOT)
    _wide = _NEAR.replace("abs(c.iy - g.iy) <= 1", "abs(c.iy - g.iy) <= 2").replace("JOIN c", "LEFT JOIN c" if _r in ("sum", "count") else "JOIN c")
    _add(
        f"ws_wide_{_r}", lambda s, d, r=_r: shown(cube_e(s, d).apply_pixel(_ROOT, "value").window_space(f"{r}(value)", window=(5, 3))),
        _sql(E_SQL, "g.it;g.iy;g.ix", {f"value_{_r}": _w}, _wide),
    )


def _folded(pad: str) -> str:
    """The cells of 3 by 3 windows of cube L's prices, those outside by a padding."""
    fold = {"REPLICATE": "least(greatest({i}, 0), {n} - 1)", "REFLECT": "CASE WHEN {i} < 0 THEN -1 - {i} WHEN {i} >= {n} THEN 2 * {n} - 1 - {i} ELSE {i} END", "REFLECT_PIXEL": "CASE WHEN {i} < 0 THEN -{i} WHEN {i} >= {n} THEN 2 * {n} - 2 - {i} ELSE {i} END"}[pad]
    y, x = fold.format(i="(g.iy + o.a)", n=11), fold.format(i="(g.ix + q.b)", n=50)
    return f""", g AS (SELECT it, iy, ix FROM range(83) AS t(it), range(11) AS y(iy), range(50) AS x(ix)),
w AS (SELECT g.it, g.iy, g.ix, o.a, q.b, {y} AS cy, {x} AS cx FROM g, range(-1, 2) AS o(a), range(-1, 2) AS q(b)),
k AS (SELECT w.it, w.iy, w.ix, w.a, w.b, c.price FROM w JOIN c ON c.it = w.it AND c.iy = w.cy AND c.ix = w.cx)
"""


_KERNEL = [[1, 2, 1], [2, 4, 2], [1, 2, 3]]
_WEIGHT = "CASE WHEN a = 1 AND b = 1 THEN 3 ELSE (2 - abs(a)) * (2 - abs(b)) END"
for _pad in ("REPLICATE", "REFLECT", "REFLECT_PIXEL"):
    _add(
        f"ws_kernel_{_pad.lower()}", lambda s, d, pad=_pad: shown(cube_l(s, d).select_bands("price").window_space(kernel=_KERNEL, pad=pad)),
        _sql(L_SQL + _folded(_pad), "it;iy;ix", {"price": f"CASE WHEN count(price) = 9 THEN sum(price * ({_WEIGHT})) END"}, "FROM k GROUP BY it, iy, ix"),
    )
    _add(
        f"ws_padded_{_pad.lower()}", lambda s, d, pad=_pad: shown(cube_l(s, d).window_space("max(price)", "min(price)", window=(3, 3), pad=pad)),
        _sql(L_SQL + _folded(_pad), "it;iy;ix", {"price_max": "max(price)", "price_min": "min(price)"}, "FROM k GROUP BY it, iy, ix"),
    )
_add(
    "ws_kernel_constant", lambda s, d: shown(cube_l(s, d).select_bands("price").window_space(kernel=_KERNEL, pad=10)),
    _sql(L_SQL + """, g AS (SELECT it, iy, ix FROM range(83) AS t(it), range(11) AS y(iy), range(50) AS x(ix)),
    w AS (SELECT g.it, g.iy, g.ix, o.a, q.b, g.iy + o.a AS cy, g.ix + q.b AS cx FROM g, range(-1, 2) AS o(a), range(-1, 2) AS q(b)),
    k AS (SELECT w.it, w.iy, w.ix, w.a, w.b, c.it AS hit, CASE WHEN cy BETWEEN 0 AND 10 AND cx BETWEEN 0 AND 49 THEN price ELSE 10 END AS price FROM w LEFT JOIN c ON c.it = w.it AND c.iy = w.cy AND c.ix = w.cx)
    """, "it;iy;ix", {"price": f"CASE WHEN count(price) = 9 THEN sum(price * ({_WEIGHT})) END"}, "FROM k GROUP BY it, iy, ix HAVING count(hit) > 0"),
)
_SIDES = """, f AS (SELECT it, iy, ix, value, last_value(value IGNORE NULLS) OVER b AS a, last_value(CASE WHEN value IS NOT NULL THEN it END IGNORE NULLS) OVER b AS ia,
  first_value(value IGNORE NULLS) OVER n AS z, first_value(CASE WHEN value IS NOT NULL THEN it END IGNORE NULLS) OVER n AS iz FROM d
  WINDOW b AS (PARTITION BY iy, ix ORDER BY it ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY iy, ix ORDER BY it ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""
for _m, _f in {
    "locf": "a", "nocb": "z", "near": "CASE WHEN a IS NULL THEN z WHEN z IS NULL THEN a WHEN it - ia <= iz - it THEN a ELSE z END",
    "linear": "CASE WHEN a IS NULL THEN z WHEN z IS NULL THEN a WHEN iz = ia THEN value ELSE a + (z - a) * (it - ia) / (iz - ia) END",
}.items():
    _add(f"fill_{_m}", lambda s, d, m=_m: shown(cube_e(s, d).select_bands("value").fill_time(m)), _sql(E_SQL + _SIDES, "it;iy;ix", {"value": _f}, "FROM f"))

# ---------------------------------------------------------------- joins and geometry

_add(
    "join_bands", lambda s, d: shown(join.join_bands({"a": cube_e(s, d).filter_pixel("value > 30"), "b": cube_e(s, d).filter_pixel("n > 1").select_bands("n")})),
    _sql(E_SQL, "it;iy;ix", {"a_value": "CASE WHEN value > 30 THEN value END", "a_n": "CASE WHEN value > 30 THEN n END", "b_n": "CASE WHEN n > 1 THEN n END"}, "FROM c WHERE value > 30 OR n > 1"),
)
_TRIANGLE = [[(1.2, 2.0), (13.9, 4.1), (6.3, 22.5)]]
_IN_TRIANGLE = """((1.2 - (ix + 0.5)) * (4.1 - 2.0) - (2.0 - (23.5 - iy)) * (13.9 - 1.2)) >= 0 AND ((13.9 - (ix + 0.5)) * (22.5 - 4.1) - (4.1 - (23.5 - iy)) * (6.3 - 13.9)) >= 0
  AND ((6.3 - (ix + 0.5)) * (2.0 - 22.5) - (22.5 - (23.5 - iy)) * (1.2 - 6.3)) >= 0"""
_add("filter_geom", lambda s, d: shown(cube_e(s, d).filter_geom(_TRIANGLE)), _sql(E_SQL, "it;iy;ix", {"value": "value", "n": "n"}, f"FROM c WHERE {_IN_TRIANGLE}"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    """Nations as points, boxes and times."""
    n = read(spark, d, "nation")
    k = F.col("n_nationkey")
    x, y = k % 14 + 0.3, k % 23 + 0.4
    at = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    box = F.array(at(x, y), at(x + 3, y), at(x + 3, y + 2), at(x, y + 2))
    return n.select(k.cast("int").alias("fid"), F.when(k % 2 == 0, "POINT").otherwise("POLYGON").alias("geom_type"), F.when(k % 2 == 0, F.array(F.array(at(x, y)))).otherwise(F.array(box)).alias("rings"), F.date_format(F.date_add(F.lit("2024-01-02").cast("date"), k % 25), "yyyy-MM-dd").alias("day"))


_CELLS = """, f AS (SELECT n_nationkey AS fid, n_nationkey % 14 + 0.3 AS x, n_nationkey % 23 + 0.4 AS y, DATE '2024-01-02' + CAST(n_nationkey % 25 AS INTEGER) AS day FROM nation),
h AS (SELECT fid, day, iy, ix FROM f, (SELECT DISTINCT iy, ix FROM g) WHERE fid % 2 = 0 AND ix = CAST(floor(x) AS BIGINT) AND iy = CAST(floor(24 - y) AS BIGINT)
  OR fid % 2 = 1 AND ix + 0.5 BETWEEN x AND x + 3 AND 23.5 - iy BETWEEN y AND y + 2)
"""
_add(
    "extract_geom", lambda s, d: extract_geom(cube_e(s, d), _features(s, d)).select(F.col("FID").cast("long").alias("FID"), "time", rounded(F.col("value")).alias("value"), F.col("n")),
    f"{E_SQL}{_CELLS}SELECT CAST(fid AS BIGINT) AS FID, strftime(DATE '2024-01-01' + CAST(it AS INTEGER), '%Y-%m-%d') AS time, round(value, 6) AS value, n FROM h JOIN c USING (iy, ix)",
)
_add(
    "extract_geom_time", lambda s, d: extract_geom(cube_e(s, d), _features(s, d), time_column="day").select(F.col("FID").cast("long").alias("FID"), "time", rounded(F.col("value")).alias("value")),
    f"{E_SQL}{_CELLS}SELECT CAST(fid AS BIGINT) AS FID, strftime(day, '%Y-%m-%d') AS time, round(value, 6) AS value FROM h JOIN c ON c.iy = h.iy AND c.ix = h.ix AND it = date_diff('day', DATE '2024-01-01', day)",
)
_add(
    "zonal_statistics", lambda s, d: zonal_statistics(cube_e(s, d), _features(s, d), ["mean", "max", "count"], reduce_time=True).select(F.col("FID").cast("long").alias("FID"), *[rounded(F.col(f"value_{r}")).alias(r) for r in ("mean", "max", "count")]),
    f"{E_SQL}{_CELLS}SELECT CAST(fid AS BIGINT) AS FID, round(avg(value), 6) AS mean, round(max(value), 6) AS max, CAST(count(value) AS DOUBLE) AS count FROM h JOIN c USING (iy, ix) GROUP BY fid",
)

# ---------------------------------------------------------------- images

I_GRID = Grid.of({"left": 0, "right": 10, "bottom": 0, "top": 5, "t0": "1995-01", "t1": "2001-12"}, dx=1, dy=1, dt="P3M")


def _month() -> Column:
    """Months from 1995 on, 1 for its January."""
    return (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")


def _catalogue(spark: SparkSession, d: str) -> Collection:
    """Orders by month and customer modulo 7 as images."""
    o = read(spark, d, "orders")
    images = o.groupBy((_month() * 7 + F.col("o_custkey") % 7).cast("int").alias("id")).agg(F.date_format(F.date_trunc("month", F.min("o_orderdate")), "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"))
    images = images.selectExpr("id", "concat('image', id) AS name", "0D AS left", "5D AS top", "0D AS bottom", "10D AS right", "datetime", "'EPSG:4326' AS proj")
    refs = images.selectExpr("id AS image_id", "1 AS band_id", "name AS descriptor", "1 AS band_num").union(images.selectExpr("id", "2", "name", "2"))
    return Collection.of(spark, images=images, gdalrefs=refs, bands=[(1, "total", "float64", 0.0, 1.0, "", "-1"), (2, "quality", "uint8", 0.0, 1.0, "", "")])


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """A pixel for each customer of an image: the root of the largest order, and the day of the last as quality."""
    o = read(spark, d, "orders")
    k = F.col("o_custkey")
    g = o.groupBy((_month() * 7 + k % 7).cast("int").alias("image_id"), k.alias("k")).agg(F.sqrt(F.max("o_totalprice") / 7).alias("total"), F.max(F.dayofmonth("o_orderdate")).cast("double").alias("quality"))
    x, y = F.col("k") % 97 / 9.7, F.col("k") % 49 / 9.8
    return g.select("image_id", x.alias("x"), y.alias("y"), F.explode(F.array(F.struct(F.lit("total").alias("b"), F.col("total").alias("v")), F.struct(F.lit("quality").alias("b"), F.col("quality").alias("v")))).alias("p")).select("image_id", F.col("p.b").alias("band_name"), "x", "y", F.col("p.v").alias("value"))


_I_MONTH = "(year(o_orderdate) - 1995) * 12 + month(o_orderdate)"
_I_SQL = f"""WITH o AS (SELECT ({_I_MONTH}) * 7 + o_custkey % 7 AS id, o_custkey AS k, min({_I_MONTH}) AS m, sqrt(max(o_totalprice) / 7) AS total, CAST(max(day(o_orderdate)) AS DOUBLE) AS quality
  FROM orders GROUP BY 1, 2),
p AS (SELECT (m - 1) // 3 AS it, id, (k % 97) / 9.7 AS px, (k % 49) / 9.8 AS py, 5 - (k % 49) / 9.8 AS fy, total, quality, k FROM o),
r AS (SELECT it, id, px, py, CAST(floor(px) AS BIGINT) AS ix, CAST(floor(fy) AS BIGINT) AS iy, pow(px - 0.5 - floor(px), 2) + pow(fy - 0.5 - floor(fy), 2) AS d, total, quality, k FROM p),
v AS (SELECT it, iy, ix, id, avg(total) AS total FROM r WHERE iy BETWEEN 0 AND 4 AND ix BETWEEN 0 AND 9 GROUP BY ALL)
"""
_COMPOSE = {"first": "arg_min(total, id)", "last": "arg_max(total, id)", "min": "min(total)", "max": "max(total)", "mean": "avg(total)", "median": "median(total)", "count_values": "count(total)", "count_images": "count(DISTINCT id)", "none": "arg_max(total, id)"}
for _m, _f in _COMPOSE.items():
    _add(
        f"composite_{_m}", lambda s, d, m=_m: shown(raster_cube(_catalogue(s, d), _pixels(s, d), View(I_GRID, m, "average"), bands=["total"])),
        _sql(_I_SQL, "it;iy;ix", {"total": _f}, "FROM v GROUP BY it, iy, ix"),
    )
for _m, _f in {"max": "max(total)", "min": "min(total)", "med": "median(total)", "q1": "quantile_cont(total, 0.25)", "q3": "quantile_cont(total, 0.75)"}.items():
    _add(
        f"resample_{_m}", lambda s, d, m=_m: shown(raster_cube(_catalogue(s, d), _pixels(s, d), View(I_GRID, "mean", m), bands=["total"])),
        _sql(_I_SQL.replace("avg(total)", _f), "it;iy;ix", {"total": "avg(total)"}, "FROM v GROUP BY it, iy, ix"),
    )
_NEAR = "arg_min({0}, {{'d': d, 'px': px, 'py': py, 'v': {0}}})"
for _m in ("bilinear", "cubic", "cubicspline", "lanczos"):
    _add(f"resample_{_m}", lambda s, d, m=_m: shown(raster_cube(_catalogue(s, d), _pixels(s, d), View(I_GRID, "mean", m), bands=["total"])))
_add(
    "resample_near", lambda s, d: shown(raster_cube(_catalogue(s, d), _pixels(s, d), View(I_GRID, "mean", "near"), bands=["total"])),
    _sql(_I_SQL.replace("avg(total)", _NEAR.format("total")), "it;iy;ix", {"total": "avg(total)"}, "FROM v GROUP BY it, iy, ix"),
)
_add(
    "resample_mode", lambda s, d: shown(raster_cube(_catalogue(s, d), _pixels(s, d), View(I_GRID, "mean", "mode"), bands=["quality"])),
    _sql(
        _I_SQL + ", n AS (SELECT it, iy, ix, id, quality, count(*) AS n FROM r WHERE iy BETWEEN 0 AND 4 AND ix BETWEEN 0 AND 9 GROUP BY ALL), "
        "w AS (SELECT it, iy, ix, id, arg_min(quality, {'n': -n, 'v': quality}) AS quality FROM n GROUP BY ALL) ",
        "it;iy;ix", {"quality": "avg(quality)"}, "FROM w GROUP BY it, iy, ix",
    ),
)
_add(
    "image_mask", lambda s, d: shown(raster_cube(_catalogue(s, d), _pixels(s, d), View(I_GRID, "max", "average"), mask={"band": "quality", "min": 10, "max": 20})),
    _sql(_I_SQL.replace("avg(total)", f"avg(total) AS total, {_NEAR.format('quality')} AS quality").replace("AS quality AS total", "AS quality"), "it;iy;ix", {"total": "max(CASE WHEN quality BETWEEN 10 AND 20 THEN NULL ELSE total END)"}, "FROM v GROUP BY it, iy, ix"),
)
_add(
    "collection_range_query", lambda s, d: _catalogue(s, d).range_query(0, 4, 0, 4, "1995-03-01", "1995-05", ["total"]).selectExpr("CAST(image_id AS BIGINT) AS image_id", "descriptor", "datetime"),
    f"SELECT DISTINCT ({_I_MONTH}) * 7 + o_custkey % 7 AS image_id, 'image' || (({_I_MONTH}) * 7 + o_custkey % 7) AS descriptor, strftime(date_trunc('month', o_orderdate), '%Y-%m-%dT%H:%M:%S') AS datetime FROM orders WHERE o_orderdate >= '1995-03-01' AND o_orderdate < '1995-06-01'",
)


def _files(spark: SparkSession, d: str) -> DataFrame:
    path = F.format_string("/data/scene%03d_%s_%s.tif", F.col("c"), F.date_format("o_orderdate", "yyyyMMdd"), F.col("b"))
    # of each day of a scene, before its paths are written: many orders share one
    o = read(spark, d, "orders").select((F.col("o_custkey") % 200).alias("c"), F.col("o_orderdate").cast("date").alias("o_orderdate")).distinct()
    return o.withColumn("b", F.explode(F.array(F.lit("red"), F.lit("nir"), F.lit("txt")))).select(path.alias("path")).distinct()


_FORMAT = {"pattern": r".*\.tif", "images": {"pattern": r".*/(.+)_[a-z]+\.tif"}, "datetime": {"pattern": r".*_([0-9]{8})_.*", "format": "%Y%m%d"}, "bands": {"red": {"pattern": r".*_red\.tif"}, "nir": {"pattern": r".*_nir\.tif"}}}
_NAME = "format('scene{:03d}_{}', o_custkey % 200, strftime(o_orderdate, '%Y%m%d'))"


def _format_query(spark: SparkSession, d: str) -> DataFrame:
    c = create_collection(_files(spark, d), _FORMAT)
    return c.images.join(c.gdalrefs, F.col("id") == F.col("image_id")).groupBy("name", "datetime").agg(F.count_distinct("band_id").alias("bands"), F.max("descriptor").alias("descriptor"))


_add("collection_format", _format_query, f"SELECT DISTINCT {_NAME} AS name, strftime(date_trunc('day', o_orderdate), '%Y-%m-%dT%H:%M:%S') AS datetime, CAST(2 AS BIGINT) AS bands, '/data/' || {_NAME} || '_red.tif' AS descriptor FROM orders")


def _stac(spark: SparkSession, d: str) -> DataFrame:
    text = """concat('{"id":"i', s_suppkey, '","bbox":[', s_suppkey % 90, ',1,', s_suppkey % 90 + 2, ',4],"properties":{"datetime":"2021-03-0', s_suppkey % 9 + 1, 'T10:00:00Z","eo:cloud_cover":"', s_suppkey % 100,
    '","proj:epsg":"32632"},"assets":{"B02":{"href":"s3://bucket/', s_suppkey, '/B02.tif"},"B03":{"href":"https://host/', s_suppkey, '/B03.tif"}}}')"""
    c = stac_collection(read(spark, d, "supplier").select(F.expr(text).alias("item")), property_filter=lambda p: p["eo:cloud_cover"].cast("int") < 40)
    bands = c.bands.select(F.col("id").alias("band_id"), F.col("name").alias("band"))
    return c.images.join(c.gdalrefs, F.col("id") == F.col("image_id")).join(bands, "band_id").select("name", "left", "right", "datetime", "proj", "band", "descriptor")


_add("stac_collection", _stac, """SELECT 'i' || s_suppkey AS name, CAST(s_suppkey % 90 AS DOUBLE) AS left, CAST(s_suppkey % 90 + 2 AS DOUBLE) AS right, '2021-03-0' || (s_suppkey % 9 + 1) || 'T10:00:00' AS datetime,
  'EPSG:32632' AS proj, b AS band, CASE b WHEN 'B02' THEN '/vsis3/bucket/' ELSE '/vsicurl/https://host/' END || s_suppkey || '/' || b || '.tif' AS descriptor
  FROM supplier, (VALUES ('B02'), ('B03')) AS x(b) WHERE s_suppkey % 100 < 40""")


def _stack(spark: SparkSession, d: str) -> DataFrame:
    e = cube_e(spark, d)
    return shown(stack_cube([(t, e.slice_time(t).df.select("iy", "ix", "value", "n")) for t in ("2024-01-09", "2024-01-02")], E_GRID, ["value", "n"]))


_add("stack_cube", _stack, _sql(E_SQL, "CASE it WHEN 1 THEN 0 ELSE 1 END;iy;ix", {"value": "value", "n": "n"}, "FROM c WHERE it IN (1, 8)"))

# ---------------------------------------------------------------- user functions, plans and files

_add("udf_apply_pixel", lambda s, d: shown(cube_e(s, d).apply_pixel(lambda v: [v["value"] * 2 + v["n"]], ["out"], by_batch=True)), _sql(E_SQL, "it;iy;ix", {"out": "value * 2 + n"}, "FROM c"))
_add("udf_reduce_time", lambda s, d: shown(cube_e(s, d).reduce_time(fun=lambda x: [np.nanmax(x[0]) - np.nanmin(x[0])], names=["range"])), _sql(E_SQL, "0;iy;ix", {"range": "max(value) - min(value)"}, "FROM c GROUP BY iy, ix"))
_add("udf_reduce_space", lambda s, d: shown(cube_e(s, d).reduce_space(fun=lambda x: [np.nansum(x[1])], names=["n"])), _sql(E_SQL, "it;0;0", {"n": "sum(n)"}, "FROM c GROUP BY it"))
_add("udf_apply_time", lambda s, d: shown(cube_e(s, d).apply_time(lambda x: np.nancumsum(x[1:2], axis=1), ["n"])), _sql(E_SQL, "it;iy;ix", {"n": "coalesce(sum(n) OVER (PARTITION BY iy, ix ORDER BY it), 0)"}, "FROM d"))
_add("udf_chunk_apply", lambda s, d: shown(cube_e(s, d).chunk_apply(lambda x: np.nan_to_num(x[:1], nan=-1.0), ["value"], (30, 8, 8))), _sql(E_SQL, "g.it;g.iy;g.ix", {"value": "coalesce(value, -1)"}, "FROM g LEFT JOIN c ON c.it = g.it AND c.iy = g.iy AND c.ix = g.ix"))
_add("predict", lambda s, d: shown(cube_e(s, d).predict(lambda x: 3 * x["value"] - x["n"], ["_score"])), _sql(E_SQL, "it;iy;ix", {"X_score": "3 * value - n"}, "FROM c"))


def _rebuilt(spark: SparkSession, d: str) -> DataFrame:
    c = cube_e(spark, d).filter_pixel("value > 10").aggregate_time("P7D", "sum").reduce_time("max(value)")
    return shown(codec.from_json(spark, codec.to_json(c), {"points": lambda node: cube_e(spark, d)}))


def _from_plan(spark: SparkSession, d: str) -> DataFrame:
    """A cube of events, made by its plan alone."""
    path = f"{d}/events.parquet"
    c = points_to_cube(read(spark, d, "events"), E_GRID, "ts", "user_id % 15 + 0.5", "23.5 - hour(ts)", {"value": ("mean", "value"), "n": ("count", "value")}, path=path)
    return shown(codec.from_json(spark, codec.to_json(c.apply_pixel("value * n", "total").reduce_time("max(total)"))))


_add("plan_alone", _from_plan, _sql(E_SQL, "0;iy;ix", {"total_max": "max(value * n)"}, "FROM c GROUP BY iy, ix"))
_add("plan_rebuilt", _rebuilt, _sql(E_SQL, "0;iy;ix", {"value_max": "max(value)"}, "FROM (SELECT iy, ix, it // 7, sum(value) AS value FROM c WHERE value > 10 GROUP BY ALL) GROUP BY iy, ix"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    c, p = cube_e(spark, d), Packing("uint16", 0.01, -100.0, 65535)
    v = p.pack(c.band("value"))
    return c.df.select(F.col("it").cast("long").alias("it"), F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), v.cast("long").alias("stored"), rounded(p.unpack(v)).alias("value"))


_add("packing", _packed, f"{E_SQL}SELECT CAST(it AS BIGINT) AS it, CAST(iy AS BIGINT) AS iy, CAST(ix AS BIGINT) AS ix, CAST(round((value + 100) / 0.01) AS BIGINT) AS stored, round(round((value + 100) / 0.01) * 0.01 - 100, 6) AS value FROM c")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Points to a cube, a predicate on its cells, and statistics over time."""
    return shown(cube_e(spark, d).filter_pixel("value > 10").reduce_time("sum(value)", "median(value)", "q3(value)", "sd(value)", "which_min(value)"))


_add("flagship", flagship, _sql(E_SQL, "0;iy;ix", {f"value_{r}": _AGG[r].format(v="value") for r in ("sum", "median", "q3", "sd", "which_min")}, "FROM c WHERE value > 10 GROUP BY iy, ix"))
