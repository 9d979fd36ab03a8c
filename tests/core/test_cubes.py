import numpy as np
import pytest

from gridloom import Grid
from gridloom.operators import join, pixel
from gridloom.plans import codec
from gridloom.sinks import files
from gridloom.sources.synthetic import dummy_cube, empty_cube


def grid(nx=5, ny=5, t0="2021-01-01", t1="2021-12-31", dt="P1M"):
    return Grid.of({"left": 0, "right": nx, "bottom": 0, "top": ny, "t0": t0, "t1": t1}, dx=1, dy=1, dt=dt)


def from_array(spark, x, dt="P1D"):
    """A cube of (band, t, y, x); NaN is a cell without a value."""
    b, nt, ny, nx = x.shape
    g = Grid.of({"left": 0, "right": nx, "bottom": 0, "top": ny, "t0": "2021-01-01", "t1": f"2021-01-{nt:02d}"}, dx=1, dy=1, dt=dt)
    names = [f"b{i + 1}" for i in range(b)]
    rows = [(t, y, c, *[None if np.isnan(v) else float(v) for v in x[:, t, y, c]]) for t in range(nt) for y in range(ny) for c in range(nx) if not np.isnan(x[:, t, y, c]).all()]
    from gridloom import Cube
    from gridloom.cube import cell_schema

    return Cube.make(spark.createDataFrame(rows, cell_schema(names)), g, names, {"cube_type": "given"})


def sample(nt=6, ny=5, nx=4, seed=1, gaps=0.3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(1, nt, ny, nx)).round(3)
    x[r.random(x.shape) < gaps] = np.nan
    return x


def test_aggregate_space_counts_cells(spark):
    want = np.array([[1, 2, 2], [2, 4, 4], [2, 4, 4]])
    for method in ("sum", "count"):
        got = files.as_array(dummy_cube(spark, grid(t1="2021-01-31")).aggregate_space(2, 2, method))
        assert (got[0, 0] == want).all() or (got[0, 0][::-1, ::-1] == want).all()


def test_constant_cubes(spark):
    c = dummy_cube(spark, grid(), 1, 2.0).aggregate_space(fact=5, method="var")
    assert (files.as_array(c) == 0).all()
    m = files.as_array(dummy_cube(spark, grid(1, 1, dt="P1D")).aggregate_time("P1M", "sum"))[0, :, 0, 0]
    assert m.tolist() == [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    assert dummy_cube(spark, grid(1, 1, dt="P1D")).aggregate_time("P5D").nt == 73 == dummy_cube(spark, grid(1, 1, dt="P1D")).aggregate_time(fact=5).nt
    assert empty_cube(spark, grid()).aggregate_time("P3M", "sum").df.count() == 0


def test_reduce(spark):
    x = sample()
    c = from_array(spark, x)
    got = files.as_array(c.reduce_time("sum(b1)", "count(b1)", "q1(b1)", "which_max(b1)", "median(b1)", "prod(b1)"))
    some = ~np.isnan(x[0]).all(0)
    assert np.allclose(got[0, 0][some], np.nansum(x[0], 0)[some])
    assert np.allclose(got[2, 0][some], np.nanquantile(x[0], 0.25, axis=0)[some])
    assert np.allclose(got[3, 0][some], 20210101 + np.nanargmax(np.where(np.isnan(x[0]), -9e9, x[0]), 0)[some])
    assert np.allclose(files.as_array(c.reduce_space("mean(b1)"))[0, :, 0, 0], np.nanmean(x[0], axis=(1, 2)))
    once = c.reduce_time("max(b1)")
    assert once.reduce_time("max(b1_max)").bands == ("b1_max",) and once.nt == 1
    with pytest.raises(ValueError):
        c.reduce_time("nonsense(b1)")


def test_windows_in_time(spark):
    x = sample(nt=8)
    c = from_array(spark, x)
    got = files.as_array(c.window_time("mean(b1)", "sum(b1)", "median(b1)", window=(2, 1)))
    for t in range(8):
        w = x[0, max(0, t - 2) : t + 2]
        some = ~np.isnan(x[0]).all(0)
        assert np.allclose(got[1, t][some], np.nansum(w, 0)[some])
        with np.errstate(all="ignore"):
            assert np.allclose(got[2, t], np.nanmedian(w, 0), equal_nan=True)
    k = files.as_array(c.window_time(kernel=[1, 2, 3]))
    want = np.full(x[0].shape, np.nan)
    want[1:-1] = x[0, :-2] + 2 * x[0, 1:-1] + 3 * x[0, 2:]
    assert np.allclose(k[0], want, equal_nan=True)


@pytest.mark.parametrize(("pad", "mode"), [("REPLICATE", "edge"), ("REFLECT", "symmetric"), ("REFLECT_PIXEL", "reflect"), (7, "constant")])
def test_padding(spark, pad, mode):
    x = sample(nt=2, ny=5, nx=4, gaps=0.05)
    kernel = np.arange(15, dtype=float).reshape(5, 3)
    p = np.pad(x[0], ((0, 0), (2, 2), (1, 1)), mode=mode, **({"constant_values": 7} if mode == "constant" else {}))
    want = np.array([[[(kernel * p[t, i : i + 5, j : j + 3]).sum() for j in range(4)] for i in range(5)] for t in range(2)])
    c = from_array(spark, x)
    assert np.allclose(files.as_array(c.window_space(kernel=kernel.tolist(), pad=pad))[0], want, equal_nan=True)
    means = np.array([[[np.nanmean(p[t, i : i + 5, j : j + 3]) for j in range(4)] for i in range(5)] for t in range(2)])
    assert np.allclose(files.as_array(c.window_space("mean(b1)", window=(5, 3), pad=pad))[0], means)


def test_windows_in_space_count(spark):
    want = np.full((10, 10), 9.0)
    want[[0, -1]], want[:, [0, -1]] = 6, 6
    for i in (0, -1):
        for j in (0, -1):
            want[i, j] = 4
    c = dummy_cube(spark, grid(10, 10, dt="P365D"))
    assert (files.as_array(c.window_space("count(band1)", window=(3, 3)))[0, 0] == want).all()
    assert (files.as_array(c.window_space(kernel=[[1] * 3] * 3, pad=0))[0, 0] == want).all()
    assert (files.as_array(c.window_space(kernel=[[1] * 3] * 3, pad="REFLECT"))[0, 0] == 9).all()
    kept = c.window_space("max(band1)", window=(3, 3), keep_bands=True)
    assert kept.bands == ("band1", "band1_max")


def test_fill(spark):
    x = np.array([np.nan, 1, np.nan, np.nan, np.nan, 5, np.nan]).reshape(1, 7, 1, 1)
    c = from_array(spark, x)
    want = {"locf": [np.nan, 1, 1, 1, 1, 5, 5], "nocb": [1, 1, 5, 5, 5, 5, np.nan], "near": [1, 1, 1, 1, 5, 5, 5], "linear": [1, 1, 2, 3, 4, 5, 5]}
    for method, values in want.items():
        assert np.allclose(files.as_array(c.fill_time(method)).ravel(), values, equal_nan=True), method


def test_cells(spark):
    c = dummy_cube(spark, grid(), 3)
    got = files.as_array(c.apply_pixel(["band1 + 2 * band2", "ix", "sqrt(4) + cos(pi)", "band1 / 0", "!(band1 > 2) && band2 == 1"], list("abcde")))
    assert (got[0] == 3).all() and (got[1, 0, 0] == np.arange(5)).all() and np.allclose(got[2], 1) and np.isnan(got[3]).all() and (got[4] == 1).all()
    assert c.apply_pixel("band1", keep_bands=False).bands == ("band1",)
    assert c.rename_bands(band1="x").bands == ("x", "band2", "band3") and c.select_bands(3, "band1").bands == ("band3", "band1")
    with pytest.raises(ValueError):
        c.select_bands("x")
    with pytest.raises(ValueError):
        c.apply_pixel("system(1)")
    assert c.filter_pixel("band1 > 1").df.count() == 0
    masked = pixel.mask_bands(c.apply_pixel("ix", "q", keep_bands=True), "q", values=[1, 2], invert=True)
    assert {r["ix"] for r in masked.df.collect()} == {1, 2}


def test_subsets(spark):
    c = dummy_cube(spark, grid(10, 10, dt="P1D")).apply_pixel(["it", "iy", "ix"], ["it_", "iy_", "ix_"])
    assert c.slice_time("2021-02-01").df.select("it_").distinct().collect()[0][0] == 31
    assert files.as_array(c.slice_space(loc=(2.5, 7.5)))[1:, 0, 0, 0].tolist() == [2, 2]
    assert c[:, :, 3, 4].shape == (3, 365, 1, 1)
    k = c.crop({"left": 2, "right": 5, "bottom": 1, "top": 4, "t0": "2021-01-10", "t1": "2021-01-20"})
    assert k.shape == (3, 11, 3, 3) and k.df.agg({"it_": "min"}).first()[0] == 9
    assert k.grid.left == 2 and k.grid.top == 4
    s = c.select_time(["2021-03-01", "2021-01-05"])
    assert s.nt == 2 and [r[0] for r in s.df.select("it_").distinct().orderBy("it_").collect()] == [4, 59]
    assert s.reduce_time("which_max(it_)").df.first()["it__which_max"] == 20210301
    with pytest.raises(ValueError):
        c.slice_time(it=400)
    with pytest.raises(ValueError):
        c.crop(iextent={"x": (20, 30)})


def test_join(spark):
    a, b = dummy_cube(spark, grid()), dummy_cube(spark, grid(), 1, 3.0)
    assert join.join_bands([a, b]).bands == ("X1.band1", "X2.band1")
    assert join.join_bands({"p": a, "q": b.filter_pixel("band1 > 5")}).df.where("`q.band1` IS NULL").count() == 300
    with pytest.raises(ValueError):
        join.join_bands([a, dummy_cube(spark, grid(4))])


def test_plans_are_rebuilt(spark):
    c = dummy_cube(spark, grid(6, 6, dt="P1D"), 2)
    cubes = [
        c.select_bands(1), c.rename_bands(band1="z"), c.apply_pixel("band1 * 2 + it", "s"), c.filter_pixel("band1 == 1"), c.crop(iextent={"x": (1, 3)}), c.slice_time(it=3), c.slice_space(i=(1, 2)),
        c.select_time(["2021-01-03"]), c.reduce_time("sum(band1)"), c.reduce_space("mean(band2)"), c.aggregate_time("P1M", "sum"), c.aggregate_space(fact=2, method="sum"),
        c.window_time("max(band1)", window=(1, 1)), c.window_space(kernel=[[1, 1, 1]] * 3, pad="REFLECT"), c.fill_time("locf"), join.join_bands({"a": c, "b": c}), pixel.mask_bands(c, "band1", values=[5]),
        c.filter_geom([[(1, 1), (5, 1), (5, 5), (1, 5)]]), empty_cube(spark, grid()),
    ]
    for cube in cubes:
        again = codec.from_json(spark, codec.to_json(cube))
        assert again.bands == cube.bands and again.grid == cube.grid and again.plan == cube.plan
        assert again.df.exceptAll(cube.df).isEmpty() or cube.shape[1] > 100
    with pytest.raises(ValueError):
        codec.from_json(spark, '{"cube_type": "nonsense"}')


def test_files(spark, tmp_path):
    c = from_array(spark, sample())
    for name, kw in {"plain": {}, "chunks": {"chunk": (2, 3, 3)}, "steps": {"by_step": True}}.items():
        files.write_cube(c, str(tmp_path / name), **kw)
        assert np.allclose(files.as_array(files.read_cube(spark, str(tmp_path / name))), files.as_array(c), equal_nan=True)
    p = files.pack_minmax("uint16", -5, 5)
    files.write_cube(c, str(tmp_path / "packed"), pack=p)
    assert np.allclose(files.as_array(files.read_cube(spark, str(tmp_path / "packed"))), files.as_array(c), atol=p.scale, equal_nan=True)
    assert files.as_table(c).count() == 120 and files.as_table(c, True).count() == int((~np.isnan(sample())).sum())


def test_user_functions(spark):
    x = sample()
    c = from_array(spark, x)
    assert np.allclose(files.as_array(c.apply_pixel(lambda v: [v["b1"] + 1], ["p"])), x + 1, equal_nan=True)
    assert c.reduce_time(fun=lambda m: [np.nanmax(m), m.shape[1]]).bands == ("band1", "band2")
    got = files.as_array(c.chunk_apply(lambda b: np.nan_to_num(b), ["z"], (2, 2, 2)))
    assert np.allclose(got[~np.isnan(x)], x[~np.isnan(x)])
    with pytest.raises(Exception, match="keep the number of steps"):
        c.apply_time(lambda m: m[:, :2]).df.collect()


def test_partitioning_does_not_matter(spark):
    c = from_array(spark, sample())
    one = {tuple(r) for r in c.window_space("mean(b1)", window=(3, 3)).reduce_time("count(b1_mean)").df.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert one == {tuple(r) for r in c.window_space("mean(b1)", window=(3, 3)).reduce_time("count(b1_mean)").df.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_user_functions_come_back_with_their_settings(spark):
    c = from_array(spark, sample())
    plus, twice, whole = (lambda v: [v["b1"] + 1]), (lambda m: m * 2), (lambda b: b + 1)
    cubes = [
        (c.apply_pixel(plus, ["p"], keep_bands=True), plus), (c.apply_time(twice, ["p"], keep_bands=True), twice), (c.chunk_apply(whole, ["p"], (2, 3, 3)), whole),
        (c.predict(lambda x: x["b1"] * 3, ["p"], keep_bands=True), lambda x: x["b1"] * 3), (c.reduce_time(fun=lambda m: [np.nansum(m)], names=["s"]), lambda m: [np.nansum(m)]),
        (c.reduce_space(fun=lambda m: [np.nansum(m)], names=["s"]), lambda m: [np.nansum(m)]),
    ]
    for cube, f in cubes:
        again = codec.from_json(spark, codec.to_json(cube), {"given": lambda node: c}, {cube.plan["cube_type"]: f})
        assert again.bands == cube.bands and again.plan == cube.plan
        assert np.allclose(files.as_array(again), files.as_array(cube), equal_nan=True)


def test_operators_take_the_names_that_a_join_gives(spark):
    x, y = sample(seed=2), sample(seed=3)
    c = join.join_bands([from_array(spark, x), from_array(spark, y)])
    assert c.bands == ("X1.b1", "X2.b1")
    got = files.as_array(c.window_space("sum(X1.b1)", "max(X2.b1)", window=(1, 1)))
    assert np.allclose(got[0], np.nan_to_num(x[0])) and np.allclose(got[1], y[0], equal_nan=True)
    kept = c.window_space("count(X1.b1)", window=(1, 1), keep_bands=True)
    assert kept.bands == ("X1.b1", "X2.b1", "X1.b1_count")
    assert np.allclose(files.as_array(kept)[2], ~np.isnan(x[0]))
    for made in (c.fill_time("locf"), c.window_time("mean(X1.b1)", window=(1, 1)), c.reduce_time("mean(X2.b1)"), c.reduce_space("max(X1.b1)"), c.aggregate_time("P2D", "mean"), c.aggregate_space(fact=2, method="max"), c.crop(iextent={"x": (0, 1)})):
        assert made.df.count() > 0


def test_expressions_with_bits_and_overflow(spark):
    c = dummy_cube(spark, grid(1, 1, t1="2021-01-31"), 1, 6.0)
    text = {"a": "band1 & 3", "o": "band1 | 3", "t": "(band1 > 5) & (band1 < 7)", "big": "exp(1000)", "low": "-exp(1000)", "nan": "sqrt(-1)", "zero": "band1 / 0", "same": "exp(0)"}
    row = c.apply_pixel(list(text.values()), list(text)).df.first().asDict()
    assert {k: row[k] for k in text} == {"a": 2.0, "o": 7.0, "t": 1.0, "big": None, "low": None, "nan": None, "zero": None, "same": 1.0}


def test_series_and_masks_take_one_pass(spark):
    c = from_array(spark, sample())
    plan = lambda x: x.df._jdf.queryExecution().executedPlan().toString()
    for made in (c.fill_time("linear"), c.window_time("mean(b1)", window=(1, 1))):
        assert plan(made).count("Exchange") == 1 and "Join" not in plan(made)
    inside = c.filter_geom([[(0.2, 0.2), (3.7, 0.2), (3.7, 4.4), (0.2, 4.4)], [(1, 1), (2, 1), (2, 2), (1, 2)]])
    assert "BroadcastHashJoin" in plan(inside) and "SortMergeJoin" not in plan(inside)
    want = sample()
    # the hole, and the top row, whose centres lie at 4.5
    want[:, :, 3, 1] = want[:, :, 0] = np.nan
    assert np.allclose(files.as_array(inside), want, equal_nan=True)


@pytest.mark.parametrize("pad", [None, "REPLICATE", "REFLECT_PIXEL", 7])
def test_windows_by_rows_and_columns(spark, pad):
    x = sample(nt=3, ny=6, nx=7, gaps=0.6)
    # a step without a row, and a corner that no window's cells reach
    x[:, 1] = np.nan
    x[:, 2, :4, :3] = np.nan
    mode = {None: "constant", 7: "constant", "REPLICATE": "edge", "REFLECT_PIXEL": "reflect"}[pad]
    p = np.pad(x[0], ((0, 0), (2, 2), (1, 1)), mode=mode, **({"constant_values": np.nan if pad is None else 7} if mode == "constant" else {}))
    if pad == 7:
        p[1] = np.nan  # constants join steps that have a row
    names = ("min", "max", "sum", "count", "mean", "prod")
    cube = from_array(spark, x).window_space(*[f"{n}(b1)" for n in names], window=(5, 3), pad=pad)
    got = dict(zip(names, files.as_array(cube), strict=True))
    fun = {"min": np.nanmin, "max": np.nanmax, "sum": np.nansum, "count": lambda w: (~np.isnan(w)).sum(), "mean": np.nanmean, "prod": np.nanprod}
    for n in names:
        for t, i, j in np.ndindex(3, 6, 7):
            w = p[t, i : i + 5, j : j + 3]
            want = np.nan if np.isnan(w).all() and n in ("min", "max", "mean") else fun[n](w)
            assert np.allclose(got[n][t, i, j], want, equal_nan=True), (n, t, i, j)
    # as the plain way has them
    median = files.as_array(from_array(spark, x).window_space("median(b1)", "mean(b1)", window=(5, 3), pad=pad))
    assert np.allclose(median[1], got["mean"], equal_nan=True)


def test_user_functions_by_batch(spark):
    x = sample()
    c = from_array(spark, x)
    calls = [lambda v: [v["b1"] + 1, 3.0], lambda v: [v["b1"] + 1, 3.0]]
    one, many = (files.as_array(c.apply_pixel(f, ["p", "q"], keep_bands=True, by_batch=k)) for k, f in enumerate(calls))
    assert np.allclose(one, many, equal_nan=True)
    again = codec.from_json(spark, codec.to_json(c.apply_pixel(calls[1], ["p", "q"], by_batch=True)), {"given": lambda node: c}, {"apply_pixel_function": calls[1]})
    assert again.plan["by_batch"] and np.allclose(files.as_array(again), many[1:], equal_nan=True)


def test_chunks_know_what_they_are_of(spark):
    c = dummy_cube(spark, grid(5, 4, t1="2021-03-31"), 2)
    srs = c.srs

    def centres(block, of):
        assert of["bands"] == ["band1", "band2"] and of["srs"] == srs and len(of["t"]) == block.shape[1]
        y, x = np.meshgrid(of["y"], of["x"], indexing="ij")
        return np.stack([np.broadcast_to(y, block.shape[1:]), np.broadcast_to(x, block.shape[1:])])

    got = files.as_array(c.chunk_apply(centres, ["y", "x"], (2, 3, 3)))
    assert (got[0, 2, :, 0] == [3.5, 2.5, 1.5, 0.5]).all() and (got[1, 0, 0] == [0.5, 1.5, 2.5, 3.5, 4.5]).all()
    sums = files.as_array(c.chunk_apply(lambda b: b.sum(axis=(1, 2, 3)), ["a", "b"], (3, 2, 5)))
    assert (sums == 30).all()
    with pytest.raises(Exception, match="gives a block"):
        c.chunk_apply(lambda b: b[:, :, :2], ["a", "b"], (1, 4, 5)).df.collect()


def test_labelled_time_is_cropped(spark):
    c = dummy_cube(spark, grid(2, 2, dt="P1D")).select_time(["2021-01-01", "2021-01-05", "2021-01-10", "2021-01-20"])
    labels = lambda snap, t0, t1: [str(t) for t in c.crop({"t0": t0, "t1": t1}, snap=snap).grid.labels]
    assert labels("in", "2021-01-02", "2021-01-18") == ["2021-01-05", "2021-01-10"]
    assert labels("out", "2021-01-02", "2021-01-18") == ["2021-01-01", "2021-01-05", "2021-01-10", "2021-01-20"]
    assert labels("near", "2021-01-02", "2021-01-15") == ["2021-01-01", "2021-01-05", "2021-01-10", "2021-01-20"]
    assert labels("near", "2021-01-05", "2021-01-10") == labels("out", "2021-01-05", "2021-01-10") == ["2021-01-05", "2021-01-10"]
    assert c.crop({"left": 1, "right": 2}).nt == 4
    with pytest.raises(ValueError):
        c.crop({"t0": "2020-12-01", "t1": "2021-01-10"})


def test_packing(spark, tmp_path):
    p = files.pack_minmax("int16", 0, 100, simplify=True)
    assert np.isclose(p.scale, 0.001) and p.nodata == -32768
    c = from_array(spark, sample())
    files.write_images(c, str(tmp_path / "images"), pack=files.pack_minmax("uint8", -5, 5), overviews=1)
    stored = spark.read.parquet(str(tmp_path / "images" / "level=0"))
    assert dict(stored.dtypes)["b1"] == "smallint" and stored.count() == c.df.count() and (tmp_path / "images" / "level=1.json").exists()
