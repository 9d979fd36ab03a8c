import json

import pytest
from pyspark.sql import functions as F

from gridloom import Grid, View
from gridloom import cli, queries
from gridloom.operators import geom
from gridloom.plans import codec
from gridloom.sinks import files
from gridloom.sources.catalog import FORMATS, Collection, _range, collection_formats, collection_from_lists, create_collection, stac_collection
from gridloom.sources.images import raster_cube, stack_cube
from gridloom.sources.points import points_to_cube
from gridloom.streaming.ingest import append_files, windowed_cells

G = Grid.of({"left": 0, "right": 4, "bottom": 0, "top": 2, "t0": "2021-01-01", "t1": "2021-01-04"}, dx=1, dy=1, dt="P2D")


def images(spark):
    boxes = [(0, 4, 0, 2)] * 3
    return collection_from_lists(spark, ["a", "b", "c"], ["2021-01-01T10:00:00", "2021-01-02T10:00:00", "2021-01-03T10:00:00"], ["v", "q"], boxes=boxes)


def pixels(spark):
    rows = [(1, "v", 0.5, 0.5, 1.0), (2, "v", 0.5, 0.5, 5.0), (3, "v", 0.6, 0.4, 7.0), (1, "q", 0.5, 0.5, 2.0), (2, "q", 0.5, 0.5, 0.0), (1, "v", 3.5, 1.5, float("nan"))]
    return spark.createDataFrame(rows, "image_id int, band_name string, x double, y double, value double")


@pytest.mark.parametrize(("method", "want"), [("first", 1), ("last", 5), ("none", 5), ("min", 1), ("max", 5), ("mean", 3), ("median", 3), ("count_values", 2), ("count_images", 2)])
def test_composites(spark, method, want):
    c = raster_cube(images(spark), pixels(spark), View(G, method), ["v"])
    rows = {(r["it"], r["iy"], r["ix"]): r["v"] for r in c.df.collect()}
    assert rows[0, 1, 0] == want
    assert rows.get((0, 0, 3)) in ((None, 0.0) if method == "count_values" else (None, 1.0))


def test_mask(spark):
    c = raster_cube(images(spark), pixels(spark), View(G, "max"), mask={"band": "q", "values": [2]})
    assert {(r["it"], r["ix"]): r["v"] for r in c.df.where("iy = 1").collect()} == {(0, 0): 5.0, (1, 0): 7.0}


def test_formats(spark):
    paths = ["/x/s1_20210101_red.tif", "/x/s1_20210101_nir.tif", "/x/s2_20210105_red.tif", "/x/other.txt", "/x/s3_nodate_red.tif"]
    fmt = {"pattern": r".*\.tif", "images": {"pattern": r".*/(.+)_[a-z]+\.tif"}, "datetime": {"pattern": r".*_([0-9]{8})_.*", "format": "%Y%m%d"}, "bands": {"red": {"pattern": r".*_red\.tif"}, "nir": {"pattern": r".*_nir\.tif", "nodata": -1}}}
    c = create_collection(spark.createDataFrame([(p,) for p in paths], "path string"), fmt)
    assert {(r["name"], r["datetime"]) for r in c.images.collect()} == {("s1_20210101", "2021-01-01T00:00:00"), ("s2_20210105", "2021-01-05T00:00:00")}
    assert c.gdalrefs.count() == 3
    assert c.filter_bands(["nir"]).gdalrefs.count() == 1
    assert c.filter_datetime_range("2021-01-02", "2021-01-05").images.count() == 1
    assert c.add(c).images.count() == 2
    told = c.with_tables(image_md=c.images.where("name LIKE 's2%'").selectExpr("id AS image_id", "'cloud' AS `key`", "'7' AS value"))
    both = c.filter_datetime_range("2021-01-01", "2021-01-02").add(told)
    assert [tuple(r) for r in both.image_md.join(both.images.selectExpr("id AS image_id", "name"), "image_id").select("name", "value").collect()] == [("s2_20210105", "7")]


def test_stac(spark):
    def item(i, **props):
        return json.dumps({"id": i, "bbox": [1, 2, 3, 4], "properties": props, "assets": {"a": {"href": "https://h/a.tif"}, "m": {"href": "s3://b/m.tif", "eo:bands": [{"name": "x"}, {"name": "y"}]}}})

    items = [item("1", datetime="2021-01-01T00:00:00Z"), item("1", datetime="2021-01-01T00:00:00Z"), item("2", start_datetime="2021-01-01T00:00:00Z", end_datetime="2021-01-03T00:00:00Z", **{"proj:epsg": "4326"})]
    c = stac_collection(spark.createDataFrame([(x,) for x in items], "item string"))
    assert [r["name"] for r in c.bands.orderBy("id").collect()] == ["a", "m:x", "m:y"]
    assert {r["name"]: r["datetime"] for r in c.images.collect()} == {"1": "2021-01-01T00:00:00", "2": "2021-01-02T00:00:00"}
    assert c.gdalrefs.where("band_num = 2").first()["descriptor"] == "/vsis3/b/m.tif"


def test_presets(spark):
    assert len(collection_formats()) == 21 and sum(len(f["bands"]) for f in FORMATS.values()) == 163
    l8 = "/d/LC08_L1TP_226063_20140719_20170421_01_T1"
    s2 = "/d/S2A_MSIL2A_20200102T030405_N0213_R1_T32.SAFE/GRANULE/x/IMG_DATA/R10m/T32_20200102T030405"
    given = {
        "L8_SR": ([f"{l8}_{b}.tif" for b in ("pixel_qa", "radsat_qa", "sr_aerosol", *(f"sr_{x}" for x in ("band1", "band2", "band3", "band4", "band5", "band6", "band7", "ndvi", "evi", "savi", "msavi", "ndmi", "nbr", "nbr2")))] + [f"{l8}_sr_band1.tif.aux.xml"], "2014-07-19T00:00:00", 17),
        "L8_L1TP": ([f"{l8}/LC08_L1TP_226063_20140719_20170421_01_T1_B{k}.TIF" for k in (1, 10)], "2014-07-19T00:00:00", 2),
        "Sentinel2_L2A": ([f"{s2}_B02_10m.jp2", f"{s2}_B03_10m.jp2"], "2020-01-02T03:04:05", 2),
        "Sentinel2_L1C_AWS": (["/vsis3/sentinel-s2-l1c/tiles/1/C/CV/2016/1/10/0/B03.jp2"], "2016-01-10T00:00:00", 1),
        "MxD11A1": ([f'HDF4_EOS:EOS_GRID:"/d/MOD11A1.A2018060.h1.hdf":MODIS_Grid_Daily_1km_LST:{b}' for b in ("LST_Day_1km", "LST_Night_1km")], "2018-03-01T00:00:00", 2),
        "CHIRPS_v2_0_monthly_p05_tif": (["/d/chirps-v2.0.2019.07.tif.gz"], "2019-07-01T00:00:00", 1),
    }
    for name, (paths, when, refs) in given.items():
        c = create_collection(spark.createDataFrame([(p,) for p in paths], "path string"), name)
        assert [r["datetime"] for r in c.images.collect()] == [when], name
        assert (c.gdalrefs.count(), c.gdalrefs.select("band_id").distinct().count(), c.bands.count()) == (refs, refs, len(FORMATS[name]["bands"])), name


def test_ids_of_many_images(spark):
    n = 130_000
    fmt = {"images": {"pattern": r"/(.+)_[0-9]{8}_red\.tif"}, "datetime": {"pattern": r".*_([0-9]{8})_.*"}, "bands": {"red": {"pattern": ".*red.*"}}}
    paths = spark.range(n).select(F.format_string("/s%06d_20210101_red.tif", F.col("id") * 7919 % n).alias("path"))
    item = F.format_string('{"id":"s%06d","bbox":[1,2,3,4],"properties":{"datetime":"2021-01-01T00:00:00Z"},"assets":{"a":{"href":"s%06d"}}}', F.col("id") * 7919 % n, F.col("id") * 7919 % n)
    for c in (create_collection(paths, fmt), stac_collection(spark.range(n).select(item.alias("item")))):
        assert c.images.where(F.concat(F.lit("s"), F.lpad((F.col("id") - 1).cast("string"), 6, "0")) == F.col("name")).count() == c.images.count() == n
        assert c.gdalrefs.where(F.col("descriptor").contains(F.concat(F.lit("s"), F.lpad((F.col("image_id") - 1).cast("string"), 6, "0")))).count() == c.gdalrefs.count() == n


def test_files_and_items_are_looked_at_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    told = F.udf(told, "string").asNondeterministic()
    fmt = {"images": {"pattern": r"/(.+)_[0-9]{8}_[a-z]+\.tif"}, "datetime": {"pattern": r".*_([0-9]{8})_.*"}, "bands": {b: {"pattern": f".*_{b}.*"} for b in ("red", "nir")} | {"any": {"band": 3}}}
    path = F.format_string("/s%03d_20210101_%s.tif", F.floor(F.col("id") / 3), F.element_at(F.array(F.lit("red"), F.lit("nir"), F.lit("txt")), (F.col("id") % 3 + 1).cast("int")))
    item = F.format_string('{"id":"s%03d","bbox":[1,2,3,4],"properties":{"datetime":"2021-01-01T00:00:00Z"},"assets":{"a":{"href":"s%d"}}}', F.floor(F.col("id") / 3), F.col("id"))
    made = (create_collection(spark.range(300).select(told(path).alias("path")), fmt), stac_collection(spark.range(300).select(told(item).alias("item"))))
    assert [c.images.count() for c in made] == [100, 100] and [c.gdalrefs.count() for c in made] == [500, 100]
    assert made[0].gdalrefs.where("(band_id = 1) = (descriptor LIKE '%red%') OR band_id = 3 AND band_num = 3").count() == 500
    assert made[0].gdalrefs.join(made[0].images, F.col("id") == F.col("image_id")).where("contains(descriptor, name)").count() == 500
    assert seen.value == 600
    for c in made:  # few bytes of a scratch file can be many rows
        assert "SortMergeJoin" in c.gdalrefs._jdf.queryExecution().executedPlan().toString()


def test_no_files_match(spark):
    c = create_collection(spark.createDataFrame([("/x/other.txt",)], "path string"), "L8_SR")
    assert (c.images.count(), c.gdalrefs.count(), c.bands.count()) == (0, 0, 17)


def test_ranges_of_names(spark):
    names = ["", "a", "b", "bb", "m", "zz", "é", "￿"]
    table = spark.createDataFrame([(x,) for x in names], "name string")
    for bounds in (["b"], ["a", "b", "c"], sorted(f"{x}{y}" for x in "abmz" for y in ("", "a", "b", "é", "z"))):
        got = {r["name"]: r["k"] for r in table.select("name", _range(F.col("name"), bounds).alias("k")).collect()}
        assert got == {x: sum(b <= x for b in bounds) for x in names}


def test_orders_of_a_day_share_their_paths_before_they_are_written(spark, sf):
    text = queries._files(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in text.split("Generate explode")[1]


def test_saved_collections(spark, tmp_path):
    images(spark).save(str(tmp_path / "c"))
    c = Collection.open(spark, str(tmp_path / "c"))
    assert c.images.count() == 3 and c.default_view().grid.nx == 512


def test_points(spark):
    rows = [("2021-01-01 05:00:00", 0.5, 0.5, 1.0), ("2021-01-02 23:59:59", 0.9, 0.1, 3.0), ("2021-01-03 00:00:00", 0.5, 0.5, float("nan")), ("2021-01-09 00:00:00", 0.5, 0.5, 9.0), ("2021-01-01 00:00:00", 9.5, 0.5, 9.0)]
    t = spark.createDataFrame(rows, "t string, x double, y double, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    c = points_to_cube(t, G, "t", "x", "y", {"m": ("mean", "v"), "n": ("count", "v")})
    assert {tuple(r) for r in c.df.collect()} == {(0, 1, 0, 2.0, 2.0), (1, 1, 0, None, 0.0)}


def test_source_filters_reach_the_scan(spark, sf):
    from gridloom.queries import cube_e

    df = cube_e(spark, sf).select_bands("value").df
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(ts" in text.split("PushedFilters: ")[1].split("\n")[0] and "props" not in text.split("ReadSchema: ")[1].split("\n")[0]


def test_geometry():
    square = [[(1, 0), (3, 0), (3, 2), (1, 2)]]
    assert sorted(geom.polygon_cells(G, square)) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    holed = [[(0, 0), (4, 0), (4, 2), (0, 2)], [(1, 0), (2, 0), (2, 2), (1, 2)]]
    assert sorted({ix for _, ix in geom.polygon_cells(G, holed)}) == [0, 2, 3]
    assert geom.point_cells(G, [(4, 0), (0.2, 1.9)]) == [(1, 3), (0, 0)]
    assert geom.line_cells(G, [(0.5, 0.5), (3.5, 0.5)]) == [(1, 0), (1, 1), (1, 2), (1, 3)]


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("2021-01-01 05:00:00", 0.5, 0.5, 1.0), ("2021-01-02 01:00:00", 0.5, 0.5, 3.0), ("2021-01-09 00:00:00", 0.5, 0.5, 5.0)]
    spark.createDataFrame(rows, "t string, x double, y double, v double").withColumn("t", F.col("t").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema("t timestamp, x double, y double, v double").parquet(src)
    q = windowed_cells(stream, G, "t", "x", "y", {"m": ("mean", "v")}).writeStream.format("memory").queryName("cells").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", out).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("cells").collect()} == {(0, 1, 0, 2.0)}  # the last point is after the grid
    seen = []
    append_files(stream, lambda df: seen.append(df.count()), str(tmp_path / "check")).awaitTermination(120)
    assert seen == [3]


def test_plans_that_name_their_tables_run_alone(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("points", "file", "pixels", "one", "two", "out")}
    table = spark.createDataFrame([("2021-01-01 05:00:00", 0.5, 0.5, 2.0), ("2021-01-03 05:00:00", 0.5, 0.5, 4.0)], "t string, x double, y double, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    table.write.parquet(at["points"])
    images(spark).save(at["file"])
    pixels(spark).write.parquet(at["pixels"])
    for name, value in (("one", 1.0), ("two", 2.0)):
        spark.createDataFrame([(0, 1, value)], "iy int, ix int, v double").write.parquet(at[name])
    read = spark.read.parquet
    cubes = [
        points_to_cube(read(at["points"]), G, "t", "x", "y + 1", {"m": ("mean", "v * 2")}, path=at["points"]),
        raster_cube(Collection.open(spark, at["file"]), read(at["pixels"]), View(G, "max", "average"), ["v"], {"band": "q", "values": [2]}, {"file": at["file"], "pixels": at["pixels"]}),
        stack_cube([("2021-01-03", read(at["two"])), ("2021-01-01", read(at["one"]))], G, paths=[at["two"], at["one"]]),
    ]
    rows = lambda c: sorted(map(tuple, c.df.collect()), key=str)
    for cube in cubes:
        again = codec.from_json(spark, codec.to_json(cube))
        assert again.plan == cube.plan and again.grid == cube.grid and rows(again) == rows(cube) != []
    for bare in (points_to_cube(table, G, "t", "x", "y", {"m": ("mean", "v")}), raster_cube(images(spark), pixels(spark), View(G)), stack_cube([("2021-01-01", read(at["one"]))], G)):
        with pytest.raises(ValueError, match="give a source"):
            codec.from_json(spark, codec.to_json(bare))
    with pytest.raises(ValueError, match="columns as text"):
        points_to_cube(table, G, "t", F.col("x"), "y", {"m": ("mean", "v")}, path=at["points"])
    plan = tmp_path / "plan.json"
    plan.write_text(codec.to_json(cubes[1].reduce_time("max(v)")))
    assert cli.main(["exec", str(plan), at["out"]]) == 0
    assert rows(files.read_cube(spark, at["out"])) == rows(cubes[1].reduce_time("max(v)"))
