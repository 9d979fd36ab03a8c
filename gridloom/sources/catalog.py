"""Image collections: a catalogue of six tables, made from file names by a format, from lists, or from STAC items."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import accumulate
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..grid import Grid, View
from ..scratch import saved

SCHEMAS = {
    "collection_md": "key string, value string",
    "bands": "id int, name string, type string, offset double, scale double, unit string, nodata string",
    "band_md": "band_id int, key string, value string",
    "images": "id int, name string, left double, top double, bottom double, right double, datetime string, proj string",
    "image_md": "image_id int, key string, value string",
    "gdalrefs": "image_id int, band_id int, descriptor string, band_num int",
}

#: Names sampled for each range in which images are numbered.
SAMPLED = 20


@dataclass(frozen=True)
class Collection:
    """The tables of a catalogue, as DataFrames."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    @staticmethod
    def of(spark: SparkSession, **rows) -> Collection:
        """Tables from lists of rows or DataFrames; absent ones are empty."""
        out = {}
        for name, schema in SCHEMAS.items():
            given = rows.get(name, [])
            out[name] = given if isinstance(given, DataFrame) else spark.createDataFrame(given, schema)
        return Collection(out)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Collection:
        return Collection({name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()})

    def save(self, path: str, mode: str = "errorifexists") -> None:
        for name, df in self.tables.items():
            df.write.mode(mode).parquet(f"{path}/{name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.tables[name]
        raise AttributeError(name)

    def with_tables(self, **tables: DataFrame) -> Collection:
        return Collection({**self.tables, **tables})

    # ------------------------------------------------------------ filters

    def filter_bands(self, names: Sequence[str]) -> Collection:
        bands = self.bands.where(F.col("name").isin(list(names)))
        return self.with_tables(bands=bands, gdalrefs=self.gdalrefs.join(F.broadcast(bands.select(F.col("id").alias("band_id"))), "band_id", "left_semi").select("image_id", "band_id", "descriptor", "band_num"))

    def _with_images(self, images: DataFrame) -> Collection:
        kept = images.select(F.col("id").alias("image_id"))
        return self.with_tables(images=images, gdalrefs=self.gdalrefs.join(kept, "image_id", "left_semi"), image_md=self.image_md.join(kept, "image_id", "left_semi"))

    def filter_datetime_range(self, t0: str, t1: str) -> Collection:
        return self._with_images(self.images.where(F.col("datetime").between(t0, _end(t1))))

    def filter_spatial_range(self, left: float, right: float, bottom: float, top: float) -> Collection:
        return self._with_images(self.images.where(_overlap(left, right, bottom, top)))

    def range_query(self, left: float, right: float, bottom: float, top: float, t0: str, t1: str, bands: Sequence[str] | None = None) -> DataFrame:
        """The datasets of images that overlap a box (degrees) and lie in a range of times, both ends included."""
        images = self.images.where(F.col("datetime").between(t0, _end(t1)) & _overlap(left, right, bottom, top))
        named = self.bands if bands is None else self.bands.where(F.col("name").isin(list(bands)))
        refs = self.gdalrefs.join(F.broadcast(named.select(F.col("id").alias("band_id"), F.col("name").alias("band_name"), "nodata", "offset", "scale")), "band_id")
        return images.select(F.col("id").alias("image_id"), F.col("name").alias("image_name"), "datetime", "proj").join(refs, "image_id")

    def extent(self) -> dict:
        r = self.images.agg(F.min("left").alias("left"), F.max("right").alias("right"), F.min("bottom").alias("bottom"), F.max("top").alias("top"), F.min("datetime").alias("t0"), F.max("datetime").alias("t1")).first()
        return r.asDict()

    def default_view(self) -> View:
        """The whole extent, 512 cells along its longer side, four steps of time."""
        e = self.extent()
        wide, high = e["right"] - e["left"], e["top"] - e["bottom"]
        e = {**e, "t0": e["t0"][:10], "t1": e["t1"][:10]}
        size = max(wide, high) / 512
        return View(Grid.of(e, dx=size, dy=size, nt=4), "first", "near")

    def add(self, other: Collection) -> Collection:
        """Images of another collection whose names are new here, with their metadata."""
        new = other.images.join(self.images.select("name"), "name", "left_anti").select(*self.images.columns)
        base = (self.images.agg(F.max("id")).first()[0] or 0) + 1
        # bands meet by name; unknown ones are appended
        bands = other.bands.join(self.bands.select("name"), "name", "left_anti").select(*self.bands.columns)
        band_base = (self.bands.agg(F.max("id")).first()[0] or 0) + 1
        all_bands = self.bands.unionByName(bands.withColumn("id", F.col("id") + band_base))
        ids = other.bands.select(F.col("id").alias("band_id"), "name").join(all_bands.select(F.col("id").alias("to"), "name"), "name").drop("name")
        refs = other.gdalrefs.join(new.select(F.col("id").alias("image_id")), "image_id", "left_semi").join(F.broadcast(ids), "band_id")
        return self.with_tables(
            bands=all_bands, images=self.images.unionByName(new.withColumn("id", F.col("id") + base)),
            image_md=self.image_md.unionByName(other.image_md.join(new.select(F.col("id").alias("image_id")), "image_id", "left_semi").select((F.col("image_id") + base).alias("image_id"), "key", "value")),
            gdalrefs=self.gdalrefs.unionByName(refs.select((F.col("image_id") + base).alias("image_id"), F.col("to").alias("band_id"), "descriptor", "band_num")),
        )


def _end(t1: str) -> str:
    """A day or month as an end includes all of it: times are compared as text."""
    return t1 if len(t1) >= 19 else t1 + "￿"


def _overlap(left: float, right: float, bottom: float, top: float) -> Column:
    return (F.col("right") >= left) & (F.col("left") <= right) & (F.col("top") >= bottom) & (F.col("bottom") <= top)


# ---------------------------------------------------------------- formats

#: The reference's presets, one file of JSON each.
FORMATS: dict[str, dict] = {p.stem: json.loads(p.read_text()) for p in sorted((Path(__file__).parent.parent / "formats").glob("*.json"))}


def collection_formats() -> list[str]:
    return sorted(FORMATS)


def add_collection_format(name: str, text: str) -> None:
    """Adds a format given as JSON, after looking at it."""
    f = json.loads(text)
    if not {"images", "bands"} <= set(f):
        raise ValueError("a format has images and bands")
    for p in [f.get("pattern", ""), f["images"]["pattern"], *(b.get("pattern", "") for b in f["bands"].values())]:
        re.compile(p)
    FORMATS[name] = f


def _whole(pattern: str) -> str:
    """Patterns of formats match whole paths."""
    return f"^(?:{pattern})\\z"


def _found(text: Column, pattern: str) -> Column:
    """The first group of a pattern that matched."""
    groups = re.compile(pattern).groups
    parts = [F.nullif(F.regexp_extract(text, _whole(pattern), i), F.lit("")) for i in range(1, groups + 1)] or [F.nullif(F.regexp_extract(text, _whole(pattern), 0), F.lit(""))]
    return F.coalesce(*parts)


def _parsed(text: Column, fmt: str) -> Column:
    """A time by a format of strptime, which may end before the text does; null if it does not fit. Formats without a
    percent sign are Spark's."""
    if "%" not in fmt:
        return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
    digits = {"Y": 4, "m": 2, "d": 2, "H": 2, "M": 2, "S": 2, "j": 3}
    fields, pattern = [], "^"
    for field, other in re.findall(r"%(.)|([^%]+)", fmt):
        if field and field not in digits:
            raise ValueError(f"%{field} is not known in a format of times")
        pattern += f"([0-9]{{1,{digits[field]}}})" if field else re.escape(other)
        fields += [field] if field else []
    part = lambda k, rest: F.regexp_extract(text, pattern, fields.index(k) + 1).try_cast("int") if k in fields else F.lit(rest)
    # a day of the year is a number of days after its first
    when = F.try_make_timestamp_ntz(part("Y", 1970), part("m", 1), part("d", 1), part("H", 0), part("M", 0), part("S", 0).cast("decimal(16,6)"))
    return F.when(part("j", 1).between(1, 366), when + F.make_dt_interval(part("j", 1) - 1)).cast("timestamp_ntz")


def create_collection(files: DataFrame, fmt: str | dict) -> Collection:
    """files: path, and where known left, top, bottom, right, proj. Paths that do not match the format are left out;
    files of one image name make one image. Files are looked at once; what is found of them is kept as a scratch table."""
    f = FORMATS[fmt] if isinstance(fmt, str) else fmt
    spark, p = files.sparkSession, F.col("path")
    geo = {"left": "double", "top": "double", "bottom": "double", "right": "double", "proj": "string"}
    own = files.select("path", *[(F.col(c) if c in files.columns else F.lit(None)).cast(t).alias(c) for c, t in geo.items()])
    if f.get("pattern"):
        own = own.where(p.rlike(_whole(f["pattern"])))
    when = _parsed(_found(p, f["datetime"]["pattern"]), f["datetime"].get("format", "%Y%m%d"))
    own = own.withColumns({"name": _found(p, f["images"]["pattern"]), "when": when}).where("name IS NOT NULL AND when IS NOT NULL")
    if f.get("srs"):
        own = own.withColumn("proj", F.lit(f["srs"]))
    step = f["datetime"].get("bands", {}).get("dt")
    refs = []
    for i, b in enumerate(f["bands"].values()):
        ref = F.struct(F.lit(i + 1).alias("band_id"), F.lit(int(b.get("band", 1))).alias("band_num"))
        refs.append(F.when(p.rlike(_whole(b["pattern"])), ref) if b.get("pattern") else ref)
    all_refs = own.select("*", F.inline(F.array_compact(F.array(*refs))))
    if step:
        # the bands of a file are steps of time, and each makes an image
        n = int(f["datetime"]["bands"].get("count", 1))
        shift = f"make_interval({', '.join(str(int(re.sub(r'[^0-9]', '', step))) + ' * k' if u == step[-1] else '0' for u in 'YMWD')})"
        all_refs = all_refs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"when": F.expr(f"when + {shift}"), "band_num": F.col("k") + 1, "name": F.concat_ws("_", "name", F.col("k") + 1)})
    all_refs = saved(all_refs)
    images = all_refs.groupBy("name").agg(*[F.first(c, ignorenulls=True).alias(c) for c in geo], F.min("when").alias("when"))
    images = _numbered(images)
    md = [(k, str(v)) for k, v in f.items() if isinstance(v, str)]
    bands = [(i + 1, n, b.get("type", ""), float(b.get("offset", 0)), float(b.get("scale", 1)), b.get("unit", ""), str(b.get("nodata", ""))) for i, (n, b) in enumerate(f["bands"].items())]
    out = images.select("id", "name", "left", "top", "bottom", "right", F.date_format("when", "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"), "proj")
    gdal = all_refs.join(images.select("name", "id").hint("merge"), "name").select(F.col("id").alias("image_id"), "band_id", F.col("path").alias("descriptor"), "band_num")
    return Collection.of(spark, collection_md=md, bands=bands, images=out, gdalrefs=gdal)


def _numbered(images: DataFrame) -> DataFrame:
    """Adds id: the place of a name in the order of all names, from 1. Names are distinct. They are dealt to ranges, by
    bounds from those of smallest hash, and numbered within each after the counts of the ranges before: no task sees all."""
    # not compressed, as Spark takes the size of files for that of rows when it decides on a broadcast
    images = saved(images, "none")
    n = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = sorted(r["name"] for r in images.select("name").orderBy(F.xxhash64("name"), "name").limit(SAMPLED * n).collect())
    bounds = [some[len(some) * k // n] for k in range(1, n)] if len(some) >= SAMPLED * n else []
    # a function of the name alone: the same however often, and on whatever partitions, it is computed
    dealt = images.withColumn("_range", _range(F.col("name"), bounds) if bounds else F.lit(0))
    counts = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}
    before = [0, *accumulate(counts.get(k, 0) for k in range(len(bounds)))]
    own = F.row_number().over(Window.partitionBy("_range").orderBy("name"))
    return dealt.withColumn("id", (own + F.lit(before)[F.col("_range")]).cast("int")).drop("_range")


def _range(x: Column, bounds: Sequence[str]) -> Column:
    """How many of some ascending bounds are at most x: x is compared with the first of each block, then with one block."""
    w = math.isqrt(len(bounds))
    below = lambda some: F.size(F.filter(some, lambda b: b <= x))
    at = (F.greatest(below(F.lit(bounds[::w])), F.lit(1)) - 1) * w
    return at + below(F.slice(F.lit(bounds), at + 1, F.lit(w)))


def collection_from_lists(spark: SparkSession, files: Sequence[str], datetimes: Sequence[str], band_names: Sequence[str], one_band_per_file: bool = False, boxes: Sequence[tuple] | None = None, proj: str = "EPSG:4326") -> Collection:
    """Files with known times: each holds all bands, or one band each, in turn."""
    images, refs = {}, []
    for i, (path, when) in enumerate(zip(files, datetimes, strict=True)):
        name = when if one_band_per_file else path
        k = images.setdefault(name, (len(images) + 1, when, boxes[i] if boxes else (None,) * 4))[0]
        if one_band_per_file:
            refs.append((k, 1 + sum(r[0] == k for r in refs), path, 1))
        else:
            refs += [(k, b + 1, path, b + 1) for b in range(len(band_names))]
    rows = [(k, n, *map(lambda v: None if v is None else float(v), (b[0], b[3], b[2], b[1])), w, proj) for n, (k, w, b) in images.items()]
    return Collection.of(spark, images=rows, gdalrefs=refs, bands=[(i + 1, n, "", 0.0, 1.0, "", "") for i, n in enumerate(band_names)])


# ---------------------------------------------------------------- STAC

_ITEM = """struct<id:string, bbox:array<double>, properties:map<string,string>, assets:map<string,
 struct<href:string, `proj:epsg`:string, `eo:bands`:array<struct<name:string>>, roles:array<string>>>>"""


def default_url(url: Column) -> Column:
    """URLs as paths of virtual file systems."""
    out = F.regexp_replace(url, "^s3://", "/vsis3/")
    out = F.regexp_replace(out, "^gs://", "/vsigs/")
    return F.regexp_replace(out, "^(https?://)", "/vsicurl/$1")


def stac_collection(
    items: DataFrame, asset_names: Sequence[str] | None = None, asset_regex: str | None = None, url: Callable[[Column], Column] = default_url, property_filter: Callable[[Column], Column] | None = None,
    srs: str | None = None, srs_overwrite: bool = False, duration: str = "center",
) -> Collection:
    """items: a column item with the JSON of each. Assets become bands; intervals count by their centre or start; of
    equal ids one is taken."""
    spark = items.sparkSession
    x = items.select(F.from_json("item", _ITEM).alias("i")).select("i.*").where("id IS NOT NULL").dropDuplicates(["id"])
    props = F.col("properties")
    if property_filter is not None:
        x = x.where(property_filter(props))
    ts = lambda k: F.try_to_timestamp(F.regexp_replace(F.substring(props[k], 1, 19), "T", " "))
    start, end = ts("start_datetime"), ts("end_datetime")
    middle = F.timestamp_seconds((F.unix_timestamp(start) + F.unix_timestamp(end)) / 2) if duration == "center" else start
    when = F.coalesce(ts("datetime"), middle)
    a = x.select("*", when.alias("when"), F.explode(F.map_entries("assets")).alias("a")).where("when IS NOT NULL")
    if asset_names:
        a = a.where(F.col("a.key").isin(list(asset_names)))
    if asset_regex:
        a = a.where(F.col("a.key").rlike(asset_regex))
    subs = F.when(F.size(F.col("a.value.`eo:bands`")) > 1, F.transform(F.col("a.value.`eo:bands`"), lambda b, k: F.struct(F.concat(F.col("a.key"), F.lit(":"), b["name"]).alias("band"), (k + 1).cast("int").alias("num"))))
    own = F.coalesce(subs, F.array(F.struct(F.col("a.key").alias("band"), F.lit(1).alias("num"))))
    proj = F.coalesce(F.concat(F.lit("EPSG:"), F.col("a.value.`proj:epsg`")), F.concat(F.lit("EPSG:"), props["proj:epsg"]))
    proj = F.lit(srs) if srs_overwrite and srs else F.coalesce(proj, F.lit(srs))
    # one pass over the items: of equal ids all tables then show the same one
    rows = saved(a.select("id", "bbox", "when", proj.alias("proj"), url(F.col("a.value.href")).alias("descriptor"), F.explode(own).alias("b")))
    names = [r["band"] for r in rows.select("b.band").distinct().orderBy("band").collect()]
    images = rows.groupBy(F.col("id").alias("name")).agg(F.first("bbox").alias("bbox"), F.first("when").alias("when"), F.first("proj", True).alias("proj"))
    images = _numbered(images)
    box = F.col("bbox")
    out = images.select("id", "name", box[0].alias("left"), F.when(F.size(box) == 6, box[4]).otherwise(box[3]).alias("top"), box[1].alias("bottom"), F.when(F.size(box) == 6, box[3]).otherwise(box[2]).alias("right"), F.date_format("when", "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"), "proj")
    number = F.create_map(*[v for i, n in enumerate(names) for v in (F.lit(n), F.lit(i + 1))]) if names else F.create_map()
    refs = rows.join(images.select(F.col("id").alias("image_id"), F.col("name").alias("id")).hint("merge"), "id").select("image_id", number[F.col("b.band")].alias("band_id"), "descriptor", F.col("b.num").alias("band_num"))
    return Collection.of(spark, images=out, gdalrefs=refs, bands=[(i + 1, n, "", 0.0, 1.0, "", "") for i, n in enumerate(names)])
