"""Command line: look at a stored cube or catalogue, run a plan."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gridloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("info", help="what a stored catalogue holds").add_argument("path")
    run = sub.add_parser("exec", help="run a plan and store its cube")
    run.add_argument("plan")
    run.add_argument("out")
    make = sub.add_parser("create_collection", help="a catalogue of the files under a folder")
    make.add_argument("folder")
    make.add_argument("format")
    make.add_argument("out")
    more = sub.add_parser("addo", help="overviews of a stored cube")
    more.add_argument("path")
    more.add_argument("out")
    more.add_argument("--levels", type=int, default=3)
    sub.add_parser("formats", help="known formats of collections")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    from .plans.codec import from_json
    from .sinks.files import _read_text, read_cube, write_cube, write_images
    from .sources.catalog import Collection, collection_formats, create_collection

    if a.command == "info":
        c = Collection.open(spark, a.path)
        print({**c.extent(), "images": c.images.count(), "bands": [r["name"] for r in c.bands.collect()]})
    elif a.command == "exec":
        write_cube(from_json(spark, _read_text(spark, a.plan)), a.out)
    elif a.command == "create_collection":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(a.folder).select("path")
        create_collection(files, a.format).save(a.out)
    elif a.command == "addo":
        write_images(read_cube(spark, a.path), a.out, overviews=a.levels)
    else:
        print("\n".join(collection_formats()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
