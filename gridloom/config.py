"""Settings of the library, and what they mean to Spark."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Options:
    #: Shuffle partitions; Spark's own if None.
    parallel: int | None = None
    default_chunksize: tuple[int, int, int] = (1, 256, 256)
    compression: str = "zstd"
    show_progress: bool = False
    debug: bool = False


_options = Options()


def options(spark: SparkSession | None = None, **changes) -> Options:
    """The settings, after changes; with a session, those that Spark knows are put there."""
    global _options
    unknown = set(changes) - {f.name for f in fields(Options)}
    if unknown:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    _options = replace(_options, **changes)
    if spark is not None:
        if _options.parallel:
            spark.conf.set("spark.sql.shuffle.partitions", str(_options.parallel))
        spark.conf.set("spark.sql.parquet.compression.codec", _options.compression)
    return _options
