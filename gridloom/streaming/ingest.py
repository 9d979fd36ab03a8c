"""Streams: composites over event time, and catalogues that grow as files arrive."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import reducers as R
from ..grid import Grid
from ..sources.points import clean
from ..timeaxis import SECONDS


def windowed_cells(events: DataFrame, grid: Grid, time: str, x: str, y: str, bands: Mapping[str, tuple[str, str]], late: str = "1 day") -> DataFrame:
    """Cells of a stream of points: event-time windows as long as the grid's steps, and its rows and columns. Rows that
    come later than `late` after the newest are left out, and so are rows before or after the grid's steps."""
    g = grid
    if g.unit not in SECONDS:
        raise ValueError("a window has a fixed length: steps of weeks at most")
    start = f"{g.t0.epoch() % (g.dt.n * SECONDS[g.unit])} seconds"
    own = events.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", late)
    seconds = F.col("_ts").cast("double")
    cells = own.where((seconds >= g.t0.epoch()) & (seconds < g.time(g.nt).epoch())).select(
        F.window("_ts", f"{g.dt.n * SECONDS[g.unit]} seconds", startTime=start).alias("w"), F.floor((g.top - F.col(y)) / g.dy).cast("int").alias("iy"),
        F.floor((F.col(x) - g.left) / g.dx).cast("int").alias("ix"), *[clean(F.col(c)).alias(f"_{b}") for b, (_, c) in bands.items()],
    )
    cells = cells.where(F.col("iy").between(0, g.ny - 1) & F.col("ix").between(0, g.nx - 1))
    step = F.floor((F.unix_timestamp(F.col("w.start")) - g.t0.epoch()) / (g.dt.n * SECONDS[g.unit])).cast("int")
    return cells.groupBy("w", "iy", "ix").agg(*[R.plain(r, F.col(f"_{b}")).alias(b) for b, (r, _) in bands.items()]).select(step.alias("it"), "iy", "ix", *bands)


def append_files(listing: DataFrame, add: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch of new files to add, once: the growing form of adding images to a catalogue."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            add(df)

    return listing.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
