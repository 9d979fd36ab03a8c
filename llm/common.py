"""Shared plumbing: scratch tables in the shared folder, Arrow batches cut to bounded pieces, byte-level kernels.

Kernels work on the contiguous UTF-8 buffer of an Arrow string column, so that the cost of Python is paid per piece
of a few megabytes and not per word.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once (one longer document is a piece of its own): kernels take up to some
#: hundred times as much.
PIECE_BYTES = 1 << 19
_U = np.uint64


# ---------------------------------------------------------------- Spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only where it is unset and Spark runs in one
    process, a temporary one; on a cluster other machines could not read that."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="scratch-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found


_written: list[tuple[SparkSession, str]] = []


def saved(df: DataFrame) -> DataFrame:
    """Writes df to the shared scratch folder and reads it back: cuts the lineage, and a lost executor costs nothing
    that was written. Scratch tables go when the driver ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_drop)
    _written.append((spark, path))
    # shuffle files of the finished job go as soon as the driver knows that nothing refers to them
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more: all that was made of them is itself written."""
    for df in tables:
        _delete(df.sparkSession, df._scratch)


def _drop() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already; the folder is scratch space
            return


def fresh(df: DataFrame) -> str:
    """A prefix that no column of df begins with."""
    out = "_"
    while any(c.startswith(out) for c in df.columns):
        out += "_"
    return out


def unsigned_crc(column: str) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


# ---------------------------------------------------------------- pieces of Arrow batches


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]] if len(off) else data[:0], off - off[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches between documents so that no piece has more than limit bytes of text, but for single longer ones."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, off = utf8(batch.column(column))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def map_text(df: DataFrame, f: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict], schema, column: str = "text", limit: int = PIECE_BYTES) -> DataFrame:
    """Runs f(piece, bytes, offsets) -> columns over pieces of df."""

    def run(batches):
        for piece in pieces(batches, column, limit):
            yield to_batch(f(piece, *utf8(piece.column(column))))

    return df.mapInArrow(run, schema)


def to_batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def binaries(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


# ---------------------------------------------------------------- hashes of ranges of bytes

MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(MULTIPLIER, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.empty(max(n, 1 << 16), np.uint64)
        known[0], k = 1, 1
        while k < len(known):
            m = min(k, len(known) - k)
            known[k : k + m] = known[:m] * _U(pow(base, k, 1 << 64))
            k += m
        if n <= 4 * PIECE_BYTES:
            _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class RangeHash:
    """64-bit hashes of any ranges of a sequence in constant time each: a prefix sum of value times multiplier power."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * powers(MULTIPLIER, len(values)), out=self.sums[1:])
        self.back = powers(_INVERSE, len(values) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def byte_hash(data: np.ndarray) -> RangeHash:
    return RangeHash(BYTE_VALUES[data])


# ---------------------------------------------------------------- words

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word [^\\x20\\x09-\\x0D]+, and for each document the index of its first word."""
    inside = ~SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def runs(per_doc: np.ndarray) -> np.ndarray:
    """For counts by document, the document of each item."""
    return np.repeat(np.arange(len(per_doc)), per_doc)


def seen_before(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items given in order of documents: whether the same key came earlier in the document, and whether it comes
    there twice or more."""
    order = np.lexsort((key, doc))
    same = np.zeros(len(key), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    more = same.copy()
    more[:-1] |= same[1:]
    earlier, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order], twice[order] = same, more
    return earlier, twice


def counted(at: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of the sorted positions lie in each document."""
    return np.diff(np.searchsorted(at, off))
