"""Best-fit packing by minimum bin slack.

All that the choice of bins depends on is how many pieces there are of each length, at most `capacity` numbers. For
these the driver makes patterns: for a bin with the longest length left, a bitset subset-sum dynamic programme over the
available lengths finds the fullest feasible combination, which is removed as many times as it fits into what is left. Each pattern uses up at
least one length (or is the last), and has fewer than sqrt(2 * capacity) different lengths, so the plan is small
whatever the corpus. Pieces find their places by their rank among those of equal length: ranks are prefix sums of counts by
partition, so no length, however common, meets in one task.

Defined cases: a null text is an empty one, which is the end token alone. Repeated rows are packed each for itself;
pieces of rows with the same doc_id carry the same (doc_id, piece).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces as text_pieces
from .common import saved, table, utf8
from .pretokens import Remembering

CAPACITY = 1024
END = 2
#: Numbers of lengths in tasks, three integers each, that are broadcast.
BROADCAST_ROWS = 1 << 18


# ---------------------------------------------------------------- the plan


@dataclass
class Plan:
    """Ranges of ranks by length, and where they go: bins of a pattern are numbered from `bin`; in each of them `times`
    pieces of the length stand one after the other from `offset`."""

    key: np.ndarray
    bin: np.ndarray
    times: np.ndarray
    offset: np.ndarray
    bins: int

    #: Ranks are below it.
    RANKS = 1 << 48

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, length * self.RANKS + rank, side="right") - 1
        r = rank - self.key[k] % self.RANKS
        return self.bin[k] + r // self.times[k], self.offset[k] + length * (r % self.times[k])


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """A combination of available lengths whose sum is the largest that fits: reachable sums are the bits of an
    integer, shifted by each length in powers of two of its copies; the way back tells the combination, in which long
    lengths come first, so that short ones stay for later bins."""
    full = (1 << (capacity + 1)) - 1
    steps, bits = [], 1
    for length in sorted(counts):
        left, copies = min(counts[length], capacity // length), 1
        while left:
            take = min(copies, left)
            steps.append((length, take, bits))
            bits |= bits << (length * take) & full
            left -= take
            copies *= 2
    at, out = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        size = length * take
        if size <= at and before >> (at - size) & 1:
            out[length] = out.get(length, 0) + take
            at -= size
    return out


def seeded(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest length, and with it the fullest combination for the rest of the bin. The plain form uses up short
    lengths on bins that longer ones could fill, and leaves long ones without a match."""
    longest = max(counts)
    rest = {k: n - (k == longest) for k, n in counts.items() if k <= capacity - longest and n - (k == longest)}
    out = {longest: 1}
    for length, n in fullest(rest, capacity - longest).items():
        out[length] = out.get(length, 0) + n
    return out


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    left = {k: n for k, n in counts.items() if n}
    used: dict[int, int] = {}
    rows: list[tuple[int, int, int, int]] = []
    bins = 0
    while left:
        pattern = seeded(left, capacity)
        again = min(left[k] // n for k, n in pattern.items())
        offset = 0
        for length, n in pattern.items():
            rows.append((length * Plan.RANKS + used.get(length, 0), bins, n, offset))
            used[length] = used.get(length, 0) + n * again
            offset += length * n
            left[length] -= n * again
            if not left[length]:
                del left[length]
        bins += again
    columns = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return Plan(*columns, bins)


# ---------------------------------------------------------------- documents to pieces


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens; only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    out, at = [], 0
    while at < n:
        size = first if at == 0 else capacity
        out.append((at, size))
        at += size
    return out


class Encoder:
    """Encodes as the tokenizers library does. Its added tokens (special ones among them) are strings that it finds in
    a text before anything else; texts that hold one go to the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.plain = remembering(path)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and where each document's begin."""
        ids, at = self.plain.encode(data, off)
        raw = data.tobytes()
        if not any(t in raw for t in self.added):
            return ids, at
        own = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for d, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            if any(raw.find(t, a, b) >= 0 for t in self.added):
                own[d] = np.array(self.library.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.int32)
        return np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])


def remembering(path: str) -> Remembering:
    """Encodes texts without added tokens by the library, a match of the pattern at a time."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    encode = lambda text: library.encode_batch_fast([text], add_special_tokens=False)[0].ids
    line = encode("\n")

    def new(matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # words go as lines of one text, as a call for each costs more than its encoding; what has other white
        # space than a first space goes by itself
        texts = [m.decode() for m in matches]
        plain = np.array([t.strip() == (t[1:] if t[0] == " " else t) != "" for t in texts], bool)
        ids = np.array(encode("\n".join([t for t, p in zip(texts, plain.tolist(), strict=True) if p])), np.int32)
        ends = np.append(np.flatnonzero(ids == line[0]), len(ids))
        if len(line) != 1 or len(ends) != max(1, plain.sum()):
            plain[:], ids, ends = False, ids[:0], np.zeros(1, np.int64)
        sizes = np.zeros(len(texts), np.int64)
        if plain.any():
            sizes[plain] = np.diff(ends, prepend=-1) - 1
        others = {i: encode(texts[i]) for i in np.flatnonzero(~plain).tolist()}
        for i, own in others.items():
            sizes[i] = len(own)
        flat = np.zeros(sizes.sum(), np.int32)
        flat[np.repeat(plain, sizes)] = ids[ids != line[0]]
        starts = np.cumsum(sizes) - sizes
        for i, own in others.items():
            flat[starts[i] : starts[i] + len(own)] = own
        return sizes, flat

    return Remembering(new)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) for each piece, with the task that cut it (block) and its rank
    there among pieces of equal length (local)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, local long" + ", ids array<int>" * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "local", "ids"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]

    def run(batches):
        encoder, block, seen = Encoder(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in text_pieces(batches, limit=2 << 20):
            ids, at = encoder.encode(*utf8(batch.column("text")))
            rows: list[tuple] = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                whole = np.append(ids[a:b], end).astype("<u4")
                for k, (start, size) in enumerate(cut(len(whole), capacity)):
                    own = whole[start : start + size]
                    rows.append((doc, k, start, size, zlib.crc32(own.tobytes()), block, seen[size], *([own.tolist()] if with_ids else [])))
                    seen[size] += 1
            columns = list(zip(*rows, strict=True)) or [()] * (7 + with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=False)], names=names[: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces (length from 1 to capacity, block and local as pieces() gives them)."""
    rows = saved(cut_pieces)
    per_block = rows.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    firsts = saved(per_block.withColumn("first", F.coalesce(before, F.lit(0))))
    counts = {int(r["length"]): int(r["n"]) for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = make_plan(counts, capacity)
    # numbers grow with tasks: beyond the bound pieces are dealt out by length and task, of which none has many
    known = firsts.select("length", "block", "first")
    known = F.broadcast(known) if firsts.count() <= broadcast_rows else known.hint("merge")
    ranked = rows.join(known, ["length", "block"]).withColumn("rank", F.col("first") + F.col("local"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("sequence_id", "offset"), plan.place(length.to_numpy(), rank.to_numpy()), strict=True)))

    out = ranked.withColumn("at", place("length", "rank"))
    kept = [c for c in cut_pieces.columns if c not in ("block", "local")]
    return out.select(*kept, F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
