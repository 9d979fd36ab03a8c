"""Suffix-array deduplication: a byte goes if a string of LENGTH bytes that covers it also starts earlier (in a smaller
document, or before in the same one), judged on the input.

The suffix array is built as by a difference cover, distributed. A sample of suffixes is chosen so that every window
of LENGTH bytes holds one at a place that its bytes alone decide; so one key a suffix does, where the residues of a
fixed cover would need one for each of its elements. Suffixes are compared to the depth of LENGTH only:

1. Sampled suffixes are named by their first K bytes. Names that occur once need no further comparison and are dropped.
2. Of those that remain, suffixes whose windows have one 64-bit hash, all bytes of all of them, are settled by the first
   of them, with no comparison of bytes.
3. The others meet by name. There sampled suffixes are sorted as triples: three words of their bytes are named by rank,
   and one sort of the names, of fixed depth, stands in for the recursion.
4. Remaining suffixes, those that begin l bytes before a sampled one, are merged by the l bytes and the rank of the
   sampled suffix that follows.
5. Adjacent prefixes are compared: where LENGTH bytes agree, all but the earliest suffix are covered.

Names with very many different surroundings are not gathered: each of their windows is a row of its own, grouped by hash.

Defined cases: a null text is empty. Texts shorter than LENGTH bytes keep all. Rows without a doc_id keep all. Rows that
repeat take no bytes from each other. Rows of one doc_id with different texts are one document, and a string starts
where it starts in any of them: those that start it at the least place keep it, later places lose it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import marked_runs, slide_first
from .common import byte_hash, discard, map_text, mix, runs, saved, table

LENGTH = 100
K = 24
#: Different surroundings of a name, above which its windows go as rows.
HOT = 20_000
#: Sampled suffixes that are sorted at once, or one name's.
CHUNK = 40_000
_U = np.uint64


class Sample:
    """Sampled suffixes of a piece: where they are, and the first and last windows that they stand for."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int, k: int):
        self.hash = byte_hash(data)
        m = len(data) - length + 1
        if m <= 0:
            self.at = self.low = self.high = self.doc = np.zeros(0, np.int64)
        else:
            grams = np.arange(len(data) - k + 1)
            first = slide_first(self.hash(grams, grams + k), length - k + 1)
            ends = np.repeat(off[1:], np.diff(off))[:m]
            begin = np.flatnonzero(np.arange(m) + length <= ends)
            first = first[begin]
            new = np.ones(len(first), bool)
            new[1:] = first[1:] != first[:-1]
            self.at, self.low = first[new], begin[new]
            self.high = begin[np.append(new[1:], True)[: len(new)]]
            self.doc = np.searchsorted(off, self.at, side="right") - 1
        self.name = self.hash(self.at, self.at + k)
        self.around = mix(self.hash(self.low, self.high + length) + (self.at - self.low).astype(_U))
        #: place in the document, and how far before it its first and last windows begin
        self.code = (self.at - off[self.doc]) << 16 | (self.at - self.low) << 8 | (self.at - self.high)


def _ranked(matrix: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of bytes (within groups, if first names these), and for each in that order how many bytes it
    shares with the one before (-1 at the start of a group). Rows are triples of words; words are named by rank."""
    n, width = matrix.shape
    word = -(-width // 3)
    wide = np.zeros((n, 3 * word), np.uint8)
    wide[:, :width] = matrix
    names = [np.unique(np.ascontiguousarray(wide[:, i * word : (i + 1) * word]).view(f"V{word}").ravel(), return_inverse=True)[1] for i in range(3)]
    order = np.lexsort((*names[::-1], *([] if first is None else [first])))
    here = matrix[order]
    other = here[1:] != here[:-1]
    shared = np.full(n, -1, np.int64)
    shared[1:] = np.where(other.any(1), other.argmax(1), width)
    if first is not None:
        shared[1:][first[order][1:] != first[order][:-1]] = -1
    return order, shared


def covered(name: np.ndarray, doc: np.ndarray, code: np.ndarray, bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows (row, first and last distance before the sampled suffix) whose bytes start earlier among the rows."""
    n, most = len(name), length - 1
    far, near = code >> 8 & 0xFF, code & 0xFF
    left, right = np.zeros((n, most), np.uint8), np.zeros((n, length), np.uint8)
    for i, body in enumerate(bodies):
        b = np.frombuffer(body, np.uint8)
        left[i, : far[i]] = b[: far[i]][::-1]
        right[i, : len(b) - far[i]] = b[far[i] :]
    order, shared = _ranked(right, name)
    order_left, shared_left = _ranked(left)
    when = np.empty(n, np.int64)
    when[np.lexsort((code, doc))] = np.arange(n)
    hit = np.zeros((n, most + 2), bool)
    rank, rank_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(int(near.min(initial=0)), int(far.max(initial=-1)) + 1):  # noqa: E741
        rows = np.flatnonzero((near <= l) & (l <= far))
        if len(rows) < 2:
            continue
        rank[order] = np.cumsum(shared < length - l)
        rank_left[order_left] = np.cumsum(shared_left < l)
        key = rank[rows] * (n + 1) + rank_left[rows]
        by = np.lexsort((when[rows], key))
        same = key[by][1:] == key[by][:-1]
        # equal windows at one place are those of repeated rows
        begins = np.flatnonzero(np.concatenate([[True], ~same]))
        head = np.repeat(by[begins], np.diff(np.append(begins, len(by))))
        twin = (doc[rows[by]] == doc[rows[head]]) & (code[rows[by]] == code[rows[head]])
        hit[rows[by[1:][same & ~twin[1:]]], l + 1] = True
    edge = np.diff(hit.astype(np.int8), axis=1, append=0)
    row, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return row, start, end - 1


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(v) if v.is_valid else 0 for v in column], np.int64)
    return np.asarray(column.flatten(), np.int64), counts


class Repeats:
    def __init__(self, docs: DataFrame, length: int = LENGTH, k: int = K):
        self.docs, self.length, self.k = docs.select("doc_id", F.xxhash64("text").alias("row"), "text"), length, k
        self.scratch: list[DataFrame] = []

    def _saved(self, df: DataFrame) -> DataFrame:
        self.scratch.append(saved(df))
        return self.scratch[-1]

    def _rows(self, all_: bool) -> DataFrame:
        length, k = self.length, self.k

        def run(piece: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> dict:
            x = Sample(data, off, length, k)
            if not all_:
                return {"name": x.name.astype(np.int64)}
            take = pa.array(x.doc)
            return {"name": x.name.astype(np.int64), "doc_id": piece.column("doc_id").take(take), "row": piece.column("row").take(take), "code": x.code, "around": x.around.astype(np.int64)}

        return map_text(self.docs.where("doc_id IS NOT NULL"), run, "name long" + ", doc_id long, row long, code long, around long" * all_)

    def ranges(self) -> DataFrame:
        """doc_id, row, first, last: windows (by first byte) that start earlier, in ranges."""
        length, k = self.length, self.k
        often = self._saved(self._rows(False).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"))
        rows = self._saved(self._rows(True).join(often, "name"))
        groups = self._saved(rows.groupBy("name", "around").agg(F.min(F.struct("doc_id", "code", "row")).alias("least")))
        later = rows.join(groups, ["name", "around"]).where("doc_id > least.doc_id OR code > least.code")
        start, place = F.expr("(code >> 8) & 255"), F.expr("code >> 16")
        settled = later.select("doc_id", "row", (place - start).alias("first"), (place - F.expr("code & 255")).alias("last"))
        mixed = groups.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", (F.col("n") > HOT).alias("hot"))
        asked = groups.join(mixed, "name").select("least.doc_id", "least.row", "least.code", "hot")
        asked = self._saved(asked.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("code")).alias("code"), F.sort_array(F.collect_set(F.when(F.col("hot"), F.col("code")))).alias("hot")))
        here = self.docs.join(asked, ["doc_id", "row"])

        def bodies(piece: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> dict:
            code, counts = _lists(piece.column("code"))
            hot, hot_counts = _lists(piece.column("hot"))
            doc = runs(counts)
            cold = ~np.isin(doc << 48 | code, runs(hot_counts) << 48 | hot)
            doc, code = doc[cold], code[cold]
            at = off[doc] + (code >> 16)
            s, e = at - (code >> 8 & 0xFF), at - (code & 0xFF) + length
            raw = data.tobytes()
            return {
                "name": byte_hash(data)(at, at + k).astype(np.int64), "doc_id": piece.column("doc_id").take(pa.array(doc)), "row": piece.column("row").take(pa.array(doc)), "code": code,
                "body": pa.array([raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)], pa.binary()),
            }

        def windows(piece: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> dict:
            hot, counts = _lists(piece.column("hot"))
            n = (hot >> 8 & 0xFF) - (hot & 0xFF) + 1
            at = np.repeat(off[runs(counts)] + (hot >> 16) - (hot >> 8 & 0xFF), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc = np.repeat(runs(counts), n)
            return {"bytes": byte_hash(data)(at, at + length).astype(np.int64), "doc_id": piece.column("doc_id").take(pa.array(doc)), "row": piece.column("row").take(pa.array(doc)), "first": at - off[doc]}

        def sort(batches):
            held: list[pd.DataFrame] = []

            def done(pdf: pd.DataFrame) -> pd.DataFrame:
                row, first, last = covered(pdf["name"].to_numpy(), pdf["doc_id"].to_numpy(), pdf["code"].to_numpy(), pdf["body"].tolist(), length)
                at = pdf["code"].to_numpy()[row] >> 16
                return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[row], "row": pdf["row"].to_numpy()[row], "first": at - last, "last": at - first})

            for pdf in batches:
                held.append(pdf)
                if sum(map(len, held)) >= CHUNK:
                    whole = pd.concat(held, ignore_index=True)
                    tail = whole["name"] == whole["name"].iat[-1]
                    if not tail.all():
                        yield done(whole[~tail].reset_index(drop=True))
                        whole = whole[tail]
                    held = [whole]
            if held:
                yield done(pd.concat(held, ignore_index=True))

        meet = map_text(here, bodies, "name long, doc_id long, row long, code long, body binary").repartition("name").sortWithinPartitions("name")
        found = settled.union(meet.mapInPandas(sort, "doc_id long, row long, first long, last long"))
        if not asked.where(F.size("hot") > 0).isEmpty():
            rows = self._saved(map_text(here.where(F.size("hot") > 0), windows, "bytes long, doc_id long, row long, first long"))
            least = rows.groupBy("bytes").agg(F.min(F.struct("doc_id", "first")).alias("least"))
            again = rows.join(least, "bytes").where("doc_id > least.doc_id OR first > least.first")
            found = found.union(again.select("doc_id", "row", "first", F.col("first").alias("last")))
        return found

    def removals(self) -> DataFrame:
        """doc_id and row, and first and last of its ranges as arrays."""
        ranges = saved(self.ranges())
        discard(*self.scratch)
        return ranges.groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "last")).alias("r")).select("doc_id", "row", "r.first", "r.last")


def removed_bytes(piece: pa.RecordBatch, data: np.ndarray, off: np.ndarray, length: int) -> np.ndarray:
    first, counts = _lists(piece.column("first"))
    last, _ = _lists(piece.column("last"))
    base = np.repeat(off[:-1], counts)
    return marked_runs(len(data), first + base, last + base + length)


def dedup(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""

    def run(piece: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> dict:
        gone = removed_bytes(piece, data, off, length)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1] | np.isin(np.arange(1, len(gone)), off) if len(gone) else False
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off])
        kept = [hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)]
        return {"doc_id": piece.column("doc_id"), "n_bytes": np.diff(off), "n_removed": total(gone), "n_spans": total(begins), "kept_sha256": kept}

    repeats = Repeats(docs, length, k)
    return map_text(repeats.docs.join(repeats.removals(), ["doc_id", "row"], "left"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """docs with the covered bytes removed from their texts, and n_chars brought up to date. A character goes if one of
    its bytes does. Texts of which nothing is left are empty."""
    names = docs.columns
    rest = [c for c in names if c != "text"]
    found = Repeats(docs, length, k).removals()

    def run(piece: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> dict:
        gone = removed_bytes(piece, data, off, length)
        lead = np.flatnonzero(data & 0xC0 != 0x80)
        if len(lead):
            gone = np.repeat(np.logical_or.reduceat(gone, lead), np.diff(np.append(lead, len(data))))
        out = [data[a:b][~gone[a:b]].tobytes().decode() if ok.as_py() else None for a, b, ok in zip(off[:-1], off[1:], piece.column("text").is_valid(), strict=True)]
        columns = dict(zip(rest, piece.column("rest").flatten(), strict=True)) | {"text": pa.array(out, pa.string())}
        if "n_chars" in columns:
            hit = piece.column("first").is_valid().to_pylist()
            columns["n_chars"] = pa.array([len(t) if h and t is not None else n for t, h, n in zip(out, hit, columns["n_chars"].to_pylist(), strict=True)], pa.int64())
        return {c: columns[c] for c in names}

    # the other columns travel as one, whatever their names
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), "text", F.xxhash64("text").alias("own"))
    joined = whole.join(found, (F.col("rest.doc_id") == F.col("doc_id")) & (F.col("own") == F.col("row")), "left").select("rest", "text", "first", "last")
    return map_text(joined, run, docs.schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
