"""Substring deduplication by compaction of a sparse De Bruijn graph of word k-mers.

Nodes are the k-mers at anchors that content defines, edges the words from one anchor to the end of the next. Edges that
only ever occur together, one after the other, have a node between them that does not branch: a join of edges with
their only successors and predecessors compacts them, and a compacted path stands in each of its documents
with the same words. Its least document keeps it, the others lose it; its source coordinates (document, first and last
word) say where. Windows that reach over the ends of paths are verified by themselves: those of equal words
meet, and all lose but the least document's.

Repeats are between different documents (smaller doc_id keeps), judged on the input. Equality is that of 64-bit hashes
of word sequences.

Defined cases: a null or empty text has no word. Documents shorter than a window keep all. Rows that repeat (doc_id and
text) never remove each other; of one doc_id with different texts, each row is judged by itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import anchors, marked_runs, slide
from .common import RangeHash, byte_hash, discard, map_text, runs, saved, table, words

WINDOW = 50
K = 10
_U = np.uint64
#: What is known of the edge that begins at an anchor.
NONE, FIRST, LATER, CHAINED = 0, 1, 2, 4
#: What is known of an anchor: a smaller document has it.
TARGET = 8


class Words:
    """Words of a piece, their hashes, and the anchors among their k-mers."""

    def __init__(self, data: np.ndarray, off: np.ndarray, window: int, k: int):
        self.ws, self.we, self.first = words(data, off)
        self.n = np.diff(self.first)
        self.doc = runs(self.n)
        self.hash = RangeHash(byte_hash(data)(self.ws, self.we))
        m = len(self.ws) - k + 1
        at = np.arange(max(m, 0))
        grams = self.hash(at, at + k) if m > 0 else np.zeros(0, np.uint64)
        whole = self.doc[k - 1 :] == self.doc[: max(m, 0)] if m > 0 else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        chosen = anchors(grams[at], self.doc[at], window - k + 1)
        self.at = at[chosen]
        self.node = grams[self.at]
        self.anchor_doc = self.doc[self.at]
        linked = self.anchor_doc[1:] == self.anchor_doc[:-1]
        self.edge = np.zeros(len(self.at), np.uint64)
        if len(linked):
            self.edge[:-1] = np.where(linked, self.hash(self.at[:-1], self.at[1:] + k), _U(0))
        # the least k-mer of each window: it is an anchor wherever the words of the window stand
        self.least = slide(grams, window - k + 1, np.minimum) if len(self.ws) >= window else np.zeros(0, np.uint64)
        self.next = np.zeros(len(self.at), np.uint64)
        if len(linked):
            self.next[:-1] = np.where(linked, self.edge[1:], _U(0))


def paths(at: np.ndarray, doc: np.ndarray, state: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and state of each compacted path, a run of chained edges, among anchors in order."""
    edge = np.flatnonzero((state > 0) & ((state & 3) > 0))
    starts = np.ones(len(edge), bool)
    starts[1:] = ~(((state[edge[:-1]] & CHAINED) > 0) & (edge[1:] == edge[:-1] + 1) & (doc[edge[1:]] == doc[edge[:-1]]))
    ends = np.append(starts[1:], True)[: len(edge)]
    return at[edge[starts]], at[edge[ends] + 1] + k, state[edge[starts]] & 3


def unsettled(pos: np.ndarray, state: np.ndarray, window: int, k: int) -> np.ndarray:
    """Which anchors of one row, that a smaller document has as well, can be the least of a window that no removed path
    covers: one that reaches over an end of the path."""
    first, end, kind = paths(pos, np.zeros(len(pos), np.int64), state, k)
    out = (state & TARGET) > 0
    first, end = first[kind == LATER], end[kind == LATER]
    if len(first):
        path = np.searchsorted(first, pos - (window - k), side="right") - 1
        # paths come in order of both ends, so that the last that begins early enough reaches farthest
        out &= (path < 0) | (end[np.maximum(path, 0)] < pos + window)
    return out


def _places(x: Words, column: pa.Array) -> np.ndarray:
    """Words at the positions that a list column gives for each row of the piece."""
    counts = np.array([len(v) if v.is_valid else 0 for v in column], np.int64)
    return np.asarray(column.flatten(), np.int64) + np.repeat(x.first[:-1], counts)


def settle(x: Words, piece: pa.RecordBatch, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (by first word) that a path removes, and those that are left to verify."""
    begins = np.arange(len(x.least))
    whole = x.doc[window - 1 :] == x.doc[: len(begins)] if len(begins) else np.zeros(0, bool)
    of = np.full(len(x.ws) + 1, -1, np.int64)
    of[_places(x, piece.column("pos"))] = np.asarray(piece.column("state").flatten(), np.int64)
    first, end, kind = paths(x.at, x.anchor_doc, of[x.at], k)
    cover = (end - first >= window) & (kind == LATER)
    removed = marked_runs(len(begins) + 1, first[cover], end[cover] - window + 1)[:-1] & whole
    grams = x.hash(at := _places(x, piece.column("need")), at + k)
    return removed, whole & ~removed & np.isin(x.least, grams)


def removed_words(x: Words, piece: pa.RecordBatch, window: int, k: int) -> np.ndarray:
    removed, _ = settle(x, piece, window, k)
    start = np.concatenate([np.flatnonzero(removed), _places(x, piece.column("at"))])
    return marked_runs(len(x.ws), start, start + window) if len(x.ws) else np.zeros(0, bool)


class Graph:
    """Occurrences of repeated nodes, and what is known of their edges."""

    def __init__(self, docs: DataFrame, window: int = WINDOW, k: int = K):
        self.window, self.k = window, k
        self.docs = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")

    def occurrences(self) -> DataFrame:
        window, k = self.window, self.k

        def run(piece: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> dict:
            x = Words(data, off, window, k)
            take = pa.array(x.anchor_doc)
            return {
                "doc_id": piece.column("doc_id").take(take), "row": piece.column("row").take(take), "pos": (x.at - x.first[x.anchor_doc]).astype(np.int32),
                "node": x.node.astype(np.int64), "edge": x.edge.astype(np.int64), "next": x.next.astype(np.int64),
            }

        # rows without an id can't be the smaller document of another
        known = self.docs.where(F.col("doc_id").isNotNull())
        all_ = saved(map_text(known, run, "doc_id long, row long, pos int, node long, edge long, next long"))
        # written first, so that Spark can split the rows of a common node where they meet it
        nodes = saved(all_.groupBy("node").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("node", F.col("a").alias("least_of_node")))
        rows = saved(all_.join(nodes, "node"))
        discard(all_, nodes)
        return rows

    def compacted(self, rows: DataFrame) -> DataFrame:
        """For each repeated edge: its least document, and whether it is chained with its only successor."""
        edges = rows.where("edge <> 0").groupBy("edge").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"), F.min("next").alias("x"), F.max("next").alias("y"))
        edges = saved(edges.where("least < most"))
        before = rows.where("edge <> 0 AND next <> 0").groupBy(F.col("next").alias("to")).agg(F.count(F.lit(1)).alias("m"), F.min("edge").alias("p"), F.max("edge").alias("q"))
        only = edges.where("x = y AND x <> 0 AND x <> edge").select("edge", F.col("x").alias("to"))
        chained = only.join(before, "to").where("p = q AND p = edge").join(edges.select(F.col("edge").alias("to"), F.col("n").alias("k")), "to").where("m = k").select("edge", F.lit(True).alias("chained"))
        return edges.select("edge", "least").join(chained, "edge", "left")

    def known(self) -> DataFrame:
        """For each row with repeated anchors: their places and states, in order."""
        rows = self.occurrences()
        # written first, so that Spark can split the rows of a common edge; last anchors, which begin none, meet nothing
        edges = saved(self.compacted(rows))
        found = rows.where("edge <> 0").join(edges, "edge", "left").unionByName(rows.where("edge = 0"), allowMissingColumns=True)
        state = F.when(F.col("least").isNull(), NONE).otherwise(F.when(F.col("least") < F.col("doc_id"), LATER).otherwise(FIRST) + F.when(F.col("chained"), CHAINED).otherwise(0))
        state = (state + F.when(F.col("least_of_node") < F.col("doc_id"), TARGET).otherwise(0)).cast("int")
        states = found.select("doc_id", "row", F.struct("pos", state.alias("state"), "node").alias("a"))
        arrays = saved(states.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("a")).alias("a")).select("doc_id", "row", "a.pos", "a.state", "a.node"))
        window, k = self.window, self.k

        def open_nodes(batches):
            for pdf in batches:
                left = [np.asarray(node)[unsettled(np.asarray(pos, np.int64), np.asarray(state, np.int64), window, k)] for pos, state, node in zip(pdf["pos"], pdf["state"], pdf["node"], strict=True)]
                yield pd.DataFrame({"node": np.unique(np.concatenate([np.zeros(0, np.int64), *left]))})

        nodes = saved(arrays.select("pos", "state", "node").mapInPandas(open_nodes, "node long").distinct())
        need = rows.join(nodes, "node").groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("need"))
        known = saved(arrays.drop("node").join(need, ["doc_id", "row"], "left"))
        discard(rows, edges, arrays, nodes)
        return known

    def removals(self) -> DataFrame:
        """doc_id, row, pos, state and at: what final() needs of each row with repeated anchors."""
        known, window, k = self.known(), self.window, self.k

        def run(piece: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> dict:
            x = Words(data, off, window, k)
            at = np.flatnonzero(settle(x, piece, window, k)[1])
            take = pa.array(x.doc[at])
            return {"doc_id": piece.column("doc_id").take(take), "row": piece.column("row").take(take), "at": (at - x.first[x.doc[at]]).astype(np.int32), "words": x.hash(at, at + window).astype(np.int64)}

        open_ = saved(map_text(self.docs.join(known, ["doc_id", "row"]), run, "doc_id long, row long, at int, words long"))
        least = saved(open_.groupBy("words").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most"))
        gone = open_.join(least, "words").where("least < doc_id").groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("at")).alias("at"))
        out = saved(known.join(gone, ["doc_id", "row"], "left"))
        discard(known, open_, least)
        return out


def dedup(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs."""
    graph = Graph(docs, window, k)

    def run(piece: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> dict:
        x = Words(data, off, window, k)
        gone = removed_words(x, piece, window, k)
        raw, out = data.tobytes(), []
        for a, b in zip(x.first[:-1], x.first[1:], strict=True):
            out.append(hashlib.sha256(b" ".join(raw[s:e] for s, e, g in zip(x.ws[a:b].tolist(), x.we[a:b].tolist(), gone[a:b].tolist(), strict=True) if not g)).hexdigest())
        total = np.concatenate([[0], np.cumsum(gone)])
        return {"doc_id": piece.column("doc_id"), "n_words": x.n, "n_removed": total[x.first[1:]] - total[x.first[:-1]], "kept_sha256": out}

    return map_text(graph.docs.join(graph.removals(), ["doc_id", "row"], "left"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
