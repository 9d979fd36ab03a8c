"""N-gram Jaccard join, size-aware: documents are sets of word shingles, two of them link when
PERCENT * union <= 100 * intersection, and links make components.

Equal sets are one node. A node of n shingles can lack at most n - need(n) of them in a set that it links with, so
that all others stand in a second set too. Two filters follow, and neither loses a link:

1. Of a part of the universe, chosen by hash, each shingle is held against all: nodes too many of whose chosen
   shingles stand in no second set are out (should all shingles they may lack lie in that part, the rest is shared still).
2. The same is asked of all shingles of the nodes that are left.

Heavy sets: inverted lists of shingles are scanned. A node is posted in the lists of its rarest shingles, so many that
sets that link share one of them; how far down its order a shingle stands bounds the shingles that are common beyond
it, and with that the sizes of sets that it can link with. A list's owners are held against one of them, in rounds that
end when they bring few links more; then owners of a list that are still in different components, and whose bounds
admit it, meet each other, all of them. Intersections are counted exactly.

Light sets: all subsets of the sizes that an intersection could have are enumerated. Two sets that share a subset of
the size of their intersection meet at it, so that its smallest owner links with all owners that link there at all:
a star, and no pair need be verified.

The boundary between the two is chosen by cost: that size for which the subsets of all smaller nodes and the measured
lists that all larger ones would scan are least together.

Lists are never gathered: their bounds and best owners are aggregates, and owners meet them by joins that Spark splits
where a list is long.

Defined cases: null or empty texts have the empty set, which links with nothing and is its own component. Repeated
rows have equal sets. Rows of one doc_id with different texts are sets of their own, each in the component that its own
links make. Rows without a doc_id are documents like any other: they link, and bridge others. A component is named by
its least doc_id, or null if it has none; one_of_each drops a doc_id if any of its rows has a smaller one in its
component, and keeps all rows of the others, and all rows without a doc_id. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, byte_hash, discard, map_text, mix, runs, saved, table, to_batch, words
from .graph import components

SIZE = 3
PERCENT = 90
#: What holding a node against another costs, in rows of lists or subsets.
VERIFY_COST = 64
#: Sets of more shingles are never light, whatever lists cost: their subsets are too many.
LIGHT_MOST = 24
#: Rounds end when one brings no more links than the first, divided by this.
ENOUGH = 16
#: Ids of documents, 8 bytes each, that are broadcast.
BROADCAST_IDS = 1 << 21
#: Subsets that are made at once, or one node's.
SUBSETS = 1 << 18
_U = np.uint64


# ---------------------------------------------------------------- sets


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, document by document, and where each document's begin. A document of fewer
    words than a shingle has its whole sequence as the one."""
    low = LOWER[data]
    ws, we, first = words(low, off)
    w, n_words = byte_hash(low)(ws, we), np.diff(first)
    doc = runs(n_words)
    if len(w) >= size:
        whole = doc[size - 1 :] == doc[: len(doc) - size + 1]
        h = w[size - 1 :]
        for k in range(size - 2, -1, -1):
            h = mix(w[k : len(w) - size + 1 + k] + mix(h + _U(k + 1)))
        h, at = h[whole], doc[: len(whole)][whole]
    else:
        h, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        own = []
        for d in short:
            x = _U(n_words[d])
            for y in w[first[d] : first[d + 1]]:
                x = mix(np.array([x], np.uint64) + y)[0]
            own.append(x)
        h, at = np.concatenate([h, np.array(own, np.uint64)]), np.concatenate([at, short])
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    h, at = h[new], at[new]
    return h, np.searchsorted(at, np.arange(len(off)))


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def nodes_of(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number for each set, equal for equal sets."""
    return mix(_sums(mix(h ^ _U(0x5851F42D4C957F2D)), first) + mix(np.diff(first).astype(np.uint64))).astype(np.int64)


# ---------------------------------------------------------------- sizes


def light_sizes(size: int, percent: int = PERCENT) -> range:
    """Sizes that the intersection with a linked set can have."""
    return range(-(-percent * size // 100), size + 1)


def subsets(size: int, percent: int = PERCENT) -> int:
    return sum(comb(size, c) for c in light_sizes(size, percent))


def sampling(percent: int = PERCENT) -> int:
    """One in so many shingles is held against all: a node must find over half of these in other sets."""
    rate = 1
    while 5 * rate * (100 - percent) <= 100:
        rate *= 2
    return rate


def boundary(nodes: dict[int, int], scanned: dict[int, int], percent: int = PERCENT) -> int:
    """The largest size of light sets, from the number of nodes of each size and the rows of lists that these meet."""
    heavy = {n: scanned.get(n, 0) + VERIFY_COST * k for n, k in nodes.items()}
    light = {n: subsets(n, percent) * k for n, k in nodes.items()}
    cost = lambda most: sum(light[n] for n in nodes if n <= most) + sum(heavy[n] for n in nodes if n > most)
    return min(range(LIGHT_MOST + 1), key=lambda most: (cost(most), most))


# ---------------------------------------------------------------- keys


def chosen(h: np.ndarray, rate: int) -> np.ndarray:
    return mix(h ^ _U(0x9FB21C651E98DF25)) & _U(rate - 1) == 0


def _light(h: np.ndarray, first: np.ndarray, node: np.ndarray, percent: int) -> dict:
    keys, sizes, owners, ns = [], [], [], []
    for d in range(len(node)):
        own = mix(h[first[d] : first[d + 1]])
        n, total = len(own), own.sum(dtype=np.uint64)
        for c in light_sizes(n, percent):
            left = list(combinations(range(n), n - c))
            gone = own[np.array(left, np.int64).reshape(len(left), n - c)].sum(axis=1, dtype=np.uint64)
            keys.append(mix(total - gone + mix(np.array([c], np.uint64))).astype(np.int64))
            sizes += [c] * len(left)
            owners += [node[d]] * len(left)
            ns += [n] * len(left)
    return {"key": np.concatenate(keys) if keys else np.zeros(0, np.int64), "c": pa.array(sizes, pa.int32()), "v": pa.array(owners, pa.int64()), "n": pa.array(ns, pa.int64())}


# ---------------------------------------------------------------- the join


class Join:
    """Links between different sets of docs (doc_id, text)."""

    def __init__(self, docs: DataFrame, size: int = SIZE, percent: int = PERCENT):
        self.docs, self.size, self.percent = docs.select("doc_id", "text"), size, percent
        self.rate = rate = sampling(percent)
        count = lambda h, f: np.diff(np.concatenate([[0], np.cumsum(chosen(h, rate))])[f])
        self.base = saved(self._map(lambda p, h, f, v: {"doc_id": p.column("doc_id"), "n": np.diff(f).astype(np.int64), "s": count(h, f).astype(np.int64), "v": v}, "doc_id long, n long, s long, v long"))
        #: The least intersection with a linked set.
        self.need = f"(({percent} * n + 99) div 100)"

    def _map(self, f, schema: str, docs: DataFrame | None = None) -> DataFrame:
        size = self.size

        def run(piece: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> dict:
            h, first = shingle_sets(data, off, size)
            return f(piece, h, first, nodes_of(h, first))

        return map_text(self.docs if docs is None else docs, run, schema)

    def candidates(self) -> DataFrame:
        """v, n, doc_id (the least) of the nodes that the first filter leaves."""
        rate = self.rate

        def rows(p: pa.RecordBatch, h: np.ndarray, f: np.ndarray, v: np.ndarray) -> dict:
            use = chosen(h, rate)
            return {"e": h[use].astype(np.int64), "v": np.repeat(v, np.diff(f))[use]}

        all_ = self._map(rows, "e long, v long")
        shared = saved(all_.groupBy("e").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a < b").select("e"))
        # each of the m rows of a node counts its shingles
        found = all_.join(shared, "e").groupBy("v").agg(F.count(F.lit(1)).alias("k"))
        nodes = self.base.where("n > 0").groupBy("v").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("s").alias("s"), F.count(F.lit(1)).alias("m"))
        out = saved(nodes.join(found, "v", "left").where(f"coalesce(k, 0) >= m * (s - (n - {self.need}))").select("v", "n", "doc_id"))
        discard(shared)
        return out

    def sets(self) -> DataFrame:
        """v, n, h (shingle hashes) of these nodes."""
        nodes = self.candidates()
        ids = nodes.select("doc_id").distinct()
        # texts stay where they are if their ids are few; else both sides are dealt out by id
        docs = self.docs.join(F.broadcast(ids) if nodes.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
        # sets of which no row has a doc_id are found by v, among all rows without one
        docs = docs.union(self.docs.where("doc_id IS NULL"))
        pack = lambda p, h, f, v: {"v": v, "h": pa.ListArray.from_arrays(pa.array(f, pa.int32()), pa.array(h.astype(np.int64)))}
        out = saved(self._map(pack, "v long, h array<long>", docs).join(nodes.select("v", "n"), "v").dropDuplicates(["v"]).select("v", "n", "h"))
        discard(nodes)
        return out

    def lists(self, sets: DataFrame) -> DataFrame:
        """key, k (owners of the list), and of each owner v, n and p: how many of its shingles come before in its order,
        the rarest first."""
        rows = sets.select("v", "n", F.explode("h").alias("e"))
        often = saved(rows.groupBy("e").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
        met = rows.join(often, "e").groupBy("v").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", "e"))).alias("x"))
        met = met.withColumn("r", F.size("x").cast("long")).where(f"r >= {self.need}")
        prefix = met.select("v", "n", "r", F.posexplode(F.expr(f"slice(x, 1, int(r - {self.need} + 1))")).alias("j", "x"))
        own = saved(prefix.select("v", "n", (F.col("n") - F.col("r") + F.col("j")).alias("p"), F.col("x.e").alias("key")))
        shared = saved(own.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
        out = saved(own.join(shared, "key").select("key", "k", "v", "n", "p"))
        discard(often, own, shared)
        return out

    def measured(self, sets: DataFrame, lists: DataFrame) -> int:
        """The boundary, by what the lists of small nodes hold."""
        small = f"n <= {LIGHT_MOST}"
        nodes = {r["n"]: r["k"] for r in sets.where(small).groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
        scanned = {r["n"]: r["k"] for r in lists.where(small).groupBy("n").agg(F.sum("k").alias("k")).collect()}
        return boundary(nodes, scanned, self.percent)

    def light_links(self, sets: DataFrame, most: int) -> DataFrame:
        percent = self.percent

        def run(batches):
            for batch in batches:
                h = batch.column("h")
                off, values, v = np.asarray(h.offsets), np.asarray(h.values).astype(np.uint64), np.asarray(batch.column("v"))
                total = np.cumsum([subsets(int(n), percent) for n in np.diff(off)])
                for part in np.split(np.arange(len(v)), np.searchsorted(total, np.arange(1, total[-1] // SUBSETS + 1) * SUBSETS)) if len(v) else []:
                    yield to_batch(_light(values, off[part[0] : part[-1] + 2], v[part], percent)) if len(part) else to_batch(_light(values, off[:1], v[:0], percent))

        rows = saved(sets.where(f"n <= {most}").select("v", "h").mapInArrow(run, "key long, c int, v long, n long"))
        best = rows.groupBy("key", "c").agg(F.min(F.struct("n", "v")).alias("least"))
        met = rows.join(best, ["key", "c"]).where(f"(100 + {percent}) * c >= {percent} * (n + least.n)")
        out = saved(met.select(F.col("v").alias("u"), F.col("least.v").alias("v")).where("u <> v").distinct())
        discard(rows)
        return out

    def fits(self, n: str, p: str, m: str, q: str) -> str:
        """Whether sets of n and m shingles that share one with p and q before it can have enough in common."""
        return f"(100 + {self.percent}) * least({n} - {p}, {m} - {q}) >= {self.percent} * ({n} + {m})"

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that link, by their exact intersection, as edges (u, v)."""
        one, two = (sets.select(F.col("v").alias(k), F.col("h").alias(f"h{k}")) for k in "ab")
        met = pairs.join(one, "a").join(two, "b")
        both = F.size(F.array_intersect("ha", "hb"))
        link = (100 + self.percent) * both >= self.percent * (F.size("ha") + F.size("hb"))
        return met.where(link).select(F.col("a").alias("u"), F.col("b").alias("v"))

    def components(self) -> DataFrame:
        """v, root for each set that links with another."""
        sets = self.sets()
        all_lists = self.lists(sets)
        most = self.measured(sets, all_lists)
        links = self.light_links(sets, most)
        # a light set can link with heavy ones of little more
        lists = all_lists.where(f"n >= {-(-self.percent * (most + 1) // 100)}")
        tried, first = None, 0
        while True:
            roots = components(links)
            left = self._apart(lists, roots)
            # a list's owners are held against one of them: of the largest component, and with the best bound
            sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
            rank = left.join(sizes, "root", "left").withColumn("size", F.coalesce("size", F.lit(1)))
            best = saved(rank.groupBy("key").agg(F.max(F.struct("size", (F.col("n") - F.col("p")).alias("rest"), "v", "n", "p", "root")).alias("best")))
            met = left.join(best, "key").where(f"root <> best.root AND {self.fits('n', 'p', 'best.n', 'best.p')}")
            pairs = met.select("v", F.least("v", F.col("best.v")).alias("a"), F.greatest("v", F.col("best.v")).alias("b"))
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            counted = pairs.groupBy("v", "a", "b").agg(F.count(F.lit(1)).alias("k")).groupBy("v").agg(F.max(F.struct("k", "a", "b")).alias("p"))
            new = saved(counted.select("p.a", "p.b").distinct())
            found = saved(self.verified(new, sets))
            number = found.count()
            old, links = links, saved(links.union(found))
            before, tried = tried, new if tried is None else saved(tried.union(new))
            discard(old, found, best, *([] if before is None else [before, new]))
            first = first or number
            if ENOUGH * number <= first:
                break
            discard(roots, left)
        # owners of a list that are still apart, all against all that their bounds admit
        other = left.select("key", F.col("v").alias("w"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("root").alias("other"))
        met = left.join(other, "key").where(f"v < w AND root <> other AND {self.fits('n', 'p', 'm', 'q')}")
        rest = met.select(F.col("v").alias("a"), F.col("w").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        more = saved(self.verified(saved(rest), sets))
        out = roots if more.isEmpty() else components(saved(links.union(more)))
        discard(sets, all_lists, left)
        return out

    def _apart(self, lists: DataFrame, roots: DataFrame) -> DataFrame:
        """The rows of lists whose owners are in different components, with these, but for rows that no size in the
        list fits."""
        at = saved(lists.join(roots.withColumnRenamed("node", "v"), "v", "left").withColumn("root", F.coalesce("root", "v")))
        p = self.percent
        most = f"((100 + {p}) * (n - p) div {p}) - n"
        split = saved(at.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("n").alias("small"), F.max("n").alias("large"), F.max(F.expr(most)).alias("reach")).where("x < y"))
        left = saved(at.join(split, "key").where(f"{most} >= small AND {self.need} <= large AND n <= reach").select("key", "v", "n", "p", "root"))
        discard(at, split)
        return left


def join_documents(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    j = Join(docs, size, percent)
    own = j.base.where("n > 0")
    roots = j.components()
    nodes = own.groupBy("v").agg(F.min("doc_id").alias("least"))
    at = nodes.join(roots.withColumnRenamed("node", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = saved(at.groupBy("root").agg(F.min("least").alias("component_id")))
    known = saved(at.join(least, "root").select("v", "component_id"))
    out = own.join(known, "v").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    discard(least)
    return out.union(j.base.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs but those that have a linked document of smaller doc_id in their component."""
    found = join_documents(docs, size, percent).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))
