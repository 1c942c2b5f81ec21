"""Approximate nearest neighbours by cosine, in a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` vectors, by a hash of vec_id) and every vector is assigned to a leaf.  A
query walks the tree through a priority queue of branches, nearest centre first, and visits leaves until it has visited
as many as calibration on the sample asked for (the fewest that hold ``RECALL`` of true neighbours) and has met enough
candidates.  Leaves are dealt in blocks, queries too, so that no task holds more than a block of each.  Of
equal vectors in a leaf only those that can be among the k nearest (smallest vec_id) are compared.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and those of another length than
most vectors (ties: the shorter), take no part, neither as queries nor as candidates; null vec_ids neither; rows repeated
whole are candidates each, but not of a query of the same vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tollgate.llm.common import grouped_arrow, prepare, scratch, table

SAMPLE, BRANCH, LEAF = 20_000, 8, 100
RECALL, PROBES = 0.96, 256
BLOCK = 4096
K, EVERY = 5, 50


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) double matrix of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Tree:
    """centres[n], children[n] (node numbers, empty for a leaf) and leaf[n] (its number, -1 for an inner node)."""

    def __init__(self):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self.visits = 1

    def _node(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.leaf) - 1

    def grow(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 7) -> Tree:
        rng = np.random.default_rng(seed)
        todo = [(self._node(x.mean(axis=0)), x)]
        while todo:
            node, part = todo.pop(0)
            groups = [] if len(part) <= leaf else [g for g in _kmeans(part, branch, rng) if len(g)]
            if len(groups) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for g in groups:
                child = self._node(part[g].mean(axis=0))
                self.children[node].append(child)
                todo.append((child, part[g]))
        return self

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: down the nearest centres."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = _distances(x[rows], np.stack([self.centres[c] for c in self.children[node]])).argmin(axis=1)
                todo += [(c, rows[near == i]) for i, c in enumerate(self.children[node])]
        return out

    def visit(self, q: np.ndarray):
        """Leaves for one query, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            kids = self.children[node]
            for d, c in zip(_distances(q[None], np.stack([self.centres[c] for c in kids]))[0].tolist(), kids, strict=True):
                heapq.heappush(queue, (d, c))

    def calibrate(self, x: np.ndarray, k: int = K, recall: float = RECALL, probes: int = PROBES) -> Tree:
        """Set ``visits``: the fewest leaves that hold ``recall`` of the probes' true neighbours within the sample."""
        home = self.assign(x)
        at = np.linspace(0, len(x) - 1, min(probes, len(x))).astype(np.int64)
        ranks = []
        for i in np.unique(at):
            near = x @ x[i]
            near[i] = -np.inf
            true = np.argsort(-near, kind="stable")[: min(k, len(x) - 1)]
            place = {leaf: n for n, leaf in enumerate(self.visit(x[i]))}
            ranks += [place[int(h)] + 1 for h in home[true]]
        ranks.sort()
        self.visits = ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))] if ranks else self.leaves
        return self


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(axis=1)[None] - 2 * x @ c.T + 1.0


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> list[np.ndarray]:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        near = _distances(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return [np.flatnonzero(near == i) for i in range(len(centres))]


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v: array<double>, h1, h2) of vectors that take part, and their length (0: there are none)."""
    v = F.col("embedding").cast("array<double>")
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("v", lambda x: x != 0))
    sizes = fine.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = sizes["dim"] if sizes else 0
    # -0.0 and 0.0 are the same component
    flat = F.transform("v", lambda x: x + F.lit(0.0))
    return fine.where(F.size("v") == dim).select("vec_id", flat.alias("v"), F.xxhash64(flat).alias("h1"), F.xxhash64(F.lit(3), flat).alias("h2")), dim


def fit(vectors: DataFrame, dim: int, size: int = SAMPLE) -> Tree:
    """Grow and calibrate the tree on about ``size`` vectors at most."""
    total = vectors.count()
    scale = 1 << 30
    part = vectors if total <= size else vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(scale)) < int(scale * size / total))
    got = part.select("vec_id", "v").toArrow().sort_by("vec_id").combine_chunks()
    x = unit(matrix(got["v"].combine_chunks(), dim))
    x = np.unique(x, axis=0)  # copies would only crowd leaves
    return Tree().grow(x).calibrate(x)


def build_index(vectors: DataFrame, tree: Tree, dim: int) -> DataFrame:
    """Every vector with its leaf."""
    prepare(vectors.sparkSession)

    def run(batches):
        for b in batches:
            if b.num_rows:
                leaf = tree.assign(unit(matrix(b.column("v"), dim)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int64())], names=[*b.schema.names, "leaf"])

    return vectors.mapInArrow(run, "vec_id long, v array<double>, h1 long, h2 long, leaf long")


def search(index: DataFrame, queries: DataFrame, tree: Tree, dim: int, k: int = K, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found; ``queries`` has vec_id and v."""
    prepare(index.sparkSession)
    copies = Window.partitionBy("leaf", "h1", "h2").orderBy("vec_id")
    # of equal vectors, a query's own and the k smallest others are all that can be among its k nearest
    own = Window.partitionBy("leaf", "h1", "h2", "vec_id").orderBy("vec_id")
    compared = index.withColumn("again", F.row_number().over(own)).where(F.col("again") <= k).drop("again")
    compared = compared.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= 2 * k).drop("copy", "h1", "h2")
    compared = scratch(compared, "leaves")
    # at most LEAF times fewer than the sample's vectors: a few hundred rows
    held = {r["leaf"]: (r["n"], r["ids"]) for r in compared.groupBy("leaf").agg(F.count("*").alias("n"), F.approx_count_distinct("vec_id").alias("ids")).collect()}
    blocks = {leaf: -(-n // block) for leaf, (n, _) in held.items()}
    wanted = scratch(queries.select("vec_id", "v").dropDuplicates(["vec_id"]), "queries")
    parts = max(1, -(-wanted.count() // block))
    visits = tree.visits

    def route(batches):
        for b in batches:
            ids, x = b.column("vec_id").to_pylist(), unit(matrix(b.column("v"), dim)) if b.num_rows else []
            at, leaves = [], []
            for i in range(len(ids)):
                seen = met = 0
                for leaf in tree.visit(x[i]):
                    if leaf not in held:
                        continue
                    at.append(i)
                    leaves.append(leaf)
                    seen, met = seen + 1, met + held[leaf][1]
                    if seen >= visits and met >= 4 * k:
                        break
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array([blocks[x] for x in leaves], pa.int32()),
                                                  b.column("vec_id").take(pa.array(at)), b.column("v").take(pa.array(at))], names=["leaf", "nb", "vec_id", "v"])

    spark = index.sparkSession
    qpart = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    routed = wanted.mapInArrow(route, "leaf long, nb int, vec_id long, v array<double>").select(
        "leaf", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("vb"), qpart.alias("qb"), F.lit(True).alias("query"), "vec_id", "v")
    nb = F.element_at(F.map_from_arrays(F.lit(list(blocks)), F.lit(list(blocks.values()))), F.col("leaf")) if blocks else F.lit(1)
    dealt = compared.select("leaf", F.pmod(F.xxhash64("vec_id", F.lit(1)), nb).cast("int").alias("vb"),
                            F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("qb"), F.lit(False).alias("query"), "vec_id", "v")

    def nearest(group: pa.Table) -> pa.Table | None:
        ask = group["query"].to_numpy()
        ids, x = group["vec_id"].to_numpy(), matrix(group["v"].combine_chunks(), dim)
        q, v, qid, vid = x[ask], x[~ask], ids[ask], ids[~ask]
        if not len(q) or not len(v):
            return None
        norm_q, norm_v = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
        out = []
        for lo in range(0, len(q), 512):
            part = slice(lo, lo + 512)
            near = (q[part] / norm_q[part, None]) @ (v / norm_v[:, None]).T
            near[qid[part, None] == vid[None]] = -np.inf
            # all within rounding of the k-th largest, then exactly
            edge = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else near.min(axis=1)
            i, j = np.nonzero((near >= edge[:, None] - 1e-9) & (near > -np.inf))
            i = i + lo
            exact = (q[i] * v[j]).sum(axis=1) / (norm_q[i] * norm_v[j])
            order = np.lexsort((vid[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
            best = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
            out.append((qid[i[best]], vid[j[best]], exact[best]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    found = grouped_arrow(routed.unionByName(dealt), ["leaf", "vb", "qb"], nearest, "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """The k nearest of every vector whose vec_id ``every`` divides."""
    fine, dim = usable(vectors)
    if not dim:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = fit(fine, dim)
    index = scratch(build_index(fine, tree, dim), "ann-index")
    return search(index, index.where(F.col("vec_id") % every == 0), tree, dim, k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
