"""Approximate nearest neighbours by a vantage-point tree in each shard.

Vectors go to the shard of their nearest pivot; a shard of more than ``FULL`` vectors is dealt into parts at random, so a hot region is never one task's. A part's tree halves its points by their
distance from a vantage point down to leaves. A query descends to its own leaf first, then sweeps the tree, leaving out a child whose triangle-inequality bound is above ``FACTOR``
times its present k-th distance. A factor of one restores exact search; a smaller one prunes more. The same rule, with the bounds of a
shard's ball and of the plane between two pivots, decides which other shards a query is sent to after its own part
has given a first k-th distance; the other parts of its shard always get it. Whole batches of queries are taken through the tree together. Candidates are those within the
k-th distance and the error of single precision; they are ranked by their exact distance and id.

Equal vectors are one node, with the smallest of their ids, and are neighbours of each other at the end; of a node, its k + 1 smallest ids are all that can be asked for.

Every vector is indexed. ``asked`` says of an id whether it is a query (all are, unless it is given). A query's neighbours are the ``k`` others with the smallest Euclidean distance, in that order, ties by id.

Defined results: rows that ``vectors.clean`` leaves out are neither queries nor neighbours. With fewer than k others, there are fewer neighbours. Vectors that are equal
under several ids are neighbours at distance 0. An empty table gives none. Only the id and vector columns are read;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom.llm.common import Table, frugal
from auditloom.llm.vectors import clean, distances, lists, matrix, pivots

K = 10
FACTOR = 0.5
SHARD = 16384
#: Pivots at most, as every task gets them all (of 64 numbers each: 2 MB in double precision), and vectors of a part.
MOST_PIVOTS, FULL = 4096, 4 * SHARD
LEAF = 256
BATCH = 1024
#: Candidates whose exact distances are computed at once.
PAIRS = 1 << 16
SEED = 5


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a, or of one vector, from the rows of b in double precision."""
    return np.sqrt(((a.astype(np.float64) - b) ** 2).sum(1))


class VPTree:
    """Nodes: (vantage point, least and most distance on the left, on the right, children) or a range of leaf rows."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF, seed: int = SEED):
        self.x, self.leaf = x, leaf
        self.rng = np.random.default_rng(seed)
        self.order: list[np.ndarray] = []
        self.size = 0
        self.root = self._build(np.arange(len(x))) if len(x) else None
        self.rows = np.concatenate(self.order) if self.order else np.empty(0, np.int64)
        self.data = x[self.rows]
        self.norm = (self.data * self.data).sum(1)
        self.ids = ids[self.rows]

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            self.order.append(rows)
            self.size += len(rows)
            return (self.size - len(rows), self.size)
        vp = self.x[rows[self.rng.integers(len(rows))]]
        d = _exact(vp, self.x[rows])
        half = len(rows) // 2
        by = np.argpartition(d, half)
        lo, hi = by[:half], by[half:]
        bounds = (d[lo].min(), d[lo].max(), d[hi].min(), d[hi].max())
        return (vp, bounds, self._build(rows[lo]), self._build(rows[hi]))

    def search(self, q: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances), each (queries, k), by distance and id; row -1 at infinity where there are fewer. bound: distances beyond which nothing is asked for."""
        best = np.full((len(q), k), np.inf)
        found = np.full((len(q), k), -1, np.int64)
        tau = np.full(len(q), np.inf) if bound is None else bound.astype(np.float64)
        if self.root is None:
            return found, best
        qn = (q * q).sum(1)
        slack = (q.shape[1] + 4) * 2.0**-23 * (qn + self.norm.max())  # bound of the error of squared distances in single precision
        done = np.full(len(q), -1)

        def leaf(node, at: np.ndarray) -> None:
            a, b = node
            d = q[at] @ self.data[a:b].T
            d *= -2
            d += qn[at][:, None]
            d += self.norm[None, a:b]
            most = tau[at] ** 2 + slack[at]
            better = np.flatnonzero(d.min(1) <= most)
            if not len(better):
                return
            at, d, most = at[better], d[better], most[better]
            if b - a > k:
                most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * slack[at])
            who, row = np.nonzero(d <= most[:, None])
            row += a
            far = np.concatenate([_exact(self.data[row[c : c + PAIRS]], q[at[who[c : c + PAIRS]]]) for c in range(0, len(row), PAIRS)])
            near = far <= tau[at[who]]
            who, row, far = np.concatenate([np.repeat(np.arange(len(at)), k), who[near]]), np.concatenate([found[at].reshape(-1), row[near]]), np.concatenate([best[at].reshape(-1), far[near]])
            order = np.lexsort((self.ids[row], far, who))
            who = who[order]
            order = order[np.arange(len(who)) - np.searchsorted(who, who) < k]  # a query has k entries at least, if only empty ones
            best[at], found[at] = far[order].reshape(-1, k), row[order].reshape(-1, k)
            tau[at] = np.minimum(tau[at], best[at, -1])

        def away(node, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Bounds below the distances to all of the left and the right child."""
            vp, (a, b, c, e), _, _ = node
            d = _exact(vp, q[at])
            least = lambda lo, hi: np.maximum(0, np.maximum(lo - d, d - hi) - 1e-12 * (d + hi))
            return least(a, b), least(c, e)

        def descend(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if len(node) == 2:
                leaf(node, at)
                done[at] = node[0]
                return
            left, right = away(node, at)
            near = left <= right
            descend(node[2], at[near])
            descend(node[3], at[~near])

        def sweep(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if len(node) == 2:
                rest = at[done[at] != node[0]]
                if len(rest):
                    leaf(node, rest)
                return
            left, right = away(node, at)
            sweep(node[2], at[left <= factor * tau[at]])
            sweep(node[3], at[right <= factor * tau[at]])

        descend(self.root, np.arange(len(q)))
        sweep(self.root, np.arange(len(q)))
        return np.where(found >= 0, self.rows[np.maximum(found, 0)], -1), best


def _nearest(centres: np.ndarray):
    """Adds the shard (nearest pivot) and the distance from it."""
    centres = centres.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(matrix(batch.column(1)).astype(np.float64), centres)
                s = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array(s.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(s)), s]).astype(np.float64))], names=["id", "v", "ask", "home", "away"]
                )

    return run


def _routed(centres: np.ndarray, radius: np.ndarray, first: np.ndarray, factor: float):
    """A query for every part, but its own, of the shards that may hold something nearer than its k-th neighbour so far; first: where the parts of each shard begin, and the end."""
    centres = centres.astype(np.float64)
    apart = np.sqrt(distances(centres, centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                leaf, tau = part.column(2).to_numpy(), part.column(3).to_numpy()
                home = np.searchsorted(first, leaf, "right") - 1
                d2 = distances(matrix(part.column(1)).astype(np.float64), centres)
                plane = (d2 - d2[np.arange(len(home)), home][:, None]) / np.maximum(2 * apart[home], 1e-9)
                least = np.maximum(np.sqrt(d2) - radius[None, :], plane)
                slack = 1e-6 * np.sqrt(d2.max(1))  # rounding, so that ties at the bound are kept
                own = np.arange(len(centres))[None, :] == home[:, None]
                who, where = np.nonzero(((least <= (factor * tau + slack)[:, None]) | own) & (radius >= 0)[None, :])
                size = first[where + 1] - first[where]
                who, to = np.repeat(who, size), np.repeat(first[where] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                other = to != leaf[who]
                sent = part.take(pa.array(who[other]))
                yield pa.RecordBatch.from_arrays([sent.column(0), sent.column(1), pa.array(to[other].astype(np.int32)), sent.column(3)], names=["id", "v", "shard", "tau"])

    return run


def _searched(k: int, factor: float, own: bool):
    """Parts come one after another, points (tau null) before queries; own: those of the points with ask are the queries."""

    def answers(tree: VPTree, ids: np.ndarray, q: np.ndarray, qid: np.ndarray, shard: int, bound) -> pa.RecordBatch:
        rows, exact = tree.search(q, k + 1, factor, bound)
        rows = np.where(ids[rows] == qid[:, None], -1, rows)  # not itself
        exact[rows < 0] = np.inf
        order = np.lexsort((ids[rows], exact), axis=1)[:, :k]
        exact, rows = np.take_along_axis(exact, order, 1), np.take_along_axis(rows, order, 1)
        good = np.isfinite(exact)
        cut = pa.array(np.concatenate([[0], np.cumsum(good.sum(1))]).astype(np.int32))
        tau = np.where(good.sum(1) == k, exact[:, -1], np.inf)
        cols = [pa.array(qid), pa.ListArray.from_arrays(cut, pa.array(ids[rows][good])), pa.ListArray.from_arrays(cut, pa.array(exact[good])), pa.array(np.full(len(qid), shard, np.int32)), pa.array(tau)]
        cols.append(lists(q))
        return pa.RecordBatch.from_arrays(cols, names=["id", "near", "dist", "shard", "tau", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree, ids = None, [], None, None
        for batch in batches:
            s, tau = batch.column(2).to_numpy(), batch.column(3)
            point = tau.is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((s[1:] != s[:-1]) | (point[1:] != point[:-1])) + 1).tolist(), len(s)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if s[a] != shard:
                    if own and held:
                        yield from whole(held, shard)
                    shard, held, tree = s[a], [], None
                if point[a]:
                    held.append(part)
                elif held or tree is not None:
                    if tree is None:
                        t = pa.Table.from_batches(held)
                        ids = t["id"].to_numpy()
                        tree, held = VPTree(matrix(t["v"]), ids), []
                    for at in range(0, part.num_rows, BATCH):
                        p = part.slice(at, BATCH)
                        yield answers(tree, ids, matrix(p.column(1)), p.column(0).to_numpy(), int(shard), p.column(3).to_numpy())
        if own and held:
            yield from whole(held, shard)

    def whole(held: list, shard: int) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        asked = np.flatnonzero(t["ask"].to_numpy(zero_copy_only=False))
        if not len(asked):
            return
        ids, x = t["id"].to_numpy(), matrix(t["v"])
        tree = VPTree(x, ids)
        for at in range(0, len(asked), BATCH):
            q = asked[at : at + BATCH]
            yield answers(tree, ids, x[q], ids[q], int(shard), None)

    return run


_FOUND = "id bigint, near array<bigint>, dist array<double>, shard int, tau double, v array<float>"


def _expanded(top: DataFrame, nodes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(id, z) of the ids asked for (id, node), from the k nearest nodes of each node and the first ids of the nodes that are several vectors. Of a node, no more than its first k ids can be among k neighbours."""
    many = nodes.where(F.size("ids") > 1).select("id", "ids")
    first = many.select(F.col("id").alias("i"), F.slice("ids", 1, k).alias("xs"))
    each = top.select("id", F.explode_outer("z").alias("n")).select("id", F.col("n.d").alias("d"), F.col("n.i").alias("i")).join(first, "i", "left")
    members = F.transform(F.coalesce("xs", F.array("i")), lambda x: F.struct(F.col("d").alias("d"), x.alias("i")))
    z = each.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.when(F.col("i").isNotNull(), members)))), 1, k).alias("z"))  # k nodes of k ids at most
    z = asked.join(z.withColumnRenamed("id", "node"), "node").join(many.select(F.col("id").alias("node"), F.col("ids").alias("xs")), "node", "left")
    own = F.expr("transform(filter(coalesce(xs, array(id)), x -> x <> id), x -> named_struct('d', 0D, 'i', x))")
    return z.select("id", F.slice(F.array_sort(F.concat(own, "z")), 1, k).alias("z"))


def neighbours(
    df: DataFrame, k: int = K, factor: float = FACTOR, shard: int = SHARD, id_col: str = "vec_id", vec_col: str = "embedding", asked: Callable[[F.Column], F.Column] | None = None, full: int | None = None
) -> DataFrame:
    """(vec_id, neighbours array<bigint>, distances array<double>), nearest first, of every vector whose id is asked for."""
    is_asked = asked or (lambda i: F.lit(True))
    full = full or 4 * shard
    key = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(SEED), "v").alias("k2")]  # 128 bits stand for the vector
    rows = Table(clean(df, id_col, vec_col).select("id", "v", is_asked(F.col("id")).alias("ask"), *key), "vp-vectors")
    # The first ids of equal vectors: Spark cuts each group to k + 1 rows before it is shuffled.
    few = rows.df.select("k1", "k2", "id").withColumn("rank", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))).where(F.col("rank") <= k + 1)
    few = few.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    one = rows.df.groupBy("k1", "k2").agg(F.min_by("v", "id").alias("v"), F.bool_or("ask").alias("ask"))
    nodes = Table(one.join(few, ["k1", "k2"]).select(F.col("ids")[0].alias("id"), "v", "ask", "ids", "k1", "k2"), "vp-nodes")
    n = nodes.df.count()
    if not n:
        return rows.df.selectExpr("id vec_id", "array(id) neighbours", "array(cast(0 as double)) distances")
    centres = pivots(nodes.df.select("id", "v"), n, max(shard, -(-n // MOST_PIVOTS)), SEED)
    s = len(centres)
    placed = Table(nodes.df.select("id", "v", "ask").mapInArrow(frugal(_nearest(centres)), "id bigint, v array<float>, ask boolean, home int, away double"), "vp-placed")
    radius, parts = np.full(s, -1.0), np.ones(s, np.int64)
    sizes = placed.df.groupBy("home").agg(F.max("away").alias("r"), F.count("*").alias("m")).collect()  # a row for each pivot
    for r in sizes:
        radius[r["home"]], parts[r["home"]] = r["r"], -(-r["m"] // full)
    first = np.concatenate([[0], np.cumsum(parts)])
    leaves = int(first[-1])
    begin = df.sparkSession.createDataFrame(sorted((i, int(first[i]), int(parts[i])) for i in range(s)), "home int, begin int, parts int")
    points = placed.df.join(F.broadcast(begin), "home")  # MOST_PIVOTS rows at most
    points = points.select("id", "v", (F.col("begin") + F.pmod(F.xxhash64(F.lit(SEED), "id"), F.col("parts"))).cast("int").alias("shard"), F.lit(None).cast("double").alias("tau"), "ask")
    own = Table(points.repartitionById(leaves, F.col("shard")).sortWithinPartitions("shard").mapInArrow(frugal(_searched(k, factor, True)), _FOUND), "vp-own")
    found = own.df.select("id", "near", "dist")
    if leaves > 1:
        queries = own.df.select("id", "v", "shard", "tau").mapInArrow(frugal(_routed(centres, radius, first, factor)), "id bigint, v array<float>, shard int, tau double")
        both = points.drop("ask").union(queries).repartitionById(leaves, F.col("shard")).sortWithinPartitions("shard", F.col("tau").asc_nulls_first())
        found = found.union(both.mapInArrow(frugal(_searched(k, factor, False)), _FOUND).select("id", "near", "dist"))
    top = found.select("id", F.arrays_zip(F.col("dist").alias("d"), F.col("near").alias("i")).alias("z"))
    top = top.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("z"))), 1, k).alias("z"))
    ids = rows.df.where("ask").select("id", "k1", "k2").join(nodes.df.select("k1", "k2", F.col("id").alias("node")), ["k1", "k2"]).select("id", "node")
    out = Table(_expanded(top, nodes.df, ids, k).select(F.col("id").alias("vec_id"), F.col("z.i").alias("neighbours"), F.col("z.d").alias("distances")), "vp-neighbours")
    for t in (rows, nodes, placed, own):
        t.drop()
    return out.df


#: Vectors whose id is divisible by EVERY are the queries of ``op8_vptree_neighbours``.
EVERY = 20
SQL = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0)
SELECT vec_id, rank, neighbour, round(distance, 6) AS distance
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS INTEGER) AS rank FROM d) WHERE rank <= {K}
"""
