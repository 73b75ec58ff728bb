"""Near-duplicate embeddings by a robust-pruned flat graph.

Unit vectors are put into the shards of their two nearest pivots, so shards overlap. There are ``MOST_PIVOTS`` pivots at most; a shard with more than ``FULL`` vectors is cut
again by pivots of its own, which every task of that shard gets. Each shard builds a graph: a node's candidates are
its nearest members and some at random, and robust pruning keeps a candidate unless one kept before is nearer to it by the factor ``ALPHA``;
edges are made mutual and pruned again. The adjacency lists that a node has in several shards are united into one flat graph. Every vector is then
searched for in all of its shards: a greedy beam search from the medoid, and from every node within the radius a range expansion that
follows all edges until no node within the radius is new. In each shard the recall of a sample of searches is audited against brute force; while it is below
``RECALL``, the beam is doubled and the shard is searched again. Pairs that were found are verified by their exact cosine.
What is still in a shard of more than ``FULL`` vectors, as a large group of near copies is, is dealt into blocks, and all pairs of blocks are compared in tasks of their own.

Two near vectors may share no shard, the more so the more pivots there are. So where there are several shards, what they share is audited again, against brute force of a sample
over all vectors: while the share of the pairs near the threshold or of the closer ones that meet in a shard is below ``RECALL``, another round is made with other pivots.

A pair is counted in the first shard that both are in, so no list of pairs is made or shuffled: a shard gives for each vector the number of links that it counts, and the smallest id
of its group in the shard; groups are then connected over all shards. Equal vectors are one node with a weight.

The result has one row for each id: its class (the smallest id that it is connected with) and the number of vectors of other ids with at least the cosine.

Defined results: ids that ``vectors.clean`` leaves out, and zero vectors, are classes of their own without a link. An id is once in the table, by the rule of ``vectors.clean``; null ids have no row. An empty
table gives no rows. Only the id and vector columns are read; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.chosen_path import components
from auditloom.llm.common import Table, frugal, unit_hash
from auditloom.llm.vectors import clean, distances, lists, matrix, pivots

COSINE = 0.95
#: Vectors of a shard on average (each is in two), candidates of a node, those at random, its degree, and the pruning factor.
SHARD = 4096
#: Pivots at most that every task gets (of 64 numbers each: 1 MB), vectors of a shard that is not cut again, and those of a side of a block pair.
MOST_PIVOTS, FULL, BLOCK = 4096, 16 * SHARD // 4, 4096
NEAR, RANDOM, DEGREE, ALPHA = 32, 12, 24, 1.2
BEAM = 16
#: Candidates of a node at most when mutual edges are pruned: of a hub's the nearest and the farthest.
WIDEST = 48
#: Searches audited in a shard, and the recall that they must reach.
AUDIT, RECALL = 256, 0.98
#: Vectors compared with all others after each round.
AUDIT_ALL = 2048
SEED = 23


def prune(x: np.ndarray, at: np.ndarray, cand: np.ndarray, d: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of many nodes at once: cand and d (nodes, c) sorted by squared distance, -1 where there is none; (nodes, degree) with -1 at the end."""
    n, c = cand.shape
    v = x[np.maximum(cand, 0)]
    alive = cand >= 0
    kept = np.full((n, degree), -1, np.int64)
    count = np.zeros(n, np.int64)
    sq = (v * v).sum(2)
    for j in range(c):
        take = np.flatnonzero(alive[:, j] & (count < degree))
        if not len(take):
            continue
        kept[take, count[take]] = cand[take, j]
        count[take] += 1
        between = sq[take] + sq[take, j][:, None] - 2 * np.einsum("nck,nk->nc", v[take], v[take, j])
        alive[take] &= alpha * alpha * between > d[take]
    return kept


def build(x: np.ndarray, seed: int = SEED, near: int = NEAR, rand: int = RANDOM, degree: int = DEGREE, widest: int = WIDEST) -> np.ndarray:
    """(n, degree) neighbours of each row, -1 where there are fewer."""
    n = len(x)
    if n < 2:
        return np.full((n, degree), -1, np.int64)
    rng = np.random.default_rng(seed)
    close, far = degree * 3 // 4, degree - degree * 3 // 4
    graph = np.full((n, degree), -1, np.int64)
    for a in range(0, n, 1024):
        at = np.arange(a, min(n, a + 1024))
        d = distances(x[at], x)
        d[np.arange(len(at)), at] = np.inf
        k = min(near, n - 1)
        c = np.argpartition(d, k - 1, axis=1)[:, :k]
        cd = np.take_along_axis(d, c, 1)
        order = np.argsort(cd, axis=1, kind="stable")
        c, cd = np.take_along_axis(c, order, 1), np.take_along_axis(cd, order, 1)
        graph[at, :close] = prune(x, at, c, cd, close)
        r = rng.integers(0, n, (len(at), rand))
        rd = np.take_along_axis(d, r, 1)
        order = np.argsort(rd, axis=1, kind="stable")
        r, rd = np.take_along_axis(r, order, 1), np.take_along_axis(rd, order, 1)
        r[~np.isfinite(rd)] = -1
        graph[at, close:] = prune(x, at, r, rd, far)
    # Mutual edges: the reverse ones join a node's list and are pruned with it.
    src = np.repeat(np.arange(n), degree)
    dst = graph.reshape(-1)
    src, dst = src[dst >= 0], dst[dst >= 0]
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    key = np.unique(a * n + b)
    a, b = key // n, key % n
    d = ((x[a] - x[b]) ** 2).sum(1)
    order = np.lexsort((d, a))
    a, b, d = a[order], b[order], d[order]
    begin = np.searchsorted(a, np.arange(n + 1))
    widest = int(min(np.diff(begin).max(), widest))
    cand, cd = np.full((n, widest), -1, np.int64), np.full((n, widest), np.inf, np.float32)
    pos = np.arange(len(a)) - begin[a]
    # of a hub's many edges the nearest half and the farthest half of the places are candidates
    size = np.diff(begin)[a]
    slot = np.where(pos < widest // 2, pos, pos - size + widest)
    ok = (size <= widest) | (pos < widest // 2) | (pos >= size - (widest - widest // 2))
    slot = np.where(size <= widest, pos, slot)
    cand[a[ok], slot[ok]], cd[a[ok], slot[ok]] = b[ok], d[ok]
    out = np.full((n, degree + far), -1, np.int64)
    for at in range(0, n, 1024):
        e = slice(at, at + 1024)
        out[e, :degree] = prune(x, np.arange(n)[e], cand[e], cd[e], degree)
    out[:, degree:] = graph[:, close:]  # a node keeps its far edges, so no group is an island
    return out


def search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, radius2: float, beam: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the rows found within a squared distance of each query, by beam search from start and range expansion."""
    m, n = len(q), len(x)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True  # where there is no neighbour
    xs = np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])
    links = np.where(graph >= 0, graph, n)
    sq = (xs * xs).sum(1)
    qq = (q * q).sum(1)
    ids = np.full((m, beam), n)
    dist = np.full((m, beam), np.inf, np.float32)
    fresh = np.zeros((m, beam), bool)
    ids[:, 0], dist[:, 0], fresh[:, 0] = start, ((q - x[start]) ** 2).sum(1), True
    seen[:, start] = True
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    got = np.flatnonzero(dist[:, 0] <= radius2)
    hits.append((got, np.full(len(got), start)))
    active = np.arange(m)
    while len(active):
        masked = np.where(fresh[active], dist[active], np.inf)
        best = masked.argmin(1)
        go = np.isfinite(masked[np.arange(len(active)), best])
        active, best = active[go], best[go]
        if not len(active):
            break
        fresh[active, best] = False
        nb = links[ids[active, best]]
        old = seen[active[:, None], nb]
        seen[active[:, None], nb] = True
        d = sq[nb] + qq[active][:, None] - 2 * np.einsum("ark,ak->ar", xs[nb], q[active])
        d[old] = np.inf
        a, b = np.nonzero(d <= radius2)
        hits.append((active[a], nb[a, b]))
        both = np.concatenate([dist[active], d], 1)
        top = np.argpartition(both, beam - 1, axis=1)[:, :beam]
        dist[active] = np.take_along_axis(both, top, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], nb], 1), top, 1)
        fresh[active] = np.take_along_axis(np.concatenate([fresh[active], np.isfinite(d)], 1), top, 1)
    qi, ri = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
    found = [np.unique(qi * n + ri)]
    edge = found[0]
    while len(edge):  # range expansion: all edges of all nodes within the radius
        news = []
        for at in range(0, len(edge), 1 << 16):
            f, r = edge[at : at + (1 << 16)] // n, edge[at : at + (1 << 16)] % n
            nb = links[r]
            f = np.broadcast_to(f[:, None], nb.shape)
            ok = ~seen[f, nb]
            key = np.unique(f[ok] * n + nb[ok])
            f, r = key // n, key % n
            seen[f, r] = True
            d = sq[r] + qq[f] - 2 * np.einsum("pk,pk->p", xs[r], q[f])
            news.append(key[d <= radius2])
        edge = np.concatenate(news)
        found.append(edge)
    key = np.unique(np.concatenate(found))
    return key // n, key % n


def medoid(x: np.ndarray) -> int:
    return int(((x - x.mean(0)) ** 2).sum(1).argmin())


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = matrix(batch.column(1)).astype(np.float64)
        size = np.sqrt((x * x).sum(1))
        ok = size > 0
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), lists((x[ok] / size[ok][:, None]).astype(np.float32))], names=["id", "v"])


def _nearest_two(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    k = min(2, len(centres))
    return np.argpartition(distances(x, centres), k - 1, axis=1)[:, :k] if k > 1 else np.zeros((len(x), 1), np.int64)


def _shard_batch(shard: np.ndarray, ids: pa.Array, v: pa.Array, w: pa.Array) -> pa.RecordBatch:
    """A row for each (vector, shard); shard: (vectors, k)."""
    who = pa.array(np.repeat(np.arange(len(shard)), shard.shape[1]))
    return pa.RecordBatch.from_arrays([pa.array(shard.reshape(-1).astype(np.int64)), ids.take(who), v.take(who), w.take(who)], names=["shard", "id", "v", "w"])


def _two_shards(centres: np.ndarray, first: int):
    """The shards of the two nearest of the centres; numbers begin at first and leave room for the shards that each may be cut into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = first + (_nearest_two(matrix(batch.column(1)), centres) << 13)
                yield _shard_batch(s, batch.column(0), batch.column(1), batch.column(2))

    return run


def _cut_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of large shards, each with all pivots of its shard, in the same order: members go to the shards of their two nearest."""
    for t in _by_shard(batches):
        pivot = t["is_pivot"].to_numpy(zero_copy_only=False)
        own, member = t.filter(pa.array(pivot)).sort_by("id"), t.filter(pa.array(~pivot)).combine_chunks()
        if not member.num_rows:
            continue
        v, base = member["v"].combine_chunks(), t["shard"][0].as_py()
        s = base + 1 + _nearest_two(matrix(v), matrix(own["v"])) if own.num_rows else np.full((member.num_rows, 1), base)
        yield _shard_batch(s, member["id"].combine_chunks(), v, member["w"].combine_chunks())


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole shards, from batches sorted by the first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        s = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[0].column(0)[0].as_py() != s[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _by_shard(batches):
        t = t.sort_by("id")
        ids, x, shard = t["id"].to_numpy(), matrix(t["v"]), t["shard"][0].as_py()
        g = build(x, SEED + shard % (1 << 40))
        cut = np.concatenate([[0], np.cumsum((g >= 0).sum(1))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), shard)), pa.ListArray.from_arrays(pa.array(cut), pa.array(ids[g[g >= 0]]))], names=["id", "shard", "links"])


def found_pairs(x: np.ndarray, graph: np.ndarray, cosine: float, beam: int = BEAM, audit: int = AUDIT, recall: float = RECALL, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(rows a, rows b, audited recall, beam used) of the pairs within a shard, a < b."""
    n = len(x)
    radius2 = 2 - 2 * cosine + 1e-5
    start = medoid(x)
    sample = np.arange(n) if n <= audit else np.random.default_rng(seed).choice(n, audit, replace=False)
    near = distances(x[sample], x) <= radius2
    near[np.arange(len(sample)), sample] = False
    true = int(near.sum())
    while True:
        qs, rs = [], []
        for at in range(0, n, 1024):
            q, r = search(x, graph, x[at : at + 1024], radius2, min(beam, n), start)
            qs.append(q + at), rs.append(r)
        q, r = np.concatenate(qs), np.concatenate(rs)
        lo, hi = np.minimum(q, r), np.maximum(q, r)
        key = np.unique(lo[lo < hi] * n + hi[lo < hi])
        lo, hi = key // n, key % n
        a, b = np.nonzero(near)
        want = np.minimum(sample[a], b) * n + np.maximum(sample[a], b)
        reached = float(np.isin(want, key).mean()) if true else 1.0
        if reached >= recall or beam >= n:
            return lo, hi, reached, beam
        beam *= 2


class Tally:
    """What one task counts for its vectors: links of the pairs that it owns, and groups by union-find over all pairs."""

    def __init__(self, ids: np.ndarray, w: np.ndarray, shards: pa.Array, here: int):
        self.ids, self.w, self.here = ids, w, here
        flat, size = shards.flatten().to_numpy(), np.diff(shards.offsets.to_numpy())
        self.shards = np.full((len(ids), int(size.max(initial=1))), -1, np.int64)
        self.shards[np.repeat(np.arange(len(ids)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        self.links = np.zeros(len(ids), np.int64)
        self.root = np.arange(len(ids))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Rows a[i] and b[i] are near."""
        x, y = self.shards[a], self.shards[b]
        first = np.full(len(a), np.iinfo(np.int64).max)
        for k in range(x.shape[1]):
            meets = (x[:, k, None] == y).any(1) & (x[:, k] >= 0)
            first = np.where(meets, np.minimum(first, x[:, k]), first)
        own = first == self.here
        np.add.at(self.links, a[own], self.w[b[own]])
        np.add.at(self.links, b[own], self.w[a[own]])
        # Groups: hook the larger root to the smaller until no pair has two roots.
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def batch(self) -> pa.RecordBatch:
        """(id, links, root) of the vectors that have a partner; ids ascend, so the first row of a group has its smallest id."""
        some = np.flatnonzero((self.links > 0) | (np.bincount(self.root, minlength=len(self.root))[self.root] > 1))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[some]), pa.array(self.links[some]), pa.array(self.ids[self.root[some]])], names=["id", "links", "root"])


_TALLY = "id bigint, links bigint, root bigint"


def _wide(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    y = x.astype(np.float64)
    return y / np.sqrt((y * y).sum(1))[:, None]


def _list_column(t: pa.Table, name: str) -> pa.ListArray:
    c = t[name].combine_chunks()
    return c if isinstance(c, pa.ListArray) else pa.concat_arrays(c.chunks)


def _tallied(cosine: float):
    """Shards with their vectors' adjacency lists: search, verification, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_shard(batches):
            t = t.sort_by("id")
            ids, x, shard = t["id"].to_numpy(), matrix(t["v"]), t["shard"][0].as_py()
            links = _list_column(t, "links")
            size = np.diff(links.offsets.to_numpy())
            flat = links.flatten().to_numpy()
            pos = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
            own = np.repeat(np.arange(len(ids)), size)
            here = ids[pos] == flat  # edges of the united graph that lead out of the shard are followed in the other one
            own, pos = own[here], pos[here]
            first = np.searchsorted(own, np.arange(len(ids)))
            graph = np.full((len(ids), int(np.bincount(own, minlength=len(ids)).max(initial=1))), -1, np.int64)
            graph[own, np.arange(len(own)) - first[own]] = pos
            a, b, _, _ = found_pairs(x, graph, cosine, seed=SEED + shard % (1 << 40))
            wide, tally = _wide(x), Tally(ids, t["w"].to_numpy(), _list_column(t, "shards"), shard)
            for at in range(0, len(a), 1 << 16):
                i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                ok = (wide[i] * wide[j]).sum(1) >= cosine
                tally.add(i[ok], j[ok])
            yield tally.batch()

    return run


def _block_pairs(cosine: float):
    """Two blocks of a shard that is too large for a graph (or one with itself): all pairs across, by brute force."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_shard(batches):
            t = t.sort_by("id")
            wide, block = _wide(matrix(t["v"])), t["block"].to_numpy()
            tally = Tally(t["id"].to_numpy(), t["w"].to_numpy(), _list_column(t, "shards"), t["of"][0].as_py())
            left = np.flatnonzero(block == block.min())
            right = np.flatnonzero(block == block.max())
            if t["i"][0].as_py() != t["j"][0].as_py() and len(np.unique(block)) < 2:
                continue  # one of two blocks is empty
            for at in range(0, len(left), 256):
                rows = left[at : at + 256]
                a, b = np.nonzero(wide[rows] @ wide[right].T >= cosine - 1e-12)
                a, b = rows[a], right[b]
                keep = a != b if t["i"][0].as_py() != t["j"][0].as_py() else a < b
                a, b = a[keep], b[keep]
                for k in range(0, len(a), 1 << 16):
                    i, j = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                    ok = (wide[i] * wide[j]).sum(1) >= cosine
                    tally.add(i[ok], j[ok])
            yield tally.batch()

    return run


def _placed(nodes: DataFrame, n: int, shard: int, full: int, seed: int, round_: int) -> tuple[Table, int]:
    """(shard, id, v, w) of one draw of pivots, and the number of pivots; large shards are cut again, once."""
    want = min(MOST_PIVOTS, -(-n // shard))
    centres = pivots(nodes, n, -(-n // want), seed)
    rows = "shard bigint, id bigint, v array<float>, w bigint"
    placed = Table(nodes.mapInArrow(frugal(_two_shards(centres, round_ << 40)), rows), "graph-shards")
    sizes = placed.df.groupBy("shard").agg(F.count("*").alias("m"))
    if not sizes.where(F.col("m") > full).limit(1).count():
        return placed, len(centres)
    sized = placed.df.join(F.broadcast(sizes), "shard")  # MOST_PIVOTS rows at most
    large = sized.where(F.col("m") > full)
    of = F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("m") / shard))
    chunks = F.ceil(F.col("m") / (4 * shard)).cast("bigint")
    member = large.select("shard", "id", "v", "w", F.pmod(F.xxhash64(F.lit(seed), "id"), chunks).alias("chunk"), F.lit(False).alias("is_pivot"))
    own = large.where(unit_hash(seed + 1, F.col("id")) < of / F.col("m")).select("shard", "id", "v", "w", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("chunk"), F.lit(True).alias("is_pivot"))
    cells = member.union(own).select(F.xxhash64("shard", "chunk").alias("cell"), "shard", "id", "v", "w", "is_pivot").repartition("cell").sortWithinPartitions("cell")
    again = Table(sized.where(F.col("m") <= full).select("shard", "id", "v", "w").union(cells.mapInArrow(frugal(_cut_again), rows)), "graph-shards")
    placed.drop()
    return again, len(centres)


def _round(nodes: DataFrame, n: int, shard: int, full: int, seed: int, round_: int, cosine: float, before: DataFrame | None) -> tuple[Table, Table, int]:
    """(id, links, root) as counted in the shards of one draw of pivots, (id, shards) of this round and those before, and the number of pivots."""
    placed, s = _placed(nodes, n, shard, full, seed, round_)
    sizes = placed.df.groupBy("shard").agg(F.count("*").alias("m")).where(F.col("m") > full)
    crowded = sizes.limit(1).count() > 0
    small = placed.df.join(sizes, "shard", "left_anti") if crowded else placed.df
    tasks = max(1, -(-2 * n // (2 * shard)))
    lists_ = small.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(frugal(_graphs), "id bigint, shard bigint, links array<bigint>")
    large = placed.df.join(sizes, "shard") if crowded else None
    if crowded:
        lists_ = lists_.union(large.select("id", "shard", F.array().cast("array<bigint>")))
    flat = lists_.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"), F.collect_set("shard").alias("shards"))
    if before is not None:
        flat = flat.join(before.withColumnRenamed("shards", "old"), "id").select("id", "links", F.concat("old", "shards").alias("shards"))
    flat = Table(flat, "graph-flat")
    both = small.join(flat.df, "id").select("shard", "id", "v", "w", "links", "shards")
    tally = both.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(frugal(_tallied(cosine)), _TALLY)
    if crowded:
        parts = F.ceil(F.col("m") / BLOCK).cast("bigint")
        dealt = large.join(flat.df.select("id", "shards"), "id").withColumns({"parts": parts, "block": F.pmod(F.xxhash64(F.lit(seed), "id"), parts)})
        pairs = dealt.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)"))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        cells = pairs.select(F.xxhash64("shard", "i", "j").alias("cell"), F.col("shard").alias("of"), "i", "j", "block", "id", "v", "w", "shards").repartition("cell").sortWithinPartitions("cell")
        tally = tally.union(cells.mapInArrow(frugal(_block_pairs(cosine)), _TALLY))
    return Table(tally, "graph-tally"), flat, s


def _against(ids: np.ndarray, x: np.ndarray, cosine: float):
    """Pairs of the given vectors with those of a batch, by brute force."""
    wide = _wide(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                other, v = part.column(0).to_numpy(), matrix(part.column(1))
                near = np.nonzero(v @ x.T >= cosine - 1e-5)
                for k in range(0, len(near[0]), 1 << 16):
                    i, j = near[0][k : k + (1 << 16)], near[1][k : k + (1 << 16)]
                    u = v[i].astype(np.float64)
                    c = (u * wide[j]).sum(1) / np.sqrt((u * u).sum(1))
                    ok = (c >= cosine) & (other[i] != ids[j])
                    a, b = other[i[ok]], ids[j[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(c[ok])], names=["a", "b", "cosine"])

    return run


def _sampled_pairs(nodes: DataFrame, n: int, cosine: float) -> DataFrame:
    """(a, b, cosine) of all pairs that a sample of AUDIT_ALL vectors is in, in whatever shards they are."""
    share = min(1.0, (AUDIT_ALL + 4 * AUDIT_ALL**0.5) / n)
    drawn = nodes.withColumn("u", unit_hash(SEED - 1, F.col("id"))).where(F.col("u") < share).orderBy("u", "id").limit(AUDIT_ALL).collect()
    ids, x = np.array([r["id"] for r in drawn], np.int64), np.array([r["v"] for r in drawn], np.float32)
    return nodes.mapInArrow(frugal(_against(ids, x, cosine)), "a bigint, b bigint, cosine double").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def audited(shards: DataFrame, true: DataFrame, cosine: float) -> float:
    """The share of true pairs that meet in a shard: the smaller one of those in the half next to the threshold and of those closer; 1 where there are none."""
    near = (F.col("cosine") < (1 + cosine) / 2).alias("near")
    side = lambda c: shards.select(F.col("id").alias(c), F.col("shards").alias(f"{c}s"))
    got = true.join(side("a"), "a").join(side("b"), "b").groupBy(near).agg(F.avg(F.arrays_overlap("as", "bs").cast("double")).alias("recall"))
    return min([r["recall"] for r in got.collect()], default=1.0)


def near_duplicates(df: DataFrame, cosine: float = COSINE, shard: int = SHARD, full: int = FULL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, class_id, n_links), a row for each id: the smallest id that it is connected with by pairs of at least that cosine, and the number of such pairs that it is in."""
    every = df.select(F.col(f"`{id_col}`").try_cast("bigint").alias("vec_id")).where("vec_id is not null").distinct()
    unit = Table(clean(df, id_col, vec_col).mapInArrow(frugal(_unit), "id bigint, v array<float>"), "graph-unit")
    key = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(SEED), "v").alias("k2")]  # 128 bits stand for the vector
    nodes = unit.df.groupBy(*key).agg(F.min("id").alias("id"), F.any_value("v").alias("v"), F.count("*").alias("w"))
    nodes = Table(nodes, "graph-nodes")
    member = unit.df.select("id", *key).join(nodes.df.select("k1", "k2", F.col("id").alias("node"), "w"), ["k1", "k2"]).select(F.col("id").alias("vec_id"), "node", "w")
    member = Table(member, "graph-member")
    unit.drop()
    n = nodes.df.count()
    if not n:
        return every.selectExpr("vec_id", "vec_id class_id", "0L n_links")
    rows = nodes.df.select("id", "v", "w")
    tallies: list[Table] = []
    flat: Table | None = None
    true: Table | None = None
    while True:
        k = len(tallies)
        tally, new, s = _round(rows, n, shard, full, SEED + 10 * k, k, cosine, flat.df.select("id", "shards") if flat else None)
        tallies.append(tally)
        if flat:
            flat.drop()
        flat = new
        if s == 1:  # every two vectors were in one shard, unless it was cut again
            crowd = flat.df.where(F.size("shards") > 1).limit(1).count()
            if not crowd:
                break
        true = true or Table(_sampled_pairs(rows.select("id", "v"), n, cosine), "graph-audit")
        if audited(flat.df, true.df, cosine) >= RECALL:
            break
    counted = reduce(DataFrame.union, [t.df for t in tallies])
    root = components(counted.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = counted.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    near = root.df.select(F.col("x").alias("node"), F.col("root").alias("class"))
    mine = member.df.join(links, "node", "left").join(near, "node", "left").select("vec_id", F.coalesce("class", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"))
    out = Table(every.join(mine, "vec_id", "left").select("vec_id", F.coalesce("class", "vec_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links")), "graph-classes")
    for t in (true, flat, root, nodes, member, *tallies):
        if t:
            t.drop()
    return out.df


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
f AS (SELECT x, least(x, min(y)) AS class_id FROM r GROUP BY x),
k AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(class_id, vec_id) AS class_id, coalesce(n_links, 0) AS n_links FROM v LEFT JOIN f ON f.x = vec_id LEFT JOIN k ON k.a = vec_id
"""
