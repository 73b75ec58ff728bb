"""Set-similarity self-join of documents over word n-grams, by the chosen-path method.

A document is its set of word 3-grams (lower case; words are runs of ASCII letters and digits and non-ASCII bytes; a text of one or two
words is a set of one). The join finds all pairs with Jaccard similarity of ``THRESHOLD`` or more.

1. Documents with equal sets are joined to one set at once. Each set gets ``T_`` minima of seeded hashes, which embed it in sets of equal
   size: the tokens (i, minimum i) of two sets agree in a share that is their Jaccard similarity on average.
2. A run takes a token of a set with probability 1 / (THRESHOLD * T_), by a hash of the token alone; sets that take one token
   share a bucket. Runs are repeated as often as the target recall asks for; equal buckets of several runs are one.
3. A bucket of up to ``LIMIT`` sets is compared by brute force in one task. A larger one is split by a further round over the whole cluster: it is dealt into
   chunks of bounded size, each with the same sample of the bucket; sets that are close to the sample on average would be compared with most
   of the bucket in any case, so they are compared with all of it, in cells of ``BLOCK`` by ``BLOCK`` sets, and leave it. The rest goes to buckets by further tokens
   that its members share (``SPLIT_RUNS`` runs in the first split, then one), until buckets are small or ``LEVELS`` deep, where what is left is compared in cells. So no bucket is capped,
   and none is held by one task or the driver.
4. Pairs whose sketches come near the threshold are verified exactly on the sets themselves (40-bit hashes of 3-grams), each pair once, group by group; a group of more than
   ``GROUP`` sets or ``GRAMS`` n-grams is verified in cells.

A pair that shares tokens of several small buckets is taken in the first, by rule and without a shuffle.

``classes`` returns one row for each document id: its class (the smallest id of the connected group) and the number of its links. Copies are never expanded into pairs: links of equal
sets are counted by multiplication. ``join`` returns the pairs of different sets by the smallest id that has each, and ``membership`` says which
ids have which set. The number of such pairs, and with it the work, grows with the links between different texts: a family of f unlike texts that are all similar has f * f / 2.

Defined results: rows with a null id are in no class and no pair; null and empty texts and texts without a word have empty sets and no link, so the class of their id is the id itself
(unless it has other texts). Rows that repeat an id and a text are one document. An id with several texts takes part with each; a link is counted for each two texts (of this id and another), and texts of
one id are in one class without a link. An empty table gives no rows. Ids are whole numbers; an id that isn't, in a column of another type, counts as null. Only doc_id and text are read; other columns, whatever their
names, are ignored by ``classes`` and ``join`` and kept by ``dedupe``. ``dedupe`` keeps, of each connected group, the document with the smallest id; rows of the same id stay or go together, and rows with a null
id stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import Table, frugal

NGRAM = 3
THRESHOLD = 0.5
TARGET_RECALL = 0.97
#: Tokens of a sketch (bits of a mask: at most 63), and how far below the threshold a sketch may be and its pair is still verified.
T_ = 63
SLACK = 0.15
LIMIT = 1000
LEVELS = 4
#: Runs of the tokens by which a large bucket is split first (one in further splits), sets of a sample of a large bucket, of a chunk of it, and of a side of a cell.
SPLIT_RUNS = 3
SAMPLE, CHUNK, BLOCK = 256, 4096, 1024
#: Sets, and n-grams of them, that are verified together at most, but for a cell of two sides.
GROUP, GRAMS = 1024, 1 << 20
SEED = 2718

_U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_RNG = np.random.default_rng(SEED)
_BYTE = _RNG.integers(1, 2**63, 256).astype(_U) * _U(2) + _U(1)
_P = _U(0x9E3779B97F4A7C15)
_P_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MUL = _RNG.integers(1, 2**63, T_).astype(_U) * _U(2) + _U(1)
_ADD = _RNG.integers(1, 2**63, T_).astype(_U)
_BLOCK = 1 << 19


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, _BLOCK + 1)
        one = np.ones(1, _U)
        _powers[:] = [np.concatenate([one, np.cumprod(np.full(size - 1, p, _U), dtype=_U)]) for p in (_P, _P_INV)]
    return _powers[0], _powers[1]


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each word begins, its hash) in bytes: differences of prefix sums of a polynomial, so no word is touched alone."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + _BLOCK)
        if end < len(data):  # cut where no word is
            back = np.flatnonzero(~_WORD[data[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                ahead = np.flatnonzero(~_WORD[data[end:]])
                end = end + int(ahead[0]) + 1 if len(ahead) else len(data)
        part = data[at:end]
        inside = np.concatenate([[False], _WORD[part], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edge[::2], edge[1::2]
        up, down = _pow(len(part))
        total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[part] * up[: len(part)], dtype=_U)])
        hashes.append(_mix((total[e] - total[s]) * down[s]))
        starts.append(s + at)
        at = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, _U)
    return np.concatenate(starts), np.concatenate(hashes)


def shingles(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, 40-bit hash) of the distinct n-grams of some texts in lower case, in order."""
    size = np.array([len(r) + 1 for r in raw], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    at, h = words(np.frombuffer(b"\n".join(raw) + b"\n", np.uint8))
    doc = np.searchsorted(first, at, "right") - 1
    n = len(h)
    with np.errstate(over="ignore"):
        if n >= NGRAM:
            gram = h[: n - 2] * _U(3) + h[1 : n - 1] * _U(0x9E3779B97F4A7C15) + h[2:] * _U(0xC2B2AE3D27D4EB4F)
            whole = doc[: n - 2] == doc[2:]
            gram, own = gram[whole], doc[: n - 2][whole]
        else:
            gram, own = np.empty(0, _U), np.empty(0, np.int64)
        count = np.bincount(doc, minlength=len(raw))
        few = np.flatnonzero((count > 0) & (count < NGRAM))
        if len(few):
            begin = np.searchsorted(doc, few)
            second = np.where(count[few] == 2, h[np.minimum(begin + 1, n - 1)] * _U(5), _U(7))
            gram, own = np.concatenate([gram, h[begin] * _U(11) + second]), np.concatenate([own, few])
        key = np.unique(own.astype(_U) << _U(40) | _mix(gram) >> _U(24))
    return (key >> _U(40)).astype(np.int64), key & _U((1 << 40) - 1)


def sketches(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(number of sets, T_) minima of 32-bit hashes; begin: where each set starts in sets, none empty."""
    out = np.empty((len(begin), T_), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(T_):
            out[:, i] = np.minimum.reduceat((sets * _MUL[i] + _ADD[i]) >> _U(32), begin)
    return out


def packed(sets: np.ndarray) -> np.ndarray:
    """Five bytes for each 40-bit hash."""
    return np.ascontiguousarray(sets.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].reshape(-1)


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8").reshape(-1)


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        at = 0
        while at < len(raw):
            end, size = at, 0
            while end < len(raw) and (end == at or size + len(raw[end]) < _BLOCK):
                size += len(raw[end])
                end += 1
            own, sets = shingles(raw[at:end])
            if len(sets):
                doc, begin, n = np.unique(own, return_index=True, return_counts=True)
                with np.errstate(over="ignore"):
                    key = np.add.reduceat(_mix(sets + _U(1)), begin) ^ _mix(np.bitwise_xor.reduceat(_mix(sets * _U(31) + _U(17)), begin) + n.astype(_U))
                sk, flat = sketches(sets, begin), packed(sets)
                cut = np.concatenate([begin, [len(sets)]]) * 5
                body = flat.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[at + d] for d in doc.tolist()], pa.int64()), pa.array(key.view(np.int64)), pa.array(n.astype(np.int32)),
                        pa.array([r.tobytes() for r in sk], pa.binary()), pa.array([body[cut[k] : cut[k + 1]] for k in range(len(doc))], pa.binary()),
                    ],
                    names=["doc_id", "set_id", "n", "sketch", "grams"],
                )
            at = end


def _id(col: F.Column | None = None) -> F.Column:
    """doc_id as a whole number, null where it is none."""
    return (F.col("doc_id") if col is None else col).try_cast("bigint")


def document_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, set_id, n, sketch, grams) of the documents that have an id and a word."""
    texts = docs.select(_id().alias("doc_id"), F.lower("text").alias("text")).where("doc_id is not null and text is not null")
    return texts.mapInArrow(frugal(_sets_of), "doc_id bigint, set_id bigint, n int, sketch binary, grams binary")


def expected_recall(times: int, threshold: float = THRESHOLD, depth: int = LEVELS) -> float:
    """The probability that a pair at the threshold is found if every bucket that it shares is split depth times: a token of both is taken in some run, some token in each split, and its sketches pass."""
    p, shared = 1 / (threshold * T_), threshold * T_
    meets = 1.0
    for level in range(depth):  # from the deepest split up
        meets = 1 - (1 - p * meets) ** (shared * (SPLIT_RUNS if level == depth - 1 else 1))
    least = math.ceil((threshold - SLACK) * T_)
    sketch = sum(math.comb(T_, k) * threshold**k * (1 - threshold) ** (T_ - k) for k in range(least, T_ + 1))
    return sketch * (1 - (1 - p * meets) ** (times * shared))


def runs(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """Runs for a pair at the threshold to be found with the target's probability even in the deepest buckets; where sketches alone lose more, the runs after which no more is gained."""
    times = 1
    while expected_recall(times, threshold) < target and expected_recall(times + 1, threshold) - expected_recall(times, threshold) > 1e-3:
        times += 1
    return times


def chosen(sketch: np.ndarray, p: float, seed: int, times: int = 1) -> np.ndarray:
    """Which tokens (m, T_) are taken in any of some runs: by a hash of the token, so sets that have it agree."""
    pos = np.arange(T_, dtype=_U) << _U(32)
    with np.errstate(over="ignore"):
        token = _mix((sketch.astype(_U) | pos[None, :]) ^ _mix(np.array([seed], _U)))
        keep = np.zeros(token.shape, bool)
        for r in range(times):
            keep |= _mix(token + _U(r + 1) * _P) < _U(int(p * 2**64))
    return keep


def _pairs_within(s: np.ndarray, n: np.ndarray, rows: np.ndarray, cols: np.ndarray, least: float, ratio: float) -> np.ndarray:
    """Pairs (row, col), row before col, whose sketches agree in a share of least or more and whose sizes allow the threshold."""
    out = []
    t = np.ascontiguousarray(s[cols].T)
    need = math.ceil(least * T_)
    step = max(1, (1 << 22) // max(1, len(cols)))
    for at in range(0, len(rows), step):
        r = rows[at : at + step]
        same = np.zeros((len(r), len(cols)), np.uint8)
        for i in range(T_):
            same += s[r, i][:, None] == t[i][None, :]
        a, b = np.nonzero(same >= need)
        a, b = r[a], cols[b]
        ok = (a != b) & (np.minimum(n[a], n[b]) >= ratio * np.maximum(n[a], n[b]))
        out.append(np.stack([np.minimum(a, b)[ok], np.maximum(a, b)[ok]], 1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def split(s: np.ndarray, sample: np.ndarray, threshold: float, seed: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For members (m, T_) of a large bucket: which are close to its sample on average, and (row, child bucket) of the others."""
    near = np.zeros(len(s))
    for i in range(T_):
        value, count = np.unique(sample[:, i], return_counts=True)
        at = np.minimum(np.searchsorted(value, s[:, i]), len(value) - 1)
        near += np.where(value[at] == s[:, i], count[at], 0) / len(sample)
    heavy = near / T_ > 0.9 * threshold
    light = np.flatnonzero(~heavy)
    who, pos = np.nonzero(chosen(s[light], 1 / (threshold * T_), seed, times))
    with np.errstate(over="ignore"):
        child = _mix((s[light[who], pos].astype(_U) | pos.astype(_U) << _U(32)) ^ _mix(np.array([seed], _U) + _P))
    return heavy, light[who], child.view(np.int64)


def _buckets_of(times: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, T_)
            who, pos = np.nonzero(chosen(s, 1 / (threshold * T_), SEED, times))
            with np.errstate(over="ignore"):
                bucket = _mix((s[who, pos].astype(_U) | pos.astype(_U) << _U(32)) + _P)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(pos.astype(np.int8)), pa.array(ids[who])], names=["bucket", "pos", "set_id"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Tables of equal values of a column, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        if held and held[-1].column(column)[0].as_py() != v[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _sketch_rows(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint32).reshape(-1, T_)


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _small_buckets(s: np.ndarray, mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As bits, the small buckets that both sets of each pair are in."""
    both = np.zeros(len(a), np.int64)
    for i in range(T_):
        both |= np.where(s[a, i] == s[b, i], np.int64(1) << np.int64(i), 0)
    return both & mask[a] & mask[b]


def _candidates_of(threshold: float):
    """Small buckets, one after another. The first small bucket that both are in names a pair, any other is silent; pos is null in a bucket that a large one was split into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 0):
            ids, n, mask, s = t["set_id"].to_numpy(), t["n"].to_numpy(), t["small"].to_numpy(), _sketch_rows(t)
            every = np.arange(len(s))
            p = _pairs_within(s, n, every, every, threshold - SLACK, threshold)
            p = np.unique(p, axis=0) if len(p) else p
            a, b = p[:, 0], p[:, 1]
            both, pos = _small_buckets(s, mask, a, b), t["pos"][0].as_py()
            mine = both & -both == (0 if pos is None else np.int64(1) << np.int64(pos))
            if mine.any():
                yield _pair_batch(ids[a[mine]], ids[b[mine]])

    return run


def _split_of(threshold: float, times: int):
    """Chunks of large buckets: the sample (is_sample) and members of each. A member leaves as (bucket, set_id, heavy) and, if it isn't heavy, in its child buckets, with heavy null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 0):
            drawn = t["is_sample"].to_numpy(zero_copy_only=False)
            sample, member = t.filter(pa.array(drawn)), t.filter(pa.array(~drawn))
            if not member.num_rows:
                continue
            s, ids, bucket = _sketch_rows(member), member["set_id"].to_numpy(), t["bucket"][0].as_py()
            heavy, who, child = split(s, _sketch_rows(sample) if sample.num_rows else s, threshold, bucket % 2**62, times)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), bucket)), pa.array(ids), pa.array(heavy)], names=["bucket", "set_id", "heavy"])
            yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(ids[who]), pa.nulls(len(who), pa.bool_())], names=["bucket", "set_id", "heavy"])

    return run


def _cells_of(threshold: float):
    """Cells of a large bucket: heavy sets on the left, members on the right; of two heavy sets the smaller is on the left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 0):
            ids, n, mask, s = t["set_id"].to_numpy(), t["n"].to_numpy(), t["small"].to_numpy(), _sketch_rows(t)
            left, heavy = t["is_left"].to_numpy(zero_copy_only=False), t["heavy"].to_numpy(zero_copy_only=False)
            rows, cols = np.flatnonzero(left), np.flatnonzero(~left)
            if not len(rows) or not len(cols):
                continue
            t = None
            need = math.ceil((threshold - SLACK) * T_)
            for at in range(0, len(rows), 256):
                r = rows[at : at + 256]
                same = np.zeros((len(r), len(cols)), np.uint8)
                for i in range(T_):
                    same += s[r, i][:, None] == s[cols, i][None, :]
                a, b = np.nonzero(same >= need)
                a, b = r[a], cols[b]
                ok = (ids[a] != ids[b]) & (~heavy[b] | (ids[a] < ids[b])) & (np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]))
                a, b = a[ok], b[ok]
                mine = _small_buckets(s, mask, a, b) == 0
                if mine.any():
                    yield _pair_batch(ids[a[mine]], ids[b[mine]])

    return run


def _verified(threshold: float, tally: bool):
    """Groups come as their sets, then their pairs; sets are bit rows over the n-grams that at least two of them share. The pairs leave or, as a tally, (set, links, root) of each set:
    a link counts for each id that has the other set, and the root is the smallest set of the group that it is connected with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 0):
            is_pair = t["b"].is_valid().to_numpy(zero_copy_only=False)
            if not is_pair.any():
                continue
            whole = t.filter(pa.array(~is_pair))
            pair = t.filter(pa.array(is_pair))
            ids = whole["a"].to_numpy()
            order = np.argsort(ids)
            ids, copies = ids[order], whole["copies"].to_numpy()[order]
            grams = whole["grams"].to_pylist()
            sets = [unpacked(grams[k]) for k in order.tolist()]
            size = np.array([len(x) for x in sets])
            both = np.unique(np.stack([pair["a"].to_numpy(), pair["b"].to_numpy()], 1), axis=0)  # a pair of several large buckets comes several times
            a, b = np.searchsorted(ids, both[:, 0]), np.searchsorted(ids, both[:, 1])
            _, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            own = np.repeat(np.arange(len(sets)), size)
            shared = count > 1
            column = np.cumsum(shared) - 1
            own, column, width = own[shared[inv]], column[inv[shared[inv]]], int(shared.sum())
            common = np.zeros(len(a), np.int64)
            step = max(64, ((1 << 25) // max(1, len(sets))) // 64 * 64)
            for at in range(0, width, step):
                here = (column >= at) & (column < at + step)
                bits = np.zeros((len(sets), min(step, width - at)), bool)
                bits[own[here], column[here] - at] = True
                bits = np.packbits(bits, axis=1)
                rows = max(1, (1 << 23) // max(1, bits.shape[1]))
                for k in range(0, len(a), rows):
                    common[k : k + rows] += np.bitwise_count(bits[a[k : k + rows]] & bits[b[k : k + rows]]).sum(1, dtype=np.int64)
            j = common / (size[a] + size[b] - common)
            ok = j >= threshold
            a, b = a[ok], b[ok]
            if not tally:
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(j[ok])], names=["a", "b", "jaccard"])
                continue
            links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[roots(len(ids), a, b)[some]])], names=["a", "links", "root"])

    return run


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows is connected with by the pairs (a, b): larger roots are hooked to smaller ones until no pair has two."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def _crowds(tokens: DataFrame) -> DataFrame:
    """tokens with ``crowd``, the size of the bucket, without those of one set. Sizes are counted with partial sums, and a hot bucket is joined with one row."""
    sizes = tokens.groupBy("bucket").agg(F.count("*").alias("crowd")).where("crowd > 1")
    return tokens.join(sizes, "bucket")


def _of_buckets(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.select("bucket", "pos", "set_id", "n", "small", "sketch").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(frugal(_candidates_of(threshold)), "a bigint, b bigint")


def _dealt(col: str, parts: F.Column, seed: int) -> F.Column:
    """A part for each set, by a hash of its id alone."""
    return F.pmod(F.xxhash64(F.lit(seed), col), parts).cast("bigint")


def _in_cells(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs of heavy sets with all of their bucket; rows: bucket, heavy, set_id, n, small, sketch. Left sides and right sides are dealt into blocks, so a cell is bounded however large the bucket."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("all"), F.count(F.when(F.col("heavy"), 1)).alias("hot")).where("hot > 0")
    sized = rows.join(sizes, "bucket").withColumns({"lefts": F.ceil(F.col("hot") / BLOCK), "rights": F.ceil(F.col("all") / BLOCK)})
    row = ["bucket", "heavy", "set_id", "n", "small", "sketch"]
    to = lambda parts: F.explode(F.expr(f"sequence(0L, {parts} - 1)"))
    left = sized.where("heavy").select(*row, _dealt("set_id", F.col("lefts"), 1).alias("i"), to("rights").alias("j"), F.lit(True).alias("is_left"))
    right = sized.select(*row, to("lefts").alias("i"), _dealt("set_id", F.col("rights"), 2).alias("j"), F.lit(False).alias("is_left"))
    cells = left.union(right).select(F.xxhash64("bucket", "i", "j").alias("cell"), *row[1:], "is_left")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(frugal(_cells_of(threshold)), "a bigint, b bigint")


def _large_buckets(large: DataFrame, sets: DataFrame, threshold: float) -> list[Table]:
    """Candidates of the buckets above LIMIT, level by level; large: bucket, set_id, crowd; sets: set_id, n, small, sketch of the sets in them. Every level is written, so a lost executor costs no more than its tasks."""
    found: list[Table] = []
    held = Table(large, "path-large-0")
    for level in range(1, LEVELS + 1):
        row = ["bucket", "set_id", "sketch", "crowd"]
        whole = held.df.join(sets.select("set_id", "sketch"), "set_id").select(*row)
        last = F.expr(f"cast(ceil(crowd / {CHUNK}) as bigint) - 1")
        drawn = F.pmod(F.xxhash64(F.lit(level), "set_id", "bucket"), F.lit(1 << 40)) < F.lit(float(SAMPLE << 40)) / F.col("crowd")
        dealt = F.array(F.struct(_dealt("set_id", last + 1, 3).alias("chunk"), F.lit(False).alias("is_sample")))
        to_all = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda c: F.struct(c.alias("chunk"), F.lit(True).alias("is_sample")))
        each = whole.withColumn("to", F.explode(F.when(drawn, F.concat(dealt, to_all)).otherwise(dealt))).select(F.xxhash64("bucket", "to.chunk").alias("cell"), "bucket", "set_id", "sketch", "to.is_sample")
        parted = each.repartition("cell").sortWithinPartitions("cell").mapInArrow(frugal(_split_of(threshold, SPLIT_RUNS if level == 1 else 1)), "bucket bigint, set_id bigint, heavy boolean")
        parted = Table(parted, f"path-split-{level}")
        held.drop()
        hot = parted.df.where("heavy").select("bucket").distinct()
        heavy = parted.df.where("heavy is not null").join(hot, "bucket", "left_semi").join(sets, "set_id")
        found.append(Table(_in_cells(heavy, threshold), f"path-heavy-{level}"))
        children = Table(_crowds(parted.df.where("heavy is null").drop("heavy")), f"path-children-{level}")
        parted.drop()
        few = children.df.where(F.col("crowd") <= LIMIT).join(sets, "set_id").withColumn("pos", F.lit(None).cast("tinyint"))
        found.append(Table(_of_buckets(few, threshold), f"path-small-{level}"))
        many = children.df.where(F.col("crowd") > LIMIT)
        if not many.limit(1).count():
            children.drop()
            return found
        held = Table(many, f"path-large-{level}")
        children.drop()
    found.append(Table(_in_cells(held.df.join(sets, "set_id").withColumn("heavy", F.lit(True)), threshold), "path-rest"))
    held.drop()
    return found


class Candidates:
    """What the chosen paths leave: the documents' sets (doc_id, set_id, n, grams, row), (set_id, doc_id) without repeats, and the candidate pairs (a, b), which can come several times."""

    def __init__(self, docs: DataFrame, threshold: float, target: float):
        self.threshold = threshold
        self.raw = Table(document_sets(docs).withColumn("row", F.monotonically_increasing_id()), "path-sets")
        self.member = Table(self.raw.df.select("set_id", "doc_id").distinct(), "path-member")
        reps = self.raw.df.groupBy("set_id").agg(F.min_by(F.struct("n", "sketch"), "doc_id").alias("s")).select("set_id", "s.n", "s.sketch")
        reps = Table(reps, "path-sketches")
        tokens = reps.df.select("set_id", "sketch").mapInArrow(frugal(_buckets_of(runs(threshold, target), threshold)), "bucket bigint, pos tinyint, set_id bigint")
        buckets = Table(_crowds(tokens), "path-buckets")
        at = F.struct("bucket", "pos", "crowd")
        bit = F.when(F.col("crowd") <= LIMIT, F.expr("shiftleft(1L, cast(pos as int))")).otherwise(F.lit(0).cast("bigint"))
        per_set = buckets.df.groupBy("set_id").agg(F.bit_or(bit).alias("small"), F.collect_list(at).alias("at"))  # T_ buckets of a set at most
        masked = per_set.join(reps.df, "set_id")
        rows = masked.select(F.explode("at").alias("at"), "set_id", "n", "small", "sketch").select("at.*", "set_id", "n", "small", "sketch")
        found = [Table(_of_buckets(rows.where(F.col("crowd") <= LIMIT), threshold), "path-small-0")]
        if buckets.df.where(F.col("crowd") > LIMIT).limit(1).count():
            sets = Table(masked.where(F.exists("at", lambda x: x.crowd > LIMIT)).select("set_id", "n", "small", "sketch"), "path-large-sets")
            found += _large_buckets(buckets.df.where(F.col("crowd") > LIMIT).drop("pos"), sets.df, threshold)
            sets.drop()
        buckets.drop()
        reps.drop()
        self.parts = found

    @property
    def pairs(self) -> DataFrame:
        return reduce(DataFrame.union, [t.df for t in self.parts])

    def verified(self, pairs: DataFrame | None = None, tally: bool = False) -> Table:
        """(a, b, jaccard) of the pairs at the threshold or, as a tally, (a, links, root) of the sets in them, as each task counts them.

        A pair is verified with the others of its neighbourhood, so a set is sent to few places; large neighbourhoods are dealt into cells.
        """
        cands, raw = self.pairs if pairs is None else pairs, self.raw.df
        near = cands.select(F.col("a").alias("x"), F.col("b").alias("y")).union(cands.select(F.col("b"), F.col("a")))
        label = near.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("g"))
        placed = Table(cands.join(label, F.col("a") == F.col("x")).select("g", "a", "b"), "path-groups")
        copies = self.member.df.groupBy("set_id").agg(F.count("*").alias("copies"))
        one = raw.groupBy("set_id").agg(F.min("row").alias("row"), F.min("n").alias("n"))  # of many equal sets one row is sent
        inside = placed.df.select("g", F.col("a").alias("s")).union(placed.df.select("g", "b")).distinct()
        parts = F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / GRAMS)).cast("bigint")
        large = Table(inside.join(one, F.col("s") == F.col("set_id")).groupBy("g").agg(parts.alias("parts")).where("parts > 1"), "path-large-groups")
        split = placed.df.join(large.df, "g", "left")
        cell = split.select(F.when(F.col("parts") > 1, F.xxhash64("g", _dealt("a", F.col("parts"), 4), _dealt("b", F.col("parts"), 4))).otherwise(F.col("g")).alias("g"), "a", "b")
        need = cell.select("g", F.col("a").alias("s")).union(cell.select("g", "b")).distinct()
        sent = need.join(one, F.col("s") == F.col("set_id")).join(copies, "set_id").select("g", "set_id", "copies", "row").join(raw.select("row", "grams"), "row")
        sent = sent.select("g", F.col("set_id").alias("a"), F.lit(None).cast("bigint").alias("b"), "copies", "grams")
        both = sent.union(cell.select("g", "a", "b", F.lit(None).cast("bigint"), F.lit(None).cast("binary")))
        out = both.repartition("g").sortWithinPartitions("g").mapInArrow(frugal(_verified(self.threshold, tally)), "a bigint, links bigint, root bigint" if tally else "a bigint, b bigint, jaccard double")
        out = Table(out, "path-verified")
        placed.drop()
        large.drop()
        return out

    def groups(self, tally: DataFrame) -> tuple[DataFrame, Table]:
        """(doc_id, set_id, root) of the ids' sets, and the table of roots, to be dropped after use; sets that one id has several of are connected through it."""
        member = self.member.df
        several = member.groupBy("doc_id").agg(F.min("set_id").alias("b"), F.count("*").alias("k")).where("k > 1")
        through = member.join(several, "doc_id").where("set_id <> b").select(F.col("set_id").alias("a"), "b")
        root = components(tally.where("a <> root").select("a", F.col("root").alias("b")).union(through))
        return member.join(root.df.select(F.col("x").alias("set_id"), "root"), "set_id", "left").select("doc_id", "set_id", F.coalesce("root", "set_id").alias("root")), root

    def drop(self) -> None:
        for t in (self.raw, self.member, *self.parts):
            t.drop()


def _names(raw: DataFrame) -> DataFrame:
    """(set_id, doc): the smallest id that has the set."""
    return raw.groupBy("set_id").agg(F.min("doc_id").alias("doc"))


def join(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: the pairs of different sets, each set by the smallest id that has it (``membership`` has the others); pairs of one id's own texts are left out."""
    found = Candidates(docs, threshold, target)
    pairs, name = found.verified(), _names(found.member.df)
    left, right = name.select(F.col("set_id").alias("a"), F.col("doc").alias("x")), name.select(F.col("set_id").alias("b"), F.col("doc").alias("y"))
    named = pairs.df.join(left, "a").join(right, "b").where("x <> y")
    out = Table(named.groupBy(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).agg(F.max("jaccard").alias("jaccard")), "path-pairs")
    found.drop()
    pairs.drop()
    return out.df


def membership(docs: DataFrame) -> DataFrame:
    """(doc_id, text_of): for each id and each of its sets, the smallest id with an equal set."""
    raw = Table(document_sets(docs), "path-sets").df.select("set_id", "doc_id").distinct()
    return raw.join(_names(raw), "set_id").select("doc_id", F.col("doc").alias("text_of")).distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, class_id, n_links), a row for each id: the smallest id of its connected group, and how many texts of other ids are at least that similar to its own."""
    found = Candidates(docs, threshold, target)
    tally = found.verified(tally=True)
    member = found.member.df
    copies = member.groupBy("set_id").agg(F.count("*").alias("copies"))
    linked = tally.df.groupBy(F.col("a").alias("set_id")).agg(F.sum("links").alias("others"))
    per_set = copies.join(linked, "set_id", "left").select("set_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    group, root = found.groups(tally.df)
    first = group.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    per_id = group.join(per_set, "set_id").join(first, "root").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))
    every = docs.select(_id().alias("doc_id")).where("doc_id is not null").distinct()
    out = every.join(per_id, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"))
    several = member.join(member.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1"), "doc_id").select("doc_id", "set_id")
    extra = [tally, root]
    if several.limit(1).count():  # an id's own texts, where it has several, are no links of it
        several = Table(several, "path-several")
        side = lambda c: several.df.select(F.col("set_id").alias(c), F.col("doc_id").alias("d"))
        mine = Table(found.pairs.join(side("a"), "a").join(side("b"), ["b", "d"]).select("a", "b", "d").distinct(), "path-own")
        near = found.verified(mine.df.select("a", "b").distinct())
        own = mine.df.join(near.df, ["a", "b"]).groupBy(F.col("d").alias("doc_id")).agg((2 * F.count("*")).alias("own"))
        out = out.join(own, "doc_id", "left").select("doc_id", "class_id", (F.col("n_links") - F.coalesce("own", F.lit(0))).alias("n_links"))
        extra += [several, mine, near]
    out = Table(out, "path-classes")
    found.drop()
    for t in extra:
        t.drop()
    return out.df


def components(edges: DataFrame) -> Table:
    """(x, root) for the nodes of (a, b): the smallest node that each is connected with, by minima of neighbours and pointer jumping."""
    both = Table(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), "components-edges")
    label = Table(both.df.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("root")), "components-0")
    while True:
        old = label.df
        seen = both.df.join(old.withColumnsRenamed({"x": "y", "root": "r"}), "y").groupBy("x").agg(F.min("r").alias("r"))
        low = old.join(seen, "x").select("x", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        jump = low.join(old.select(F.col("x").alias("root"), F.col("root").alias("far")), "root").select("x", "was", F.least("root", "far").alias("root"))
        new = Table(jump, "components")
        moved = new.df.where("root <> was").limit(1).count()
        label.drop()
        label = new
        if not moved:
            both.drop()
            return label


def dedupe(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """docs without the documents that are near duplicates of one with a smaller id, over whole connected groups."""
    found = Candidates(docs, threshold, target)
    tally = found.verified(tally=True)
    group, root = found.groups(tally.df)
    first = group.groupBy("root").agg(F.min("doc_id").alias("kept"), F.count("*").alias("k")).where("k > 1")
    lost = Table(group.join(first, "root").where("doc_id <> kept").select(F.col("doc_id").alias("__path_lost")).distinct(), "path-lost")
    found.drop()
    tally.drop()
    root.drop()
    gone = lost.df
    return docs.join(gone, _id(docs["doc_id"]) == gone["__path_lost"], "left_anti")


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '(?:[0-9a-z]|[^\\x00-\\x7F])+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {NGRAM} THEN list_transform(range(1, len(w) - {NGRAM} + 2), lambda i: array_to_string(w[i : i + {NGRAM} - 1], ' '))
         ELSE [array_to_string(w, ' ')] END) AS gram FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE CAST(c AS DOUBLE) / (x.n + y.n - c) >= {THRESHOLD}),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
f AS (SELECT x, least(x, min(y)) AS class_id FROM r GROUP BY x),
k AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN f ON f.x = doc_id LEFT JOIN k ON k.a = doc_id
"""
