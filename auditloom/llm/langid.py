"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read a window of UTF-8 bytes forwards and backwards; a linear layer on both states gives every position class
probabilities, and a document's probabilities are their mean over all its positions. The network is trained here,
in numpy, by backpropagation through time with Adam, on windows of a bounded sample of rows with a known language (``PER_LANG`` rows
expected of each language, ``WINDOWS`` windows of each) and on made-up noise, which is the class 'und'. The sample is drawn by a hash of the id, so every run
and every retry fits the same weights.

Whole texts are labelled: a text is cut into windows of ``WINDOW`` bytes, each read from zero states, as in training, and every
byte gets a label. Windows of many documents are run as one batch.

A document is rejected if the pooled probability of 'und' is above ``MOST_UND``: one that holds some language is kept, however mixed or short.

Defined results: null, empty and white-space texts are 'und' with no positions and a null probability, and are rejected. If no row has a
language, all are 'und'. Rows are independent: repeated rows repeat their results. A null language or id in a row only keeps the row out of
training or counts as one id there. An empty table gives none. ``identify`` reads doc_id and text, and lang for training; ``keep_identified`` keeps all columns whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import frugal, unit_hash

UND = "und"
HIDDEN = 8
WINDOW = 128
#: Rows expected in the training sample of each language, windows cut from each, and their length.
PER_LANG, WINDOWS, TRAIN_WINDOW = 400, 3, 72
STEPS, BATCH, RATE = 260, 96, 0.03
MOST_UND = 0.8
SEED = 11


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiGRU:
    """h' = n + z (h - n), n = tanh(x_n + r (h U_n)), r and z logistic; one set of weights for each direction.

    table: (2, 3, 256, H) inputs of the gates r, z, n by byte, biases included; u: (2, 3, H, H); w: (2, H, K); c: (K,).
    """

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        k = len(classes)
        self.classes = classes
        self.p = {
            "table": (rng.standard_normal((2, 3, 256, hidden)) * 0.3).astype(np.float32),
            "u": (rng.standard_normal((2, 3, hidden, hidden)) / np.sqrt(hidden)).astype(np.float32),
            "w": (rng.standard_normal((2, hidden, k)) / np.sqrt(2 * hidden)).astype(np.float32),
            "c": np.zeros(k, np.float32),
        }

    def states(self, x: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """States (2, W, B, H) for bytes x (W, B); those of the backward direction are in its own order. A masked position has zero states."""
        table, u = self.p["table"], self.p["u"]
        steps, b = x.shape
        hidden = u.shape[-1]
        out = np.empty((2, steps, b, hidden), table.dtype)
        h = np.zeros((2, 1, b, hidden), table.dtype)
        g, m, d = np.empty((2, 3, b, hidden), table.dtype), np.empty((2, 3, b, hidden), table.dtype), np.empty((2, b, hidden), table.dtype)
        for t in range(steps):
            np.take(table[0], x[t], axis=1, out=g[0])
            np.take(table[1], x[steps - 1 - t], axis=1, out=g[1])
            np.matmul(h, u, out=m)
            rz, n = g[:, :2], g[:, 2]
            rz += m[:, :2]
            # the logistic function by tanh, which numpy has in vector code
            rz *= 0.5
            np.tanh(rz, out=rz)
            rz += 1
            rz *= 0.5
            np.multiply(g[:, 0], m[:, 2], out=d)
            n += d
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((h[:, 0].copy(), g.copy(), m[:, 2].copy()))
            np.subtract(h[:, 0], n, out=d)
            d *= g[:, 1]
            d += n
            if mask is not None:
                d[0] *= mask[t][:, None]
                d[1] *= mask[steps - 1 - t][:, None]
            out[:, t] = d
            h = out[:, t, None]
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """(K, W, B) for bytes (W, B)."""
        s = self.states(x, mask)
        w = self.p["w"]
        hidden, k = w.shape[1:]
        z = np.matmul(w[0].T, s[0].reshape(-1, hidden).T)
        z += np.matmul(w[1].T, s[1, ::-1].reshape(-1, hidden).T)
        z += self.p["c"][:, None]
        np.minimum(z, 60, out=z)
        np.exp(z, out=z)
        z += 1e-20
        z /= z.sum(0)
        return z.reshape(k, *x.shape)

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions of windows x (W, B) of classes y (B,) that mask (W, B) has as 1, and its gradients through time."""
        p = self.p
        steps, b = x.shape
        kept: list = []
        mask = np.ones((steps, b), p["u"].dtype) if mask is None else mask
        both = np.stack([mask, mask[::-1]])[..., None]  # in each direction's own order
        s = self.states(x, mask, kept)
        s1 = s[1, ::-1]
        z = s[0] @ p["w"][0] + s1 @ p["w"][1] + p["c"]
        z = z - z.max(-1, keepdims=True)
        e = np.exp(z)
        q = e / e.sum(-1, keepdims=True)
        loss = float(-(np.log(q[:, np.arange(b), y] + 1e-12) * mask).sum() / mask.sum())
        dz = q.copy()
        dz[:, np.arange(b), y] -= 1
        dz *= (mask / mask.sum())[..., None]
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        flat = dz.reshape(-1, dz.shape[-1])
        hidden = p["u"].shape[-1]
        grad["c"] = flat.sum(0)
        grad["w"][0] = s[0].reshape(-1, hidden).T @ flat
        grad["w"][1] = s1.reshape(-1, hidden).T @ flat
        ds = np.stack([dz @ p["w"][0].T, (dz @ p["w"][1].T)[::-1]])  # in each direction's own order
        dh = np.zeros((2, b, hidden), p["u"].dtype)
        wide = np.zeros((2, 3, steps, b, hidden), p["u"].dtype)
        for t in range(steps - 1, -1, -1):
            h, g, un = kept[t]
            r, zt, n = g[:, 0], g[:, 1], g[:, 2]
            dh = (dh + ds[:, t]) * both[:, t]
            dn = dh * (1 - zt) * (1 - n * n)
            dzt = dh * (h - n) * zt * (1 - zt)
            dr = dn * un * r * (1 - r)
            gates = np.stack([dr, dzt, dn * r], 1)  # at the products with u
            grad["u"] += np.matmul(h[:, None].swapaxes(-1, -2), gates)
            wide[:, 0, t], wide[:, 1, t], wide[:, 2, t] = dr, dzt, dn
            dh = dh * zt + np.matmul(gates, p["u"].swapaxes(-1, -2)).sum(1)
        one = np.zeros((steps * b, 256), p["u"].dtype)
        for k, order in ((0, x), (1, x[::-1])):
            one[:] = 0
            one[np.arange(steps * b), order.reshape(-1)] = 1
            grad["table"][k] = np.matmul(one.T, wide[k].reshape(3, steps * b, hidden))
        return loss, grad

    def fit(self, windows: list[bytes], labels: list[int], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> list[float]:
        """Adam on batches with as many windows of each class; the loss of each step."""
        rng = np.random.default_rng(seed)
        y = np.asarray(labels)
        size = max(map(len, windows))
        by = [np.flatnonzero(y == k) for k in sorted(set(labels))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            at = np.concatenate([rng.choice(rows, max(1, batch // len(by))) for rows in by])
            x, mask = np.zeros((size, len(at)), np.uint8), np.zeros((size, len(at)), np.float32)
            for j, i in enumerate(at):
                x[: len(windows[i]), j], mask[: len(windows[i]), j] = np.frombuffer(windows[i], np.uint8), 1
            loss, grad = self.gradients(x, y[at], mask)
            losses.append(loss)
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grad.values())))
            lr = rate * min(1.0, step / 20) * (0.05 + 0.95 * 0.5 * (1 + np.cos(np.pi * step / steps)))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(self.p[k].dtype)
        return losses


def noise(n: int, size: int, seed: int = SEED) -> list[bytes]:
    """Windows that are no language: symbols, digits, hexadecimal, base64, random bytes, one character over and over."""
    rng = np.random.default_rng(seed)
    sets = [b"!\"#$%&'()*+,-./:;<=>?@[]^_{|}~ ", b"0123456789 .,-", b"0123456789abcdef", bytes(range(65, 91)) + bytes(range(97, 123)) + b"0123456789+/", bytes(range(256)), None]
    out = []
    for i in range(n):
        s = sets[i % len(sets)]
        s = bytes([int(rng.integers(33, 127))]) if s is None else s
        out.append(bytes(np.frombuffer(s, np.uint8)[rng.integers(0, len(s), size)]))
    return out


def train(docs: DataFrame, seed: int = SEED) -> BiGRU | None:
    """Fit the network on a bounded sample of the rows that have a language; None if there are none.

    Only windows come to the driver, about PER_LANG * WINDOWS * TRAIN_WINDOW bytes for each language whatever the size of docs.
    """
    known = docs.where("lang is not null and trim(lang) not in ('', 'und') and length(text) > 0")
    counts = {r["lang"]: r["n"] for r in docs.where("lang is not null and trim(lang) not in ('', 'und')").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, PER_LANG / n)])
    drawn = known.where(unit_hash(seed, F.col("doc_id")) < share[F.col("lang")])
    at = lambda i: F.substring("text", F.floor(unit_hash(seed + i, F.col("doc_id")) * F.greatest(F.length("text") - TRAIN_WINDOW + 1, F.lit(1))).cast("int") + 1, F.lit(TRAIN_WINDOW))
    got = drawn.select("doc_id", "lang", *[at(i + 1).alias(f"w{i}") for i in range(WINDOWS)]).collect()
    got.sort(key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["w0"]))
    classes = sorted({r["lang"] for r in got}) + [UND]
    windows, labels = [], []
    for r in got:
        for i in range(WINDOWS):
            w = r[f"w{i}"].encode("utf-8", "replace")
            if len(w) >= 24:
                windows.append(w[:TRAIN_WINDOW])
                labels.append(classes.index(r["lang"]))
    if not windows:
        return None
    classes = [c for k, c in enumerate(classes) if c == UND or k in set(labels)]
    names = sorted({r["lang"] for r in got}) + [UND]
    labels = [classes.index(names[k]) for k in labels]
    extra = noise(max(60, len(windows) // len(classes)), TRAIN_WINDOW, seed)
    model = BiGRU(classes, seed=seed)
    model.fit(windows + extra, labels + [classes.index(UND)] * len(extra), seed=seed)
    return model


def label_batch(model: BiGRU, raw: list[bytes], lanes: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For whole texts: class of every byte (texts one after another), summed probabilities (n, K), and the bytes of each."""
    k = len(model.classes)
    size = np.array([len(r) for r in raw], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    labels, pooled = np.zeros(len(data), np.uint8), np.zeros((len(raw), k))
    whole = size // WINDOW
    n_windows = int(whole.sum())
    doc = np.repeat(np.arange(len(raw)), whole)
    begin = start[doc] + (np.arange(n_windows) - np.repeat(np.cumsum(whole) - whole, whole)) * WINDOW
    steps = np.arange(WINDOW)[:, None]
    for at in range(0, n_windows, lanes):
        b = begin[at : at + lanes]
        where = b[None, :] + steps
        p = model.probabilities(data[where])
        labels[where] = p.argmax(0)
        np.add.at(pooled, doc[at : at + lanes], p.sum(1).T)
    rest = size - whole * WINDOW
    tails = np.flatnonzero(rest)
    tails = tails[np.argsort(rest[tails], kind="stable")]  # tails of like length share a batch
    for at in range(0, len(tails), lanes):
        d = tails[at : at + lanes]
        n = rest[d]
        steps_here = int(n.max())
        inside = np.arange(steps_here)[:, None] < n[None, :]
        where = np.minimum((start[d] + whole[d] * WINDOW)[None, :] + np.arange(steps_here)[:, None], max(0, len(data) - 1))
        p = model.probabilities(data[where], None if inside.all() else inside.astype(np.float32))
        labels[where[inside]] = p.argmax(0)[inside]
        pooled[d] += (p * inside).sum(1).T
    return labels, pooled, size


def verdicts(model: BiGRU | None, texts: list[str | None]) -> tuple[list, list, list, list, list, list]:
    """Of each text: language, its probability, whether it is accepted, bytes, and the runs of equal labels as ends and labels."""
    n = len(texts)
    if model is None:
        return [UND] * n, [None] * n, [False] * n, [0] * n, [[]] * n, [[]] * n
    raw = [t.encode("utf-8", "surrogatepass") if t and not t.isspace() else b"" for t in texts]
    labels, pooled, size = label_batch(model, raw)
    mean = pooled / np.maximum(size, 1)[:, None]
    best, und = mean.argmax(1), model.classes.index(UND)
    lang, prob, good, ends, runs = [], [], [], [], []
    start = np.concatenate([[0], np.cumsum(size)])
    cut = np.unique(np.concatenate([np.flatnonzero(labels[1:] != labels[:-1]) + 1, start])) if len(labels) else start[:1]
    first = np.searchsorted(cut, start)
    for i in range(n):
        if not size[i]:
            lang.append(UND), prob.append(None), good.append(False), ends.append([]), runs.append([])
            continue
        name, p = model.classes[best[i]], float(mean[i, best[i]])
        lang.append(name), prob.append(p), good.append(float(mean[i, und]) <= MOST_UND)
        mine = cut[first[i] : first[i + 1] + 1]
        ends.append((mine[1:] - start[i]).astype(np.int32))
        runs.append(labels[mine[:-1]].astype(np.int8))
    return lang, prob, good, size.tolist(), ends, runs


_OUT = "doc_id bigint, lang_id string, probability double, accepted boolean, n_bytes bigint, run_ends array<int>, run_labels array<tinyint>, classes array<string>"


def identify(docs: DataFrame, model: BiGRU | None = None) -> DataFrame:
    """doc_id, lang_id, probability, accepted, n_bytes, and the labels of all positions as runs: where each ends, and its class as a place in classes (from 0)."""
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                lang, prob, good, size, ends, runs = verdicts(model, part.column(1).to_pylist())
                cut = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
                flat = lambda xs, kind: pa.array(np.concatenate([np.asarray(x, kind) for x in xs] or [np.empty(0, kind)]))
                cols = [part.column(0), pa.array(lang, pa.string()), pa.array(prob, pa.float64()), pa.array(good, pa.bool_()), pa.array(size, pa.int64())]
                cols += [pa.ListArray.from_arrays(pa.array(cut), flat(ends, np.int32)), pa.ListArray.from_arrays(pa.array(cut), flat(runs, np.int8))]
                names = model.classes if model is not None else [UND]
                every = np.arange(0, part.num_rows * len(names) + 1, len(names), dtype=np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(every), pa.array(names * part.num_rows, pa.string())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_id", "probability", "accepted", "n_bytes", "run_ends", "run_labels", "classes"])

    return docs.selectExpr("try_cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(frugal(run), _OUT)


def keep_identified(docs: DataFrame, model: BiGRU | None = None) -> DataFrame:
    """The rows of docs whose language is identified; all columns as they were."""
    model = model or train(docs)
    names = docs.columns
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                good = verdicts(model, part.column(where).to_pylist())[2]
                yield part.filter(pa.array(good, pa.bool_()))

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(frugal(run), schema)
