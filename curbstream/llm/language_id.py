"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled documents. It reads a
text in stretches of ``STRETCH`` bytes in both directions, gives every byte position a distribution over languages, and
pools the positions of the whole document: the mean of their log probabilities, as a distribution again. Its largest
value is the score.

Every whole text is read, null or letterless ones get ``und`` and score 0. Without labelled documents every text is
``und``. Repeated rows get equal results; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curbstream.llm.common import record
from curbstream.llm.words import slices, texts

STRETCH, TRAIN_STRETCH, HIDDEN = 128, 64, 8
#: At most about so many labelled documents of each language are sampled for the fit, and so many stretches of each.
SAMPLE_DOCS, SAMPLE_STRETCHES = 600, 6
UNKNOWN = "und"


@dataclass
class Net:
    """A minimal gated unit in each of two directions, and one output layer.

    gate f = sigmoid(E_f[byte] + h U_f), candidate n = tanh(E_n[byte] + f * (h U_n)), h <- n + f (h - n). Gate and
    candidate stand side by side in the last axis.
    """

    byte: np.ndarray  # 2, 256, 2 H
    square: np.ndarray  # 2, H, 2 H
    out: np.ndarray  # 2, H, K
    bias: np.ndarray  # K
    labels: list[str]

    def params(self) -> list[np.ndarray]:
        return [self.byte, self.square, self.out, self.bias]


def new_net(labels: list[str], hidden: int, seed: int) -> Net:
    rng = np.random.default_rng(seed)
    f = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    return Net(f(2, 256, 2 * hidden, s=0.3), f(2, hidden, 2 * hidden, s=hidden**-0.5), f(2, hidden, len(labels), s=0.3), np.zeros(len(labels), np.float32), labels)


def _both_ways(x: np.ndarray) -> np.ndarray:
    """(B, L) bytes to (L, 2, B): forward, and from the end."""
    return np.ascontiguousarray(np.stack([x.T, x[:, ::-1].T], axis=1)).astype(np.int64)


def states(net: Net, x: np.ndarray) -> np.ndarray:
    """(B, L) bytes to the two hidden states at each position, (2, L, B, H). Works in place on a few buffers."""
    steps, hidden = _both_ways(x), net.square.shape[1]
    length, _, batch = steps.shape
    half = np.concatenate([np.full(hidden, 0.5, np.float32), np.ones(hidden, np.float32)])
    byte, square = net.byte * half, net.square * half
    hs = np.empty((2, length, batch, hidden), np.float32)
    g, e = np.empty((batch, 2 * hidden), np.float32), np.empty((batch, 2 * hidden), np.float32)
    f, n = np.empty((batch, hidden), np.float32), np.empty((batch, hidden), np.float32)
    for d in (0, 1):
        h = np.zeros((batch, hidden), np.float32)
        for t in range(length):
            np.matmul(h, square[d], out=g)
            np.take(byte[d], steps[t, d], axis=0, out=e, mode="clip")
            np.add(g[:, :hidden], e[:, :hidden], out=f)
            np.tanh(f, out=f)
            f *= 0.5
            f += 0.5
            np.multiply(g[:, hidden:], f, out=n)
            n += e[:, hidden:]
            np.tanh(n, out=n)
            to = hs[d, t if d == 0 else length - 1 - t]
            np.subtract(h, n, out=to)
            to *= f
            to += n
            h = to
    return hs


def log_probs(net: Net, hs: np.ndarray) -> np.ndarray:
    """(K, L, B): log probability of each language at each position. Outputs are bounded, so exp needs no shift."""
    _, length, batch, hidden = hs.shape
    y = sum(net.out[d].T @ hs[d].reshape(-1, hidden).T for d in (0, 1)) + net.bias[:, None]
    y -= np.log(np.exp(y).sum(axis=0))
    return y.reshape(-1, length, batch)


def gradients(net: Net, x: np.ndarray, label: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over the masked positions and its gradients, by backpropagation through time."""
    steps, hidden = _both_ways(x), net.square.shape[1]
    length, _, batch = steps.shape
    kept, h = [], np.zeros((2, batch, hidden), net.byte.dtype)
    hs = np.empty((2, length, batch, hidden), net.byte.dtype)
    for t in range(length):
        g = np.matmul(h, net.square)
        e = np.stack([net.byte[d][steps[t, d]] for d in (0, 1)])
        f = 0.5 * np.tanh(0.5 * (g[..., :hidden] + e[..., :hidden])) + 0.5
        n = np.tanh(e[..., hidden:] + f * g[..., hidden:])
        kept.append((h, f, n, g[..., hidden:]))
        h = n + f * (h - n)
        hs[0, t], hs[1, length - 1 - t] = h
    lp = log_probs(net, hs)
    m = mask.T / mask.sum()
    hot = np.eye(len(net.labels), dtype=lp.dtype)[label].T[:, None]
    loss = -float((lp * hot * m).sum())
    dy = (np.exp(lp) - hot) * m
    flat = dy.reshape(len(dy), -1)
    d_out = np.stack([hs[d].reshape(-1, hidden).T @ flat.T for d in (0, 1)])
    d_hs = [(flat.T @ net.out[d].T).reshape(length, batch, hidden) for d in (0, 1)]
    d_square, d_byte = np.zeros_like(net.square), np.zeros_like(net.byte)
    pre = np.empty((2, length, batch, 2 * hidden), net.byte.dtype)
    dh = np.zeros((2, batch, hidden), net.byte.dtype)
    for t in range(length - 1, -1, -1):
        hp, f, n, gn = kept[t]
        dh = dh + np.stack([d_hs[0][t], d_hs[1][length - 1 - t]])
        dn = dh * (1 - f) * (1 - n * n)
        pre[:, t, :, :hidden] = (dh * (hp - n) + dn * gn) * f * (1 - f)
        pre[:, t, :, hidden:] = dn
        through = pre[:, t].copy()
        through[..., hidden:] *= f
        d_square += np.matmul(hp.transpose(0, 2, 1), through)
        dh = dh * f + np.matmul(through, net.square.transpose(0, 2, 1))
    for d in (0, 1):
        at = steps[:, d].ravel()
        order = np.argsort(at, kind="stable")
        which, begin = np.unique(at[order], return_index=True)
        d_byte[d, which] = np.add.reduceat(pre[d].reshape(-1, 2 * hidden)[order], begin, axis=0)
    return loss, [d_byte, d_square, d_out, dy.sum(axis=(1, 2))]


def train(x: np.ndarray, mask: np.ndarray, label: np.ndarray, labels: list[str], steps: int = 200, batch: int = 192, rate: float = 0.02, hidden: int = HIDDEN, seed: int = 3) -> Net:
    """Adam over random batches of stretches, classes drawn evenly."""
    net, rng = new_net(labels, hidden, seed), np.random.default_rng(seed)
    m1, m2 = ([np.zeros_like(p) for p in net.params()] for _ in range(2))
    by = [np.flatnonzero(label == k) for k in range(len(labels))]
    for step in range(1, steps + 1):
        at = np.concatenate([rng.choice(b, -(-batch // len(by))) for b in by if len(b)])
        _, grads = gradients(net, x[at], label[at], mask[at])
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(net.params(), grads, m1, m2, strict=True):
            g = np.clip(g, -1, 1)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return net


def stretches(off: np.ndarray, data: np.ndarray, length: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of some documents in rows of ``length``: bytes (spaces after a document's end), number of own bytes, document."""
    n = np.diff(off)
    rows = -(-n // length)
    doc = np.repeat(np.arange(len(n)), rows)
    within = (np.arange(len(doc)) - np.repeat(np.cumsum(rows) - rows, rows)) * length
    own = np.minimum(n[doc] - within, length)
    at = (off[:-1][doc] + within)[:, None] + np.arange(length)
    mask = np.arange(length) < own[:, None]
    return np.where(mask, data[np.minimum(at, len(data) - 1)], 32).astype(np.uint8), mask, doc


def pooled(net: Net, off: np.ndarray, data: np.ndarray, block: int = 1024) -> np.ndarray:
    """Sum over all positions of the log probabilities of each document, and the number of positions last."""
    out = np.zeros((len(off) - 1, len(net.labels) + 1))
    for lo, hi in slices(off, block * STRETCH):
        x, mask, doc = stretches(off[lo : hi + 1], data)
        for i in range(0, len(x), block):
            m = mask[i : i + block].astype(np.float32)
            own = (log_probs(net, states(net, x[i : i + block])) * m.T).sum(axis=1).T
            np.add.at(out, lo + doc[i : i + block], np.concatenate([own, m.sum(axis=1, keepdims=True)], axis=1))
    return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs: int = SAMPLE_DOCS, each: int = SAMPLE_STRETCHES) -> Net | None:
    """Trains on at most about ``docs`` documents of each label, ``each`` stretches of each, chosen by the hash of ``key``."""
    have = labelled.where(F.col(lang).isNotNull() & F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    counts = {r[lang]: r["count"] for r in have.groupBy(lang).count().collect()}  # one row per language
    if not counts:
        return None
    labels = sorted(counts)
    share = F.create_map(*[F.lit(v) for k in labels for v in (k, min(1.0, docs / counts[k]))])
    luck = F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    picked = have.where(luck < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("h"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = texts(b.column("text"))
            out: list[list] = [[], [], []]
            for i, (k, h) in enumerate(zip(b.column("lang").to_pylist(), b.column("h").to_pylist(), strict=True)):
                n = int(off[i + 1] - off[i])
                starts = sorted({int(s) for s in np.random.default_rng(h & (2**63 - 1)).integers(0, max(1, n - TRAIN_STRETCH + 1), each)})
                for s in starts:
                    out[0].append(k), out[1].append(h), out[2].append(data[off[i] + s : off[i] + min(n, s + TRAIN_STRETCH)].tobytes())
            yield record(["lang", "h", "part"], pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()))

    rows = sorted((r["lang"], r["h"], bytes(r["part"])) for r in picked.mapInArrow(cut, "lang string, h bigint, part binary").collect())  # the bounded sample
    off = np.concatenate([[0], np.cumsum([len(p) for _, _, p in rows])])
    x, mask, _ = stretches(off, np.frombuffer(b"".join(p for _, _, p in rows), np.uint8), TRAIN_STRETCH)
    label = np.array([labels.index(k) for k, _, _ in rows])
    return train(x, mask.astype(np.float32), label, labels)


def annotate(docs: DataFrame, net: Net | None, text: str = "text", pred: str = "_lang_pred", score: str = "_lang_score") -> DataFrame:
    """The input rows, all columns as they were, with ``pred`` and ``score`` added."""
    if net is None:
        return docs.withColumns({pred: F.lit(UNKNOWN), score: F.lit(0.0)})
    schema = StructType(list(docs.schema.fields)).add(pred, "string").add(score, "double")
    words = F.coalesce(docs[text].cast("string"), F.lit(""))
    own = len(docs.columns)
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)], words.alias("text"), words.rlike(r"\p{L}").alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*net.labels, UNKNOWN], dtype=object)
        for b in batches:
            got = pooled(net, *texts(b.column(own)))
            p = np.exp(got[:, :-1] / np.maximum(got[:, -1:], 1))
            p /= p.sum(axis=1, keepdims=True)
            ok = b.column(own + 1).to_numpy(zero_copy_only=False)
            best = np.where(ok, p.argmax(axis=1), len(net.labels))
            yield record(schema.names, *b.columns[:own], pa.array(names[best], pa.string()), pa.array(np.where(ok, p.max(axis=1), 0.0).astype(np.float64)))

    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, net: Net | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    return annotate(rows, net, "text", "lang_pred", "score").select("doc_id", "lang_pred", "score")
