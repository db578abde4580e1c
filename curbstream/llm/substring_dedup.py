"""Substring dedup by suffix automata of reference shards.

A window is ``WINDOW`` consecutive words of one document. A word is removed when a window over it also starts in a document
with a smaller id; windows are judged on the input. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.

1. Anchors. Each window is filed under the least hash of its eight-word grams (the leftmost on a tie), so equal windows are
   filed alike wherever they stand. Consecutive windows with one anchor are a piece: a stretch of words of the document.
2. Reference shards. Only anchors of two or more documents can matter; the different pieces under such an anchor, each with
   the smallest document that has it, are one shard. A shard goes to the task that holds the documents' pieces with its anchor.
   Automata of all shards would grow with the data, so they are not broadcast to all tasks. Shards of more than
   ``SHARD_PIECES`` pieces are cut, and what their parts found is merged by window in Spark.
3. Streaming. The shard's pieces run through its suffix automaton with word transitions. Every state knows the smallest
   document among its places; at each end of a window the state of the last ``WINDOW`` words is followed.
4. Spans. Windows with a smaller document become spans of words, merged per document, cut out of the text.

A null text has no words. A null id never has a smaller one and is none: such rows stay whole. Rows that repeat an id do
not remove each other's words. An empty table gives an empty result. Word hashes have 64 bits, pieces are told apart by two.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbstream.llm.common import bloom_of, input_rows, record, stage
from curbstream.llm.words import Bloom, Words, mix, powers, word_slices

WINDOW, GRAM = 50, 8
SHARD_PIECES, _ROWS_OUT = 1000, 2000
_PLACE = np.uint64((1 << 24) - 1)


class SuffixAutomaton:
    """Of several word sequences, each with a number; a state holds the smallest number among the places of its words."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.low = [-1], [0], [2**63 - 1]

    def _copy(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.low.append(2**63 - 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._copy(last, c, q)
        new, p = len(self.next), last
        self.next.append({})
        self.size.append(self.size[last] + 1)
        self.low.append(2**63 - 1)
        self.link.append(0)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._copy(p, c, q)
        return new

    def add(self, words: Sequence[int], number: int) -> None:
        at = 0
        for c in words:
            at = self._extend(at, c)
            if number < self.low[at]:
                self.low[at] = number

    def finish(self) -> None:
        """Passes the smallest numbers from longer contexts to their suffixes."""
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            p = self.link[v]
            if self.low[v] < self.low[p]:
                self.low[p] = self.low[v]

    def matches(self, words: Sequence[int], window: int) -> Iterator[tuple[int, int | None]]:
        """For each word: length of the longest match that ends there (``window`` at most), and the smallest number of a full one."""
        at, n = 0, 0
        for c in words:
            while at and c not in self.next[at]:
                at = self.link[at]
                n = min(n, self.size[at])
            if c in self.next[at]:
                at, n = self.next[at][c], n + 1
            while at and self.size[self.link[at]] >= window:
                at = self.link[at]
            n = min(n, window)
            yield n, self.low[at] if n >= window else None


def anchors(w: Words, h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of a slice: anchor hash, first word, number of windows, document."""
    g, at = w.windows(h, gram)
    n, span = len(h), window - gram + 1
    counts = w.counts
    doc = np.repeat(np.arange(len(counts)), counts)
    ok = np.arange(n) + window <= w.first[1:][doc] if n else np.zeros(0, bool)
    if not ok.any():
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e
    # The least (hash, place) of the next ``span`` grams, by running minima from both ends of blocks.
    full = -(-n // span) * span
    key = np.full(full, np.uint64(2**64 - 1), np.uint64)
    key[at] = (g & ~_PLACE) | (at.astype(np.uint64) & _PLACE)
    left = np.minimum.accumulate(key.reshape(-1, span), axis=1).ravel()
    right = np.minimum.accumulate(key.reshape(-1, span)[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.flatnonzero(ok)
    least = np.minimum(right[start], left[start + span - 1])
    place = start + ((least & _PLACE).astype(np.int64) - start % (1 << 24)) % (1 << 24)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    full_hash = np.zeros(n, np.uint64)
    full_hash[at] = g
    return full_hash[place[first]], start[first], np.diff(np.append(first, len(start))), doc[start[first]]


def _stretch_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    base = np.uint64(0xC2B2AE3D27D4EB4F)
    p, inv = powers(base, len(h)), powers(np.uint64(pow(int(base), -1, 1 << 64)), len(h))
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p, dtype=np.uint64)])
    return mix((s[end] - s[start]) * inv[start] + (end - start).astype(np.uint64))


_PIECE = "a bigint, p1 bigint, p2 bigint, doc_id bigint, th bigint, s0 bigint, n int"


def _pieces(batch: pa.RecordBatch, wanted: Bloom | None = None, key: Callable[..., np.ndarray] = lambda a, p1, doc_id: a) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Per slice: the columns of its pieces (those whose key is in ``wanted``), and the hashes of its words."""
    ids = batch.column("doc_id").to_numpy()
    for lo, _, w in word_slices(batch.column("text")):
        h = w.hashes(21)
        a, s, n, doc = anchors(w, h)
        if wanted is None:
            yield {"a": a, "doc": lo + doc}, h
            continue
        e = s + n + WINDOW - 1
        p1 = _stretch_hash(h, s, e)
        at = np.flatnonzero(wanted.has(key(a, p1, ids[lo + doc])))
        if len(at):
            a, s, n, e, doc, p1 = a[at], s[at], n[at], e[at], doc[at], p1[at]
            yield {"a": a, "p1": p1, "p2": _stretch_hash(w.hashes(22), s, e), "doc": lo + doc, "s0": s - w.first[doc], "n": n, "from": s, "to": e}, h


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of each document, each once."""
    for b in batches:
        for p, _ in _pieces(b):
            a, doc = p["a"], p["doc"]
            order = np.lexsort((a, doc))
            a, doc = a[order], doc[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
            yield record(["a", "doc_id"], pa.array(a[new].view(np.int64)), b.column("doc_id").take(pa.array(doc[new])))


def _source_key(a: np.ndarray, p1: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return mix(p1 ^ mix(doc_id.view(np.uint64)))


def _spans(low: np.ndarray, doc: int, s0: int) -> list[tuple[int, int]]:
    hit = np.flatnonzero(low < doc)
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > WINDOW)
    return [(s0 + int(i), s0 + int(j) + WINDOW) for i, j in zip(hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])], strict=True)]


def _instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of documents with the smallest documents of their windows to spans of words."""
    for b in batches:
        out: list[list] = [[], [], [], []]
        for d, th, s0, low in zip(*(b.column(c).to_pylist() for c in ("doc_id", "th", "s0", "low")), strict=True):
            for x, y in _spans(np.array(low, np.int64), d, s0):
                for o, v in zip(out, (d, th, x, y), strict=True):
                    o.append(v)
        yield record(["doc_id", "th", "from", "to"], *[pa.array(o, pa.int64()) for o in out])


def _digest(words: list[bytes], spans: list[tuple[int, int]]) -> tuple[int, str, list[bytes]]:
    gone = np.zeros(len(words), bool)
    for x, y in spans:
        gone[x:y] = True
    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if spans else words
    return int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), kept


def _automata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition sorted by shard: builds a shard's automaton, streams its pieces. Holds one shard and some results."""
    out: list[list] = [[] for _ in range(6)]

    def run(rows: list[tuple]) -> None:
        sam = SuffixAutomaton()
        words = [np.frombuffer(r[5], np.int64).tolist() for r in rows]
        for r, w in zip(rows, words, strict=True):
            sam.add(w, r[4])
        sam.finish()
        for r, w in zip(rows, words, strict=True):
            low = [x for n, x in sam.matches(w, WINDOW) if n >= WINDOW]
            keys = [hashlib.blake2b(r[5][8 * i : 8 * (i + WINDOW)], digest_size=16).digest() for i in range(len(low))] if r[6] > 1 else []
            for c, v in zip(out, (*r[:4], low, keys), strict=True):
                c.append(v)

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.binary())]
        done = record(["a", "p1", "p2", "sub", "low", "keys"], *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)])
        for c in out:
            c.clear()
        return done

    now, held = None, []
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in ("a", "p1", "p2", "sub", "md", "words", "subs")), strict=True):
            if (r[0], r[3]) != now:
                if held:
                    run(held)
                if len(out[0]) > _ROWS_OUT:
                    yield flush()
                now, held = (r[0], r[3]), []
            held.append(r)
    if held:
        run(held)
    yield flush()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different windows of each part of a shard in a batch, with the smallest document the part knows."""
    for b in batches:
        held: dict[tuple[int, int, bytes], int] = {}
        for a, sub, low, keys in zip(*(b.column(c).to_pylist() for c in ("a", "sub", "low", "keys")), strict=True):
            held.update(zip(((a, sub, k) for k in keys), low, strict=True))
        yield record(["a", "sub", "key", "low"], pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int64()), pa.array([k[2] for k in held], pa.binary()), pa.array(list(held.values()), pa.int64()))


def _merged(pieces: pa.Table, shared: pa.Table) -> pa.Table:
    """One part's pieces with what other parts know about their windows."""
    best = dict(zip(shared.column("key").to_pylist(), shared.column("low").to_pylist(), strict=True))
    low = [[best.get(k, x) for k, x in zip(ks, lo, strict=True)] for ks, lo in zip(pieces.column("keys").to_pylist(), pieces.column("low").to_pylist(), strict=True)]
    return pa.table([pieces.column("a"), pieces.column("p1"), pieces.column("p2"), pa.array(low, pa.list_(pa.int64()))], names=["a", "p1", "p2", "low"])


def removable_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, spans): word spans to remove; th is the text's xxhash64, which tells rows with one id apart."""
    rows = input_rows(docs, doc_id, text).where("doc_id is not null").withColumn("th", F.xxhash64("text"))
    shared = rows.select("doc_id", "text").mapInArrow(_first, "a bigint, doc_id bigint").groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("a")
    shared = stage(shared, "substring-anchors")
    some = bloom_of(shared, "a", 26)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, _ in _pieces(b, some):
                of = pa.array(p["doc"])
                yield record(_PIECE.replace(",", "").split()[::2], *[pa.array(p[c].view(np.int64)) for c in ("a", "p1", "p2")], b.column("doc_id").take(of), b.column("th").take(of), pa.array(p["s0"]), pa.array(p["n"].astype(np.int32)))

    pieces = stage(rows.mapInArrow(second, _PIECE).join(shared, "a", "left_semi"), "substring-pieces")
    distinct = pieces.groupBy("a", "p1", "p2").agg(F.min("doc_id").alias("md"), F.max("doc_id").alias("xd"), F.max("n").alias("n"))
    per = distinct.groupBy("a").agg(F.count("*").alias("np"), F.min("md").alias("lo"), F.max("xd").alias("hi")).where("lo < hi")
    distinct = stage(distinct.join(per.select("a", "np"), "a"), "substring-distinct")
    # A piece under an anchor of its own has one smallest document for all its windows.
    alone = distinct.where("np = 1").select("a", "p1", "p2", F.array_repeat("md", F.col("n")).alias("low"))
    several = distinct.where("np > 1").withColumn("subs", F.ceil(F.col("np") / SHARD_PIECES).cast("int")).withColumn("sub", F.pmod("p1", "subs"))
    several = several.select("a", "p1", "p2", "md", "sub", "subs")
    keyed = stage(several, "substring-several")

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield record(["k"], pa.array(_source_key(b.column("a").to_numpy(), b.column("p1").to_numpy().view(np.uint64), b.column("md").to_numpy()).view(np.int64)))

    sources = bloom_of(keyed.select("a", "p1", "md").mapInArrow(source, "k bigint"), "k", 26)

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, h in _pieces(b, sources, _source_key):
                words = h.view(np.int64)
                yield record(["a", "p1", "p2", "md", "words"], *[pa.array(p[c].view(np.int64)) for c in ("a", "p1", "p2")], b.column("doc_id").take(pa.array(p["doc"])), pa.array([words[i:j].tobytes() for i, j in zip(p["from"], p["to"], strict=True)], pa.binary()))

    texts = rows.select("doc_id", "text").mapInArrow(third, "a bigint, p1 bigint, p2 bigint, md bigint, words binary").groupBy("a", "p1", "p2", "md").agg(F.first("words").alias("words"))
    shards = keyed.join(texts, ["a", "p1", "p2", "md"]).select("a", "p1", "p2", "sub", "md", "words", "subs")
    ran = stage(shards.repartition("a", "sub").sortWithinPartitions("a", "sub", "p1", "p2").mapInArrow(_automata, "a bigint, p1 bigint, p2 bigint, sub bigint, low array<bigint>, keys array<binary>"), "substring-automata")
    whole = ran.where(F.size("keys") == 0).select("a", "p1", "p2", "low")
    # Parts of a large shard: windows that several parts have take the smallest document of all of them.
    parts = ran.where(F.size("keys") > 0)
    known = parts.select("a", "sub", "low", "keys").mapInArrow(_windows, "a bigint, sub bigint, key binary, low bigint")
    best = known.groupBy("a", "key").agg(F.min("low").alias("low"), F.collect_set("sub").alias("subs")).where(F.size("subs") > 1).select("a", F.explode("subs").alias("sub"), "key", "low")
    parts = parts.groupBy("a", "sub").cogroup(best.groupBy("a", "sub")).applyInArrow(_merged, "a bigint, p1 bigint, p2 bigint, low array<bigint>")
    low = stage(alone.union(whole).union(parts), "substring-low")
    hits = pieces.join(low, ["a", "p1", "p2"]).where(F.array_min("low") < F.col("doc_id"))
    spans = hits.select("doc_id", "th", "s0", "low").mapInArrow(_instances, "doc_id bigint, th bigint, from bigint, to bigint")
    return spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("from", "to")).alias("spans"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, spans; with ``with_text`` also kept_text.

    Documents without a span never leave their task; those with one meet their spans by id and text hash.
    """
    rows = input_rows(docs, doc_id, text).withColumn("th", F.xxhash64("text"))
    spans = stage(removable_spans(docs, doc_id, text), "substring-spans")
    some = bloom_of(spans, "th")
    kind = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<from:bigint,to:bigint>>" + ", kept_text string" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column("spans").to_pylist() if "spans" in b.schema.names else [None] * b.num_rows
            out: list[list] = [[] for _ in range(5)]
            for t, s in zip(b.column("text").to_pylist(), given, strict=True):
                words = (t or "").encode().split()
                gone, sha, kept = _digest(words, [(x["from"], x["to"]) for x in s or []])
                for o, v in zip(out, (len(words), gone, sha, s or [], b" ".join(kept).decode() if with_text else None), strict=True):
                    o.append(v)
            span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], span)] + [pa.array(out[4], pa.string())] * with_text
            yield record(["doc_id", "n_words", "n_removed", "kept_sha256", "spans"] + ["kept_text"] * with_text, b.column("doc_id"), *cols)

    def chosen(inside: bool):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(some.has(b.column("th").to_numpy()) == inside))

        return keep

    columns = "doc_id bigint, text string, th bigint"

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cut(chosen(False)(batches))

    there = rows.mapInArrow(chosen(True), columns).alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.th") == F.col("s.th")), "left")
    return rows.mapInArrow(clean, kind).union(there.select("d.doc_id", "text", "spans").mapInArrow(cut, kind))
