"""Best-fit packing with certified bin counts.

Documents become token pieces of at most ``length`` ids. Pieces are dealt over groups of bounded size; each group is
packed best-fit decreasing, and dual-feasible functions give a lower bound of the bins it needs. A group whose count
equals its bound is final. Groups with a gap exchange their pieces and are packed again; a packing is only replaced by one
with fewer bins. Rounds end when no gap is left or a round saves nothing.

A piece is an integer of 1 to ``length``, so a group is packed from a table of open bins by free space; a full bin needs
no search. Null and empty texts yield one piece, the end id. Repeated rows are packed as often as they occur. An empty table gives an
empty result. Tokenising looks up the ids of each distinct run between spaces, which is exact for tokenizers whose
pre-tokenizer never joins text over white space (tested).
"""
from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbstream.llm.common import input_rows, record, stage

LENGTH, END = 2048, 0
PIECES_PER_GROUP = 100_000
_WORDS = 500_000
_LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u0148\u014A-\u01EF\u01F1-\u024F"  # whose lower case is one letter
_LATIN = re.compile(f"[{_LETTERS}]+")
_SIGNS = ".,;:!?*$%&#"


class Encoder:
    """Token ids of whole texts through a bounded table of runs between ASCII white space.

    A run of Latin letters is one word for the pre-tokenizer, so new ones go straight to the model, in lower case and as
    byte characters. Signs at the end of a run are a word of their own, so such a run is what stands before them and the
    signs. Any other run passes through the whole tokenizer.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(tokenizer_file)
        self.model, self.as_bytes = self.tok.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.signs: dict[str, list[int]] = {}
        self.table = np.zeros(0, np.uint32)
        self.begin = np.zeros(1, np.int64)

    def _ids(self, run: str) -> list[int]:
        if run.isascii() and run.isalpha():
            return [t.id for t in self.model.tokenize(run.lower())]
        if _LATIN.fullmatch(run):
            return [t.id for t in self.model.tokenize(self.as_bytes.pre_tokenize_str(normalize("NFC", run).lower())[0][0])]
        word = run.rstrip(_SIGNS)
        if word != run and _LATIN.fullmatch(word):
            k = self.at.get(word)
            own = self._ids(word) if k is None else self.table[self.begin[k] : self.begin[k + 1]].tolist()
            sign = run[len(word) :]
            if sign not in self.signs:
                self.signs[sign] = self.tok.encode(sign, add_special_tokens=False).ids
            return own + self.signs[sign]
        return self.tok.encode(run, add_special_tokens=False).ids

    def _learn(self, new: list[str]) -> None:
        flat, ends = array("I"), array("q")
        base, n = int(self.begin[-1]), len(self.at)
        for w in new:
            flat.extend(self._ids(w))
            ends.append(base + len(flat))
        self.at.update(zip(new, range(n, n + len(new)), strict=True))
        self.table = np.concatenate([self.table, np.frombuffer(flat, np.uint32)])
        self.begin = np.concatenate([self.begin, np.frombuffer(ends, np.int64)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.at) > _WORDS:
            self.clear()
        runs, found, none = [], [], repeat(-1)
        for t in texts:
            t = t.replace("\n", " ").replace("\t", " ").replace("\r", " ")
            # A-Z is lower-cased by the tokenizer either way; fewer runs differ. Special tokens are told by case.
            r = (t.lower() if t.isascii() and "<|" not in t else t).split(" ")
            runs.append(r)
            found.append(np.fromiter(map(self.at.get, r, none), np.int64, len(r)))
        gaps = [np.flatnonzero(k < 0) for k in found]
        new = dict.fromkeys(r[i] for r, g in zip(runs, gaps, strict=True) for i in g.tolist())
        if new:
            self._learn(list(new))
        out = []
        for r, k, g in zip(runs, found, gaps, strict=True):
            if len(g):
                k[g] = [self.at[r[i]] for i in g.tolist()]
            lo, n = self.begin[k], self.begin[k + 1] - self.begin[k]
            ends = np.cumsum(n)
            out.append(self.table[np.repeat(lo - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)])
        return out


#: Kept by a worker process from task to task; a table of runs is the same whoever fills it.
_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def pieces(docs: DataFrame, tokenizer_file: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (place of the document in the input), piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_file)
        for batch in batches:
            out: list[list[int | None]] = [[] for _ in range(6)]
            ids, rows, texts = (batch.column(c).to_pylist() for c in ("doc_id", "row", "text"))
            for lo in range(0, len(texts), 256):
                for d, r, t in zip(ids[lo : lo + 256], rows[lo : lo + 256], enc.encode(texts[lo : lo + 256]), strict=True):
                    t = np.append(t, END).astype("<u4")
                    for p, s in enumerate(range(0, len(t), length)):
                        x = t[s : s + length]
                        for c, v in zip(out, (d, r, p, s, len(x), zlib.crc32(x.tobytes())), strict=True):
                            c.append(v)
            yield record(["doc_id", "row", "piece", "start", "length", "ids_crc32"], *[pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(out)])

    rows = input_rows(docs, doc_id, text).select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each size, and the number of bins. Bins are found by free space in a table."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(length + 1)]
    tail = 0  # bit f is set while a bin with f free places is open
    n, used = 0, []
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = tail >> size
        if fits:
            f = size + (fits & -fits).bit_length() - 1
            b = free[f].pop()
            if not free[f]:
                tail &= ~(1 << f)
        else:
            b, f, n = n, length, n + 1
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if f - size:
            free[f - size].append(b)
            tail |= 1 << (f - size)
    return bins, offsets, n


def lower_bound(sizes: np.ndarray, length: int) -> int:
    """The largest bound of bins over two families of dual-feasible functions, by number of pieces of each size."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=length + 1)
    x = np.arange(length + 1)
    best = -(-int((count * x).sum()) // length)
    # Pieces over length - t count as a whole bin, those under t as nothing.
    upper, mass = np.cumsum(count[::-1])[::-1], np.cumsum(count * x)
    for t in range(1, length // 2 + 1):
        mid = int(mass[length - t] - mass[t - 1])
        best = max(best, (int(upper[length - t + 1]) if t else 0) + -(-mid // length))
    # Rounding to k parts of a bin: (k + 1) x / length down, unless it divides; k of them fill a bin.
    for k in range(1, 21):
        y = (k + 1) * x
        f = np.where(y % length == 0, x * k, (y // length) * length)
        best = max(best, -(-int((count * f).sum()) // (length * k)))
    return best


def _pack(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One partition, sorted by group: packs group after group, holding one."""
        held: list[pa.RecordBatch] = []
        now: int | None = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                sizes = t.column("length").to_numpy()
                bins, offsets, n = best_fit_decreasing(sizes, length)
                least = lower_bound(sizes, length)
                m = len(sizes)
                for b in pa.table([t.column("grp"), t.column("row"), t.column("piece"), t.column("length"), pa.array(bins), pa.array(offsets), pa.array(np.full(m, n)), pa.array(np.full(m, least))], names=["grp", "row", "piece", "length", "bin", "offset", "bins", "least"]).to_batches(20_000):
                    yield b

        for batch in batches:
            g = batch.column("grp").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if g[lo] != now:
                        yield from close()
                        held, now = [], g[lo]
                    held.append(batch.slice(lo, hi - lo))
        yield from close()

    return run


_PACKED = "grp bigint, row bigint, piece int, length bigint, bin bigint, offset bigint, bins bigint, least bigint"


def _pack_groups(p: DataFrame, length: int) -> DataFrame:
    return p.select("grp", "row", "piece", "length").repartition("grp").sortWithinPartitions("grp", "row", "piece").mapInArrow(_pack(length), _PACKED)


def pack(docs: DataFrame, tokenizer_file: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", group: int = PIECES_PER_GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    all_pieces = stage(pieces(docs, tokenizer_file, length, doc_id, text), "pack-pieces")
    n = all_pieces.count()
    groups = max(1, -(-n // group))
    dealt = all_pieces.withColumn("grp", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    packed = stage(_pack_groups(dealt, length), "pack-0")
    rounds = 0
    while True:
        sums = packed.groupBy("grp").agg(F.max("bins").alias("bins"), F.max("least").alias("least"))
        gaps = stage(sums.where("bins > least"), "pack-gaps")
        left, bins = gaps.agg(F.count("*"), F.sum("bins")).first()
        if left < 2:  # nothing to exchange with
            break
        rounds += 1
        first = gaps.agg(F.min("grp")).first()[0]
        base = first - first % (1 << 40) + (1 << 40)  # group numbers of this round
        again = packed.join(gaps.select("grp"), "grp", "left_semi")
        again = again.withColumn("grp", F.lit(base) + F.pmod(F.xxhash64("row", "piece", F.lit(rounds)), F.lit(left)))
        new = stage(_pack_groups(again, length), f"pack-{rounds}")
        made = new.select("grp", "bins").distinct().agg(F.sum("bins")).first()[0]
        if made >= bins:
            break
        packed = stage(packed.join(gaps.select("grp"), "grp", "left_anti").unionByName(new), "pack-merged")
    # Numbered by group: a group's bins follow those of the groups before it. One row per group of 100,000 pieces.
    starts = packed.groupBy("grp").agg(F.max("bins").alias("bins"))
    starts = starts.select("grp", F.coalesce(F.sum("bins").over(W.orderBy("grp").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("from"))
    placed = packed.join(F.broadcast(starts), "grp").select("row", "piece", (F.col("from") + F.col("bin")).alias("sequence_id"), "offset")
    return all_pieces.join(placed, ["row", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

