"""Ranked lexical search over an inverted index in shards, by Block-Max MaxScore. All scores are 64-bit integers.

``build`` scans the documents once for the two corpus sums that scores need, and once more to write the index: a shard is
some megabytes of one task's documents, so nothing is shuffled. A shard holds one row per term: its postings in blocks of
128, each packed into gaps and counts of one, two or four bytes, with the largest impact of every block and of the list.

``search`` joins the lists with the terms of the items and hands each (shard, block of items) to one task at a time. Lists
come in the order of their bound. Those whose bounds could lift a document to the present 50th score are essential and read
whole; for the others only documents already found are candidates, and a candidate whose partial score, with the bounds of
the lists to come and the best impact of the block it falls in, stays below that score goes before the block is
unpacked. A task keeps its 50 best per item over all shards it sees, so bounds get tighter, and the tasks' bests are merged.

A rejected document is proven to be below 50 others, so nothing is lost; equal scores are kept and ordered by id.

Nulls: a null text has no terms and counts for nothing, a null id comes last among equal scores. Rows of one item id (null
included) are one item. Repeated documents are documents of their own. Without documents or terms the result is empty.
Long texts are cut between terms while they are scanned. Other columns are ignored. ``n * N`` times 50 has to fit in 64 bits.
"""
from __future__ import annotations

import itertools
import os
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbstream.llm.common import input_rows, record, shuffle_width, stage
from curbstream.llm.words import texts
from curbstream.session import staging_root

TOP, BLOCK, ITEMS = 50, 128, 512
#: Bytes of text in a shard; a longer document is a shard by itself.
SHARD = 8 << 20
_PIECE = 1 << 20
_TERM, _BETWEEN = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The documents of a shard are a list without a term.
_LIST = "shard bigint, term string, df bigint, best bigint, last array<int>, peak array<bigint>, at array<int>, wide array<smallint>, data binary, ids array<bigint>, lengths array<bigint>"


def norm(n: np.ndarray | int, docs: int, terms: int) -> np.ndarray | int:
    """The length of a document in hundredths of the mean, half of it counted."""
    return 50 + (50 * n * docs) // terms


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def corpus_sums(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and all their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            off, data = texts(batch.column(0))
            for i in range(batch.num_rows):
                found = 0
                for lo in range(off[i], off[i + 1], _PIECE):
                    # One byte more in front tells whether a term goes on.
                    x = _IS_TERM[data[max(lo - 1, off[i]) : min(lo + _PIECE, off[i + 1])]]
                    found += int(np.count_nonzero(x[1:] & ~x[:-1])) + int(lo == off[i] and bool(x[0]))
                n, total = n + (found > 0), total + found
        yield record(["n", "total"], pa.array([n], pa.int64()), pa.array([total], pa.int64()))

    r = docs.select("text").mapInArrow(count, "n bigint, total bigint").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return int(r.n or 0), int(r.total or 0)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about a megabyte, cut between terms."""
    at = 0
    while len(text) - at > _PIECE:
        m = _BETWEEN.search(text, at + _PIECE)
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


@dataclass
class _Shard:
    """Documents of a shard while they are scanned: a number for each of their terms."""

    number: defaultdict = field(default_factory=lambda: defaultdict(itertools.count().__next__))
    terms: list[np.ndarray] = field(default_factory=list)
    ids: list[int | None] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    size: int = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        n = 0
        for piece in _pieces(text):
            found = _TERM.findall(piece.lower())
            self.terms.append(np.fromiter(map(self.number.__getitem__, found), np.int64, len(found)))
            n += len(found)
        if n:
            self.ids.append(doc_id)
            self.lengths.append(n)
        self.size += len(text)

    def rows(self, shard: int, docs: int, total: int) -> pa.RecordBatch:
        schema = ["shard", "term", "df", "best", "last", "peak", "at", "wide", "data", "ids", "lengths"]
        n, d = len(self.number), len(self.ids)
        lengths = np.array(self.lengths, np.int64)
        # Postings in the order of (term, document): the same pair repeated is the number of occurrences.
        key, tf = np.unique(np.concatenate(self.terms) * d + np.repeat(np.arange(d), lengths), return_counts=True)
        term, doc = np.divmod(key, d)
        tf = tf.astype(np.int64)
        first = np.searchsorted(term, np.arange(n + 1))
        place = np.arange(len(key)) - first[term]
        head = np.flatnonzero(place % BLOCK == 0)
        block = np.cumsum(place % BLOCK == 0) - 1
        gap = doc.copy()
        gap[1:] -= np.where(place[1:] % BLOCK == 0, 0, doc[:-1])
        peak = np.maximum.reduceat(impact(tf, norm(lengths, docs, total)[doc]), head)
        held = np.diff(np.append(head, len(key)))
        wide = [np.where(m < 1 << 8, 1, np.where(m < 1 << 16, 2, 4)) for m in (np.maximum.reduceat(gap, head), np.maximum.reduceat(tf, head))]
        start = np.append(0, np.cumsum(held * (wide[0] + wide[1])))
        out, within = np.zeros(start[-1], np.uint8), np.arange(len(key)) - head[block]
        for values, w, base in ((gap, wide[0], start[:-1]), (tf, wide[1], start[:-1] + held * wide[0])):
            at = base[block] + within * w[block]
            for i in range(4):
                more = w[block] > i
                out[at[more] + i] = (values[more] >> (8 * i)) & 255
        blocks = np.searchsorted(head, first)  # where each term's blocks begin
        off = pa.array(np.append(blocks, blocks[-1]), pa.int32())
        own = start[:-1] - start[blocks[:-1]][np.repeat(np.arange(n), np.diff(blocks))]
        end = np.append(start[blocks], start[-1]).astype(np.int32)
        lists = lambda v, t: pa.ListArray.from_arrays(off, pa.array(v, t))
        docs_of = lambda v: pa.array([None] * n + [v], pa.list_(pa.int64()))
        return record(
            schema, pa.array(np.full(n + 1, shard), pa.int64()), pa.array([b.decode("utf-8", "replace") for b in self.number] + [None], pa.string()), pa.array(np.append(np.diff(first), d), pa.int64()),
            pa.array(np.append(np.maximum.reduceat(peak, blocks[:-1]), 0), pa.int64()), lists(doc[np.append(head[1:], len(key)) - 1], pa.int32()), lists(peak, pa.int64()), lists(own, pa.int32()), lists(wide[0] * 8 + wide[1], pa.int16()),
            pa.Array.from_buffers(pa.binary(), n + 1, [None, pa.py_buffer(end.tobytes()), pa.py_buffer(out.tobytes())]), docs_of(self.ids), docs_of(lengths),
        )


@dataclass(frozen=True)
class Index:
    """A written index and the two sums its impacts were made with."""

    folder: str
    docs: int
    terms: int


def build(docs: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD) -> Index:
    """Writes the index of all documents and all their terms."""
    folder = folder or os.path.join(staging_root(docs.sparkSession), "curbstream", f"index-{uuid.uuid4().hex}")
    d = input_rows(docs, doc_id, text)
    n, total = corpus_sums(d)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = (TaskContext.get().partitionId() << 24), _Shard()
        for batch in batches:
            off, data = texts(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, x in enumerate(ids):
                size = int(off[i + 1] - off[i])
                if shard.ids and shard.size + size > shard_bytes:
                    yield shard.rows(name, n, total)
                    name, shard = name + 1, _Shard()
                shard.add(x, data[off[i] : off[i + 1]].tobytes())
        if shard.ids:
            yield shard.rows(name, n, total)

    d.mapInArrow(scan, _LIST).write.parquet(folder)
    return Index(folder, n, total)


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, term``: the different terms of each item."""
    lower = F.translate(items[text].cast("string"), _UPPER, _UPPER.lower())
    found = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), 0)
    return items.select(items[item_id].cast("bigint").alias("item_id"), F.explode(found).alias("term")).distinct()


def weight(df: Column, docs: int) -> Column:
    return F.floor(F.lit(1000.0) * F.ln(F.lit(float(2 * docs + 2)) / (2 * df + 1))).cast("bigint")


@dataclass
class _List:
    """A term's postings in one shard; blocks are unpacked once and kept while the shard is searched."""

    best: int
    last: np.ndarray
    peak: np.ndarray
    at: np.ndarray
    wide: np.ndarray
    data: bytes
    size: int
    norms: np.ndarray
    open: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        got = self.open.get(b)
        if got is None:
            n = BLOCK if b + 1 < len(self.at) else self.size - b * BLOCK
            w, v = divmod(int(self.wide[b]), 8)
            gap = np.frombuffer(self.data, f"<u{w}", n, int(self.at[b]))
            tf = np.frombuffer(self.data, f"<u{v}", n, int(self.at[b]) + n * w).astype(np.int64)
            doc = np.cumsum(gap, dtype=np.int64)
            got = self.open[b] = (doc, impact(tf, self.norms[doc]))
        return got

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if -1 not in self.open:
            got = [self.block(b) for b in range(len(self.at))]
            self.open[-1] = (np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]))
        return self.open[-1]


@dataclass
class Best:
    """The highest scores of an item so far, equal ones by id with null last."""

    top: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    null: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def least(self) -> int:
        """A document below this score cannot enter."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        s, n, i = np.append(self.score, score), np.append(self.null, null), np.append(self.id, ids)
        o = np.lexsort((i, n, -s))[: self.top]
        self.score, self.null, self.id = s[o], n[o], i[o]


def find(terms: list[tuple[int, _List]], best: Best, n_docs: int, seen: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that may enter ``best`` and their scores. ``terms`` are weights and lists.

    ``seen`` counts postings of essential lists, blocks unpacked for candidates, and candidates that a block's peak turned away.
    """
    terms = sorted(terms, key=lambda x: -x[0] * x[1].best)
    bound = np.append(np.cumsum([w * x.best for w, x in terms][::-1])[::-1], 0)
    acc, least, seen = np.zeros(n_docs, np.int64), best.least, seen if seen is not None else {}

    def lift(scores: np.ndarray) -> int:
        """With as many documents at this score or above, none below it can enter."""
        return max(least, int(np.partition(scores, -best.top)[-best.top])) if len(scores) >= best.top else least

    i = 0
    while i < len(terms) and bound[i] >= least:  # essential: documents of these lists alone could enter
        doc, q = terms[i][1].whole()
        acc[doc] += terms[i][0] * q
        least = lift(acc[doc])
        seen["essential"] = seen.get("essential", 0) + len(doc)
        i += 1
    least = lift(acc)
    cand = np.flatnonzero(acc + bound[i] >= least)
    cand = cand[acc[cand] > 0]
    for (w, x), rest in zip(terms[i:], bound[i + 1 :], strict=True):
        if not len(cand):
            break
        b = np.searchsorted(x.last, cand)
        inside = b < len(x.last)
        peak = np.where(inside, x.peak[np.minimum(b, len(x.last) - 1)], 0)
        keep = acc[cand] + w * peak + rest >= least
        seen["refused"] = seen.get("refused", 0) + int(np.count_nonzero(~keep))
        cand, b, inside = cand[keep], b[keep], inside[keep]
        for k in np.unique(b[inside]):
            seen["opened"] = seen.get("opened", 0) + (int(k) not in x.open)
            doc, q = x.block(int(k))
            mine = cand[b == k]
            at = np.minimum(np.searchsorted(doc, mine), len(doc) - 1)
            hit = doc[at] == mine
            acc[mine[hit]] += w * q[at[hit]]
        least = lift(acc[cand])
        cand = cand[acc[cand] + rest >= least]
    return cand, acc[cand]


def search(index: Index, items: DataFrame, top: int = TOP, item_id: str = "item_id", text: str = "text", block_items: int = ITEMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above 0."""
    spark, (n, total) = items.sparkSession, (index.docs, index.terms)
    lists = spark.read.parquet(index.folder)
    wanted = stage(item_terms(items, item_id, text), "item_terms")
    df = lists.select("term", "df").join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    # Blocks of items of a fixed mean size, by hash: what a task holds does not grow with their number.
    blocks = -(-wanted.select("item_id").distinct().count() // block_items) or 1
    uses = wanted.join(df, "term").select("term", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block"), F.struct("item_id", weight(F.col("df"), max(n, 1)).alias("w")).alias("use"))
    uses = stage(uses.groupBy("term", "block").agg(F.collect_list("use").alias("uses")), "item_uses")  # at most the items of one block
    found = lists.where("term IS NOT NULL").join(uses, "term")
    shards = lists.where("term IS NULL").withColumn("uses", F.lit(None).cast(uses.schema["uses"].dataType)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cols = ["block", "shard", "df", "best", "last", "peak", "at", "wide", "data", "ids", "lengths", "uses"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int | None, Best] = {}

        def searched(ids: pa.Array, lengths: np.ndarray, lists: list[tuple]) -> None:
            norms = norm(lengths, n, total)
            null, id_ = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            of: dict[int | None, list[tuple[int, _List]]] = defaultdict(list)
            for size, high, last, peak, at, wide, data, use in lists:
                x = _List(high, last, peak, at, wide, data, size, norms)
                for u in use:
                    of[u["item_id"]].append((u["w"], x))
            for item, terms in of.items():
                b = best.setdefault(item, Best(top))
                doc, score = find(terms, b, len(norms))
                if len(doc):
                    b.add(score, null[doc], id_[doc])

        def bests() -> Iterator[pa.RecordBatch]:
            for item, b in best.items():
                k = len(b.score)
                yield record(["item_id", "doc_id", "score"], pa.array([item] * k, pa.int64()), pa.array(b.id, pa.int64(), mask=b.null), pa.array(b.score, pa.int64()))
            best.clear()

        unit, ids, lengths, held = None, None, None, []
        for batch in batches:
            c = dict(zip(cols, batch.columns, strict=True))
            for i in range(batch.num_rows):
                u = (c["block"][i].as_py(), c["shard"][i].as_py())
                if u != unit:
                    if unit is not None and held:
                        searched(ids, lengths, held)
                    if unit is not None and u[0] != unit[0]:
                        yield from bests()
                    unit, held = u, []
                if c["ids"][i].is_valid:
                    ids, lengths = c["ids"][i].values, c["lengths"][i].values.to_numpy()
                else:
                    held.append((c["df"][i].as_py(), c["best"][i].as_py(), *(c[k][i].values.to_numpy() for k in ("last", "peak", "at", "wide")), c["data"][i].as_py(), c["uses"][i].as_py()))
        if unit is not None and held:
            searched(ids, lengths, held)
        yield from bests()

    units = found.select(cols).unionByName(shards.select(cols)).repartition(shuffle_width(spark), "block", "shard").sortWithinPartitions("block", "shard")
    got = units.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return got.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


ORACLE = f"""
WITH term AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w FROM documents
), item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark
), doc AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM term GROUP BY doc_id
), total AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM doc
), posting AS (
  SELECT doc_id, w, count(*)::BIGINT AS tf FROM term WHERE w IN (SELECT w FROM item) GROUP BY doc_id, w
), weight AS (
  SELECT w, floor(1000.0::DOUBLE * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS g FROM (SELECT w, count(*)::BIGINT AS df FROM posting GROUP BY w), total
), scored AS (
  SELECT item_id, doc_id, sum(g * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM posting JOIN weight USING (w) JOIN item USING (w) JOIN doc USING (doc_id), total GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {TOP}
"""
