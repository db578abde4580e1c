"""Exact n-gram Jaccard join by a token-group matrix.

A document's set is its distinct five-word shingles (fewer words: the whole sequence as one; none: empty, linked with
nothing), A-Z lower-cased. Two documents link when 100 |A and B| >= percent |A or B|. The result gives each document its
component, so copies are not expanded into pairs, and no link between different texts is lost.

1. Documents with equal sets become one class, by two 64-bit sums and the size.
2. Similar classes are partitioned into groups: classes that share a MinHash key are verified against that class of the
   key which shares its keys with most others, and verified links make the groups. A class that misses its group is a group by itself.
3. Which groups can hold a partner: a set and a partner share one of the set's ``|A| - ceil(p |A|) + 1`` first tokens in any
   fixed order, and the smaller set one of its ``|A| - ceil(2p / (1 + p) |A|) + 1`` first ("early"). Tokens in many documents come last in the order (counted over all documents), so common passages seldom
   bring groups together, and a shared token counts only where its places in both sets leave room for the overlap. Tokens
   travel as packed blocks by hash range.
4. Each group's token union is a row of the matrix: places out of 2^16, as a list or, from 4096 places on, as a bitmap. A
   query's places that are not in the row are tokens the group lacks; it is opened against the group only if what is left
   can be the overlap with its smallest member. A full row prunes less and loses nothing. Only places travel here; tokens
   are read for opened groups alone.
5. Opened pairs are verified: first against a few members of the group, then, for groups still apart, all members that
   share such a token and that the other side's row does not rule out.

Null ids are not linked (component_id null). Rows that repeat an id count as one document. An empty table gives an empty
result. Hashes are 64 bits wide.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbstream.llm.common import bloom_of, input_rows, record, shuffle_width, stage
from curbstream.llm.components import components
from curbstream.llm.words import Words, mix, shingles, word_slices

SHINGLE, PERCENT = 5, 80
KEYS, PER_KEY = 8, 3
#: Tokens in at least HEAVY documents come late in the order; at most MOST_HEAVY of them, the most frequent, are told to tasks.
HEAVY, MOST_HEAVY = 8, 1 << 20
#: Places of a row; they are told in two bytes.
MATRIX_BITS, PIVOTS = 1 << 16, 7
_FLUSH = 200_000


def distinct_shingles(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted inside each document, and their documents."""
    g, doc = shingles(w, k, lower=True, seed=9)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], doc[new]


def _sums(g: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.add.reduceat(mix(g), begin), np.add.reduceat(mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin)


def _sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: documents that have shingles, their tokens, and where each document's tokens begin."""
    for lo, _, w in word_slices(column):
        g, doc = distinct_shingles(w)
        if len(g):
            have, begin = np.unique(doc, return_index=True)
            yield lo + have, g, begin


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = mix(np.arange(KEYS * PER_KEY, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
    for b in batches:
        m = b.num_rows
        n, s1, s2 = np.zeros(m, np.int64), np.zeros(m, np.uint64), np.zeros(m, np.uint64)
        keys = np.zeros((m, KEYS), np.uint64)
        for at, g, begin in _sets(b.column("text")):
            n[at] = np.diff(np.append(begin, len(g)))
            s1[at], s2[at] = _sums(g, begin)
            for k in range(KEYS):
                v = np.full(len(at), k + 1, np.uint64)
                for j in range(PER_KEY):
                    v = mix(v + np.minimum.reduceat(g * a[k * PER_KEY + j], begin))
                keys[at, k] = v
        flat = pa.array(keys.view(np.int64).ravel())
        yield record(["doc_id", "n", "s1", "s2", "keys"], b.column("doc_id"), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * KEYS), flat))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, g, begin in _sets(b.column("text")):
            ends = np.append(begin, len(g))
            yield record(["doc_id", "tokens"], b.column("doc_id").take(pa.array(at)), pa.array([g[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary()))


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, tokens), the sorted 64-bit tokens, for documents that have any."""
    return rows.select("doc_id", "text").mapInArrow(_tokens, "doc_id bigint, tokens binary").dropDuplicates(["doc_id", "tokens"])


def read_some(rows: DataFrame, ids: DataFrame, read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``read`` over the documents in ``ids`` (doc_id). A filter of fixed size leaves out most others in the same task."""
    some = bloom_of(ids, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return read(b.filter(pa.array(some.has(b.column("doc_id").to_numpy()))) for b in batches)

    return rows.select("doc_id", "text").mapInArrow(run, schema).join(ids, "doc_id", "left_semi")


def sets_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return read_some(rows, ids, _tokens, "doc_id bigint, tokens binary").dropDuplicates(["doc_id", "tokens"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = PERCENT / 100) -> DataFrame:
    """Of the pairs (a, b) of documents those that link, with their Jaccard similarity."""
    percent = round(similarity * 100)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, value = [], []
            for i, (x, y) in enumerate(zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                either = len(p) + len(q) - both
                if 100 * both >= percent * either:
                    keep.append(i)
                    value.append(both / either)
            yield record(["a", "b", "jaccard"], b.column("a").take(pa.array(keep, pa.int64())), b.column("b").take(pa.array(keep, pa.int64())), pa.array(value, pa.float64()))

    x = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    # The pairs of a document that is in very many are split by the sort-merge join's handling of skew.
    full = pairs.select("a", "b").join(y, "b").join(x, "a")
    return full.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint, jaccard double")


def _blocks(spark_width: int) -> int:
    """Bits of the block number: blocks of tokens by their highest bits, a few per task."""
    return max(6, (4 * spark_width - 1).bit_length())


def heavy_tokens(rows: DataFrame, least: int = HEAVY, most: int = MOST_HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (their high bits, sorted) that at least ``least`` documents hold, at most ``most``, and the log of their number.

    All documents count. A token is 32 bits inside its block; two tokens that share them only change the order.
    """
    bits = _blocks(shuffle_width(rows.sparkSession))
    shift, low = np.uint64(64 - bits - 32), np.uint64(0xFFFFFFFF)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            v, c = np.unique(np.concatenate(held), return_counts=True)
            block = (v >> np.uint64(32)).astype(np.int64)
            v = (v & low).astype(np.uint32)
            at = np.searchsorted(block, np.arange((1 << bits) + 1))
            out: list[list] = [[], [], [], []]
            for i in range(1 << bits):
                x, n = v[at[i] : at[i + 1]], c[at[i] : at[i + 1]]
                if len(x):
                    for o, y in zip(out, (i, x[n == 1].tobytes(), x[n > 1].tobytes(), n[n > 1].astype(np.uint32).tobytes()), strict=True):
                        o.append(y)
            return record(["block", "once", "more", "n"], pa.array(out[0], pa.int32()), *[pa.array(o, pa.binary()) for o in out[1:]])

        for b in batches:
            for _, g, _ in _sets(b.column("text")):
                held.append(g >> shift)
                size += len(g)
                if size > _FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, group in _grouped(batches, "block"):
            once = np.concatenate([np.frombuffer(x, np.uint32) for r in group for x in r.column("once").to_pylist()])
            more = np.concatenate([np.frombuffer(x, np.uint32) for r in group for x in r.column("more").to_pylist()])
            n = np.concatenate([np.frombuffer(x, np.uint32) for r in group for x in r.column("n").to_pylist()])
            v, c = np.unique(once, return_counts=True)
            all_v = np.concatenate([v, more])
            order = np.argsort(all_v, kind="stable")
            all_v, all_c = all_v[order], np.concatenate([c, n]).astype(np.int64)[order]
            if len(all_v):
                begin = np.flatnonzero(np.concatenate([[True], all_v[1:] != all_v[:-1]]))
                sums = np.add.reduceat(all_c, begin)
                hot = sums >= least
                yield record(["token", "n"], pa.array((np.int64(block) << 32) + all_v[begin][hot].astype(np.int64)), pa.array(sums[hot]))

    counted = rows.select("text").mapInArrow(local, "block int, once binary, more binary, n binary").repartition("block").sortWithinPartitions("block").mapInArrow(total, "token bigint, n bigint")
    got = stage(counted, "jaccard-heavy")
    got = got.orderBy(F.desc("n"), "token").limit(most).toPandas() if got.count() > most else got.toPandas()  # at most ``most`` rows
    order = np.argsort(got["token"].to_numpy())
    return got["token"].to_numpy(np.int64)[order].astype(np.uint64), np.log2(np.maximum(got["n"].to_numpy(np.float64)[order], 1)).astype(np.uint8) + np.uint8(1)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of equal ``key`` over the batches of a partition sorted by it."""
    now, held = None, []
    for b in batches:
        k = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)] if len(k) else []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if now is not None and k[i] != now:
                yield now, held
                held = []
            now = k[i]
            held.append(b.slice(i, j - i))
    if held:
        yield now, held


def shared_prefix_tokens(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(token, s1, early, rest): prefix tokens that classes (s1) of different sets share; ``early`` ones lie in the shorter prefix
    of the smaller set. ``rest`` tokens of the set stand at the token's place or behind it: no more can be shared with a set
    whose first shared token it is."""
    bits = _blocks(shuffle_width(rows.sparkSession))
    shift = np.uint64(64 - bits - 32)
    heavy, weight = heavy_tokens(rows)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            v, s, e, r = (np.concatenate(x) for x in zip(*held, strict=True))
            block = (v >> np.uint64(32)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            v, s, e, r, block = (v[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), s[order], e[order], r[order], block[order]
            at = np.searchsorted(block, np.arange((1 << bits) + 1))
            some = [i for i in range(1 << bits) if at[i] < at[i + 1]]
            return record(["block", "tokens", "classes", "early", "rest"], pa.array(some, pa.int32()), *(pa.array([x[at[i] : at[i + 1]].tobytes() for i in some], pa.binary()) for x in (v, s, e, r)))

        for b in batches:
            for _, g, begin in _sets(b.column("text")):
                n = np.diff(np.append(begin, len(g)))
                s1, _ = _sums(g, begin)
                doc = np.repeat(np.arange(len(n)), n)
                v = g >> shift
                rank = np.zeros(len(v), np.uint8)
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, v), len(heavy) - 1)
                    rank = np.where(heavy[at] == v, weight[at], 0).astype(np.uint8)
                # Tokens are sorted inside each document already; heavy ones go to the end, the rarest of them first.
                order = np.lexsort((rank, doc)) if rank.any() else np.arange(len(v))
                place = np.arange(len(v)) - np.repeat(begin, n)
                take = place < np.repeat(n - -(-percent * n // 100) + 1, n)
                early = place < np.repeat(n - -(-2 * percent * n // (100 + percent)) + 1, n)
                rest = (np.repeat(n, n) - place).astype(np.uint32)
                held.append((v[order][take], s1[doc[take]], early[take].astype(np.uint8), rest[take]))
                size += int(take.sum())
                if size > _FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, group in _grouped(batches, "block"):
            v = np.concatenate([np.frombuffer(x, np.uint32) for r in group for x in r.column("tokens").to_pylist()])
            s = np.concatenate([np.frombuffer(x, np.uint64) for r in group for x in r.column("classes").to_pylist()])
            e = np.concatenate([np.frombuffer(x, np.uint8) for r in group for x in r.column("early").to_pylist()])
            rest = np.concatenate([np.frombuffer(x, np.uint32) for r in group for x in r.column("rest").to_pylist()]).astype(np.int64)
            order = np.lexsort((-rest, s, v))  # of a class's equal tokens the first one stays
            v, s, e, rest = v[order], s[order], e[order], rest[order]
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (s[1:] != s[:-1])
            v, s, e, rest = v[new], s[new], e[new], rest[new]
            first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(v)))
            # Two classes at least, and one of them early.
            two = np.repeat((size > 1) & (np.maximum.reduceat(e, first) > 0), size) if len(v) else np.zeros(0, bool)
            yield record(["token", "s1", "early", "rest"], pa.array((np.int64(block) << 32) + v[two].astype(np.int64)), pa.array(s[two].view(np.int64)), pa.array(e[two] > 0), pa.array(rest[two]))

    packed = rows.select("text").mapInArrow(prefixes, "block int, tokens binary, classes binary, early binary, rest binary")
    return packed.repartition("block").sortWithinPartitions("block").mapInArrow(meet, "token bigint, s1 bigint, early boolean, rest bigint")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of each document's tokens in a matrix row, sorted, and the number of its tokens."""
    for b in batches:
        for at, g, begin in _sets(b.column("text")):
            n = np.diff(np.append(begin, len(g)))
            place = (g & np.uint64(MATRIX_BITS - 1)).astype(np.uint16)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((place, doc))
            place, doc = place[order], doc[order]
            new = np.append(True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))
            place, cut = place[new], np.searchsorted(doc[new], np.arange(len(n) + 1))
            yield record(["doc_id", "n", "places"], b.column("doc_id").take(pa.array(at)), pa.array(n), pa.array([place[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()))


def _row(lists: list[np.ndarray], maps: list[np.ndarray]) -> bytes:
    """The union of places as a sorted list, or as a bitmap where a list would not be shorter."""
    own = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint16)
    if not maps and 2 * len(own) < MATRIX_BITS // 8:
        return own.tobytes()
    bits = np.zeros(MATRIX_BITS, np.uint8)
    bits[own] = 1
    out = np.packbits(bits)
    for x in maps:
        out = out | x
    return out.tobytes()


def matrix_rows(places: DataFrame, members: DataFrame) -> DataFrame:
    """(g, row): the places of all tokens of a group's members; tasks merge what they have before the shuffle."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[int, list[np.ndarray]] = {}
            for g, x in zip(b.column("g").to_pylist(), b.column("places").to_pylist(), strict=True):
                held.setdefault(g, []).append(np.frombuffer(x, np.uint16))
            yield record(["g", "row"], pa.array(list(held), pa.int64()), pa.array([_row(x, []) for x in held.values()], pa.binary()))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, bytes] = {}
        for g, group in _grouped(batches, "g"):
            parts = [x for r in group for x in r.column("row").to_pylist()]
            wide = [len(x) == MATRIX_BITS // 8 for x in parts]
            done[g] = _row([np.frombuffer(x, np.uint16) for x, w in zip(parts, wide, strict=True) if not w], [np.frombuffer(x, np.uint8) for x, w in zip(parts, wide, strict=True) if w])
            if len(done) > 2000:
                yield record(["g", "row"], pa.array(list(done), pa.int64()), pa.array(list(done.values()), pa.binary()))
                done = {}
        yield record(["g", "row"], pa.array(list(done), pa.int64()), pa.array(list(done.values()), pa.binary()))

    own = places.join(members, "doc_id").select("g", "places").mapInArrow(merge, "g bigint, row binary")
    return own.repartition("g").sortWithinPartitions("g").mapInArrow(last, "g bigint, row binary")


def _lacks(x: bytes, row: bytes) -> int:
    """How many places of ``x`` are not in the row."""
    at = np.frombuffer(x, np.uint16)
    if len(row) == MATRIX_BITS // 8:
        bits = np.frombuffer(row, np.uint8)
        return int(np.count_nonzero((bits[at >> 3] >> (7 - (at & 7))) & 1 == 0))
    r = np.frombuffer(row, np.uint16)
    i = np.minimum(np.searchsorted(r, at), len(r) - 1)
    return int(np.count_nonzero(r[i] != at))


def _qualify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, lo = (b.column(c).to_numpy() for c in ("n", "lo"))
            lacks = np.fromiter(map(_lacks, b.column("places").to_pylist(), b.column("row").to_pylist()), np.int64, b.num_rows)
            # A partner has at least ``lo`` tokens and at least ``percent`` of n; both sizes ask for an overlap.
            least = np.maximum(100 * lo, percent * n)
            at = pa.array(np.flatnonzero((100 + percent) * 100 * (n - lacks) >= percent * (100 * n + least)))
            yield record(["doc_id", "g", "other", "n"], *[b.column(c).take(at) for c in ("doc_id", "g", "other", "n")])

    return run


def _asked(asks: DataFrame, places: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """Of the asks (doc_id, g, other), members of g, those that the row of the group ``other`` does not rule out, with n."""
    asked = asks.join(places, "doc_id").join(matrix.select(F.col("g").alias("other"), "row", "lo"), "other")
    return asked.select("doc_id", "g", "other", "n", "places", "row", "lo").mapInArrow(_qualify(percent), "doc_id bigint, g bigint, other bigint, n bigint")


def class_links(rows: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of rows (doc_id, text): the documents, their classes (n, s1, s2, rep), verified links (a, b) of class representatives
    that connect all that link, and the components of these links (node, component)."""
    d = stage(rows.mapInArrow(_describe, "doc_id bigint, n bigint, s1 bigint, s2 bigint, keys array<bigint>"), "jaccard-docs")
    classes = stage(d.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "jaccard-classes")
    with_id = rows.where("doc_id is not null")

    keys = classes.select("rep", F.posexplode("keys").alias("i", "key"))
    # The class that shares its keys with most others stands in the middle of its like: it heads them.
    crowd = stage(keys.groupBy("i", "key").agg(F.count("*").alias("m")).where("m > 1"), "jaccard-crowds")
    met = stage(keys.join(crowd, ["i", "key"]), "jaccard-keys")
    weight = met.groupBy("rep").agg(F.sum("m").alias("w"))
    heads = met.join(weight, "rep").groupBy("i", "key").agg(F.max_by("rep", F.struct("w", -F.col("rep"))).alias("head"))
    near = met.join(heads, ["i", "key"]).where("rep <> head").select(F.least("head", "rep").alias("a"), F.greatest("head", "rep").alias("b"))
    near = stage(near.distinct(), "jaccard-near")
    near_ids = near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct()
    links = stage(verified(near, stage(sets_of(with_id, near_ids), "jaccard-near-sets"), percent / 100).select("a", "b").distinct(), "jaccard-links")
    groups = stage(components(links), "jaccard-groups")
    members = classes.select("rep", "n", "s1").join(groups, classes["rep"] == groups["node"], "left").select(F.col("rep").alias("doc_id"), "n", "s1", F.coalesce("component", "rep").alias("g"))
    members = stage(members, "jaccard-members")

    shared = stage(shared_prefix_tokens(with_id, percent), "jaccard-shared")
    soon = F.when(F.col("early"), F.col("n"))
    # With the first token that two sets share as it is placed in one of them, ``slack`` bounds percent times the other's size.
    slack = (100 + percent) * F.col("rest") - percent * F.col("n")
    posts = shared.join(members, "s1").groupBy("token", "g").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min(soon).alias("lo_early"), F.max(soon).alias("hi_early"),
        F.max(slack).alias("slack"), F.max(F.when(F.col("early"), slack)).alias("slack_early"),
    )
    ends = posts.groupBy("token").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1").select("token")
    posts = stage(posts.join(ends, "token", "left_semi"), "jaccard-posts")
    # The smaller set of a pair has a shared token early, so only groups with such a token ask.
    p, q = posts.where("lo_early IS NOT NULL").alias("p"), posts.alias("q")
    fits = (F.col("p.token") == F.col("q.token")) & (F.col("p.g") != F.col("q.g")) & (100 * F.col("p.hi_early") >= percent * F.col("q.lo")) & (F.col("q.hi") >= F.col("p.lo_early"))
    fits = fits & (F.col("p.slack_early") >= percent * F.col("q.lo")) & (F.col("q.slack") >= percent * F.col("p.lo_early"))
    open_ = stage(p.join(q, fits).select(F.least("p.g", "q.g").alias("g"), F.greatest("p.g", "q.g").alias("other")).distinct(), "jaccard-open")

    # The members of the smaller group ask the row of the larger one: a large group never asks for each of its small neighbours.
    pivot = [F.min(F.struct(F.xxhash64("doc_id", F.lit(i)), "doc_id"))["doc_id"] for i in range(PIVOTS)]
    sizes = stage(members.groupBy("g").agg(F.count("*").alias("m"), F.min("n").alias("lo"), F.array_distinct(F.array(F.min("doc_id"), *pivot)).alias("pivots")), "jaccard-group-sizes")
    size = lambda c: sizes.select(F.col("g").alias(c), F.col("m").alias(f"m_{c}"))
    turn = F.col("m_g") > F.col("m_other")
    pairs = open_.join(size("g"), "g").join(size("other"), "other")
    pairs = stage(pairs.select(F.when(turn, F.col("other")).otherwise(F.col("g")).alias("g"), F.when(turn, F.col("g")).otherwise(F.col("other")).alias("other")), "jaccard-pairs")
    own = stage(members.select("doc_id", "g").join(pairs.select("g").union(pairs.select("other")).distinct(), "g", "left_semi"), "jaccard-own")
    places = stage(read_some(with_id, own.select("doc_id"), _places, "doc_id bigint, n bigint, places binary"), "jaccard-places")
    matrix = stage(matrix_rows(places, own).join(sizes.select("g", "lo"), "g"), "jaccard-matrix")
    able = stage(_asked(own.join(pairs, "g"), places, matrix, percent), "jaccard-able")
    # Opened first against a few members of the larger group, spread by hash.
    first = able.join(sizes.select(F.col("g").alias("other"), "pivots"), "other").select(F.col("doc_id").alias("x"), F.explode("pivots").alias("y"))
    first = stage(first.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "jaccard-first")
    first_ids = first.select(F.col("a").alias("doc_id")).union(first.select("b")).distinct()
    found = stage(links.union(verified(first, stage(sets_of(with_id, first_ids), "jaccard-sets"), percent / 100).select("a", "b")).distinct(), "jaccard-links")
    merged = stage(components(found), "jaccard-groups")
    # Groups still apart are opened for the members that can reach the other side: those that share a token at places that
    # leave room for the overlap. All others of a large group are not asked.
    now = lambda c, n: merged.select(F.col("node").alias(c), F.col("component").alias(n))
    apart = able.select("g", "other").distinct().join(now("g", "cg"), "g", "left").join(now("other", "co"), "other", "left").where(F.coalesce("cg", "g") != F.coalesce("co", "other")).select("g", "other")
    apart = stage(apart, "jaccard-apart")
    if apart.limit(1).count():
        ask = able.join(apart, ["g", "other"], "left_semi")
        placed = shared.join(members, "s1").select("token", "doc_id", "g", "n", slack.alias("slack"))
        x = placed.join(ask.select("doc_id", "other"), "doc_id").select("token", F.col("doc_id").alias("x"), "g", "other", F.col("n").alias("nx"), F.col("slack").alias("sx"))
        y = placed.join(apart.select(F.col("other").alias("g")).distinct(), "g", "left_semi")
        y = y.select("token", F.col("doc_id").alias("y"), F.col("g").alias("other"), F.col("n").alias("ny"), F.col("slack").alias("sy"))
        met = x.join(y, ["other", "token"]).where((F.col("sx") >= percent * F.col("ny")) & (F.col("sy") >= percent * F.col("nx")))
        met = met.select("x", "y", "g", "other").distinct().join(first.select(F.col("a").alias("x"), F.col("b").alias("y")).union(first.select("b", "a")), ["x", "y"], "left_anti")
        met = stage(met, "jaccard-met")
        back = _asked(met.select(F.col("y").alias("doc_id"), F.col("other").alias("g"), F.col("g").alias("other")).distinct(), places, matrix, percent)
        back = back.select(F.col("doc_id").alias("y"), F.col("g").alias("other"), F.col("other").alias("g"))
        rest = stage(met.join(back, ["y", "g", "other"], "left_semi").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "jaccard-rest")
        rest_ids = rest.select(F.col("a").alias("doc_id")).union(rest.select("b")).distinct()
        more = stage(verified(rest, stage(sets_of(with_id, rest_ids), "jaccard-rest-sets"), percent / 100).select("a", "b").distinct(), "jaccard-more")
        if more.limit(1).count():
            found = found.union(more)
            merged = stage(components(found), "jaccard-groups")
    return d, classes, found, merged


def jaccard_components(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    d, classes, _, merged = class_links(input_rows(docs, doc_id, text), percent)
    ids = classes.join(merged, classes["rep"] == merged["node"], "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = d.join(ids, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
