"""MinHash document fingerprints.

A fingerprint is the minimum of ``PERMUTATIONS`` universal hash permutations over a text's distinct five-word shingles,
32 bits each, worked out in numpy on whole slices of documents. Words are lower-cased; a shorter text is one shingle, an
empty or null one has none and its fingerprint is all ones. Equal texts have equal fingerprints; the likeness of two
fingerprints is the share of equal places, an estimate of the Jaccard similarity of the shingle sets.

``edit_fingerprints`` also takes each text with its second half replaced by the beginning of the next document's text, in
ascending doc_id (null first; repeated ids by the hash of their text); the last is followed by the first. Documents are
range-partitioned once; each bucket also gets the first document of the next one. ``near_documents`` joins signature bands
in Spark and verifies the Jaccard similarity on the shingles; the query op4_near_documents reaches it.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbstream.llm.common import input_rows, record, shuffle_width, stage
from curbstream.llm.words import mix, shingles, word_slices

SHINGLE, PERMUTATIONS, BANDS = 5, 64, 16
_NONE = np.uint32(0xFFFFFFFF)


def permutations(n: int = PERMUTATIONS, seed: int = 41) -> tuple[np.ndarray, np.ndarray]:
    """x -> the high 32 bits of a x + b modulo 2^64, a odd: a universal family."""
    r = mix(np.arange(2 * n, dtype=np.uint64) + np.uint64(seed << 20))
    return r[:n] | np.uint64(1), r[n:]


def signatures(column: pa.Array, n: int = PERMUTATIONS, k: int = SHINGLE) -> np.ndarray:
    """(documents, n) signatures of 32 bits."""
    a, b = permutations(n)
    out = np.full((len(column), n), _NONE, np.uint32)
    for lo, _, w in word_slices(column):
        g, doc = shingles(w, k)
        if not len(g):
            continue
        have, begin = np.unique(doc, return_index=True)
        x = np.empty_like(g)
        for i in range(n):
            np.multiply(g, a[i], out=x)
            x += b[i]
            out[lo + have, i] = np.minimum.reduceat(x, begin) >> np.uint64(32)
    return out


def hexed(sig: np.ndarray) -> list[str]:
    raw = sig.astype(">u4").tobytes()
    step = sig.shape[1] * 4
    return [raw[i : i + step].hex() for i in range(0, len(raw), step)]


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of whole buckets: each own row with the row after it, holding a few hundred rows."""
    held: list[tuple[int | None, str, int, bool]] = []

    def close(last: bool) -> Iterator[pa.RecordBatch]:
        """Works on every held row whose follower is held too."""
        rows = [(x, y) for x, y in zip(held, held[1:], strict=False) if not x[3] and x[2] == y[2]]
        if not rows:
            return
        texts = [r[1] for r in held]
        sig = signatures(pa.array(texts, pa.large_string()))
        place = {id(r): i for i, r in enumerate(held)}
        new = [edited(x[1], y[1]) for x, y in rows]
        new_sig = signatures(pa.array(new, pa.large_string()))
        at = np.array([place[id(x)] for x, _ in rows])
        own, nxt = sig[at], sig[at + 1]
        yield record(
            _SCHEMA.replace(",", "").split()[::2],
            pa.array([x[0] for x, _ in rows], pa.int64()),
            pa.array([len(x[1]) for x, _ in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
            pa.array(hexed(own)),
            pa.array(hexed(new_sig)),
            pa.array((own == new_sig).mean(axis=1)),
            pa.array((own == nxt).mean(axis=1)),
        )

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "tail")), strict=True):
            held.append(row)
            if len(held) > 400:
                yield from close(False)
                del held[:-1]
    yield from close(True)


def edit_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    rows = input_rows(docs, doc_id, text).withColumn("text", F.coalesce("text", F.lit("")))
    n = 4 * shuffle_width(spark)
    cuts = rows.select(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(10_000))).first()[0]  # n - 1 splitters
    cuts = sorted(set(cuts or []))
    order = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("o"), F.xxhash64("text").alias("h"))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    rows = rows.withColumns({"o": order, "bucket": F.when(F.col("doc_id").isNull(), 0).otherwise(bucket).cast("int")})
    # One row per bucket: its first document, and the bucket before it (the last one for the first).
    firsts = rows.groupBy("bucket").agg(F.min("o").alias("first"))
    w = W.orderBy("bucket")
    firsts = firsts.select("bucket", "first", F.coalesce(F.lag("bucket").over(w), F.last("bucket").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("before"))
    dealt = rows.join(F.broadcast(firsts), "bucket").withColumn("to", F.when(F.col("o") == F.col("first"), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("t")), F.struct(F.col("before").alias("b"), F.lit(True).alias("t")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("t")))))
    dealt = dealt.select("doc_id", "text", "o", F.explode("to").alias("to")).select("doc_id", "text", "o", F.col("to.b").alias("bucket"), F.col("to.t").alias("tail"))
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "tail", "o").select("doc_id", "text", "bucket", "tail")
    return dealt.mapInArrow(_walk, _SCHEMA)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), signature (array of 32-bit values as long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = signatures(b.column("text"))
            yield record(["doc_id", "fingerprint", "signature"], b.column("doc_id"), pa.array(hexed(sig), pa.string()), pa.array(list(sig.astype(np.int64)), pa.list_(pa.int64())))

    return input_rows(docs, doc_id, text).mapInArrow(run, "doc_id bigint, fingerprint string, signature array<bigint>")


def _set_hash(tokens: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(tokens, digest_size=8).digest(), "little", signed=True)


def _hashed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from curbstream.llm.jaccard_join import _tokens

    for b in _tokens(batches):
        yield record(["doc_id", "c", "tokens"], b.column(0), pa.array([_set_hash(t) for t in b.column(1).to_pylist()], pa.int64()), b.column(1))


def _classed(batches: Iterator[pa.RecordBatch], bands: int = BANDS) -> Iterator[pa.RecordBatch]:
    """Documents with any shingle to a 64-bit hash of their shingle set, its size, its sum and a key for each signature band."""
    from curbstream.llm.jaccard_join import _sets, _sums

    a, b = permutations()
    per = PERMUTATIONS // bands
    for batch in batches:
        for at, g, begin in _sets(batch.column("text")):
            ends = np.append(begin, len(g))
            sets = [_set_hash(g[i:j].tobytes()) for i, j in zip(ends, ends[1:], strict=False)]
            sig = np.stack([np.minimum.reduceat(g * a[i] + b[i], begin) >> np.uint64(32) for i in range(PERMUTATIONS)], axis=1)
            keys = np.empty((len(at), bands), np.uint64)
            for i in range(bands):
                h = np.full(len(at), i, np.uint64)
                for j in range(i * per, (i + 1) * per):
                    h = mix(h + sig[:, j])
                keys[:, i] = h
            s1 = pa.array(_sums(g, begin)[0].view(np.int64))
            yield record(["doc_id", "c", "n", "s1", "keys"], batch.column("doc_id").take(pa.array(at)), pa.array(sets, pa.int64()), pa.array(np.diff(ends)), s1, pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())))


def near_documents(docs: DataFrame, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS) -> DataFrame:
    """Verified near-duplicate links (a, b, jaccard): every two different shingle sets that are at least so similar, and members.

    Documents with equal shingle sets are one class; its smallest id stands for it and is linked with each of the others, so
    copies are not expanded into pairs. Of classes every pair that is similar is a link. In every band the smallest classes, one
    and twice as many each round, are compared with all others; those with a link are done, the rest goes on until nothing is
    left. What the bands have not compared, classes that share a prefix token at places that leave room for the overlap, is
    compared then, which misses no link. Like documents of a group are all compared, as each pair may be a link. An id with
    several texts has the links of each, the highest similarity of two ids counts. Null ids are left out.
    """
    from curbstream.llm.jaccard_join import read_some, shared_prefix_tokens, verified

    percent = round(similarity * 100)
    rows = input_rows(docs, doc_id, text).where("doc_id is not null")
    f = rows.mapInArrow(lambda b: _classed(b, bands), "doc_id bigint, c bigint, n bigint, s1 bigint, keys array<bigint>")
    f = stage(f.groupBy("doc_id", "c").agg(*[F.first(k).alias(k) for k in ("n", "s1", "keys")]), "fingerprint-bands")
    classes = stage(f.groupBy("c").agg(F.min("doc_id").alias("rep"), *[F.first(k).alias(k) for k in ("n", "s1", "keys")]), "fingerprint-classes")
    open_ = classes.select(F.col("c").alias("rep"), F.posexplode("keys").alias("band", "key"))
    group = ["band", "key"]
    shared = open_.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1").select(*group)
    open_ = stage(open_.join(shared, group), "fingerprint-open")

    def read(some: DataFrame) -> DataFrame:
        wanted = classes.join(some.select(F.col("rep").alias("c")), "c", "left_semi").select(F.col("rep").alias("doc_id"), F.col("c").alias("own"))
        got = read_some(rows, wanted.select("doc_id"), _hashed_sets, "doc_id bigint, c bigint, tokens binary").join(wanted, "doc_id").where("c = own")
        return stage(got.select(F.col("c").alias("doc_id"), "tokens").dropDuplicates(["doc_id"]), "fingerprint-sets")

    sets = read(open_.select("rep").distinct())
    tested, near, n = None, None, 1
    while not open_.isEmpty():
        if n == 1:
            heads = open_.groupBy(*group).agg(F.min("rep").alias("head"))
        else:
            heads = open_.withColumn("i", F.row_number().over(W.partitionBy(*group).orderBy("rep"))).where(F.col("i") <= n).select(*group, F.col("rep").alias("head"))
        asked = stage(open_.join(heads, group).where("rep > head"), "fingerprint-asked")
        pairs = asked.select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
        pairs = stage(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "fingerprint-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = stage(verified(pairs, sets, similarity), "fingerprint-near")
        near = found if near is None else near.unionByName(found)
        linked = near.select(F.col("a").alias("head"), F.col("b").alias("rep"))
        done = asked.join(linked, ["head", "rep"], "left_semi").select(*group, "rep").unionByName(heads.select(*group, F.col("head").alias("rep"))).distinct()
        open_ = stage(open_.join(done, [*group, "rep"], "left_anti"), "fingerprint-open")
        n *= 2
    # The smaller set of a link has a shared token early; of the tokens that two sets share the first one leaves room for the rest.
    slack = (100 + percent) * F.col("rest") - percent * F.col("n")
    placed = stage(shared_prefix_tokens(rows, percent).join(classes.select("s1", "c", "n"), "s1").select("token", "c", "n", "early", slack.alias("slack")), "fingerprint-posts")
    p, q = placed.where("early").alias("p"), placed.alias("q")
    fits = (F.col("p.token") == F.col("q.token")) & ((F.col("p.n") < F.col("q.n")) | ((F.col("p.n") == F.col("q.n")) & (F.col("p.c") < F.col("q.c"))))
    fits = fits & (100 * F.col("p.n") >= percent * F.col("q.n")) & (F.col("p.slack") >= percent * F.col("q.n")) & (F.col("q.slack") >= percent * F.col("p.n"))
    rest = p.join(q, fits).select(F.least("p.c", "q.c").alias("a"), F.greatest("p.c", "q.c").alias("b")).distinct()
    rest = stage(rest if tested is None else rest.join(tested, ["a", "b"], "left_anti"), "fingerprint-rest")
    links = verified(rest, read(rest.select(F.col("a").alias("rep")).union(rest.select("b")).distinct()), similarity)
    links = links if near is None else links.unionByName(near)
    of = lambda c, to: classes.select(F.col("c").alias(c), F.col("rep").alias(to))
    links = links.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")
    equal = f.select("doc_id", "c").join(classes.select("c", "rep"), "c").where("doc_id > rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("jaccard"))
    return links.unionByName(equal).groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))
