"""Importance resampling of documents towards a target corpus, by hashed n-grams.

Separators collapse to one space; a regular expression with boundary lookarounds, scanned with overlapping matches, then
gives every run of 1 to ``most`` words as one span of bytes, whose CRC-32 picks its bucket. A bucket's gain is the log of its
share in the target over its share in the documents, a document's weight the sum of its spans' gains. Gumbel noise from the
document's id turns "the highest scores" into a draw without replacement in proportion to ``exp(weight / 1000)``.

Each text is scanned once: its bucket numbers, two bytes each, are written next to its id, and counting and scoring read
those. What is sent to tasks is one gain per bucket, whatever the data.

Nulls: a null text has no words, a null id hashes as the empty text and comes last among equal scores. Repeated rows are
documents of their own. Empty documents give no rows; an empty target leaves every count of it at 0. Other columns are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbstream.llm.common import input_rows, record, shuffle_width, stage
from curbstream.llm.words import texts

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Buckets of spans held before a batch is handed on.
_FLUSH = 1 << 20
_SEPARATORS = regex.compile(rb"[^0-9a-z\x80-\xff]+")


@cache
def _runs(n: int) -> regex.Pattern:
    """Runs of ``n`` words in a line whose words are joined by one space."""
    return regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1))


def spans(text: bytes, most: int) -> Iterator[bytes]:
    """Every run of 1 to ``most`` words of the text, in UTF-8; only A-Z are lower-cased."""
    line = _SEPARATORS.sub(b" ", text.lower())
    for n in range(1, most + 1):
        for m in _runs(n).finditer(line, overlapped=True):
            yield m.group()


def _numbers(buckets: int) -> np.dtype:
    return np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")


def features(docs: DataFrame, most: int = 1, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features`` and the bucket numbers of all spans as little-endian bytes (``grams``)."""
    crc, kind = zlib.crc32, _numbers(buckets)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: pa.Array, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            n, k, g = zip(*rows, strict=True)
            return record(["doc_id", "n_words", "n_features", "grams"], ids, pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(g, pa.binary()))

        for batch in batches:
            off, data = texts(batch.column(1))
            rows, at, held = [], 0, 0
            for i in range(batch.num_rows):
                b = np.fromiter((crc(s) % buckets for s in spans(data[off[i] : off[i + 1]].tobytes(), most)), kind)
                # With w words there are w + (w - 1) + ... spans; the shortest runs come first.
                w = len(b) if most == 1 else _words(len(b), most)
                rows.append((w, len(b), b.tobytes()))
                held += len(b)
                if held >= _FLUSH:
                    yield out(batch.column(0)[at : i + 1], rows)
                    rows, at, held = [], i + 1, 0
            if rows:
                yield out(batch.column(0)[at:], rows)

    return input_rows(docs, doc_id, text).mapInArrow(scan, "doc_id bigint, n_words bigint, n_features bigint, grams binary")


def _words(n_spans: int, most: int) -> int:
    """How many words have so many runs of up to ``most`` words."""
    w, full = 0, most * (most + 1) // 2
    while w < most and n_spans >= (w + 1) * (w + 2) // 2:
        w += 1
    return w if w < most else most + (n_spans - full) // most


def bucket_counts(feats: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` over all spans; every task sends at most one row a bucket."""
    kind = _numbers(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            off, data = texts(batch.column(0))
            total += np.bincount(data[off[0] : off[-1]].view(kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield record(["bucket", "n"], pa.array(at, pa.int32()), pa.array(total[at], pa.int64()))

    return feats.select("grams").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths: a table of ``buckets`` entries."""
    spark = source.sparkSession
    d = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    d = d.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    d = stage(d, "gains")
    total = d.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    one, all_s, all_t = F.lit(1.0), F.lit(float(total.s + buckets)), F.lit(float(total.t + buckets))
    g = F.floor(F.lit(1000.0) * F.ln((F.col("t") + one) * all_s / ((F.col("s") + one) * all_t)))
    out = np.zeros(buckets, np.int64)
    for r in d.select("bucket", g.cast("bigint").alias("g")).collect():  # one row a bucket
        out[r.bucket] = r.g
    return out


def weights(feats: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the sum of each document's gains."""
    kind = _numbers(len(gain))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = texts(batch.column(3))
            w = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                w[i] = gain[data[off[i] : off[i + 1]].view(kind)].sum()
            yield record(["doc_id", "n_words", "n_features", "weight"], *batch.columns[:3], pa.array(w, pa.int64()))

    return feats.mapInArrow(add, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def ranked(d: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``rank`` 1, 2, ... by falling score for the drawn rows, null for the others.

    Rows are dealt by ranges of (score, doc_id), so a rank is the place in its range plus the sizes of the ranges before.
    """
    spark = d.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    old = d.where(F.col("n_words") >= least_words)
    width = shuffle_width(spark)
    ranges = stage(old.repartitionByRange(width, *order).withColumn("_range", F.spark_partition_id()), "score_ranges")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("n")).collect()  # one row a range
    at, before = 0, {}
    for r in sorted(sizes, key=lambda r: r[0]):
        before[r[0]] = at
        at += r[1]
    draw = percent * at // 100
    starts = spark.createDataFrame(list(before.items()), "_range int, _before bigint")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    top = ranges.join(starts, "_range").withColumn("rank", place.cast("bigint"))
    top = top.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).drop("_range", "_before")
    return top.unionByName(d.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``doc_id, n_features, n_words, weight, score, rank`` of every document; ``rank`` is null where it is not drawn."""
    feats = stage(features(docs, most, buckets, doc_id, text), "grams")
    wanted = features(target.select(F.lit(None).cast("bigint").alias("doc_id"), target[target_text].alias("text")), most, buckets)
    w = weights(feats, gains(bucket_counts(feats, buckets), bucket_counts(wanted, buckets), buckets))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(key, "utf-8"), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")
    scored = stage(w.withColumn("score", F.col("weight") + noise), "scores")
    return ranked(scored, percent, least_words).select("doc_id", "n_features", "n_words", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **settings: object) -> DataFrame:
    """The rows of ``docs`` that the draw takes, with all their columns; rows of one id are taken together."""
    ids = resample(docs, target, doc_id=doc_id, **settings).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs[doc_id].cast("bigint").eqNullSafe(F.col("_drawn")), "left_semi")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: CRC-32 from its polynomial, for each distinct word once.
ORACLE = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), words AS (
  SELECT true AS doc, doc_id AS id, unnest(regexp_extract_all(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT false, item_id, unnest(regexp_extract_all(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark
), bytes AS (
  SELECT w, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::BIGINT, 2))::BIGINT) AS b FROM (SELECT DISTINCT w FROM words)
), bucket AS (
  SELECT w, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS k FROM bytes, crc
), counted AS (
  SELECT k, count(*) FILTER (doc) AS s, count(*) FILTER (NOT doc) AS t FROM words JOIN bucket USING (w) GROUP BY k
), total AS (
  SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM counted
), gain AS (
  SELECT k, floor(1000.0::DOUBLE * ln((c.t + 1)::DOUBLE * (x.s + {BUCKETS}) / ((c.s + 1)::DOUBLE * (x.t + {BUCKETS}))))::BIGINT AS g FROM counted c, total x
), weighed AS (
  SELECT id AS doc_id, count(*) AS n, sum(g)::BIGINT AS weight FROM words JOIN bucket USING (w) JOIN gain USING (k) WHERE doc GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weighed USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM scored
)
SELECT doc_id, n_features, n_features AS n_words, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND r <= {PERCENT} * n // 100 THEN r END AS rank FROM placed
"""
