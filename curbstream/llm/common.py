"""What the operators share: inputs under names of their own, staged tables, Bloom filters of key columns."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbstream.llm.words import Bloom
from curbstream.session import stage

SPACES = r"[\x20\x09-\x0D]+"


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def input_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` as long and ``text`` as string; other columns, whatever their names, are left behind."""
    return docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))


def size_in_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null has none."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    return F.when(one == "", F.lit(0)).otherwise(F.length(one) - F.length(F.replace(one, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def bloom_of(df: DataFrame, column: str, log2_bits: int = 23) -> Bloom:
    """A Bloom filter of a long column: each task fills one of the same fixed size, the driver takes them one by one."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, any_ = Bloom.empty(log2_bits), False
        for batch in batches:
            b.add(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
            any_ = any_ or batch.num_rows > 0
        if any_:
            # In pieces, so that the driver holds a few of them at a time, and only those with a bit set.
            step = 1 << 16
            at = [i for i in range(0, len(b.bits), step) if b.bits[i : i + step].any()]
            yield pa.RecordBatch.from_arrays([pa.array([i // step for i in at], pa.int32()), pa.array([b.bits[i : i + step].tobytes() for i in at], pa.binary())], names=["at", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                y = np.frombuffer(x, np.uint8)
                held[i] = held[i] | y if i in held else y
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["at", "bits"])

    out = Bloom.empty(log2_bits)
    pieces = df.select(F.col(column).cast("bigint")).mapInArrow(fill, "at int, bits binary").repartition(8, "at").mapInArrow(join, "at int, bits binary")
    for r in pieces.collect():  # at most one filter: 2^log2_bits bits
        x = np.frombuffer(r.bits, np.uint8)
        out.bits[r.at * (1 << 16) : r.at * (1 << 16) + len(x)] |= x
    return out


def record(names: list[str], *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


__all__ = ["SPACES", "bloom_of", "input_rows", "record", "shuffle_width", "size_in_words", "stage"]
