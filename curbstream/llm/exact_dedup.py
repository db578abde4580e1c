"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts by (first bytes, SHA-256, doc_id); an external sort inside each
partition places equal texts next to each other; each row is compared in full with its neighbour. The splitters hold
doc_id, so a group of copies of any size is spread over many tasks. A group can only reach over the border of a
partition with its first or last run: at most two short rows per partition are merged and broadcast.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` becomes one space; null counts as empty. The row
with the smallest doc_id stays; a null doc_id counts as larger than any other. Repeated rows (same id, same text) are
copies like any others: exactly one row of a group has ``kept`` true. An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from curbstream.llm.common import SPACES, record, shuffle_width, stage

FIRST_CHARS = 48
_OUT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "part", "border"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.bool_()]


def _runs(carried: pa.DataType | None):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one sorted partition to rows with their run's first id and size. Holds the ids of one run."""
        text: str | None = None
        ids: list[int | None] = []
        keep, sha, part, run_no = None, "", 0, 0
        out: list[list] = [[] for _ in range(8)]

        def close(border: bool) -> None:
            if not ids:
                return
            low, n = ids[0], len(ids)
            for c, v in zip(out, (ids, [low] * n, [n] * n, [True] + [False] * (n - 1), [sha] * n, [part] * n, [border] * n, [keep] + [None] * (n - 1)), strict=True):
                c.extend(v)

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(c, k) for c, k in zip(out, _KINDS, strict=False)]
            names = list(_OUT)
            if carried is not None:
                arrays.append(pa.array(out[7], carried))
                names.append("row")
            for c in out:
                c.clear()
            return record(names, *arrays)

        for batch in batches:
            rows = batch.column("row").to_pylist() if carried is not None else None
            for i, (d, t, h, p) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "norm", "h", "part")), strict=True)):
                if t != text:
                    close(border=run_no == 0)
                    run_no += bool(ids)
                    text, sha, ids, part = t, h, [], p
                    keep = rows[i] if rows is not None else None
                ids.append(d)
            if len(out[0]) > 20_000:
                yield flush()
        close(border=True)
        if out[0]:
            yield flush()

    return walk


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; with ``carry`` also ``row``, the whole input row of the kept ones."""
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), F.regexp_replace(F.coalesce(docs[text].cast("string"), F.lit("")), SPACES, " ").alias("norm"), *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []))
    keyed = rows.withColumns({"head": F.substring("norm", 1, FIRST_CHARS), "h": F.sha2(F.encode("norm", "utf-8"), 256), "at": F.monotonically_increasing_id()})
    order = [F.col("head"), F.col("h"), F.col("norm"), F.col("doc_id").asc_nulls_last(), F.col("at")]
    dealt = keyed.repartitionByRange(shuffle_width(docs.sparkSession), "head", "h", F.col("doc_id").asc_nulls_last(), "at").sortWithinPartitions(*order)
    dealt = dealt.select("doc_id", "norm", "h", F.spark_partition_id().alias("part"), *(["row"] if carry else []))
    schema = StructType.fromDDL("doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string, part int, border boolean")
    kind = None
    if carry:
        kind = to_arrow_type(rows.schema["row"].dataType)
        schema = schema.add("row", rows.schema["row"].dataType)
    runs = stage(dealt.mapInArrow(_runs(kind), schema), "exact-runs")
    # At most two runs of a partition touch a border, so this table has two rows per partition at most.
    ends = runs.where("border").groupBy("text_sha256", "part").agg(F.min("keep_id").alias("k"), F.max("group_size").alias("n"))
    ends = ends.groupBy("text_sha256").agg(F.min("k").alias("all_id"), F.sum("n").alias("all_n"), F.min("part").alias("all_part"))
    joined = runs.join(F.broadcast(ends), "text_sha256", "left")
    over = F.col("border")
    return joined.select(
        "doc_id",
        F.when(over, F.col("all_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(over, F.col("all_n")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("kept") & (~over | (F.col("part") == F.col("all_part")))).alias("kept"),
        "text_sha256",
        *(["row"] if carry else []),
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows without copies, all columns as they were."""
    return exact_dedup(docs, doc_id, text, carry=True).where("kept").select("row.*")
