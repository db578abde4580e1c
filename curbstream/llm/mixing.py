"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash of 60 bits, so the documents of a source below a threshold are a nested random choice. Tokens
are summed by source and the first 15 bits; the bucket in which the budget runs out is refined by the next 15 bits, and
so on, until one hash value is left. Only documents of the boundary buckets are read again (about 1 in 32,768 of the
former level), nothing is sorted, and no source is gathered in one task: tasks pre-aggregate, and a window runs over at
most 32,768 sums per source.

A source whose target exceeds its size is taken whole as often as it fits, and the threshold picks who comes once more.
Null sources are a source of their own, ordered last; null and empty texts have size 0 and are never taken. Rows with
the same id and text share a hash and are taken together. An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbstream.llm.common import size_in_words, stage

BITS, LEVELS = 15, 4


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, size) to the same with ``target``: shares by weight, none above ``most`` sizes, the excess shared again.

    The fixed point of sharing again: in ascending order of (most * size / weight), sources are capped while their cap
    is under their share of what is left; the rest share what is left. One row per source.
    """
    by_name, n = W.orderBy(F.col("source").asc_nulls_last()), len(weights)
    s = sizes.withColumn("nth", F.row_number().over(by_name) - 1)
    s = s.withColumns({"weight": F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("nth") % n + 1).cast("int")).cast("bigint"), "cap": F.col("size") * most})
    by_ratio = W.orderBy((F.col("cap") / F.col("weight")), "nth")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({"left_size": F.sum("size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0)), "left_weight": F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)), "rank": F.row_number().over(by_ratio)})
    capped = F.col("cap") * F.col("left_weight") <= F.col("weight") * F.col("left_size")
    share = F.min(F.when(~capped, F.struct("rank", (F.col("left_size").cast("double") / F.col("left_weight")).alias("v")))).over(W.partitionBy())["v"]
    return s.select("source", "size", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("weight") * share).alias("target"))


def _level(h: str, level: int):
    return F.shiftright(F.col(h), BITS * (LEVELS - 1 - level)).bitwiseAND((1 << BITS) - 1)


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (how often the mix takes it), taken (words)."""
    narrow = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[source].cast("string").alias("source"), size_in_words(docs[text].cast("string")).alias("size"), _hash(docs, doc_id, text).alias("h"))
    narrow = stage(narrow, "mix-sizes")
    goal = targets(narrow.groupBy("source").agg(F.sum("size").alias("size")), weights, most)
    goal = goal.withColumns({"source_size": F.col("size"), "whole": F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)}).drop("size")
    goal = stage(goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    # The boundary bucket of each source, refined level by level: hash bits fixed so far, tokens already below them.
    edge = goal.select("source", "rest").withColumns({"fixed": F.lit(0).cast("bigint"), "below": F.lit(0).cast("bigint")})
    inside = narrow.where("size > 0")
    for level in range(LEVELS):
        if level:
            inside = stage(inside.alias("d").join(edge.alias("e"), F.expr("d.source <=> e.source") & (F.shiftright("d.h", BITS * (LEVELS - level)) == F.col("e.fixed"))).select("d.source", "d.size", "d.h"), "mix-edge")
        hist = inside.groupBy("source", _level("h", level).alias("b")).agg(F.sum("size").alias("size"))
        hist = hist.alias("h").join(edge.alias("e"), F.expr("h.source <=> e.source")).select("e.*", "b", "size")
        cum = F.sum("size").over(W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, 0))
        hist = hist.withColumn("upto", F.col("below") + cum)
        # The last bucket is the boundary too where rounding leaves the budget just above all tokens.
        at = hist.groupBy("source", "rest", "fixed").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("rest"), F.struct("b", "upto", "size"))), F.max(F.struct("b", "upto", "size"))).alias("x"))
        edge = stage(at.select("source", "rest", F.shiftleft("fixed", BITS).bitwiseOR(F.col("x.b")).alias("fixed"), (F.col("x.upto") - F.col("x.size")).alias("below"), F.col("x.upto").alias("upto")), "mix-boundary")
    # The unit on the boundary is taken when that ends nearer to the budget.
    threshold = edge.select("source", F.when(F.col("upto") - F.col("rest") < F.col("rest") - F.col("below"), F.col("fixed")).otherwise(F.col("fixed") - 1).alias("threshold"))
    plan = goal.alias("g").join(threshold.alias("t"), F.expr("g.source <=> t.source"), "left").select("g.*", "threshold")
    out = narrow.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source")).withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + (F.col("h") <= F.coalesce("threshold", F.lit(-1))).cast("bigint")).otherwise(0))
    return out.select("doc_id", "d.source", "size", "source_size", "target", F.col("copies").cast("bigint").alias("copies"), (F.col("size") * F.col("copies")).cast("bigint").alias("taken"), "h")


def _hash(docs: DataFrame, doc_id: str, text: str):
    return F.conv(F.substring(F.md5(F.concat_ws(":", docs[doc_id].cast("string"), docs[text].cast("string"))), 1, 15), 16, 10).cast("bigint")


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The input rows, each as often as the mix takes it. The narrow plan meets the whole rows by id, source and hash."""
    plan = mix_sources(docs, doc_id, text, source, weights, most).where("copies > 0").select("h", "doc_id", "source", F.array_repeat(F.lit(0), F.col("copies").cast("int")).alias("each")).dropDuplicates(["doc_id", "source", "h"]).alias("p")
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), docs[doc_id].cast("bigint").alias("doc_id"), docs[source].cast("string").alias("source"), _hash(docs, doc_id, text).alias("h")).alias("o")
    met = own.join(plan, F.expr("o.h = p.h and o.doc_id <=> p.doc_id and o.source <=> p.source"))
    return met.select("o.whole", F.explode("p.each")).select("whole.*")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, length(w) AS size, ('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), text)), 1, 15))::BIGINT AS h
  FROM (SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
), s AS (
  SELECT source, sum(size)::BIGINT AS size, 3 * sum(size)::BIGINT AS cap, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source
), w AS (SELECT *, 1 + nth % 3 AS weight FROM s), l AS (
  SELECT *, (sum(size) OVER ())::BIGINT - coalesce(sum(cap) OVER b, 0)::BIGINT AS left_size, (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER b, 0)::BIGINT AS left_weight
  FROM w WINDOW b AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (SELECT *, cap * left_weight <= weight * left_size AS capped FROM l), g AS (
  SELECT source, size AS source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight * (SELECT arg_min(left_size::DOUBLE / left_weight, cap / weight) FROM c WHERE NOT capped) END AS target FROM c
), r AS (
  SELECT d.doc_id, d.source, d.size, d.h, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS whole
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), t AS (
  SELECT *, target - whole * source_size AS rest, sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER (PARTITION BY source, h) AS unit FROM r
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * (whole + CASE WHEN upto <= rest OR (upto - unit < rest AND upto - rest < rest - (upto - unit)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM t
"""
