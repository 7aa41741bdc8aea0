"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source whose target is T words and whose documents hold S words is taken T // S times as a whole
(complete epochs); the rest, T - S * (T // S) words, is a sample without replacement: each document gets
the key -ln(u) / quality with u a hash of its id, keys are sorted within the source, sizes are prefix-summed
and documents are taken whole until the rest is reached (the document at the border where that comes
nearer to the target). Reruns agree, since u depends on doc_id, size and the seed only.

A hot source is no single task: keys fall into ranges of about `per_range` documents, ranges are
prefix-summed first, then documents within a range.

Defined results: null text has size 0 and is part of its source; a null source is the last source; blank
documents are taken with the epochs they belong to and count nothing; a null doc_id is hashed like a value;
repeated rows are each taken on their own; an empty table gives an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, n_words, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes(source, source_size, ...) with target: weights by code point of the source (null last), shares
    of `share` of all sizes, none above `most` times its source's size; what is above goes to the others
    by weight until none is above. With r = most * size / weight, the sources stopped are those of lowest r
    up to the first for which the rest, shared by weight, fits. One row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_r = Window.orderBy("r", F.col("source").asc_nulls_last())
    before, after = by_r.rowsBetween(Window.unboundedPreceding, -1), by_r.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    ranked = (
        sizes.withColumn("w", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("r", F.col("cap") / F.col("w"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", level)
        .withColumn("open", F.when(F.col("level") <= F.col("r"), F.col("level")))
    )
    # levels rise with r as long as a source is stopped, so that the first open one holds for all after it
    first = F.first("open", ignorenulls=True).over(by_r.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lam = ranked.withColumn("final", first)
    return lam.withColumn("target", F.when(F.col("final").isNull() | (F.col("r") < F.col("final")), F.col("cap")).otherwise(F.col("final") * F.col("w"))).drop(
        "w", "cap", "r", "budget", "level", "open", "final"
    )


def uniform(seed: int, *by: Column) -> Column:
    """A number in (0, 1) from the MD5 of the values, the same on every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("-")) for c in by])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def quality(text: Column, size: Column) -> Column:
    """Quality weight of a document from 0.05 to 1: how near its mean word length (with the blank) is to 7."""
    mean = F.coalesce(F.char_length(text), F.lit(0)) / F.greatest(size, F.lit(1))
    return F.greatest(F.lit(0.05), 1 - F.abs(mean - 7) / 7)


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, per_range: int = 4096) -> DataFrame:
    """docs(doc_id, source, size, quality, ...) with source_size, target, copies (how often the mix takes the
    document) and taken = copies * size; columns of these names are replaced, all others kept."""
    new = ["source_size", "target", "copies", "taken"]
    docs = docs.drop(*new)
    docs = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "size", "quality")
    key = -F.ln(uniform(seed, F.col("doc_id"), F.col("size"))) / F.col("quality")
    slim = cut(docs.withColumn("key", key), "mix")
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    goals = cut(targets(sources, weights, share, most), "targets")
    # 1 - exp(-key * q) is uniform for documents of mean quality q: a monotone spread of keys over ranges
    q = slim.agg(F.avg("quality")).first()[0] or 1.0
    ranges = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / F.lit(per_range)))
    spread = F.floor((1 - F.exp(-F.col("key") * F.lit(q))) * F.col("ranges"))
    placed = (
        slim.join(goals.withColumn("ranges", ranges), slim["source"].eqNullSafe(goals["source"]))
        .drop(goals["source"])
        .withColumn("range", F.least(spread, F.col("ranges") - 1).cast("bigint"))
    )
    key_of = [F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("s_null"), "range"]
    sums = placed.groupBy(*key_of).agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("s", "s_null").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("s", "s_null", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_start"))
    within = Window.partitionBy("s", "s_null", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (
        placed.withColumn("s", F.coalesce("source", F.lit("")))
        .withColumn("s_null", F.col("source").isNull())
        .join(starts, ["s", "s_null", "range"])
        .withColumn("end", F.col("range_start") + F.sum("size").over(within))
        .withColumn("epochs", epochs.cast("bigint"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("copies", F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("end") - F.col("size") / 2 <= F.col("rest")), 1).otherwise(0))
        .withColumn("copies", F.least("copies", F.lit(math.floor(most)).cast("bigint")))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("row.*", *new)
    )


def sized(docs: DataFrame) -> DataFrame:
    size = n_words(F.col("text"))
    return docs.withColumn("size", size).withColumn("quality", quality(F.col("text"), F.col("size")))


def op10_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    docs = sized(table(spark, sf_dir, "documents", "doc_id", "source", "text")).drop("text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


_SQL = """
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
k AS (
  SELECT doc_id, source, size, greatest(0.05, 1 - abs(coalesce(length(text), 0) / greatest(size, 1) - 7) / 7) AS q,
    ((('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, '-') || '|' || size::VARCHAR), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
    source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s),
r AS (SELECT *, cap / w AS r FROM w),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT min(r) AS r0, arg_min(level, r) AS final FROM l WHERE level <= r),
t AS (
  SELECT l.source, source_size, CASE WHEN final IS NULL OR r < final THEN cap ELSE final * w END AS target FROM l LEFT JOIN f ON TRUE),
p AS (
  SELECT doc_id, size, source_size::BIGINT AS source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs,
    sum(size) OVER (PARTITION BY k.source ORDER BY -ln(u) / q, doc_id, size ROWS UNBOUNDED PRECEDING) AS ends
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (least(2, epochs + CASE WHEN target - epochs * source_size > 0 AND ends - size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM p
"""
SQL = {"op10_weighted_mix": _SQL}
