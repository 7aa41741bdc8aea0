"""Filter interaction audit: what each filter removes in every order, by part, and what that costs.

Four filters look at a text alone; the fifth fails every copy of a smaller doc_id's text. Copies are found by
sorting: rows are dealt in ranges of (fingerprint of the text, doc_id), sorted there by fingerprint, full text and
doc_id, and each row is compared with its predecessor, so that a run of equal texts is told by its first row. A
run that goes on over a border of ranges is mended from the borders: each range states the first doc_id of every
text that has its last fingerprint, one short row for nearly every range, and rows of a range's first fingerprint
look their text up there. A group of copies, however large, is cut by doc_id (and row, for repeated doc_ids) into
as many ranges as it fills.

Failures are bits of one mask. Rows of one doc_id, part and mask are counted before labels meet them, so that no
doc_id is hot; the counts of a part and mask are additive, and every figure of every order comes from at most
32 of them.

Defined results: a null text is the empty text, a null source the part ''; a null doc_id comes after all others
(so it fails the fifth filter if its text has a doc_id anywhere, and never makes another row fail) and has no
labels; rows that repeat doc_id and text are of equal age and do not fail each other; repeated labels of a doc_id
count as 1 if any of them is 1; an empty table has no parts and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, small_batches, table, words

#: Letters of the filters; the last one is the comparison with other texts.
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 2
SIGNS = "[#$%&*|]"
ROWS_PER_RANGE = 8192
_ROW = "doc_id bigint, part string, mask int, digest binary, border boolean"


def own_failures(text: Column) -> Column:
    """Bits of the filters that look at one text: A short, B repetitive, C capitals, D signs."""
    w = words(text)
    n, distinct = F.size(w), F.size(F.array_distinct(w))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals.cast("bigint") > MOST_CAPITALS * F.char_length(text), text.rlike(SIGNS)]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range. Rows: the mask with the last filter's bit by the rows of this range; `digest` of the
    text where an earlier range may hold it too. At the end the border: a row for each text of the last
    fingerprint, with its first doc_id."""
    copy = 1 << (len(FILTERS) - 1)
    head = None  # the range's first fingerprint
    prev = None  # text, its first doc_id (None: null) and fingerprint of the run before
    border: dict[bytes, int | None] = {}
    for b in small_batches(batches, 4096):
        text, ids, n = b.column("text"), b.column("doc_id"), b.num_rows
        prints = b.column("print").to_numpy()
        head = prints[0] if head is None else head
        starts = np.ones(n, bool)
        starts[1:] = ~pc.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts[0] = prev is None or text[0].as_py() != prev[0]
        at = np.flatnonzero(starts)
        run = np.cumsum(starts) - 1  # -1: the run of the batch before
        valid, value = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        known = np.append(valid[at], prev is not None and prev[1] is not None)
        least = np.append(value[at], prev[1] if known[-1] else 0)
        fails = known[run] & (~valid | (value > least[run]))
        mask = b.column("mask").to_numpy() | np.where(fails, copy, 0).astype(np.int32)
        last = prints[-1]
        if prev is not None and last != prev[2]:
            border = {}
        digests: list[bytes | None] = [None] * (len(at) + 1)
        for k in [-1, *np.flatnonzero((prints[at] == head) | (prints[at] == last)).tolist()]:
            if k >= 0 or not starts[0]:
                i = at[k] if k >= 0 else 0
                digests[k] = hashlib.sha256(text[i].as_py().encode()).digest()
                if prints[i] == last:
                    border.setdefault(digests[k], int(least[k]) if known[k] else None)
        seen = [digests[r] if p == head else None for r, p in zip(run.tolist(), prints.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([ids, b.column("part"), pa.array(mask, pa.int32()), pa.array(seen, pa.binary()), pa.array(np.zeros(n, bool))], names=["doc_id", "part", "mask", "digest", "border"])
        r = run[-1]
        prev = (text[n - 1].as_py(), int(least[r]) if known[r] else None, last)
    if border:
        none = [None] * len(border)
        yield pa.RecordBatch.from_arrays(
            [pa.array(border.values(), pa.int64()), pa.array(none, pa.string()), pa.array(none, pa.int32()), pa.array(border.keys(), pa.binary()), pa.array([True] * len(border))],
            names=["doc_id", "part", "mask", "digest", "border"],
        )


def failures(docs: DataFrame) -> DataFrame:
    """docs(doc_id bigint, text, part) to doc_id, part, mask: one row each, a bit for each filter that it fails."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "part")
    keyed = rows.withColumn("print", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    by_age = F.col("doc_id").asc_nulls_last()
    dealt = keyed.repartitionByRange(partitions(spark, docs.count(), ROWS_PER_RANGE), "print", by_age, "row")
    # the filters come after the deal, which evaluates what stands before it twice (once for its quantiles)
    sorted_ = dealt.withColumn("mask", own_failures(F.col("text"))).sortWithinPartitions("print", "text", by_age)
    compared = cut(sorted_.select("doc_id", "text", "part", "print", "mask").mapInArrow(_compare, _ROW), "filter-audit")
    # one row for each range, and one more for each other text of an equal 64-bit fingerprint
    first = compared.filter("border").groupBy("digest").agg(F.min("doc_id").alias("first"))
    older = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    met = compared.filter("not border").join(F.broadcast(first), "digest", "left")
    return met.select("doc_id", "part", F.when(older, F.col("mask").bitwiseOR(F.lit(1 << (len(FILTERS) - 1)))).otherwise(F.col("mask")).alias("mask"))


def part_counters(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """failed(doc_id, part, mask), labels(doc_id, quality, toxic) to part, mask, n, good, toxic: additive, at most
    32 rows for each part."""
    any1 = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.groupBy("doc_id").agg(any1("quality").alias("good"), any1("toxic").alias("toxic"))
    some = failed.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    of = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c)
    return some.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def report(counters: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and counts, for every order of the filters (the letters of bits 0, 1, ...)."""
    orders = ["".join(p) for p in permutations(filters)]
    cells = counters.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    one = cells.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ","))).withColumn("step", F.explode(F.lit(list(range(1, len(filters) + 1)))))
    bits = lambda when: sum((F.when(when(F.instr(F.col("filter_order"), f)), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    one = one.withColumn("now", bits(lambda at: at == F.col("step"))).withColumn("before", bits(lambda at: at < F.col("step")))
    hit = lambda x, c: x["mask"].bitwiseAND(F.col(c)) != 0

    def total(of: str, when) -> Column:
        return F.aggregate(F.filter("cells", when), F.lit(0).cast("bigint"), lambda acc, x: acc + x[of])

    removed = lambda x: hit(x, "now") & ~hit(x, "before")
    # a failing filter comes first of the k that a text fails in one of k orders
    first = F.aggregate(F.filter("cells", lambda x: hit(x, "now")), F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"] * (F.lit(float(len(orders))) / F.bit_count(x["mask"])).cast("bigint"))
    return one.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total("n", lambda x: ~hit(x, "now") & ~hit(x, "before")).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda x: hit(x, "now") & hit(x, "before")).alias("redundant"), total("n", lambda x: x["mask"] == F.col("now")).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), first.alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents, by source, in all 120 orders."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source").select("doc_id", "text", F.coalesce("source", F.lit("")).alias("part"))
    return report(part_counters(failures(docs), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))


SQL = {
    "op11_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
m AS (SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
  + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
  + 16 * coalesce(first IS NOT NULL AND (doc_id IS NULL OR doc_id > first), false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits, a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, k AS step, bits[k] AS now, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM o, range(1, 6) r(k)),
x AS (SELECT part, filter_order, step, now, coalesce(sum(n) FILTER (mask & (now | before) = 0), 0) AS kept,
  coalesce(sum(n) FILTER (mask & now <> 0 AND mask & before = 0), 0) AS removed, coalesce(sum(n) FILTER (mask & now <> 0 AND mask & before <> 0), 0) AS redundant,
  coalesce(sum(n) FILTER (mask = now), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & now <> 0 AND mask & before = 0), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (mask & now <> 0 AND mask & before = 0), 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, now))::BIGINT AS shapley FROM x
""",
}
