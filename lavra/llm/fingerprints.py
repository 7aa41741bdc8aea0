"""Document fingerprints by consistent weighted sampling.

A document is the bag of its words, each weighted by how often it occurs. For each of `SAMPLES` samples a
word draws two Gamma(2, 1) variates r, c and a uniform b from hashes of the word alone; with weight S,
t = floor(ln S / r + b) and ln a = ln c - r * (t - b) - r; the word of least a is the sample, together with t.
Two documents agree in a sample with the probability of their generalised Jaccard similarity,
sum of least weights over sum of greatest weights.

Everything is DataFrame code inside whole-stage code generation: the least a of each sample is one long
(ln a as fixed point above, 16 hash bits of word and t below), so that a bag is folded by plain min() in
one hash aggregation. A fingerprint is 16 bits of each sample in hex.

Defined results: null is the empty text; texts without words have one common fingerprint, of likeness 1 to
each other and 0 to all others; documents are ordered by descending doc_id, null last, ties by a hash of
the text; repeated rows follow each other; one document alone is its own next; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import partitions, table, words

SAMPLES = 32
EMPTY = "-"
#: Ranges of doc_id that are sorted on their own; the heads of all ranges, about so many rows at most, are broadcast.
MOST_CELLS = 65536
#: Ranges of equal numbers of documents that are told apart first.
MOST_SEGMENTS = 1024
_STRIDE = 32


def _sample(term: Column, ln_weight: Column, k: int) -> Column:
    """The sample's candidate of one term as a long: ordered by a, ended by bits of (term, t). Null if the
    weight is. Without conditions around it, so that what it repeats is computed once."""
    h1, h2 = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    part = lambda h, at, n: (F.shiftrightunsigned(h, at).bitwiseAND(F.lit(2**n - 1)).cast("double") + 0.5) * (1.0 / 2**n)
    r = -F.log(part(h1, 0, 24) * part(h1, 24, 24))
    c = -F.log(part(h2, 0, 32) * part(h2, 32, 32))
    b = part(h1, 48, 16)
    t = F.floor(ln_weight / r + b)
    ln_a = F.log(c) - r * (t - b + 1)
    fixed = F.shiftleft(((ln_a + 4096) * F.lit(float(2**32))).cast("bigint"), 16)
    return fixed.bitwiseOR(F.shiftrightunsigned(h2, 16).bitwiseXOR(t).bitwiseAND(F.lit(0xFFFF)))


def signatures(terms: DataFrame, by: list[str], samples: int = SAMPLES) -> DataFrame:
    """terms(*by, term bigint, ln_weight): one fingerprint per by. A null ln_weight only marks that the bag
    exists. No shuffle if terms is partitioned by some of `by`."""
    mins = [F.min(_sample(F.col("term"), F.col("ln_weight"), k)).alias(f"m{k}") for k in range(samples)]
    hexed = [F.lpad(F.lower(F.hex(F.col(f"m{k}").bitwiseAND(F.lit(0xFFFF)))), 4, "0") for k in range(samples)]
    fp = F.when(F.col("m0").isNull(), F.lit(EMPTY)).otherwise(F.concat(*hexed))
    return terms.groupBy(*by).agg(*mins).select(*by, fp.alias("fingerprint"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of samples in which two fingerprints agree."""
    part = lambda x, k: F.substring(x, 4 * k + 1, 4)
    same = sum(((part(a, k) == part(b, k)).cast("int") for k in range(samples)), F.lit(0)) / float(samples)
    return F.when((a == EMPTY) | (b == EMPTY), (a == b).cast("double")).otherwise(same)


def bag(df: DataFrame, by: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of a text column, one row per by. Nothing but the key goes with the words, since that
    aggregation has a row for each distinct word of each text."""
    terms = df.select(*by, F.explode_outer(words(F.col(text))).alias("word")).select(
        *by, F.xxhash64("word").alias("term"), F.when(F.col("word").isNotNull(), 1).alias("one")
    )
    counted = terms.groupBy(*by, "term").agg(F.log(F.sum("one").cast("double")).alias("ln_weight"))
    return signatures(counted, by, samples)


def cells(docs: DataFrame, per_cell: int) -> DataFrame:
    """docs(doc_id, text) with `cell`, rising with doc_id, and below 0, falling with the hash of the text, for
    rows without doc_id. Quantiles of doc_id give segments of near equal numbers of documents, each cut into
    cells of equal width, so that far-off ids widen the cells of their own segment only."""
    spark = docs.sparkSession
    rows, ids = docs.agg(F.count("*"), F.count("doc_id")).first()
    per_cell = max(per_cell, rows // MOST_CELLS)
    n = max(1, min(MOST_SEGMENTS, ids // (4 * per_cell)))
    steps = ", ".join(f"{i / n}D" for i in range(1, n))
    cuts = sorted({-(2**63), *(docs.agg(F.expr(f"percentile_approx(doc_id, array({steps}), {20 * MOST_SEGMENTS})")).first()[0] if n > 1 else [])})
    listed = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    passed = lambda xs: F.size(F.filter(xs, lambda c: c <= F.col("doc_id")))
    stride = passed(listed(cuts[::_STRIDE]))
    segment = F.when(F.col("doc_id").isNotNull(), (stride - 1) * _STRIDE + passed(F.slice(listed(cuts), (stride - 1) * _STRIDE + 1, F.lit(_STRIDE)))).otherwise(0)
    placed = docs.withColumn("segment", segment.cast("int"))
    stats = placed.groupBy("segment").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()  # MOST_SEGMENTS + 1 rows
    listing, first = [], 0
    for r in sorted(stats, key=lambda r: r["segment"]):
        parts = -(-r["n"] // per_cell)
        low = float(r["low"] or 0)
        listing.append((r["segment"], parts, first, low, max((float(r["high"] or 0) - low) / parts, 1e-300)))
        first += parts if r["segment"] else 0
    plan = F.broadcast(spark.createDataFrame(listing or [(0, 1, 0, 0.0, 1.0)], "segment int, parts bigint, first bigint, low double, width double"))
    hashed = F.xxhash64(F.coalesce("text", F.lit(""))).cast("double") / 2.0**64 + 0.5
    share = F.when(F.col("segment") == 0, hashed * F.col("parts")).otherwise((F.col("doc_id").cast("double") - F.col("low")) / F.col("width"))
    part = F.least(F.floor(share).cast("bigint"), F.col("parts") - 1)
    cell = F.when(F.col("segment") == 0, -1 - part).otherwise(F.col("first") + part)
    return placed.join(plan, "segment").select("doc_id", "text", cell.alias("cell"))


def neighbours(docs: DataFrame, per_cell: int = 512) -> DataFrame:
    """docs(doc_id, text) with `place` in its cell, `cell`, and `next_text`, the text of the next document in
    descending doc_id (after the last: the first). `pad` rows repeat the first document of the following
    cell, so that each cell is complete by itself; the text moves in one shuffle, by cell."""
    spark = docs.sparkSession
    dealt = cells(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), per_cell)
    # the first document of each cell (~ turns the order of bigints) ends the cell that comes before it
    lead = F.struct(F.expr("~doc_id").alias("turned"), F.xxhash64("text").alias("hash"))
    heads = dealt.groupBy("cell").agg(F.min(lead).alias("head"))
    down = Window.orderBy(F.col("cell").desc())  # about MOST_CELLS rows at most
    last = F.min("cell").over(Window.partitionBy())
    heads = heads.withColumn("pad_to", F.coalesce(F.lag("cell").over(down), last)).select(F.col("cell").alias("head_cell"), "head", "pad_to")
    is_head = (F.col("cell") == F.col("head_cell")) & F.expr("~doc_id").eqNullSafe(F.col("head.turned")) & (F.xxhash64("text") == F.col("head.hash"))
    led = dealt.join(F.broadcast(heads), is_head, "left")
    places = F.array(
        F.struct(F.col("cell").alias("to"), F.lit(False).alias("pad")),
        F.when(F.col("pad_to").isNotNull(), F.struct(F.col("pad_to").alias("to"), F.lit(True).alias("pad"))),
    )
    rows = docs.count()
    dealt = (
        led.select("doc_id", "text", F.explode(F.filter(places, lambda x: x.isNotNull())).alias("p"))
        .select("doc_id", "text", F.col("p.to").alias("cell"), F.col("p.pad").alias("pad"))
        .repartition(partitions(spark, rows, 2048), "cell")
    )
    order = Window.partitionBy("cell").orderBy("pad", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return dealt.withColumn("place", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))


def edited(docs: DataFrame) -> DataFrame:
    """docs with text, and `edited`: the last third of the text (floor) replaced by as much of the start of
    the next document."""
    third = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))")
    return (
        neighbours(docs)
        .withColumn("n_chars", F.char_length("text").cast("bigint"))
        .withColumn("third", third)
        .withColumn("edited", F.when(~F.col("pad"), F.concat(kept, F.expr("substring(next_text, 1, third)"))))
    )


def op4_weighted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and the likeness of each document's
    fingerprint to the edited text's and to the next document's."""
    both = edited(table(spark, sf_dir, "documents", "doc_id", "text"))
    own = F.struct(F.lit(0).alias("variant"), F.col("text").alias("t"))
    changed = F.struct(F.lit(1).alias("variant"), F.col("edited").alias("t"))
    texts = both.select("cell", "place", F.explode(F.when(F.col("pad"), F.array(own)).otherwise(F.array(own, changed))).alias("v"))
    prints = bag(texts.select("cell", "place", F.col("v.variant").alias("variant"), F.col("v.t").alias("t")), ["cell", "place", "variant"], "t")
    row = prints.groupBy("cell", "place").agg(
        F.max(F.when(F.col("variant") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("variant") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
    )
    following = F.lead("fingerprint").over(Window.partitionBy("cell").orderBy("place"))
    # what else a document returns comes back by its place: one short row for each document
    info = both.filter(~F.col("pad")).select("cell", "place", "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    return (
        row.withColumn("next_fingerprint", following)
        .join(info, ["cell", "place"])
        .select(
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        )
    )


SQL: dict[str, str] = {}
