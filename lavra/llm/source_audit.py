"""Source divergence audit: how far the word use of the sources of a language lies apart, and by which terms.

Terms are counted by (lang, source, term), with map-side sums, so that neither a frequent term nor a large source
is one task's work. Each term that enough documents of its language hold becomes one row with the counts of its
sources; the sizes of all sources of the language turn it into a source-indexed array of smoothed shares
(parts per billion, whole numbers), by higher-order functions. Each ordered pair of positions contributes a whole
number, worked out in generated code after two explodes of that array (a higher-order function for each pair costs
several times as much), and map-side sums by (lang, pair) end in one row for each pair.

All arithmetic is in whole numbers: decimals of 38 digits where a count is multiplied, else longs; a division that
leaves the scale of longs raises. Only the sources of a language, never its terms, come together in one row.

Defined results: null text, lang and source are ''; a group without terms takes part with counts of 0; a language
with no kept terms has pairs of value 0 and no terms; one source alone has no pairs; ties go to the item that is
less in UTF-8; repeated rows count as documents of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, table

#: What stands between terms: everything in ASCII but letters.
BETWEEN = "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
LEAST_DOCS = 3
MOST_TERMS = 200
SCALE = 1_000_000_000


def terms(text: Column) -> Column:
    """Array of the terms of a text, A-Z in lower case."""
    lowered = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(lowered, BETWEEN), "")


def count_terms(docs: DataFrame) -> DataFrame:
    """docs(lang, source, text) to lang, source, term, n (occurrences), n_docs (rows that hold it)."""
    parsed = docs.select("lang", "source", terms(F.col("text")).alias("all"))
    lists = F.array(F.struct(F.lit(0).alias("doc"), F.col("all").alias("terms")), F.struct(F.lit(1).alias("doc"), F.array_distinct("all").alias("terms")))
    one = parsed.select("lang", "source", F.explode(lists).alias("x")).select("lang", "source", F.col("x.doc").alias("doc"), F.explode("x.terms").alias("term"))
    return one.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("doc")).alias("n"), F.sum("doc").cast("bigint").alias("n_docs"))


def term_vectors(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, by_source (map of counts): a row for each kept term, as wide as its sources."""
    entry = F.struct("source", "n")
    wide = counts.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.map_from_entries(F.collect_list(entry)).alias("by_source"))
    return wide.filter(F.col("n_docs") >= least_docs).select("lang", "term", "by_source")


def languages(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """groups(lang, source) and the kept terms to lang, sources (array of source and its total, in order), n_terms,
    total: one row for each language."""
    totals = vectors.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = vectors.groupBy("lang").agg(F.count("*").alias("n_terms"))
    each = groups.distinct().join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("bigint")))
    per = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("sources"), F.sum("total").alias("total"))
    return per.join(kept, "lang", "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0).cast("bigint")))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, total: Column) -> Column:
    """Smoothed share of a term in parts per billion, from 1; total with the number of terms in it."""
    return 1 + _div((n + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(19,0)"))


def gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def with_shares(vectors: DataFrame, langs: DataFrame) -> DataFrame:
    """vectors with `sources`, `shares` (of each source, in order) and `q` (of the language). langs is a written
    table, so that the join is a broadcast only where its measured size is under the session's threshold."""
    met = vectors.join(langs, "lang")
    count = lambda s: F.coalesce(F.element_at("by_source", s["source"]), F.lit(0).cast("bigint"))
    all_ = F.aggregate(F.map_values("by_source"), F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    return met.select(
        "lang", "term", "sources",
        F.transform("sources", lambda s: F.struct(count(s).alias("n"), share(count(s), s["total"] + F.col("n_terms")).alias("p"))).alias("shares"),
        share(all_, F.col("total") + F.col("n_terms")).alias("q"),
    )


def pair_gaps(shared: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, item, value: each ordered pair of sources of a language."""
    # two explodes of one array pair its positions, so that their contribution is generated code
    one = shared.select("lang", F.transform("shares", lambda s: s["p"]).alias("ps")).select("lang", "ps", F.posexplode("ps").alias("i", "p"))
    each = one.select("lang", "i", "p", F.posexplode("ps").alias("j", "q")).select("lang", "i", "j", gap(F.col("p"), F.col("q")).alias("value"))
    n = F.size("sources")
    numbers = F.sequence(F.lit(0), n - 1)
    none = langs.select("lang", F.explode(numbers).alias("i"), "sources").select("lang", "i", F.explode(numbers).alias("j"), F.lit(0).cast("bigint").alias("value"))
    summed = each.unionByName(none).filter(F.col("i") != F.col("j")).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    name = lambda c: F.get("sources", F.col(c))["source"]
    return summed.join(langs.select("lang", "sources"), "lang").select("lang", name("i").alias("source"), name("j").alias("item"), "value")


def term_gaps(shared: DataFrame) -> DataFrame:
    """lang, source, item, value: terms that a source uses more than its language does."""
    each = shared.select("lang", "term", "q", F.explode(F.arrays_zip("sources", "shares")).alias("x"))
    over = each.filter((F.col("x.shares.n") > 0) & (F.col("x.shares.p") > F.col("q")))
    return over.select("lang", F.col("x.sources.source").alias("source"), F.col("term").alias("item"), gap(F.col("x.shares.p"), F.col("q")).alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """docs(lang, source, text) to lang, source, part, item, value, rank."""
    clean = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    vectors = cut(term_vectors(count_terms(clean), least_docs), "term-vectors")
    langs = cut(languages(clean.select("lang", "source"), vectors), "term-languages")
    shared = with_shares(vectors, langs)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pair_gaps(shared, langs), "pair").unionByName(ranked(term_gaps(shared), "term").filter(F.col("rank") <= most_terms))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all pairs of sources of each language, and the 200 terms that set each source apart."""
    return divergence(table(spark, sf_dir, "documents", "lang", "source", "text"))


SQL = {
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d), e AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
v AS (SELECT lang, term FROM e GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3), vn AS (SELECT lang, count(*) AS v FROM v GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM e JOIN v USING (lang, term) GROUP BY ALL),
gt AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL), lt AS (SELECT lang, sum(total) AS total FROM gt GROUP BY 1),
ps AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(gt.total, 0) + vn.v)::HUGEINT AS p
  FROM g JOIN v USING (lang) JOIN vn USING (lang) LEFT JOIN gt USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
qs AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(lt.total) + any_value(vn.v))::HUGEINT AS q FROM c JOIN lt USING (lang) JOIN vn USING (lang) GROUP BY 1, 2),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM ps x JOIN ps y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM ps JOIN qs USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200
""",
}
