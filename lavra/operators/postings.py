"""Search in texts by an index of their trigrams, written once and read by many queries.

An index is a folder with three tables:
  texts  key, text, part: the rows, in folders by a hash of the key, each sorted by key
  lists  gram, key: which folded texts hold which three characters, placed by gram and sorted; a frequent gram is split
  sizes  gram, n: how many rows a gram has

A query is folded, its rarest trigrams are looked up (`sizes`, a row for each trigram of the query), their lists are
intersected, and only the texts of keys that hold all of them are read and compared with the whole query: the folders
of other keys are pruned. So the result equals a scan's, and trigrams serve only to leave texts out.

Rows whose text is null or shorter than the query are never found; rows that share a key share its lists and are
compared one by one, so each that matches is found once; a null key is a key like others and comes first in order.
Columns other than key and text are not kept. A query of fewer than three folded characters finds nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions.text import fold
from lavra.operators.search import plain

#: Characters of a text whose trigrams are taken at once, so that the array of a very long text stays small.
CHUNK = 1024
#: Keys that share a folder of texts, and the most folders; beyond that folders grow and are split by row groups.
PER_PART, MOST_PARTS = 1024, 4096
#: Lists that are intersected for a query.
MOST_GRAMS = 6
#: Keys tried first for a query that asks for the first few, for each of these.
TRIED = 4


def grams(text: Column) -> Column:
    """Every three characters in a row, with repeats."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1))


def folded(text: Column) -> Column:
    return fold(plain(text))


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def lists(rows: DataFrame) -> DataFrame:
    """rows(key, text) to gram, key, each gram once for a row. Chunks overlap by two characters, so that no trigram is lost."""
    chunks = F.regexp_extract_all(folded(F.col("text")), F.lit(f"(?s)(?=(.{{1,{CHUNK + 2}}})).{{1,{CHUNK}}}"), F.lit(1))
    own = F.aggregate(chunks, F.array().cast("array<string>"), lambda seen, chunk: F.array_union(seen, grams(chunk)))
    return rows.select(F.explode(own).alias("gram"), "key")


class Index:
    """The tables of an index. `build` writes them; an index that is written can be opened by its folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        about = spark.read.parquet(f"{folder}/about")
        kind = about.schema["key"].dataType.simpleString()
        shapes = {"texts": f"key {kind}, text string, part int", "lists": f"gram string, key {kind}", "sizes": "gram string, n bigint"}
        self.texts, self.lists, self.sizes = (spark.read.schema(shape).parquet(f"{folder}/{t}") for t, shape in shapes.items())
        self.parts = about.first()["parts"]

    @classmethod
    def build(cls, rows: DataFrame, folder: str) -> Index:
        """rows(key, text) as an index in a folder that does not exist yet."""
        spark, rows = rows.sparkSession, rows.select("key", "text")
        parts = max(1, min(MOST_PARTS, rows.count() // PER_PART))
        placed = rows.withColumn("part", _part(F.col("key"), parts))
        placed.hint("rebalance", "part").sortWithinPartitions("part", "key").write.partitionBy("part").parquet(f"{folder}/texts")
        stored = spark.read.schema(placed.schema).parquet(f"{folder}/texts").select("key", "text")
        listed = lists(stored)
        listed.hint("rebalance", "gram").sortWithinPartitions("gram", "key").write.parquet(f"{folder}/lists")
        spark.read.schema(listed.schema).parquet(f"{folder}/lists").groupBy("gram").agg(F.count("*").alias("n")).sortWithinPartitions("gram").write.parquet(f"{folder}/sizes")
        spark.range(1).select(F.lit(parts).alias("parts"), F.lit(None).cast(rows.schema["key"].dataType).alias("key")).write.parquet(f"{folder}/about")
        return cls(spark, folder)

    def candidates(self, query: str) -> DataFrame | None:
        """key of each text that may hold the query; None if none can."""
        asked = self.spark.range(1).select(fold(F.lit(query.strip())).alias("needle")).select("needle", F.array_distinct(grams(F.col("needle"))).alias("grams"))
        own = asked.first()["grams"]
        if not own:
            return None
        sizes = self.sizes.filter(F.col("gram").isin(own)).collect()  # at most one row for each trigram of the query
        if len(sizes) < len(own):
            return None
        rare = [r["gram"] for r in sorted(sizes, key=lambda r: (r["n"], r["gram"]))[:MOST_GRAMS]]
        found = self.lists.filter(F.col("gram").isin(rare))
        return found.groupBy("key").agg(F.size(F.collect_set("gram")).alias("n")).filter(F.col("n") == len(rare)).select("key")

    def _holding(self, rows: DataFrame, query: str) -> DataFrame:
        return rows.filter(folded(F.col("text")).contains(fold(F.lit(query.strip())))).select("key", "text")

    def search(self, query: str) -> DataFrame:
        """key, text of every row that holds the query, marks, accents and case aside."""
        keys = self.candidates(query)
        if keys is None:
            return self.texts.select("key", "text").limit(0)
        keys = keys.select(F.col("key").alias("held"), _part(F.col("key"), self.parts).alias("held_part"))
        met = self.texts.join(keys, (F.col("part") == F.col("held_part")) & F.col("key").eqNullSafe(F.col("held")), "left_semi")
        return self._holding(met, query)

    def first(self, query: str, most: int) -> DataFrame:
        """The first `most` of `search` by key, then text. A frequent query is answered from the first few candidates;
        only if too few of these hold it are all the others read."""
        keys = self.candidates(query)
        if keys is not None:
            tried = keys.select("key", _part(F.col("key"), self.parts).alias("part")).orderBy("key").limit(TRIED * most + 1).collect()  # bounded by what is asked for
            whole, tried = len(tried) <= TRIED * most, tried[: TRIED * most]
            some, places = [r["key"] for r in tried if r["key"] is not None], {r["part"] for r in tried}
            is_null = F.col("key").isNull() if len(some) < len(tried) else F.lit(False)
            met = self._holding(self.texts.filter(F.col("part").isin(places) & (F.col("key").isin(some) | is_null)), query)
            if whole or met.limit(most).count() == most:
                return met.orderBy("key", "text").limit(most)
        return self.search(query).orderBy("key", "text").limit(most)
