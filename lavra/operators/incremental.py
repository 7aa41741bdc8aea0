"""Links of an archive that grows: what is new is linked with all that is there, and nothing that is there is
worked out or written again.

Kept beside the acts, and only ever added to:
  members  key, digest (of the text but for white space), class_id
  classes  class_id, block, tokens, n: acts of one block and one token set are one class
  leading  token (with block), at, class_id, n: the leading tokens of each class (a store with `postings`, which had fewer of them, is
           to be rebuilt)
  pairs    class_id, like: classes of similarity `LIKE` or more, each pair once
  ranks    bucket, df: frequencies in the first batch, by hash buckets of tokens; others count as rarest

Two sets of Jaccard similarity t share k of their first n - ceil(t n) + k tokens in any order that both keep; the order
of `ranks` (rare first) is frozen with the first batch, so postings of all batches keep one. When the language of an archive drifts, ranks serve worse, never wrongly; a rebuild is `add` on an empty store.

`links` resolves these facts: the least act of a digest, and earlier members of like classes. So an act that
arrives late with a small key takes its place in the links of older acts without any of them being touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.text import squeeze
from lavra.operators.linking import LIKE, checked, frequencies, leading, meeting, near, needed, often, tokens, written

TABLES = ("members", "classes", "leading", "pairs")


def ranks(acts: DataFrame) -> DataFrame:
    """bucket, df of the tokens of acts(text): the order that all later batches keep."""
    return frequencies(acts.select(tokens(F.col("text")).alias("tokens")))


def _id(*columns: Column | str) -> Column:
    return F.unhex(F.md5(F.to_json(F.struct(*columns)).cast("binary")))


def _facts(acts: DataFrame) -> DataFrame:
    """acts(doc_id, ord, act_id, classe, tipo, text) to key, digest, block, tokens (sorted), class_id (null without
    tokens)."""
    key, block = F.struct("doc_id", "ord", "act_id").alias("key"), F.struct("classe", "tipo").alias("block")
    one = acts.select(key, block, F.sha2(squeeze(F.col("text")), 256).alias("digest"), F.array_sort(tokens(F.col("text"))).alias("tokens"))
    return one.withColumn("class_id", F.when(F.size("tokens") > 0, _id("block", "tokens")))


def add(acts: DataFrame, order: DataFrame, stored: dict[str, DataFrame] | None = None, like: tuple[int, int] = LIKE) -> dict[str, DataFrame]:
    """What new acts add to each of `TABLES`. stored: what these hold, None at first; it is read, by columns, and
    joined with what is new (small as a rule, and then broadcast by its measured size), not shuffled or written."""
    facts = written(_facts(acts), "facts")  # texts are folded once
    members = facts.select("key", "digest", "class_id")
    classes = facts.filter("class_id is not null").dropDuplicates(["class_id"]).select("class_id", "block", "tokens", F.size("tokens").alias("n"))
    if stored:
        classes = classes.join(stored["classes"].select("class_id"), "class_id", "left_anti")
    classes = written(classes, "classes")
    postings = written(leading(classes, order, like), "postings")
    meets = lambda others, also: postings.alias("l").join(others.alias("r"), meeting("l", "r", like) & also).select(F.col("l.class_id").alias("rep"), F.col("r.class_id").alias("like"), needed("l", "r", like).alias("need"))
    found = meets(postings.toDF(*postings.columns), F.col("r.class_id") < F.col("l.class_id"))
    every = classes
    if stored:
        found = found.unionByName(meets(stored["leading"], F.lit(True)))
        every = every.unionByName(stored["classes"])
    named = every.withColumnRenamed("class_id", "rep")
    pairs = checked(near(often(found), named, like), named, like).select(F.col("rep").alias("class_id"), "like")
    return {"members": members, "classes": classes, "leading": postings, "pairs": pairs}


def _stopped(members: DataFrame) -> DataFrame:
    """key, class_id, stop: the least act of the same digest, if that is another one."""
    least = members.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    return members.join(least, "digest", "left").select("key", "class_id", F.when(F.col("first") < F.col("key"), F.col("first")).alias("stop"))


def _alike(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """class_id, like: pairs in both directions, and each class with itself."""
    own = members.filter("class_id is not null").select("class_id").distinct().select("class_id", F.col("class_id").alias("like"))
    return pairs.unionByName(pairs.select(F.col("like").alias("class_id"), F.col("class_id").alias("like"))).unionByName(own)


def links(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, ord, duplicate_of (an act_id or null) and variants (act_ids) of every act, in the order of the archive;
    an act that has a duplicate looks only at acts before that."""
    mine, alike = _stopped(members), _alike(members, pairs)
    others = members.filter("class_id is not null").select(F.col("class_id").alias("like"), F.col("key").alias("other"))
    before = (F.col("other") < F.col("key")) & (F.col("stop").isNull() | (F.col("other") < F.col("stop")))
    met = mine.filter("class_id is not null").join(alike, "class_id").join(others, "like").filter(before)
    variants = met.groupBy("key").agg(F.array_sort(F.collect_list("other")).alias("vs"))
    none = F.array().cast("array<string>")
    return mine.join(variants, "key", "left").select(
        "key.doc_id", "key.ord", F.col("stop.act_id").alias("duplicate_of"), F.coalesce(F.transform("vs", lambda v: v["act_id"]), none).alias("variants")
    )


def link_counts(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """`links` with the number of variants in place of their list. Copies have one bound, the first of them, so that a class
    asks once for all of its copies; pairs are summed where they are met, and none is shuffled."""
    mine = _stopped(members).withColumn("bound", F.coalesce("stop", "key"))
    asked = mine.filter("class_id is not null").select("class_id", "bound").distinct()
    others = members.filter("class_id is not null").select(F.col("class_id").alias("like"), F.col("key").alias("other"))
    met = asked.join(_alike(members, pairs), "class_id").join(others, "like").filter(F.col("other") < F.col("bound"))
    counted = met.groupBy("class_id", "bound").agg(F.count("*").alias("n"))
    return mine.join(counted, ["class_id", "bound"], "left").select("key.doc_id", "key.ord", F.col("stop.act_id").alias("duplicate_of"), F.coalesce("n", F.lit(0)).cast("bigint").alias("variants"))
