"""A backup that is sealed: its entries (store.backup), and a manifest with counts and a digest over all of them.

The digest is the root of a hash tree. An entry's place in the tree is a hash of its kind and id, so that nodes are of
near equal size; a leaf's digest covers kind, id, length and the digest of what was packed, and a node's the
sorted digests below it. Each level is one aggregation over nodes of about `WIDTH` members, so that no task sees more
than its share of entries, and equal entries in any order give equal roots.

`unseal` packs out, works every digest out again and refuses a backup in which one byte of a text, a state, a blob or
the manifest has changed, an entry is missing, or one is there twice. An empty backup has a digest too."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.operators.store import FORMAT, VERSION

WIDTH = 64
_FAN = 16  # children of a node: the next hexadecimal digit of a place


class Broken(Exception):
    """A backup that is not what was sealed."""


def _leaf(sha256: Column, size: Column) -> Column:
    return F.sha2(F.to_json(F.struct("kind", "id", size.alias("bytes"), sha256.alias("sha256"))), 256)


def levels(n: int) -> int:
    """Digits of a place by which n entries fall into groups of about WIDTH."""
    d = 0
    while n > WIDTH * _FAN**d:
        d += 1
    return d


def root(leaves: DataFrame, d: int) -> str:
    """Digest over leaves(kind, id, leaf) by a tree of d digits of a place."""
    node = leaves.select(F.substring(F.sha2(F.to_json(F.struct("kind", "id")), 256), 1, d).alias("place"), F.col("leaf").alias("digest"))
    for depth in range(d, -1, -1):
        node = node.groupBy(F.substring("place", 1, depth).alias("place")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ","), 256).alias("digest"))
    top = node.first()
    return top["digest"] if top else ""


def manifest(entries: DataFrame, depth: Callable[[int], int] = levels) -> dict:
    """Counts, bytes and digest of entries(kind, id, payload, bytes, sha256), by their stated digests. depth: digits of a
    place for so many entries; a fixed depth makes groups that grow with the entries."""
    counts = entries.agg(F.count_if(F.col("kind") == "doc").alias("docs"), F.count_if(F.col("kind") == "blob").alias("blobs"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    digest = root(entries.select("kind", "id", _leaf(F.col("sha256"), F.col("bytes")).alias("leaf")), depth(counts["docs"] + counts["blobs"]))
    return {"format": FORMAT, "version": VERSION, "docs": counts["docs"], "blobs": counts["blobs"], "bytes": int(counts["bytes"]), "digest": digest}


def seal(entries: DataFrame, path: str) -> dict:
    """Write entries and manifest under a path that does not exist yet; gives the manifest, written last."""
    spark = entries.sparkSession
    entries.write.parquet(f"{path}/entries")
    told = manifest(spark.read.parquet(f"{path}/entries"))
    spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return told


def unseal(spark: SparkSession, path: str) -> DataFrame:
    """kind, id, data of a sealed backup, or Broken."""
    try:
        told = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    except (ValueError, TypeError) as e:
        raise Broken("the manifest cannot be read") from e
    if (told.get("format"), told.get("version")) != (FORMAT, VERSION):
        raise Broken("another format or version")
    entries = spark.read.parquet(f"{path}/entries")
    packed = entries.withColumn("data", F.try_to_binary("payload", F.lit("base64")))
    real = packed.withColumns({"bytes": F.coalesce(F.octet_length("data"), F.lit(-1)), "sha256": F.coalesce(F.sha2("data", 256), F.lit(""))})
    twice = entries.groupBy("kind", "id").agg(F.count("*").alias("n")).filter("n > 1 or id is null or kind not in ('doc', 'blob')")
    if not twice.isEmpty():
        raise Broken("an entry is there twice or has no name")
    if manifest(real) != told or not entries.join(real.select("kind", "id", "sha256", "bytes"), ["kind", "id", "sha256", "bytes"], "left_anti").isEmpty():
        raise Broken("contents or manifest have changed")
    return packed.select("kind", "id", "data")
