"""The archive as a store: guards, backup and its check, restore by policy, identities, decisions.

Rows without id are found by `violations` and take part in nothing else; repeated rows are told there too; empty
tables give empty results; other columns pass through, those named as a result are replaced."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Name and version of a backup, states of a document.
FORMAT, VERSION = "acervo-backup", 1
KEEP, COPY, REPLACE = "keep", "copy", "replace"


def keepable(docs: DataFrame) -> DataFrame:
    """docs that are no examples."""
    return docs.filter(~F.coalesce("example", F.lit(False)))


def should_write(docs: DataFrame) -> DataFrame:
    """One row: whether the archive is to be written: it holds something to keep, or no example."""
    example = F.coalesce("example", F.lit(False))
    return docs.agg(((F.count_if(~example) > 0) | (F.count_if(example) == 0)).alias("write"))


def blobs_of(docs: DataFrame, given: DataFrame, stored: DataFrame) -> DataFrame:
    """docs(id) with the blob given for them, else the stored one; a document without either is an error."""
    both = docs.select("id").join(given.select("id", F.col("data").alias("new__")), "id", "left").join(stored.select("id", F.col("data").alias("old__")), "id", "left")
    missing = F.raise_error(F.concat(F.lit("no blob for "), F.col("id").cast("string")))
    return both.select("id", F.coalesce("new__", "old__", missing.cast("binary")).alias("data"))


def missing_blobs(docs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Ids of documents that name a blob and have none."""
    return docs.filter("has_blob").select("id").join(blobs, "id", "left_anti")


def orphan_blobs(docs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Ids of blobs without a document."""
    return blobs.select("id").join(docs, "id", "left_anti")


def backup(docs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Entries of a backup: kind (doc or blob), id, payload (base64), bytes and sha256 of what was packed."""
    state = F.to_json(F.struct(*sorted(docs.columns)))
    doc = docs.select(F.lit("doc").alias("kind"), F.col("id").cast("string").alias("id"), F.encode(state, "UTF-8").alias("data"))
    both = doc.unionByName(blobs.select(F.lit("blob").alias("kind"), F.col("id").cast("string").alias("id"), "data"))
    return both.select("kind", "id", F.regexp_replace(F.base64("data"), "\\s", "").alias("payload"), F.octet_length("data").alias("bytes"), F.sha2("data", 256).alias("sha256"))


def envelope(entries: DataFrame) -> DataFrame:
    """One row: format, version, counts, bytes and a digest over the entries' digests (a sum of 48-bit parts, so that
    no task sees all entries)."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", "kind", "id", "sha256"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return entries.agg(
        F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.count_if(F.col("kind") == "doc").alias("docs"), F.count_if(F.col("kind") == "blob").alias("blobs"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"),
    )


def read_backup(entries: DataFrame) -> DataFrame:
    """The entries with their `data`; an entry whose bytes, length or digest do not fit is an error."""
    data = F.unbase64("payload")
    whole = (F.octet_length(data) == F.col("bytes")) & (F.sha2(data, 256) == F.col("sha256"))
    wrong = F.raise_error(F.concat(F.lit("damaged entry: "), "kind", F.lit(" "), "id"))
    return entries.select("kind", "id", F.when(F.coalesce(whole, F.lit(False)), data).otherwise(wrong.cast("binary")).alias("data"))


def violations(docs: DataFrame, acts: DataFrame, blobs: DataFrame) -> DataFrame:
    """What is wrong with a snapshot: problem and id. docs(id, filename, has_blob), acts(id, doc_id, review, pages)."""
    told = lambda rows, problem, key="id": rows.select(F.lit(problem).alias("problem"), F.col(key).cast("string").alias("id"))
    many = lambda rows: rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 and id is not null")
    checks = [
        told(docs.filter("id is null"), "document without id", "filename"), told(docs.filter("filename is null or filename = ''"), "document without name"),
        told(many(docs), "document id not unique"), told(many(acts), "act id not unique"), told(acts.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_anti"), "act without document"),
        told(acts.filter(~F.coalesce(F.col("review").isin("pendente", "revisada"), F.lit(False))), "unknown review state"), told(acts.filter(F.exists("pages", lambda p: p < 1)), "page below 1"),
        told(missing_blobs(docs, blobs), "blob missing"), told(orphan_blobs(docs, blobs), "blob without document"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def preview(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: documents that come, how many of them are here already, how many are new."""
    here = local.select("id", F.lit(1).alias("here__")).distinct()
    return incoming.select("id").join(here, "id", "left").agg(F.count("*").alias("incoming"), F.count("here__").alias("conflicts"), (F.count("*") - F.count("here__")).alias("fresh"))


def new_id(old: Column, turn: Column) -> Column:
    """The id of a copy: a digest of the old one and a number, the same on every run."""
    return F.substring(F.sha2(F.concat_ws("#", old.cast("string"), turn.cast("string")), 256), 1, 16)


def plan_restore(local: DataFrame, incoming: DataFrame, policy: str, run: str | None = None) -> DataFrame:
    """Documents after a restore, with `old_id` (what an incoming one was called) and `origin` (local or incoming).
    keep: what is here stays; replace: what comes wins; copy: both stay, and what comes gets a new id made of the old
    one and `run`, another one in each restore unless given. restore.restore takes acts and links along."""
    if policy not in (KEEP, COPY, REPLACE):
        raise ValueError(f"unknown policy: {policy}")
    mine = local.drop("old_id", "origin").withColumn("old_id", F.col("id").cast("string")).withColumn("origin", F.lit("local"))
    theirs = incoming.drop("old_id", "origin").withColumn("old_id", F.col("id").cast("string")).withColumn("origin", F.lit("incoming"))
    if policy == KEEP:
        return mine.unionByName(theirs.join(local.select("id"), "id", "left_anti"))
    if policy == REPLACE:
        return mine.join(incoming.select("id"), "id", "left_anti").unionByName(theirs)
    here = local.select("id", F.lit(True).alias("here__")).distinct()
    renamed = theirs.join(here, "id", "left").withColumn("id", F.when(F.col("here__"), new_id(F.col("old_id"), F.lit(run or uuid.uuid4().hex))).otherwise(F.col("old_id"))).drop("here__")
    return mine.withColumn("id", F.col("old_id")).unionByName(renamed.select(mine.columns))


def restore_blobs(local: DataFrame, incoming: DataFrame, plan: DataFrame) -> DataFrame:
    """Blobs after a restore: those of the plan's documents, from the side that the document is from."""
    names = plan.select("id", "old_id", "origin")
    side = lambda rows, origin: names.filter(F.col("origin") == origin).join(rows.select(F.col("id").cast("string").alias("old_id"), "data"), "old_id").select("id", "data")
    return side(local, "local").unionByName(side(incoming, "incoming"))


def union_newest_first(archive: DataFrame, new: DataFrame) -> DataFrame:
    """Archive with new documents before all others: columns id, ord, ...; new ones count down from the least ord."""
    first = archive.agg(F.coalesce(F.min("ord"), F.lit(0)).alias("first__"))  # one row
    order = Window.orderBy(F.col("ord").desc())  # the documents of one upload
    placed = new.withColumn("turn__", F.row_number().over(order)).crossJoin(F.broadcast(first)).withColumn("ord", (F.col("first__") - F.col("turn__")).cast("long")).drop("turn__", "first__")
    return archive.withColumn("ord", F.col("ord").cast("long")).unionByName(placed.select(archive.columns))


def id_collisions(docs: DataFrame) -> DataFrame:
    """Ids that several documents have."""
    return docs.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def migrate_identities(docs: DataFrame, order: str = "ord") -> DataFrame:
    """docs(id, ord, ...) with `new_id`, unique: the first document of an id keeps it, the others get one made of the
    id and their turn; `moved` tells them. Links follow by `linking.remap`."""
    turn = F.row_number().over(Window.partitionBy("id").orderBy(order))
    rows = docs.drop("new_id", "moved").withColumn("turn__", turn)
    fresh = F.when(F.col("turn__") == 1, F.col("id").cast("string")).otherwise(new_id(F.col("id"), F.col("turn__")))
    return rows.withColumn("new_id", fresh).withColumn("moved", F.col("turn__") > 1).drop("turn__")


def rekeyed(blobs: DataFrame, docs: DataFrame) -> DataFrame:
    """Blobs stored under old ids, by the ids of today: docs(id, old_id)."""
    names = docs.select(F.col("id").alias("new__"), F.col("old_id").alias("id"))
    return blobs.join(names, "id").select(F.col("new__").alias("id"), "data")


def decisions(items: DataFrame, log: DataFrame) -> DataFrame:
    """items(act_id, item, ...) with the latest `decision` of log(act_id, item, at, decision), null if there is none;
    texts stay as they are."""
    latest = log.groupBy("act_id", "item").agg(F.max_by("decision", "at").alias("decision"))
    return items.drop("decision").join(latest, ["act_id", "item"], "left")


def toggled(log: DataFrame) -> DataFrame:
    """Marks that are set: log(doc_id, page) with one row for each time a mark was put or taken away."""
    return log.groupBy("doc_id", "page").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("doc_id", "page")


def pending_migrations(known: DataFrame, done: DataFrame) -> DataFrame:
    """known(name) that done(name) lacks."""
    return known.join(done, "name", "left_anti")
