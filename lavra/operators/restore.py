"""Restore of a whole archive: documents, their acts in every state, links between acts, blobs, legacy parts, warnings.

An archive is a dict of tables: docs(id string, ...), acts(doc_id string, state int, act_id string, duplicate_of
string, variants array<string>, ...), where state is null for the acts of today and a number for those of a
state of the history, and, if it has them, blobs(id string, data), legacy(...) and warnings(warning).

Ids of documents and acts get new names by two maps that are tables: one for each document and act, and one for each
act anywhere, so that links are rewritten by joins however many there are. A link takes the new name that its own
document gives, else the one given anywhere (by the last document, if several), else it stays.

Defined results: rows without id are told by store.violations and are not restored; null links stay null, null
variants are none; an archive without a table has no such rows; extra columns pass through, null where the other
side lacks them; both inputs are left as they are."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.operators.store import COPY, KEEP, REPLACE

_ACT = ["doc_id", "state", "act_id"]


def _named(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("#", *parts), 256), 1, 16)


def _both(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
    return a.unionByName(b, allowMissingColumns=True) if a is not None and b is not None else a if b is None else b


def document_names(local: DataFrame, incoming: DataFrame, policy: str, run: str) -> DataFrame:
    """Documents that come in: id, new (their name here), here (whether the archive has that id)."""
    here = local.select("id", F.lit(True).alias("here")).distinct()
    both = incoming.select("id").filter("id is not null").distinct().join(here, "id", "left").withColumn("here", F.coalesce("here", F.lit(False)))
    if policy == KEEP:
        return both.filter("not here").withColumn("new", F.col("id"))
    return both.withColumn("new", F.when(F.col("here") & (F.lit(policy) == COPY), _named(F.col("id"), F.lit(run))).otherwise(F.col("id")))


def act_names(retained: DataFrame, incoming: DataFrame, docs: DataFrame, run: str) -> DataFrame:
    """doc_id, act_id, new of every act that comes in. An act keeps its name if its document does, no act that stays
    has it, and no document before its own brings it."""
    occupied = retained.select("act_id").distinct().withColumn("occupied", F.lit(True))
    each = incoming.select("doc_id", "act_id").distinct().join(docs.select(F.col("id").alias("doc_id"), F.col("new").alias("doc_new")), "doc_id")
    first = each.groupBy("act_id").agg(F.min("doc_id").alias("first"))
    told = each.join(first, "act_id").join(occupied, "act_id", "left")
    fresh = F.col("occupied").isNotNull() | (F.col("doc_new") != F.col("doc_id")) | (F.col("doc_id") != F.col("first"))
    return told.select("doc_id", "act_id", F.when(fresh, _named(F.col("doc_new"), F.col("act_id"), F.lit(run))).otherwise(F.col("act_id")).alias("new"))


def rewritten(acts: DataFrame, names: DataFrame) -> DataFrame:
    """acts with act_id, duplicate_of and variants by their new names; variants keep their order."""
    everywhere = names.groupBy(F.col("act_id").alias("ref")).agg(F.max_by("new", "doc_id").alias("anywhere"))
    own = names.select("doc_id", F.col("act_id").alias("ref"), F.col("new").alias("own"))
    ref = lambda at, x: F.struct(at.cast("int").alias("at"), x.alias("ref"))
    refs = F.concat(F.array(ref(F.lit(-1), F.col("duplicate_of"))), F.transform(F.coalesce("variants", F.array().cast("array<string>")), lambda x, i: ref(i, x)))
    row = acts.withColumn("row__", F.struct(*_ACT))
    each = row.select("row__", "doc_id", F.inline(refs)).filter("ref is not null").join(own, ["doc_id", "ref"], "left").join(everywhere, "ref", "left")
    renamed = each.select("row__", "at", F.coalesce("own", "anywhere", "ref").alias("to"))
    listed = renamed.groupBy("row__").agg(
        F.max(F.when(F.col("at") == -1, F.col("to"))).alias("duplicate__"), F.transform(F.array_sort(F.collect_list(F.when(F.col("at") >= 0, F.struct("at", "to")))), lambda x: x["to"]).alias("variants__")
    )
    met = row.join(listed, "row__", "left").join(names, ["doc_id", "act_id"])
    return met.withColumns({"act_id": F.col("new"), "duplicate_of": F.col("duplicate__"), "variants": F.coalesce("variants__", F.array().cast("array<string>"))}).select(acts.columns)


def restore(local: dict[str, DataFrame], incoming: dict[str, DataFrame], policy: str, run: str | None = None) -> dict[str, DataFrame]:
    """The archive after a restore. keep: documents that are here stay; replace: those that come take the place of
    those of their id; copy: both are there, and what comes gets new names made of the old ones and `run`, which is
    to be another one in each restore (and is, unless given)."""
    if policy not in (KEEP, COPY, REPLACE):
        raise ValueError(f"unknown policy: {policy}")
    run = run or uuid.uuid4().hex
    docs = document_names(local["docs"], incoming["docs"], policy, run)
    gone = docs.filter("here").select("id")
    stays = lambda t, key: t.join(gone.withColumnRenamed("id", key), key, "left_anti") if policy == REPLACE else t
    comes = lambda t, key: t.join(docs.select(F.col("id").alias(key), F.col("new").alias("new__")), key).withColumn(key, F.col("new__")).drop("new__")
    out = {"docs": _both(stays(local["docs"], "id"), comes(incoming["docs"], "id").select(incoming["docs"].columns))}
    kept = stays(local["acts"], "doc_id")
    named = act_names(kept, incoming["acts"], docs, run)
    out["acts"] = _both(kept, comes(rewritten(incoming["acts"], named), "doc_id").select(incoming["acts"].columns))
    old = stays(local["blobs"], "id") if "blobs" in local else None
    new = comes(incoming["blobs"], "id").select(incoming["blobs"].columns) if "blobs" in incoming else None
    if (blobs := _both(old, new)) is not None:
        out["blobs"] = blobs
    for part in ("legacy", "warnings"):  # parts saved long ago add up, and never replace each other
        if (both := _both(local.get(part), incoming.get(part))) is not None:
            out[part] = both.distinct() if part == "warnings" else both
    return out


def dangling(acts: DataFrame) -> DataFrame:
    """doc_id, act_id, ref of links to acts that are nowhere."""
    refs = F.array_compact(F.concat(F.array("duplicate_of"), F.coalesce("variants", F.array().cast("array<string>"))))
    return acts.select("doc_id", "act_id", F.explode(refs).alias("ref")).join(acts.select(F.col("act_id").alias("ref")).distinct(), "ref", "left_anti")


def repeated_acts(acts: DataFrame) -> DataFrame:
    """act_ids that several documents have, or one document twice in one state."""
    each = acts.groupBy("act_id", "doc_id").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("state", F.lit(-1))).alias("states"))
    return each.groupBy("act_id").agg(F.count("*").alias("docs"), F.max(F.col("n") - F.col("states")).alias("twice")).filter("docs > 1 or twice > 0").select("act_id")
