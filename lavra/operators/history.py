"""The history of documents as rows: acts(doc_id, state, ...) hold the acts of today where state is null, and those of
earlier states, numbered upwards. A change puts today's acts behind; an undo takes the last state back.

Defined results: documents that are not named keep all their rows; an undo of a document without history changes
nothing; documents that a change names for the first time get no state behind; rows without doc_id stay as they are; a
state is the rows of its number, so that a state without acts leaves none; repeated names count once; other columns
pass through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States that are kept behind today's.
MOST = 12


def _last(acts: DataFrame, names: DataFrame) -> DataFrame:
    """acts with `named__` (whether the document is) and `last__`, its greatest state."""
    last = acts.groupBy("doc_id").agg(F.max("state").alias("last__"))
    named = names.select("doc_id").distinct().withColumn("named__", F.lit(True))
    return acts.join(last, "doc_id", "left").join(named, "doc_id", "left").withColumn("named__", F.coalesce("named__", F.lit(False)))


def push(acts: DataFrame, changed: DataFrame, most: int = MOST) -> DataFrame:
    """acts after changes: changed(doc_id, ...) are all acts of the changed documents from now on; what was today's becomes
    their last state, and only the last `most` states stay."""
    told = _last(acts, changed)
    next_ = F.coalesce(F.col("last__"), F.lit(-1)) + 1
    moved = told.withColumn("state", F.when(F.col("named__") & F.col("state").isNull(), next_).otherwise(F.col("state")))
    kept = moved.filter(~F.col("named__") | (F.col("state") > next_ - most))
    return kept.select(acts.columns).unionByName(changed.withColumn("state", F.lit(None).cast("int")).select(acts.columns))


def undo(acts: DataFrame, names: DataFrame) -> DataFrame:
    """acts after the last change of the documents names(doc_id) is taken back: their last state is today's again, and
    what was today's is gone."""
    told = _last(acts, names)
    back = F.col("named__") & F.col("last__").isNotNull()
    kept = told.filter(~(back & F.col("state").isNull()))
    return kept.withColumn("state", F.when(back & (F.col("state") == F.col("last__")), None).otherwise(F.col("state"))).select(acts.columns)


def version(acts: DataFrame, back: int) -> DataFrame:
    """acts as they were `back` changes ago (0: today's); documents with fewer states behind them are left out."""
    if back == 0:
        return acts.filter("state is null")
    last = acts.groupBy("doc_id").agg(F.max("state").alias("last__"))
    return acts.join(last, "doc_id").filter(F.col("state") == F.col("last__") - (back - 1)).select(acts.columns)
