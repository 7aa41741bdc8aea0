"""Documents that arrive as files, taken into the versioned store batch by batch.

A batch is segmented, classified and linked with what the store holds, and is added to it in one commit; nothing
stored is read whole or written again (see operators.incremental). A commit notes the query and the batch, so that a
batch that comes again after a failure is passed over, while batches of another query, whose numbers begin at 0
again, are taken.

Rows with null or blank texts have no acts and leave no trace; an empty batch makes no commit; a document that
arrives twice is there twice (store.violations tells its doc_id), each a duplicate of the first."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lavra.operators import classify as C
from lavra.operators import incremental as I
from lavra.operators import segment as G
from lavra.sources import snapshots

SCHEMA = "doc_id bigint, filename string, reading string"


def arriving(spark: SparkSession, folder: str, schema: str = SCHEMA, most_files: int = 100) -> DataFrame:
    """A stream of Parquet files; the source keeps its own cursor, which only moves on."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def take(batch: DataFrame, store: str, note: str) -> int:
    """Add a batch of documents to a store, once for each note; gives the version in force after it."""
    spark = batch.sparkSession
    now = snapshots.version(spark, store)
    if note in snapshots.notes(spark, store, now):
        return now
    acts = C.classified(G.acts(batch)).persist()  # one batch, let go below
    try:
        if acts.isEmpty():
            return now
        begun = snapshots.folders(spark, store, "members", now)
        order = snapshots.read(spark, store, "ranks", now) if begun else I.ranks(acts)
        stored = {t: snapshots.read(spark, store, t, now) for t in I.TABLES} if begun else None
        added = I.add(acts, order, stored)
        return snapshots.append(spark, store, {"acts": acts, **added} | ({} if begun else {"ranks": order}), now, note)
    finally:
        acts.unpersist()


def links(spark: SparkSession, store: str, number: int | None = None) -> DataFrame:
    """Links of all acts of a store, resolved from its facts."""
    return I.links(snapshots.read(spark, store, "members", number), snapshots.read(spark, store, "pairs", number))


def _take(store: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    def one(batch: DataFrame, batch_id: int) -> None:
        told = batch.sparkSession.read.text(f"{checkpoint}/metadata", wholetext=True).first()["value"]
        take(batch, store, f"{json.loads(told)['id']}/{batch_id}")

    return one


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str) -> StreamingQuery:
    """Take in what the folder holds, then stop: new documents are segmented and classified, and linked with all
    others. A batch is one commit of the store; run again after a failure, it is taken in once."""
    stream = arriving(spark, folder).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return stream.foreachBatch(_take(store, checkpoint)).start()
