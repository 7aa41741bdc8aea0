"""A worker of Python outlives its tasks: what it keeps counts in the stages that come after."""

import os

import pytest
from pyspark.sql import functions as F

from lavra.llm import bpe


def most_held(spark):
    """MB of the largest worker itself, without mapped files."""

    def held(batches):
        import re

        import pyarrow as pa

        for _ in batches:
            with open("/proc/self/smaps_rollup") as f:
                kb = sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", f.read())))
            yield pa.RecordBatch.from_arrays([pa.array([kb // 1024], pa.int64())], ["mb"])

    return max(r.mb for r in spark.range(8).repartition(4).mapInArrow(held, "mb bigint").collect())


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_workers_hand_memory_back(spark):
    before = most_held(spark)
    words = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("w"), F.xxhash64("id", i).cast("string")))
    docs = spark.range(4_000).repartition(4).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    got = bpe.encode(docs, bpe.vocabulary_path(bpe.VOCABULARY), decoded=True)
    assert got.agg(F.count_if(F.size("token_ids") >= 300), F.count_if(F.length("decoded") > 0)).first()[:] == (4_000, 4_000)
    after = most_held(spark)
    assert after < before + 120, (before, after)
