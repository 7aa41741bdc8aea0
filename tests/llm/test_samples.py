"""Accuracy of the fingerprints of op4_weighted_samples against exact similarity."""

import collections
import re

import numpy as np

from lavra.llm import fingerprints, registry

DATA = "/root/testdata/sf0.001"


def test_samples_tell_likenesses_apart(spark):
    assert fingerprints.SAMPLES >= 32
    got = registry.QUERIES["op4_weighted_samples"](spark, DATA).toPandas()
    assert (got.fingerprint.str.len() == 4 * fingerprints.SAMPLES).all()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id", ascending=False).reset_index(drop=True)
    bags = [collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in docs.text]
    near = got.set_index("doc_id").near_next
    exact = [sum((a & b).values()) / max(1, sum((a | b).values())) for a, b in zip(bags, bags[1:] + bags[:1], strict=True)]
    errors = near.loc[docs.doc_id].to_numpy() - np.array(exact)
    # 1 / (2 sqrt(32)) is the greatest standard error of 32 samples
    assert abs(errors.mean()) < 0.04 and errors.std() < 0.0884
