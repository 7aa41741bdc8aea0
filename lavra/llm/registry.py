"""Queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, filter_audit, fingerprints, knn, licenses, minhash, mixing, quality, sharding, source_audit, substrings, token_files, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        knn.op1_voronoi_knn,
        token_files.op2_hash_indexed_ids,
        sharding.op3_virtual_slots,
        fingerprints.op4_weighted_samples,
        quality.op5_weak_quality,
        minhash.op6_bagminhash,
        toxicity.op7_lexicon_toxicity,
        substrings.op8_prefix_subtrees,
        bpe.op9_numpy_bpe,
        mixing.op10_weighted_mix,
        filter_audit.op11_filter_audit,
        source_audit.op12_source_divergence,
        licenses.op13_license_scan,
    )
}
SQL = {**knn.SQL, **mixing.SQL, **substrings.SQL, **filter_audit.SQL, **source_audit.SQL, **licenses.SQL}
