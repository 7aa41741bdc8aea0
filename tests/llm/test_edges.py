"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for all operators."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lavra.llm import registry

LONG = " ".join(f"w{i % 701}x{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [
    (5, None, None, None), (1, "", "en", "a"), (2, " \t\n", "en", "a"), (3, "one", None, "b"), (4, LONG, "en", "b"), (6, PASSAGE + " tail six", "en", None),
    (7, "head seven " + PASSAGE, "en", "c"), (8, PASSAGE + " tail six", "en", "c"), (8, PASSAGE + " tail six", "en", "c"), (None, "no id here at all", "en", "a"),
    (9, "Ünï çödé 🙂 " * 5, "fr", "a"), (10, "stupid <|endoftext|> idiot", "en", "a"),
]


def put(folder, texts):
    docs = pa.table(
        {
            "doc_id": pa.array([t[0] for t in texts], pa.int64()), "text": pa.array([t[1] for t in texts], pa.string()), "lang": pa.array([t[2] for t in texts], pa.string()),
            "source": pa.array([t[3] for t in texts], pa.string()), "n_chars": pa.array([len(t[1] or "") for t in texts], pa.int64()),
            **{c: pa.array([1] * len(texts), pa.int64()) for c in ("size", "keep", "h", "id", "target", "n_words", "label", "quality_score", "token_ids", "score", "cell")},
        }
    )
    pq.write_table(docs, f"{folder}/documents.parquet")
    some = texts != []
    labels = {"doc_id": pa.array([1, 4, 10, None, 99] if some else [], pa.int64()), "quality": pa.array([1, 1, 0, 0, None] if some else [], pa.int32()), "toxic": pa.array([0, 0, 1, 0, None] if some else [], pa.int32())}
    pq.write_table(pa.table(labels), f"{folder}/labels.parquet")
    vectors = [[1.0, 2.0], [1.0, 2.0], None, [float("nan"), 1.0], [None, 1.0], [float("inf"), 0.0], [-3.0, 0.5], [1.0, 2.0]] if some else []
    ids = [0, 1, 2, 3, 4, 5, 50, 1] if some else []
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())}), f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return put(tmp_path_factory.mktemp("odd"), TEXTS)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return put(tmp_path_factory.mktemp("empty"), [])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd_rows(spark, odd, name):
    got = registry.QUERIES[name](spark, odd).toPandas()
    if name.startswith("op1_"):
        assert set(got.query_id) == {0, 50} and got.groupby("query_id").size().max() <= 5
        assert got[got.query_id == 0].vec_id.tolist() == [1, 1, 50]
    elif name.startswith(("op11_", "op12_")):  # reports on groups; their values on odd rows are in test_audits.py
        assert set(got["part" if name.startswith("op11_") else "source"]) == {"", "a", "b", "c"}
    else:
        assert len(got) == len(TEXTS)
        assert sorted(got.doc_id.dropna()) == sorted(t[0] for t in TEXTS if t[0] is not None)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() == 0


def test_pipeline_on_odd_rows(spark, odd, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, odd).count() >= 0  # the classifier rejects texts without sentences
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_values(spark, odd):
    q = registry.QUERIES
    near = q["op6_bagminhash"](spark, odd).toPandas().set_index("doc_id")
    assert near.loc[8].class_id.tolist() == [6, 6] and near.loc[6].keep == 1 and near.loc[1].class_id == near.loc[2].class_id == near.loc[5].class_id == 1
    cut = q["op8_prefix_subtrees"](spark, odd).toPandas().set_index("doc_id")
    assert cut.loc[7].n_removed == 60 and cut.loc[6].n_removed == 0 and cut.loc[8].n_removed.tolist() == [62, 62]
    shards = q["op3_virtual_slots"](spark, odd).toPandas()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in shards.groupby("shard"))
    prints = q["op4_weighted_samples"](spark, odd).toPandas().set_index("doc_id")
    assert prints.loc[1].fingerprint == prints.loc[5].fingerprint == "-" and prints.loc[6].fingerprint == prints.loc[8].fingerprint.iloc[0]


def test_stars_join_what_the_edges_join(spark):
    from lavra.llm import minhash

    # forty nodes that share twelve neighbours, and two that share one of them or none
    edges = [(100 + i, j) for i in range(40) for j in range(12)] + [(200, 11), (200, 50), (300, 60)]
    df = spark.createDataFrame(edges, "a long, b long")
    few = minhash.stars(df)
    assert few.count() == 40 + 11 + 2 + 1 < len(edges)
    want = {r.node: r.label for r in minhash.components(df).collect()}
    assert {r.node: r.label for r in minhash.components(few).collect()} == want and want[50] == 0 and want[300] == 60
