"""The store and the ingest: batches that equal one run, checkpoints, crashes, writers that meet."""

import os

import pytest
from pyspark.sql import functions as F

from lavra.operators import classify as C
from lavra.operators import linking as K
from lavra.operators import segment as G
from lavra.sources import archive, fixtures, snapshots
from lavra.streaming import ingest

DATA = "/root/testdata/sf0.001"


def linked(df):
    return sorted((r.doc_id, r.ord, r.duplicate_of, sorted(r.variants)) for r in df.collect())


def written(folder):
    return {f"{top}/{n}" for top, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def test_three_batches_equal_one_run(spark, tmp_path):
    """Batches in an order that is not that of doc_ids, one of them with copies of what came before."""
    docs = archive.documents(spark, DATA).filter("doc_id <= 24").select("doc_id", "filename", "reading")
    copies = docs.filter("doc_id % 7 = 0").withColumn("doc_id", F.col("doc_id") + 1000)
    batches = [docs.filter("doc_id % 3 = 2"), docs.filter("doc_id % 3 = 0").unionByName(copies), docs.filter("doc_id % 3 = 1")]
    store, sizes = str(tmp_path / "store"), []
    for k, b in enumerate(batches):
        before = {f: os.path.getmtime(f) for f in written(store)}
        assert ingest.take(b, store, f"q/{k}") == k + 1
        assert all(os.path.getmtime(f) == t for f, t in before.items()) and set(before) <= written(store)
        sizes.append(snapshots.read(spark, store, "acts").count())
    assert ingest.take(batches[1], store, "q/1") == 3  # came again
    whole = C.classified(G.acts(docs.unionByName(copies)))
    assert sizes[-1] == whole.count()
    got = linked(ingest.links(spark, store))
    assert got == linked(K.act_links(whole)) and any(g[2] for g in got) and any(g[3] for g in got)
    tiny = spark.createDataFrame([(5000, "x.md", "DESPACHO\n\nUm texto diferente de todos, com palavras próprias.")], ingest.SCHEMA)
    before = written(store)
    ingest.take(tiny, store, "q/3")
    new = written(store) - before
    assert sum(map(os.path.getsize, new)) < sum(map(os.path.getsize, before)) / 4
    ingest.take(tiny.limit(0), store, "q/4")
    ingest.take(tiny.withColumn("reading", F.lit(" \n")), store, "q/5")
    assert snapshots.version(spark, store) == 4
    assert snapshots.compact(spark, store, "members", 4) == 5 and len(snapshots.folders(spark, store, "members", 5)) == 1
    assert linked(ingest.links(spark, store, 5)) == linked(ingest.links(spark, store, 4))


def test_a_new_checkpoint_takes_its_batches(spark, tmp_path):
    docs = fixtures.documents(spark).select("doc_id", "filename", "reading")
    docs.filter("doc_id <= 4").write.parquet(str(tmp_path / "one"))
    docs.filter("doc_id > 4").write.parquet(str(tmp_path / "two"))
    store = str(tmp_path / "store")
    for name in ("one", "two", "one"):
        ingest.ingest(spark, str(tmp_path / name), store, str(tmp_path / f"check-{name}")).awaitTermination()
    assert snapshots.read(spark, store, "acts").count() == 14


def test_a_crash_before_the_rename_leaves_the_version(spark, tmp_path):
    path = str(tmp_path / "s")
    snapshots.write(spark, path, {"t": spark.range(3)}, 0, "first")
    (tmp_path / "s" / "commits" / "_half").write_text("t\tnowhere\n")
    assert snapshots.version(spark, path) == 1 and snapshots.read(spark, path, "t").count() == 3
    assert snapshots.append(spark, path, {"t": spark.range(2), "u": spark.range(1)}, 1, "second") == 2
    assert snapshots.read(spark, path, "t").count() == 5 and snapshots.notes(spark, path, 2) == {"first", "second"}
    assert snapshots.write(spark, path, {"t": spark.range(1)}, 2) == 3 and snapshots.notes(spark, path, 3) == set()
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path, "u")


def test_two_writers(spark, tmp_path, monkeypatch):
    """The second finds its number taken at the rename, though it was free when it looked; then it is latched."""
    path = str(tmp_path / "s")
    snapshots.write(spark, path, {"t": spark.range(3)}, 0)
    one, two = snapshots.Writer(spark, path), snapshots.Writer(spark, path)
    assert one.put({"t": spark.range(4)}) == 2
    with monkeypatch.context() as m:
        m.setattr(snapshots, "version", lambda *a: 1)
        with pytest.raises(snapshots.Conflict):
            two.put({"t": spark.range(9)})
    with pytest.raises(snapshots.Failed):
        two.put({"t": spark.range(9)})
    assert snapshots.read(spark, path, "t").count() == 4
    assert not [f for f in os.listdir(f"{path}/commits") if f.startswith("_")]
    assert two.retry() == 2 and two.put({"t": spark.range(1)}, replace=False) == 3
    assert snapshots.read(spark, path, "t").count() == 5
