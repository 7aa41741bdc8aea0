"""Changes of acts, restore, versions of the store and streaming ingest on small fixtures, odd rows among them."""

import pytest
from pyspark.sql import functions as F

from lavra.operators import classify as C
from lavra.operators import layout as L
from lavra.operators import masking as M
from lavra.operators import records as D
from lavra.operators import segment as G
from lavra.operators import store as B
from lavra.sources import fixtures, snapshots
from lavra.streaming import ingest

P1, P2 = "0600001-23.2026.6.14.0002", "0600005-94.2025.6.14.0002"
ACT = "doc_id bigint, filename string, ord int, act_id string, title string, text string, pages array<int>"


def acts(spark, *texts):
    return spark.createDataFrame([(1, "a.md", i + 1, f"1-{i + 1}", "DESPACHO", t, [i + 1]) for i, t in enumerate(texts)], ACT)


def test_merge_warns_when_a_number_of_the_first_is_missing(spark):
    for left, right, warned in ((f"{P1} {P2}", P1, True), (P1, f"{P1} {P2}", False), ("sem", P1, False)):
        got = D.merge_acts(C.classified(acts(spark, left, right)), spark.createDataFrame([("1-1",), ("nenhum",)], "act_id string")).collect()
        assert len(got) == 1 and got[0]["warning"] == warned and got[0]["pages"] == [1, 2] and got[0]["text"] == f"{left}\n\n{right}"
    last = D.merge_acts(C.classified(acts(spark, P1)), spark.createDataFrame([("1-1",)], "act_id string")).first()
    assert last["text"] == P1 and last["warning"] is False


def test_split_classifies_both_halves_anew(spark):
    base = acts(spark, f"Processo {P1}\n\nDESPACHO\nContas de campanha das eleições 2024.", "um só parágrafo", None)
    got = {r["act_id"]: r for r in D.split_acts(base, spark.createDataFrame([("1-1", 1), ("1-2", 1), ("1-3", 0)], "act_id string, k int")).collect()}
    assert sorted(got) == ["1-1", "1-1-b1", "1-2", "1-3"]
    right = got["1-1-b1"]
    assert (right["title"], right["classe"], right["eleicao"], right["cnj"], right["pages"]) == ("DESPACHO", "prestação de contas eleitorais", "2024", [], [1])
    assert got["1-1"]["cnj"] == [P1] and got["1-1"]["eleicao"] == "[NÃO IDENTIFICADO]"


def test_classification_of_odd_rows(spark):
    odd = spark.createDataFrame([(1, "a.md", 1, "x", None, None, None, "z"), (1, "a.md", 1, "x", None, None, None, "z"), (2, None, 1, "y", "SENTENÇA", "", [], "z")], ACT + ", blob string")
    got = D.findings(D.templates(C.evidence(C.classified(odd)))).collect()
    assert len(got) >= 3 and C.classified(odd).filter("tipo = 'SENTENÇA'").count() == 1
    assert C.evidence(C.classified(odd.limit(0))).count() == 0


def test_repeated_line(spark):
    long = "linha que se repete muitas vezes no mesmo texto do ato"
    text = "\n".join(["outra linha comprida que aparece uma vez só neste texto", long, "x", long, long, "y" * 50, "y" * 50, "y" * 50, "y" * 50])
    got = spark.createDataFrame([(text,), ("curta\ncurta\ncurta",), (None,)], "t string").select(D.repeated_line(F.col("t")).alias("r")).collect()
    assert (got[0]["r"]["line"], got[0]["r"]["n"]) == (long, 3) and got[1]["r"] is None and got[2]["r"] is None


def test_quality_strings(spark):
    text = "texto sem marca |\n| a | b |\n| c |\n" + "¿" * 60
    got = M.quality_docs(G.page_slices(spark.createDataFrame([(1, "a", text)], "doc_id int, filename string, reading string")).withColumn("columns_detected", F.lit(True))).first()
    assert got["pages_processed"] is None and got["damaged_tables"] == ["texto sem página: tabela com colunas irregulares"] and not got["integral"]
    assert got["risks"] == ["texto sem página: possível leitura em colunas"]


def test_a_damaged_backup_is_told(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", None)], "id string, reading string")
    blobs = spark.createDataFrame([("a", bytearray(b"%PDF-1\n\x00\xff"))], "id string, data binary")
    entries = B.backup(docs, blobs)
    assert {r["kind"]: bytes(r["data"]) for r in B.read_backup(entries).collect() if r["kind"] == "blob"} == {"blob": b"%PDF-1\n\x00\xff"}
    with pytest.raises(Exception, match="damaged entry"):
        B.read_backup(entries.withColumn("payload", F.when(F.col("kind") == "blob", "AAAA").otherwise(F.col("payload")))).collect()
    with pytest.raises(Exception, match="no blob for b"):
        B.blobs_of(docs, blobs, blobs).collect()
    one, two = B.envelope(entries).first(), B.envelope(entries.withColumn("sha256", F.lit("0"))).first()
    assert (one["docs"], one["blobs"]) == (2, 1) and one["digest"] != two["digest"]


def test_versions_of_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert snapshots.version(spark, path) == 0
    assert snapshots.write(spark, path, {"docs": spark.range(3)}, 0) == 1
    assert snapshots.write(spark, path, {"docs": spark.range(5)}, 1) == 2
    with pytest.raises(snapshots.Conflict):
        snapshots.write(spark, path, {"docs": spark.range(9)}, 1)
    assert snapshots.read(spark, path, "docs").count() == 5 and snapshots.read(spark, path, "docs", 1).count() == 3


def test_streaming_ingest_links_new_documents_with_all(spark, tmp_path):
    folder, store, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    docs = fixtures.documents(spark).select("doc_id", "filename", "reading")
    docs.filter("doc_id <= 4").write.parquet(folder)
    ingest.ingest(spark, folder, store, check).awaitTermination()
    assert snapshots.read(spark, store, "acts").count() == 7
    docs.filter("doc_id > 4").write.mode("append").parquet(folder)
    ingest.ingest(spark, folder, store, check).awaitTermination()
    assert snapshots.read(spark, store, "acts").count() == 14
    links = ingest.links(spark, store).filter("duplicate_of is not null").collect()
    assert {(r["doc_id"], r["duplicate_of"]) for r in links} == {(8, "1-1"), (9, "9-1")}
