"""The snippet of every document, against a version in plain Python."""

import re
import unicodedata

import pyarrow as pa
import pyarrow.parquet as pq

from lavra.plans import registry


def brute(text):
    plain = re.sub(r"\\([\\`*_{}\[\]#<>])", r"\1", re.sub(r"(^|\n)#{1,3}\s+", r"\1", text))
    clean = re.sub(r"\s+", " ", plain).strip(" ")
    flat = "".join(unicodedata.normalize("NFD", c)[0] for c in clean).lower()
    at = flat.find("cion")
    if at < 0:
        return clean[:180]
    start, stop = max(0, at - 64), min(len(clean), at + 4 + 96)
    return ("…" if start else "") + clean[start:stop] + ("…" if stop < len(clean) else "")


def test_every_document_has_its_snippet(spark, tmp_path):
    long = "palavra " * 40
    texts = [long + "ACCION final", long + "la Ción " + long, "social e cidade " + long, long, "# acción\n\nde hoje", "", None]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    got = {r.doc_id: r.snippet for r in registry.QUERIES["search_snippet"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else brute(t) for i, t in enumerate(texts)}
    assert "CION" in got[0] and "Ción" in got[1]


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r.snippet for r in registry.QUERIES["search_snippet"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs}
