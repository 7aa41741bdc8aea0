"""Restore of acts with their links, blobs and legacy parts."""

import pytest

from lavra.operators import restore as V

ACTS = "doc_id string, state int, act_id string, duplicate_of string, variants array<string>"


def archive(spark, acts, **more):
    docs = sorted({a[0] for a in acts})
    tables = {"docs": spark.createDataFrame([(d, f"{d}.md") for d in docs], "id string, filename string"), "acts": spark.createDataFrame(acts, ACTS)}
    return tables | {k: spark.createDataFrame(rows, schema) for k, (rows, schema) in more.items()}


@pytest.fixture
def base(spark):
    acts = [
        ("d1", None, "d1-1", None, ["d2-1"]), ("d1", None, "d1-2", "d1-1", []), ("d1", 0, "d1-1", None, None), ("d1", 0, "old", "d1-1", ["d1-1", "d2-1"]),
        ("d2", None, "d2-1", "d1-2", ["d1-1", "old"]), ("d2", 0, "d2-1", None, []),
    ]
    return archive(spark, acts, blobs=([("d1", b"%PDF"), ("d2", b"\x00\xff")], "id string, data binary"), legacy=([(1, "x")], "part int, body string"), warnings=([("w",)], "warning string"))


def test_copy_onto_itself_twice(spark, base):
    """No act id twice, no link to nowhere, and nothing that was there is touched."""
    once = V.restore(base, base, V.COPY)
    twice = V.restore(once, base, V.COPY)
    for archive_, docs in ((once, 4), (twice, 6)):
        assert archive_["docs"].count() == archive_["docs"].select("id").distinct().count() == docs
        assert V.repeated_acts(archive_["acts"]).count() == 0 and V.dangling(archive_["acts"]).count() == 0
        assert archive_["acts"].count() == 3 * docs and archive_["blobs"].count() == docs
    kept = {tuple(r[:4]) for r in base["acts"].collect()}
    assert kept <= {tuple(r[:4]) for r in twice["acts"].collect()}
    assert twice["legacy"].count() == 3 and twice["warnings"].count() == 1
    copy = next(r for r in once["acts"].collect() if r.doc_id not in ("d1", "d2") and r.state is None and len(r.variants) == 2)
    names = {r.act_id: r for r in once["acts"].collect()}
    assert [names[v].state for v in copy.variants] == [None, 0] or [names[v].doc_id for v in copy.variants] == [names[copy.duplicate_of].doc_id] * 2


def test_an_act_id_that_another_document_has(spark, base):
    """A new document brings ids that are taken, and that two new documents share; each links to its own."""
    new = archive(spark, [("n1", None, "d1-1", None, []), ("n1", None, "n-2", "d1-1", ["s"]), ("n1", None, "s", None, []), ("n2", None, "s", None, []), ("n2", None, "n2-2", "s", ["d1-1", "elsewhere"])])
    got = V.restore(base, new, V.KEEP, "r")["acts"].collect()
    n1 = {r.act_id: r for r in got if r.doc_id == "n1"}
    n2 = {r.act_id: r for r in got if r.doc_id == "n2"}
    renamed = next(a for a in n1 if a not in ("n-2", "s"))
    assert renamed != "d1-1" and n1["n-2"].duplicate_of == renamed and n1["n-2"].variants == ["s"]
    other = next(a for a in n2 if a != "n2-2")
    assert other != "s" and n2["n2-2"].duplicate_of == other and n2["n2-2"].variants == [renamed, "elsewhere"]


def test_replace_and_keep(spark, base):
    new = archive(spark, [("d1", None, "d1-1", None, []), ("d3", None, "d3-1", "d1-1", [])], blobs=([("d1", b"new"), ("d3", b"3")], "id string, data binary"))
    put = V.restore(base, new, V.REPLACE)
    assert sorted((r.doc_id, r.act_id) for r in put["acts"].collect() if r.doc_id != "d2") == [("d1", "d1-1"), ("d3", "d3-1")]
    assert {r.id: bytes(r.data) for r in put["blobs"].collect()} == {"d1": b"new", "d2": b"\x00\xff", "d3": b"3"}
    keep = V.restore(base, new, V.KEEP)
    assert keep["acts"].filter("doc_id = 'd1'").count() == 4 and {r.id: bytes(r.data) for r in keep["blobs"].collect()}["d1"] == b"%PDF"
    empty = V.restore(base, {k: t.limit(0) for k, t in new.items()}, V.COPY)
    assert empty["acts"].count() == 6 and empty["legacy"].count() == 1
    with pytest.raises(ValueError):
        V.restore(base, new, "other")
