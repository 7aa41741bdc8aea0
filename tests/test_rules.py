"""Single cases of the rules of lines, templates and links."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lavra.operators import layout as L
from lavra.operators import linking as K
from lavra.operators import masking as M
from lavra.plans import registry


def each(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]


def test_hyphens(spark):
    cases = [("autos 0600001-", "23.2026", False), ("guarda-", "chuva e o mais", False), ("a apre-", "sentação da conta", False), ("jurisdi-", "ção eleitoral restante", True), ("sem hífen", "aqui", False), ("pala-", "vra", True)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    assert [r[0] for r in rows.orderBy("i").select(L.dehyphenate(F.col("a"), F.col("b"))).collect()] == [c[2] for c in cases]


def test_page_ranges(spark):
    cases = {("", 3): [1, 2, 3], ("1-3, 5", 9): [1, 2, 3, 5], ("3-1", 9): [1, 2, 3], ("9", 4): None, ("x", 4): None, ("8-9", 3): None, ("2–4", 3): [2, 3]}
    got = {(r.spec, r.total): r.pages for r in L.page_spec(spark.createDataFrame(list(cases), "spec string, total int")).collect()}
    assert got == cases


def test_lines(spark):
    assert each(spark, ["¿¿a b¿¿", "disse ¿sim¿ e", "¿aberto", "fim¿"], L.repair_quotes) == ["“a b”", "disse “sim” e", "“aberto", "fim”"]
    assert each(spark, ["1. item", "201. não", "a) letra", "• bala", "- traço", "texto"], lambda t: L.list_item(t)["kind"]) == ["ol", None, "ul", "ul", "ul", None]
    shapes = ["Classe: Recurso", "DIÁRIO DA JUSTIÇA", "Sumário ...... 3", "um texto comum."]
    assert [each(spark, shapes, f) for f in (L.is_field, L.is_rubric, L.is_leader)] == [[True, False, False, False], [False, True, False, False], [False, False, True, False]]
    assert each(spark, ["1.0", "1.28", "1.69", "1.7"], lambda t: L.heading_level(t.cast("double"))) == [3, 2, 2, 1]


def test_filled_templates(spark):
    templates = spark.createDataFrame([("a", "Processo [PROCESSO] em [DATA], [PROCESSO]", 1), ("b", "[DATA]", 2), ("c", None, 3)], "act_id string, template string, token int")
    fills = spark.createDataFrame([("a", "[PROCESSO]", "P1"), ("a", "[PROCESSO]", "P2"), ("a", "[DATA]", " "), ("b", "[DATA]", None), ("z", "[DATA]", "x"), (None, "[DATA]", "y")], "act_id string, token string, value string")
    got = {r.act_id: (r.template, r.token) for r in M.fill_from(templates, fills).collect()}
    assert got == {"a": ("Processo P1 em [DATA], P1", 1), "b": ("[DATA]", 2), "c": (None, 3)}
    assert M.fill_from(templates.limit(0), fills).count() == 0 and M.fill_from(templates, fills.limit(0)).count() == 3


@pytest.mark.parametrize(("doc", "old", "new"), [("x", "d1-1", "n1"), ("y", "d1-1", None), ("y", "d2-1", "n3"), ("y", "d3-1", "d3-1")])
def test_links_renamed(spark, doc, old, new):
    local = spark.createDataFrame([("x", "d1-1", "n1")], "doc_id string, old string, new string")
    anywhere = spark.createDataFrame([("d1-1", "n1"), ("d1-1", "n2"), ("d2-1", "n3")], "old string, new string")
    assert K.remap(spark.createDataFrame([(doc, old)], "doc_id string, old string"), local, anywhere).first().new == new


def test_quotations_as_their_sql_has_them(spark, tmp_path):
    long = " ".join(f"{i}" + "y" * 40 for i in range(20))
    rows = [(1, long), (2, "a b c " * 30), (3, "¿x¿ \ue0001 ¿¿ fim¿"), (4, None), (5, "x" * 300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.SQL["repair_quotes"]).fetchall()
    assert len(want) == 17 and sorted(tuple(r) for r in registry.QUERIES["repair_quotes"](spark, str(tmp_path)).collect()) == sorted(want)


def test_all_that_is_kept_is_told(spark):
    dates = [f"{d:02}/01/2024" for d in range(1, 10)]
    assert each(spark, [" e ".join([*dates, dates[0]]), "sem data"], lambda t: M.preserved(t, "datas")) == [dates, []]
    assert "[:6]" not in registry.SQL["preserve_meta"]
