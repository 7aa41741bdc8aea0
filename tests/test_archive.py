"""Segmentation, masking and classification on small texts, quirks included."""

from pyspark.sql import functions as F

from lavra.functions import text as T
from lavra.operators import classify as C
from lavra.operators import masking as M
from lavra.operators import search as S
from lavra.operators import segment as G

P1, P2, P3 = "0600001-23.2026.6.14.0002", "0600005-94.2025.6.14.0002", "0600010-11.2024.6.14.0001"


def acts(spark, text):
    df = spark.createDataFrame([(1, "x.md", text)], "doc_id long, filename string, reading string")
    return C.classified(G.acts(df)).orderBy("ord").collect()


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_two_acts_on_one_page(spark):
    got = acts(spark, f"<!-- página 1 -->\nDESPACHO\n\nProcesso {P1}\nCite-se.\n\nDECISÃO\n\nProcesso {P2}\nJulgo procedente o pedido.")
    assert [(a.title, a.cnj, a.pages) for a in got] == [("DESPACHO", [P1], [1]), ("DECISÃO", [P2], [1])]
    assert P2 not in got[0].text and got[1].resultado == "procedente"


def test_one_act_over_two_pages(spark):
    got = acts(spark, f"<!-- página 1 -->\nSENTENÇA\n\nAutos {P3}\n\n<!-- página 2 -->\nContinua o texto.")
    assert [(a.title, a.pages) for a in got] == [("SENTENÇA", [1, 2])]


def test_empty_first_page_loses_the_title_and_preamble_is_dropped(spark):
    got = acts(spark, "antes\n<!-- página 1 -->\n\n<!-- página 2 -->\nDESPACHO\nCumpra-se o que foi dito.")
    assert [(a.title, a.pages) for a in got] == [(G.UNTITLED, [2])]
    assert "antes" not in got[0].text


def test_process_header_with_another_number_opens_an_act(spark):
    got = acts(spark, f"Processo {P1}\na\nProcesso {P2}\nb\nProcesso {P1}\nc")
    assert [a.cnj for a in got] == [[P1], [P2], [P1]] and got[0].pages == []


def test_citation_does_not_split(spark):
    text = f"DESPACHO\n\nProcesso {P1}\n\nConforme precedente no processo {P2}, Rel. Fulano."
    got = acts(spark, text)
    assert len(got) == 1 and got[0].cnj == [P1]
    masked = one(spark, got[0].text, M.mask)
    assert P2 in masked and P1 not in masked and "[PROCESSO]" in masked


def test_masking_quirks(spark):
    assert one(spark, "a identidade dele", M.mask) == "a [ID_DOCUMENTO] dele"
    assert one(spark, "[ELEIÇÃO] [ÓRGÃO] [PROCESSO]", M.placeholders) == ["[PROCESSO]"]
    assert one(spark, "Interessado: Fulano", M.mask) == "Interessado: [PARTE]"


def test_csv_cell_and_folding(spark):
    assert one(spark, "a\rb", S.csv_cell) == "a\rb" and one(spark, 'a"b', S.csv_cell) == '"a""b"'
    assert one(spark, "São Cônego ÀÉÎ", T.fold) == "sao conego aei"


def test_word_edges_are_ascii(spark):
    assert one(spark, "éID", lambda c: T.has(c, r"\bID")) is True
    assert one(spark, "  x﻿", T.trim) == "x"
