"""What a query asks for is all that is worked out, and once."""

from pyspark.sql import functions as F

from lavra.functions import text as T
from lavra.operators import classify as C
from lavra.operators import masking as M
from lavra.operators import records as D
from lavra.operators import search as S
from lavra.operators import segment as G


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_split_once_at_its_marks(spark):
    df = spark.createDataFrame([(1, "vor <!-- página 3 -->\n a \n<!-- página 4 x --> b")], "doc_id long, reading string")
    got = G.page_slices(df)
    assert plan(got).count("split(reading") == 1
    assert [tuple(r) for r in got.select("page", "note", "text").collect()] == [(3, " ", "a"), (4, " x ", "b")]


ACTS = "act_id string, doc_id long, ord int, filename string, pages array<int>, title string, text string"
ROW = ("1-1", 1, 1, "a.md", [1], "SENTENÇA", "Processo 0600001-23.2026.6.14.0002\nfls. 7 Julgo procedente. Fase de execução.\ncitado 0600005-94.2025.6.14.0002")


def test_only_the_values_asked_for(spark):
    acts = spark.createDataFrame([ROW], ACTS)
    some = C.classified(acts, ["cnj", "printed_pages"])
    assert "procedente" not in plan(some.select("cnj")) and "PRINTED" not in some.columns
    every = C.classified(acts)
    for k in (*C.LABELS, "nature", "voice", "cnj", "document_id", "printed_pages"):
        assert C.classified(acts, [k]).select(k).collect() == every.select(k).collect(), k
    rito = C.evidence(C.classified(acts, ["rito"]), ["rito"])
    assert rito.select("fields").first().fields == [f for f in C.evidence(every).first().fields if f.key == "rito"]


def test_openings(spark):
    assert set(T.openings(r"\bID(?:\s+do documento)?\s*x|sala")) == set("iIİısSſ")
    assert T.openings(r"a?b") == T.openings(r"(?:a|b)c") == T.openings(r"x|\d+") == T.openings("ção|é") == ""
    words = spark.createDataFrame([("ſala",), ("ıd",), ("nada",)], "w string")
    assert [r[0] for r in words.select(T.has(F.col("w"), "sala|id")).collect()] == [True, True, False]


def test_menus_in_one_pass(spark):
    acts = spark.createDataFrame([(2, 1, "a", "x"), (1, 1, "b", "x"), (1, 2, "a", "y")], "doc_id int, ord int, classe string, rito string")
    got = {(r.menu, r.value, r.place) for r in S.menus(acts, "classe", "rito").collect()}
    assert got == {("classe", "b", 1), ("classe", "a", 2), ("rito", "x", 1), ("rito", "y", 2)}


def test_nature_of_short_texts(spark):
    acts = spark.createDataFrame([("a " * 39,), ("a " * 40,), ("\n ",)], "text string").withColumn("title", F.lit("t"))
    assert [r.nature for r in C.classified(acts, ["nature"]).collect()] == ["incompleto", "ato", "incompleto"]


def test_repeated_line_counts_trimmed_lines(spark):
    line = "linha repetida de mais de quarenta caracteres aqui"
    df = spark.createDataFrame([("\n".join([line, " " + line, "outra", line + "\t"]),), ("x\n" * 5,)], "text string")
    assert [r.r and tuple(r.r) for r in df.select(D.repeated_line(F.col("text")).alias("r")).collect()] == [(line, 3), None]


def test_plain_lines_are_not_taken_apart(spark):
    text = "Despacho\nProcesso 0600001-23.2026.6.14.0002\n" + "linha simples\n" * 9 + " \n sentença \nfim"
    df = spark.createDataFrame([(1, text), (2, text.replace("fim", "f\0m"))], "doc_id long, reading string").withColumn("filename", F.lit("a.md"))
    runs = G._chunks(df.select(F.struct("doc_id", "filename").alias("key"), "reading"), None).select(F.size("ls"))
    assert [r[0] for r in runs.collect()] == [3, 3]
    assert "translate(" not in plan(G.acts(df))
    assert sorted(G.acts(df).collect()) == sorted(G.acts(df, 1).collect()) and G.acts(df).count() == 4


def test_start_lines_hold_four_words_at_most(spark):
    lines = ["Despacho a b c", "Despacho a b c d", "Despacho  a\tb c", "ementa", "relatório despacho", "Sentença", "representação"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(G.is_start(F.col("line")))
    assert [r[0] for r in got.collect()] == [True, False, True, False, False, True, True]


def test_rules_look_at_first_letters_before_word_edges(spark):
    df = spark.createDataFrame([("x",)], "low string")
    assert "(?=[" in plan(df.select(C.quick(F.col("low"), r"\bconhecimento\b")))
    texts = spark.createDataFrame([("em conhecimento.",), ("desconhecimento",), ("aije",)], "low string")
    assert [tuple(r) for r in texts.select(C.quick(F.col("low"), r"\bconhecimento\b"), C.quick(F.col("low"), r"\bAIJE\b")).collect()] == [(True, False), (False, False), (False, True)]


def test_a_quotation_is_looked_for_once(spark):
    told = C.evidence(C.classified(spark.createDataFrame([ROW], ACTS)))
    assert plan(told).count("regexp_instr(blob") <= 5 + len(C.CLASSE) + 1 + len(C.FASE) + len(C.RESULTADO) + 1
    one = C.evidence(C.classified(spark.createDataFrame([ROW], ACTS), ["grau"]), ["grau"])
    assert plan(one).count("regexp_instr(blob") == 1


def test_plain_parts_change_no_mask_nature_or_voice(spark):
    texts = ["ID: ABCDE-1 ıd 12345 İD nº 98765", "zona\n\nª 3ª Zona Eleitoral de Belém", "Jurisprudência 01/02/2024", "ELEIÇÕES 2024 exercício 2023 Município de Belém", "İnteressado: x\n\nR$ 1,00",
             "documento incompleto" + "x" * 50, "x" * 50 + " ...\n", "continua NA página" + "y" * 40, "nota de estudo" + "z" * 40, "Petição vem a requerer", "um requerente pede", "[ trecho" + "w" * 40, "modelo", "fim modelo. EXTRATO de x", "juízo despacho", ""]
    acts = spark.createDataFrame([(str(i), i, 1, "a.md", [1], "Título", t) for i, t in enumerate(texts)], ACTS)

    def plainly(p):
        out = p
        for pattern, by, flags in M.MASKS:
            out = T.replace(out, pattern, by, flags)
        return F.when(T.has(p, M.CITATION), p).otherwise(out)

    title, text, all_ = F.col("title"), F.col("text"), F.lit("...modelo mater extrato trecho pet parecer")
    same = C.classified(acts, ["nature", "voice"]).select(
        M.mask(text) == F.array_join(F.transform(M.paragraphs(text), plainly), "\n\n"), F.col("nature") == C.nature(title, text, all_), F.col("voice") == C.voice(title, text, all_)
    )
    assert {tuple(r) for r in same.collect()} == {(True, True, True)}


def test_squeeze_and_around(spark):
    df = spark.createDataFrame([("a  b c \n d e",), (" \t",), ("x " * 60 + "  alvo  y" + " z" * 60,)], "t string")
    got = df.select(T.squeeze(F.col("t")).alias("s"), T.around(F.col("t"), r"\balvo\b").alias("a")).collect()
    assert [r.s for r in got[:2]] == ["a b c d e", ""] and [r.a for r in got[:2]] == ["", ""]
    assert got[2].a == ("x " * 19 + "alvo y" + " z" * 38).strip()
