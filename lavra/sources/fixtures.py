"""A fictional archive of nine documents and fourteen acts, flagged as examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAGE = "<!-- página {} -->\n"
_NUMBERS = ["0600001-23.2026.6.14.0002", "0600005-94.2025.6.14.0002", "0600100-85.2026.6.14.0004", "0600020-22.2024.6.14.0003", "0600021-07.2024.6.14.0003"]
_ORDER = "O juízo determina manifestação da parte interessada."
DOCUMENTS = [
    (1, "exemplo-atos.md", f"{_PAGE.format(1)}DESPACHO\n\nProcesso {_NUMBERS[0]}\n\n{_ORDER}\n\nDECISÃO\n\nProcesso {_NUMBERS[1]}\n\nJulgo procedente o pedido."),
    (2, "exemplo-sentenca.md", f"{_PAGE.format(1)}SENTENÇA\n\nProcesso 0600010-11.2024.6.14.0001\n\nVistos pelo juiz eleitoral.\n\n{_PAGE.format(2)}Julgo improcedente o pedido inicial."),
    (3, "exemplo-contas.md", f"{_PAGE.format(3)}PRESTAÇÃO DE CONTAS ANUAL\n\nProcesso {_NUMBERS[3]}\n\nExercício financeiro de 2025 do órgão partidário.\n\n"
     f"PRESTAÇÃO DE CONTAS ELEITORAIS\n\nProcesso {_NUMBERS[4]}\n\nContas de campanha das eleições 2024."),
    (4, "exemplo-representacoes.md", f"{_PAGE.format(4)}REPRESENTAÇÃO\n\nProcesso 0600030-51.2024.6.14.0008\n\nPropaganda eleitoral antecipada em rede social.\n\nREPRESENTAÇÃO\n\nProcesso 0600031-36.2024.6.14.0008\n\nPesquisa eleitoral sem registro prévio."),
    (5, "exemplo-cumprimento.md", f"{_PAGE.format(5)}DESPACHO\n\nProcesso {_NUMBERS[2]}\n\nCumprimento de sentença originado de AIJE 0600099-10. Intime-se o devedor."),
    (6, "exemplo-extrato.md", f"{_PAGE.format(8)}EXTRATO DE DESPACHO\n\nProcesso 0600040-99.2024.6.14.0009\n\nInteressado: Pessoa Fictícia\n\nPublicação resumida do despacho."),
    (7, "exemplo-digitalizado.md", f"{_PAGE.format(1)}DESPACHO\n\nProcesso 0600050-43.2024.6.14.0010\n\n{_ORDER}\n\n{_PAGE.format(2)}"),
    (8, "exemplo-sem-pagina.md", f"DESPACHO\n\nProcesso {_NUMBERS[0]}\n\n{_ORDER}"),
    (9, "exemplo-variantes.md", f"{_PAGE.format(1)}" + "\n\n".join(
        f"DESPACHO\n\nProcesso {n}\n\nO cartório certifica regularmente o decurso do prazo para {w} defesa escrita nestes autos." for n, w in ((_NUMBERS[3], "apresentar"), (_NUMBERS[4], "oferecer"), (_NUMBERS[3], "apresentar")))),
]
#: doc_id, acts, pages of the first act, classe of the last act, acts with a duplicate, acts with variants.
EXPECTED = [
    (1, 2, "1", "[NÃO IDENTIFICADO]", 0, 0), (2, 1, "1 2", "[NÃO IDENTIFICADO]", 0, 0), (3, 2, "3", "prestação de contas eleitorais", 0, 0), (4, 2, "4", "representação", 0, 0),
    (5, 1, "5", "cumprimento de sentença", 0, 0), (6, 1, "8", "[NÃO IDENTIFICADO]", 0, 0), (7, 1, "1", "[NÃO IDENTIFICADO]", 0, 1), (8, 1, "", "[NÃO IDENTIFICADO]", 1, 0), (9, 3, "1", "[NÃO IDENTIFICADO]", 1, 1),
]
EXPECTED_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({a}::BIGINT, {b}::BIGINT, '{c}', '{e}', {f}::BIGINT, {g}::BIGINT)" for a, b, c, e, f, g in EXPECTED) + ") AS t(doc_id, acts, first_pages, last_class, duplicates, variants)"


def documents(spark: SparkSession) -> DataFrame:
    """doc_id, filename, reading, faithful, example."""
    rows = spark.createDataFrame(DOCUMENTS, "doc_id bigint, filename string, reading string")
    return rows.withColumn("faithful", F.col("reading")).withColumn("example", F.lit(True))


def summary(acts: DataFrame) -> DataFrame:
    """linked acts of the archive by document, as in EXPECTED."""
    return acts.groupBy("doc_id").agg(
        F.count("*").alias("acts"), F.min_by(F.array_join(F.col("pages").cast("array<string>"), " "), "ord").alias("first_pages"), F.max_by("classe", "ord").alias("last_class"),
        F.count("duplicate_of").alias("duplicates"), F.count_if(F.size("variants") > 0).alias("variants"),
    )
