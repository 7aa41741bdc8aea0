"""A synthetic archive: one document for each customer, one act for each order, from the driver's tables.

The text is built by expressions that Spark and DuckDB both read, so that queries over the segmented archive
can be checked against acts taken straight from the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TITLE = "CASE o_orderstatus WHEN 'F' THEN 'SENTENÇA' WHEN 'O' THEN 'DESPACHO' ELSE 'EXTRATO DE DESPACHO' END"
CNJ = (
    "lpad(cast(o_orderkey % 10000000 as string), 7, '0') || '-' || lpad(cast(o_orderkey % 97 as string), 2, '0') || '.' || "
    "cast(year(o_orderdate) as string) || '.6.14.' || lpad(cast(o_custkey % 10000 as string), 4, '0')"
)
PAGE = "cast(o_orderkey % 50 + 1 as int)"
_CENTS = "cast(round(o_totalprice * 100) as bigint)"
_DATE = "lpad(cast(day(o_orderdate) as string), 2, '0') || '/' || lpad(cast(month(o_orderdate) as string), 2, '0') || '/' || cast(year(o_orderdate) as string)"
# The bodies of the acts.
BODIES = [
    "'Cumprimento de sentença originado da AIJE 0600099-10. Fase de execução. Intime-se o requerido para pagar.'",
    "'Prestação de contas anual. Exercício financeiro de 2023, na 5ª Zona Eleitoral de Marabá. Julgo procedente o pedido. Lei nº 9.504/1997.'",
    "'Contas de campanha das eleições 2024. Julgo procedente o pedido. Resolução TSE nº 23.607/2019 e Lei n. 9.096/95.'",
    "'Representação por propaganda eleitoral irregular no município de Belém. Rito sumário previsto. Publique-se em cartório.'",
    "'Julgo improcedente o pedido com base na Lei nº 4.737/65. Tribunal Regional Eleitoral do Pará. Em fase de conhecimento.'",
    "'Rito: ordinário' || chr(10) || 'ID do documento: DOC-' || cast(o_orderkey as string) || chr(10) || 'fls. ' || cast(o_orderkey % 300 as string)"
    " || chr(10) || 'Interessado: Pessoa Fictícia' || chr(10) || 'Providencie-se o necessário quanto ao registro de candidatura.' || chr(10) || 'Segue a instrução do feito nos autos.'",
    "'Classe: Ação própria' || chr(10) || 'Conforme jurisprudência citada no processo 0600001-23.2026.6.14.0002, Rel. Ministro.' || chr(10) || chr(10) || 'Em julgamento, com identidade de partes.'",
    "'Pesquisa eleitoral...'",
]
BODY = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(BODIES)) + " END"
TEXT = f"{TITLE} || chr(10) || chr(10) || 'Processo ' || {CNJ} || chr(10) || 'Data ' || {_DATE} || ' valor R$ ' || cast(cast(floor({_CENTS} / 100) as bigint) as string) || ',' || lpad(cast({_CENTS} % 100 as string), 2, '0') || chr(10) || chr(10) || {BODY}"

#: Acts as SQL, straight from the orders: the independent side of the checks.
ACTS_SQL = f"""
WITH a AS (
  SELECT o_custkey AS doc_id, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS int) AS ord,
    cast(o_custkey AS string) || '-' || cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS string) AS act_id,
    {TITLE} AS title, {CNJ} AS own_cnj, {PAGE} AS page, {TEXT} AS text, {TITLE} || chr(10) || {TEXT} AS blob
  FROM orders)
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, filename, reading."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    act = F.expr(f"'<!-- página ' || cast({PAGE} as string) || ' -->' || chr(10) || {TEXT}")
    rows = orders.select("o_custkey", F.struct("o_orderkey", act.alias("text")).alias("act"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("act")), lambda x: x["text"]), "\n\n")
    return rows.groupBy(F.col("o_custkey").alias("doc_id")).agg(joined.alias("reading")).withColumn("filename", F.format_string("arquivo-%d.md", F.col("doc_id")))
