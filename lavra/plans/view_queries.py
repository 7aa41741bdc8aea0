"""Queries of the Markdown view: one text for each customer, with a line for each order, whose shape its key decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.operators import view as V
from lavra.plans.registry import register

#: Shapes of the lines, as expressions.
SHAPES = [
    "'# Parte ' || k", "'- item **forte** ' || k", "'-  outro'", "k || '. passo'", "'segue [nota ' || k || '](https://exemplo.br/' || k || ') fim'",
    "'| a' || k || ' | b |'", "'| --- | --- |'", "'---'", "'texto com marca ' || k", r"'3. \\*fim\\*'", "'<!-- oculto -->sobra'",
]
LINE = "CASE o_orderkey % 11 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(SHAPES)) + " END"
GAP = "CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || chr(10) ELSE chr(10) END"


def texts(s: SparkSession, d: str) -> DataFrame:
    orders = s.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("string").alias("k"))
    line = F.struct("o_orderkey", F.expr(f"{GAP} || {LINE}").alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]), "")
    return orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit("---\ntitulo: x\n---"), joined).alias("text"))


def view(s: SparkSession, d: str) -> DataFrame:
    got = V.blocks(texts(s, d))
    held = F.coalesce("text", F.array_join("items", "¦"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "¦")), "¶"), F.lit(""))
    return got.select("doc_id", "chunk", "at", "kind", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("start", F.lit("")).alias("start"), held.alias("held"))


def line_spans(s: SparkSession, d: str) -> DataFrame:
    """Spans of the paragraphs and items of all texts."""
    got = V.blocks(texts(s, d)).select("doc_id", "chunk", "at", F.posexplode(F.coalesce("items", F.array("text"))).alias("item", "line"))
    each = got.select("doc_id", "chunk", "at", "item", F.posexplode(V.spans(F.col("line"))).alias("nth", "s"))
    return each.select("doc_id", "chunk", "at", "item", "nth", "s.kind", "s.text", F.coalesce("s.href", F.lit("")).alias("href"))


# The other side never parses a text: it numbers the orders and reads the shapes off their keys.
_SHAPED = (
    f"WITH l AS (SELECT o_custkey AS doc_id, o_orderkey AS n, o_orderkey::VARCHAR AS k, o_orderkey % 11 AS m, o_orderkey % 5 = 0 AS gap, "
    "CASE WHEN o_orderkey % 11 = 0 THEN 'h' WHEN o_orderkey % 11 IN (1, 2) THEN 'ul' WHEN o_orderkey % 11 IN (3, 9) THEN 'ol' WHEN o_orderkey % 11 IN (5, 6) THEN 'table' WHEN o_orderkey % 11 = 7 THEN 'hr' ELSE 'p' END AS shape FROM orders), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM l), "
    "c AS (SELECT *, sum(CASE WHEN gap AND i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS chunk FROM f), "
    "s AS (SELECT *, row_number() OVER w - 1 AS \"at\", lag(shape) OVER w AS before, last_value(CASE WHEN shape <> 'p' THEN shape END IGNORE NULLS) OVER w AS solid FROM c WINDOW w AS (PARTITION BY doc_id, chunk ORDER BY n)), "
    "e AS (SELECT *, CASE WHEN shape = 'p' AND solid = 'ol' THEN 'ol' ELSE shape END AS kind FROM s), "
    "g AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id, chunk ORDER BY n) AS last FROM e), "
    "b AS (SELECT *, sum(CASE WHEN last IS NULL OR kind IN ('h', 'hr') OR kind <> last THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, chunk ORDER BY n) AS block, "
    "CASE m WHEN 0 THEN 'Parte ' || k WHEN 1 THEN 'item **forte** ' || k WHEN 2 THEN 'outro' WHEN 3 THEN 'passo' WHEN 4 THEN 'segue [nota ' || k || '](https://exemplo.br/' || k || ') fim' "
    "WHEN 5 THEN 'a' || k || '¦b' WHEN 8 THEN 'texto com marca ' || k WHEN 9 THEN '\\*fim\\*' WHEN 10 THEN 'sobra' ELSE '' END AS part FROM g), "
    "t AS (SELECT *, sum(CASE WHEN shape = 'p' AND kind = 'ol' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, chunk, block ORDER BY n) AS item FROM b WHERE m <> 6 OR kind <> 'table') "
)
_BLOCK = "(SELECT doc_id, chunk::INT AS chunk, block, kind, min(\"at\")::INT AS \"at\" FROM b GROUP BY ALL)"
_HELD = (
    _SHAPED + ", y AS (SELECT doc_id, chunk, block, kind, CASE WHEN kind IN ('ol', 'ul', 'table') THEN item ELSE 1 END AS item, string_agg(part, ' ' ORDER BY n) AS held, "
    "min_by(CASE WHEN m = 9 THEN '3' ELSE k END, n) AS first FROM t GROUP BY ALL), x AS (SELECT doc_id, chunk, block, min(\"at\")::INT AS \"at\" FROM b GROUP BY ALL), "
    "z AS (SELECT y.*, x.\"at\" FROM y JOIN x ON x.doc_id = y.doc_id AND x.chunk = y.chunk AND x.block = y.block) "
)
register(
    "md_view_tree", view,
    _HELD + "SELECT doc_id, chunk::INT AS chunk, \"at\", kind, CASE WHEN kind = 'h' THEN 1 ELSE 0 END::INT AS level, CASE WHEN kind = 'ol' THEN min_by(first, item) ELSE '' END AS start, "
    "CASE WHEN kind = 'table' THEN string_agg(held, '¶' ORDER BY item) ELSE string_agg(held, '¦' ORDER BY item) END AS held FROM z GROUP BY doc_id, chunk, \"at\", kind",
)
_span = "\\[([^\\]\\n]+)\\]\\((https?://[^\\s)]+|mailto:[^\\s)]+)\\)|\\*\\*([^*\\n]+)\\*\\*"
register(
    "md_view_spans", line_spans,
    _HELD + f", p AS (SELECT doc_id, chunk, \"at\", item - 1 AS item, regexp_split_to_array(held, '{_span}') AS ps, regexp_extract_all(held, '{_span}') AS ms FROM z WHERE kind IN ('h', 'p', 'ol', 'ul')), "
    "i AS (SELECT *, unnest(range(2 * len(ps) - 1)) AS i FROM p), r AS (SELECT *, i % 2 = 1 AS marked, CASE WHEN i % 2 = 1 THEN ms[(i + 1) // 2] ELSE ps[i // 2 + 1] END AS raw FROM i), "
    f"w AS (SELECT *, CASE WHEN NOT marked THEN 'text' WHEN raw LIKE '**%' THEN 'strong' ELSE 'link' END AS kind, "
    f"CASE WHEN NOT marked THEN raw WHEN raw LIKE '**%' THEN regexp_extract(raw, '{_span}', 3) ELSE regexp_extract(raw, '{_span}', 1) END AS own FROM r WHERE raw <> '') "
    "SELECT doc_id, chunk::INT AS chunk, \"at\", item::INT AS item, (row_number() OVER (PARTITION BY doc_id, chunk, \"at\", item ORDER BY i) - 1)::INT AS nth, kind, "
    f"replace(own, chr(92) || '*', '*') AS text, CASE WHEN kind = 'link' THEN regexp_extract(raw, '{_span}', 2) ELSE '' END AS href FROM w",
)
