"""Queries of the search by trigram lists. The index is built over the whole table by each of them, as nothing is
kept between queries here; a user builds it once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.operators import postings as P
from lavra.operators import search as S
from lavra.operators import segment as G
from lavra.plans.registry import documents, register
from lavra.sources import archive
from lavra.sources.shared import new_folder

#: What is asked: frequent and rare, with accents and without, with blanks, with none that holds it, too short.
ASKED = ["Ción", "onan", "ZUEN", "thand of", "éouré", "the on", "Ertion on", "zzz", "the", "ön"]
MOST = 24
PROCESS, MOST_PROCESSES = "96.6.14.00", 12


def _index(s: SparkSession, d: str) -> P.Index:
    return P.Index.build(documents(s, d).select(F.col("doc_id").alias("key"), "text"), new_folder(s, "postings"))


def page_search(s: SparkSession, d: str) -> DataFrame:
    """The first documents that hold each of ten queries."""
    index = _index(s, d)
    return reduce(DataFrame.unionByName, [index.first(q, MOST).select(F.lit(q).alias("query"), F.col("key").alias("page")) for q in ASKED])


def matches(s: SparkSession, d: str) -> DataFrame:
    """All documents that hold each of ten queries."""
    index = _index(s, d)
    return reduce(DataFrame.unionByName, [index.search(q).select(F.lit(q).alias("query"), F.col("key").alias("doc_id")) for q in ASKED])


def process_search(s: SparkSession, d: str) -> DataFrame:
    """The first process numbers that hold a query, by their first page."""
    numbers = S.inverted_index(G.page_slices(archive.documents(s, d)).select("page", "text"))
    firsts = numbers.select("cnj", F.slice("pages", 1, 1).alias("pages"))
    index = P.Index.build(numbers.select(F.col("cnj").alias("key"), F.col("cnj").alias("text")), new_folder(s, "processes"))
    held = index.search(PROCESS).select(F.col("key").alias("cnj"))
    return S.process_search(firsts.join(held, "cnj", "left_semi"), PROCESS, MOST_PROCESSES)


_asked = "q AS (SELECT unnest([" + ", ".join(f"'{q}'" for q in ASKED) + "]) AS query), m AS (SELECT query, doc_id FROM q JOIN documents ON length(query) >= 3 AND contains(lower(strip_accents(text)), lower(strip_accents(query))))"
register("indexed_page_search", page_search, f"WITH {_asked} SELECT query, doc_id AS page FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY doc_id) <= {MOST}")
register("indexed_matches", matches, f"WITH {_asked} SELECT query, doc_id FROM m")
register(
    "indexed_process_search", process_search,
    f"{archive.ACTS_SQL}, c AS (SELECT page, unnest(regexp_extract_all(text, '{S.CNJ}')) AS cnj FROM a) SELECT cnj, min(page) AS first_page FROM c WHERE contains(cnj, '{PROCESS}') GROUP BY 1 ORDER BY 2, 1 LIMIT {MOST_PROCESSES}",
)
