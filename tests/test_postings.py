"""Search by trigram lists against a scan of all texts."""

import random
import tempfile
import unicodedata

import pytest
from pyspark.sql import functions as F

from lavra.operators import postings as P
from lavra.operators import search as S

SCHEMA = "key bigint, text string"
ASKED = ["ação", "ACAO", "  de ", "aaa", "xyz", "ab", "a b", "\U0001f600a", "titulo", "[x]", "fim"]


def plain_fold(text):
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(5)
    words = ["ação", "de", "aaaa", "a b", "\U0001f600a\U0001f601", "fim", "Processo", "x\\[x\\]"]
    rows = [(k, " ".join(rnd.choices(words, k=rnd.randint(0, 12)))) for k in range(60)]
    rows += [(None, "de ação"), (None, None), (3, "título de novo"), (3, "título de novo"), (4, None), (5, ""), (99, "z" * 5000 + " \U0001f600a fim")]
    return rows, P.Index.build(spark.createDataFrame(rows, SCHEMA), tempfile.mkdtemp() + "/index")


@pytest.mark.parametrize("query", ASKED)
def test_equal_to_a_scan(made, query):
    rows, index = made
    needle = plain_fold(query.strip())
    clean = [(k, t, plain_fold(t.replace("\\[", "[").replace("\\]", "]"))) for k, t in rows if t is not None]
    want = sorted(((k, t) for k, t, f in clean if len(needle) >= 3 and needle in f), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted(((r["key"], r["text"]) for r in index.search(query).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == want
    for most in (1, 5, 1000):
        assert [tuple(r) for r in index.first(query, most).collect()] == want[:most]


def test_frequent_trigrams_without_the_word(spark):
    """Candidates that come first hold all trigrams and not the query: the rest is read."""
    rows = [(k, "abcd xbcde") for k in range(50)] + [(k, "abcde") for k in range(50, 53)]
    index = P.Index.build(spark.createDataFrame(rows, SCHEMA), tempfile.mkdtemp() + "/index")
    assert [r["key"] for r in index.first("abcde", 2).collect()] == [50, 51]


def test_only_folders_of_candidates_are_read(spark, monkeypatch):
    monkeypatch.setattr(P, "PER_PART", 10)
    rows = spark.range(400).select(F.col("id").alias("key"), F.concat(F.lit("texto comum "), F.when(F.col("id") == 77, "agulha").otherwise("palha")).alias("text"))
    index = P.Index.build(rows, tempfile.mkdtemp() + "/index")
    assert index.parts == 40
    found = index.first("agulha", 24)
    assert [r["key"] for r in found.collect()] == [77]
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "part" in scan.split("PartitionFilters: [")[1].split("]")[0]
    every = index.search("agulha")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in every


def test_empty_and_clashing(spark):
    empty = P.Index.build(spark.createDataFrame([], SCHEMA), tempfile.mkdtemp() + "/index")
    assert empty.search("ação").count() == 0 and empty.first("ação", 3).count() == 0
    rows = spark.createDataFrame([(1, "uma agulha", 7, "n")], "key bigint, text string, part int, gram string")
    assert P.Index.build(rows, tempfile.mkdtemp() + "/index").search("agulha").count() == 1


def test_processes(spark):
    numbers = spark.createDataFrame([("0600001-23.2026.6.14.0002", [4, 9]), ("0600002-23.2026.6.14.0002", [2]), ("0700001-11.2020.6.14.0001", [1])], "cnj string, pages array<int>")
    index = P.Index.build(numbers.select(F.col("cnj").alias("key"), F.col("cnj").alias("text")), tempfile.mkdtemp() + "/index")
    for query in ("23.2026", "0001", "9999", "06"):
        held = index.search(query).select(F.col("key").alias("cnj"))
        assert S.process_search(numbers, query).collect() == S.process_search(numbers.join(held, "cnj", "left_semi"), query).collect()
