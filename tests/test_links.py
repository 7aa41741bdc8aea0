"""Links between acts in the index, against the rule applied to every pair."""

import csv
import json
import random
import re
import unicodedata

from pyspark.sql import functions as F

from lavra.operators import classify as C
from lavra.operators import incremental as I
from lavra.operators import linking as K
from lavra.operators import search as S
from lavra.operators import segment as G
from lavra.plans import registry

DATA = "/root/testdata/sf0.001"
P1, P2 = "0600001-23.2026.6.14.0002", "0600005-94.2025.6.14.0002"
COMMON = "O juízo determina a manifestação da parte interessada no prazo de cinco dias, com vista dos autos."


def tokens(text):
    flat = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return {t for t in re.split(r"[^\w]+|_", flat) if len(t) > 4}


def brute(rows):
    """rows of (id, block, text) in order: id to (duplicate, variants)."""
    sets, out = [tokens(t) for _, _, t in rows], {}
    norm = [" ".join(t.split()) for _, _, t in rows]
    for i, (name, block, _) in enumerate(rows):
        same, like = None, []
        for j in range(i):
            if norm[i] == norm[j]:
                same = rows[j][0]
                break
            if block == rows[j][1] and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.72:
                like.append(rows[j][0])
        out[name] = (same, like)
    return out


def test_index_holds_the_links(spark):
    want = brute([(a.act_id, (a.classe, a.tipo), a.text) for a in registry.classified(spark, DATA).orderBy("doc_id", "ord").select("act_id", "classe", "tipo", "text").collect()])
    assert sum(len(v) for _, v in want.values()) > 10_000
    lines = {r.act_id: next(csv.reader([r.line], strict=True)) for r in registry.QUERIES["index_csv"](spark, DATA).collect()}
    assert {k: (v[14] or None, v[15].split()) for k, v in lines.items()} == want
    got = {r.act_id: json.loads(r.json) for r in registry.QUERIES["index_json"](spark, DATA).collect()}
    assert {k: (v.get("duplicata_de"), v["variantes"]) for k, v in got.items()} == want


def test_copies_and_variants(spark):
    parts = [f"DESPACHO\n\nProcesso {p}\n\n{COMMON}\n\n{end}" for p, end in ((P1, "Intime-se."), (P2, "Cite-se."), (P1, "Intime-se."), (P2, "Cite-se."))]
    df = spark.createDataFrame([(1, "x.md", "<!-- página 1 -->\n\n" + "\n\n".join(parts))], "doc_id long, filename string, reading string")
    got = [(r.duplicate_of, list(r.variants)) for r in S.linked(C.classified(G.acts(df))).orderBy("ord").collect()]
    assert got == [(None, []), (None, ["1-1"]), ("1-1", []), ("1-2", ["1-1"])]


def test_null_blocks(spark):
    texts = [f"{COMMON} unico{i}" for i in range(3)]
    df = spark.createDataFrame([(1, None, texts[0]), (2, None, texts[1]), (3, "pt", texts[2]), (4, "pt", ""), (5, None, None)], "doc_id long, block string, text string")
    got = {r.doc_id: list(r.variants) for r in K.links(df).select("doc_id", F.col("variants")).collect()}
    assert got == {1: [], 2: [1], 3: [], 4: [], 5: []}


def test_pairs_of_null_blocks(spark):
    texts = [f"{COMMON} unico{i}" for i in range(4)]
    df = spark.createDataFrame([(1, None, texts[0]), (2, None, texts[1]), (3, "pt", texts[2]), (4, "pt", texts[3])], "doc_id long, block string, text string")
    assert sorted((r.doc_id, r.other) for r in K.similar_pairs(df).collect()) == [(2, 1), (4, 3)]
    assert sorted((r.doc_id, r.variant_of) for r in K.variants(df).collect()) == [(2, 1), (4, 3)]


def test_only_near_classes_are_compared_by_tokens(spark):
    rng = random.Random(7)
    vocabulary = [f"palavra{k}" for k in range(400)]
    texts = [" ".join(rng.sample(vocabulary, rng.choice([3, 20, 90, 300]))) for _ in range(40)]
    for t in texts[:20]:
        words_ = t.split()
        texts += [" ".join(words_), " ".join(words_[: len(words_) * 8 // 10] + ["outra"])]
    rows = [(i, "ab"[i % 2] if i % 5 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, block string, text string")
    sets, want = [set(t.split()) for t in texts], set()
    for i in range(len(rows)):
        want |= {(i, j, len(sets[i] & sets[j]), len(sets[i] | sets[j])) for j in range(i) if rows[i][1] == rows[j][1] and 100 * len(sets[i] & sets[j]) >= 72 * len(sets[i] | sets[j])}
    assert len(want) > 5 and {tuple(r) for r in K.similar_pairs(df).collect()} == want
    classes = df.select(F.col("doc_id").alias("rep"), "block", K.tokens(F.col("text")).alias("tokens")).withColumn("n", F.size("tokens"))
    every = classes.select("rep").crossJoin(classes.select(F.col("rep").alias("like"))).filter("like < rep")
    left = {tuple(r) for r in K.near(every, classes).collect()}
    alike = {(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 72 * len(sets[i] | sets[j])}
    assert alike <= left and len(left) < len(alike) + 100 < every.count() / 4


def test_texts_of_a_batch_are_folded_once(spark):
    acts = spark.createDataFrame([(1, 1, "1-1", "c", "t", f"{COMMON} um"), (2, 1, "2-1", "c", "t", f"{COMMON} dois")], "doc_id long, ord int, act_id string, classe string, tipo string, text string")
    added = I.add(acts, I.ranks(acts))
    assert not any("regexp_replace" in x._jdf.queryExecution().optimizedPlan().toString() for x in added.values())
    assert [tuple(r) for r in I.links(added["members"], added["pairs"]).orderBy("doc_id").collect()] == [(1, 1, None, []), (2, 1, None, ["1-1"])]


def test_counts_of_links_without_their_pairs(spark):
    texts = [f"{COMMON} unico{i % 3}" + " " * (i % 2) + (" outra" if i % 5 == 0 else "") for i in range(40)] + ["", "", None]
    rows = [(i if i else None, 1, f"{i}-1", "ab"[i % 4 == 1], "t", t) for i, t in enumerate(texts)]
    acts = spark.createDataFrame(rows, "doc_id long, ord int, act_id string, classe string, tipo string, text string")
    added = I.add(acts, I.ranks(acts))
    lists, counts = I.links(added["members"], added["pairs"]), I.link_counts(added["members"], added["pairs"])
    want = {(r.doc_id, r.duplicate_of, len(r.variants)) for r in lists.collect()}
    assert {(r.doc_id, r.duplicate_of, r.variants) for r in counts.collect()} == want and sum(x[2] for x in want) > 50
    assert "collect_list" not in registry.QUERIES["links_in_batches"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_one_shared_token_makes_no_candidates(spark, monkeypatch):
    asked, near = [], K.near
    monkeypatch.setattr(K, "near", lambda pairs, *rest: asked.append(pairs.count()) or near(pairs, *rest))
    words_ = [" ".join(f"{x}palavra{k}" for k in range(20)) for x in "ab"]
    texts = [f"rarissima{i // 2} {words_[i % 2]}" for i in range(20)] + ["sozinha", "sozinha outra", "outra sozinha"]
    df = spark.createDataFrame([(i, "pt", t) for i, t in enumerate(texts)], "doc_id long, block string, text string")
    got = {(r.doc_id, r.other) for r in K.similar_pairs(df).collect()}
    assert got == {(i, j) for i in range(20) for j in range(i) if (i - j) % 2 == 0} | {(22, 21)} and asked == [90]
