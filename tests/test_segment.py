"""Segmentation in chunks against a plain fold over lines, on random documents and on one of many lines."""

import random
import re

import pytest

from lavra.operators import segment as G

NUMBERS = [f"060000{i}-23.2026.6.14.0002" for i in range(5)]
SCHEMA = "doc_id long, filename string, reading string"


def line(r):
    c, d = r.choice(NUMBERS), r.choice(NUMBERS)
    return r.choice(["DESPACHO", "  ", "", f"Processo {c}", f"Autos {c} e {d}", f"ver {c}", f"precedente processo {c}", "texto comum", "SENTENÇA", f"DECISÃO {c}", f"<!-- página {r.randrange(9)} -->", f"Processo {c} citado {d}"])


def plain(text):
    """title, text, pages of each act, line by line."""
    parts = re.split(r"<!-- página (\d+) -->", text or "")
    slices = [(int(p), t.strip()) for p, t in zip(parts[1::2], parts[2::2], strict=True)] or [(None, parts[0].strip())]
    done, now = [], None
    for page, body in slices:
        for x in body.split("\n"):
            cited = "precedente" in x or "citado" in x
            found = [] if cited else re.findall(r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}", x)
            opens = x.strip().split(" ")[0] in ("DESPACHO", "SENTENÇA", "DECISÃO")
            header = bool(found) and x.startswith(("Processo", "Autos"))
            other = now and now["cnj"] and header and set(found) - now["cnj"]
            if now and (opens or other) and any(y.strip() for y in now["lines"]):
                done.append(now)
                now = None
            now = now or {"title": x.strip()[:80] if opens else G.UNTITLED, "lines": [], "pages": set(), "cnj": set()}
            now["lines"].append(x)
            now["cnj"] |= set(found)
            if page is not None and x.strip():
                now["pages"].add(page)
    done.append(now)
    return [(a["title"], "\n".join(a["lines"]).strip(), sorted(a["pages"])) for a in done if "\n".join(a["lines"]).strip()]


def by_hand(docs):
    return sorted(((i, f, k, f"{'null' if i is None else i}-{k}", *a) for i, f, t in docs for k, a in enumerate(plain(t), 1)), key=str)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(11)
    made = [(i, f"f{i}", "\n".join(line(r) for _ in range(r.randrange(40)))) for i in range(200)]
    return [*made, (900, "n", None), (901, "e", ""), (None, "x", "DESPACHO\n\na\nSENTENÇA\nb"), (902, "w", " \n \n")]


@pytest.mark.parametrize("chunk", [1, 3, 7, 10_000])
def test_equal_to_the_fold(spark, docs, chunk):
    got = G.acts(spark.createDataFrame([(*d, 1) for d in docs], SCHEMA + ", key int"), chunk).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(docs)


def test_rows_that_repeat(spark):
    docs = [(1, "a", "DESPACHO\nx\nv"), (1, "a", "DESPACHO\nx\nv"), (1, "b", "SENTENÇA\ny\nz\nw")]
    for chunk in (1, 100):
        got = sorted(tuple(a)[:3] for a in G.acts(spark.createDataFrame(docs, SCHEMA), chunk).collect())
        assert got == [(1, "a", 1)] * (2 if chunk > 1 else 1) + [(1, "b", 1)]


def test_a_document_of_many_lines(spark):
    """One act of 20,000 lines, then headers that change and repeat; chunks that many acts end in, and none."""
    r = random.Random(13)
    lines = ["<!-- página 1 -->", "DESPACHO", f"Processo {NUMBERS[0]}", *["texto comum"] * 20_000]
    lines += [f"Processo {NUMBERS[k // 3 % 5]}" if k % 7 == 0 else f"ver {NUMBERS[k % 2]}" if k % 1000 == 1 else "texto" for k in range(15_000)]
    lines += [line(r) if r.randrange(50) == 0 else "corrido" for _ in range(15_000)]
    doc = (1, "longo.md", "\n".join(lines))
    got = G.acts(spark.createDataFrame([doc], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == by_hand([doc]) and len(got) > 1500


def test_a_chunk_is_a_function(spark):
    """Ranges of a chunk, composed, give the acts that are open at each chunk's start."""
    from pyspark.sql import functions as F

    marks = [(10, 3, 5), (12, 1, 11), (15, -1, 13)]
    df = spark.createDataFrame([(marks,)], "marks array<struct<pos:int,low:int,high:int>>")
    rs = df.select(G._ranges(F.col("marks"), F.lit(9)).alias("rs")).first().rs

    def fold(open_):
        n = 0
        for pos, low, high in marks:
            if low < open_ <= high:
                open_, n = pos, n + 1
        return open_, n

    for entry in range(9):
        hit = [r for r in rs if r.low < entry <= r.high]
        assert ((hit[0].open, hit[0].n) if hit else (entry, 0)) == fold(entry)
