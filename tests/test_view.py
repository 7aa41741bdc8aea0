"""Blocks of Markdown texts against a walk over their lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lavra.operators import view as V

LINES = ["# Um", "### Três  níveis", "#### quatro", "#", "- a", "-  b", "-c", "1. um", "07. sete", "3.x", "texto", "  recuado ", "| a | b |", "|---|:--:|", "|c", "| |", "---", "----",
         "", "", " ", "<!-- fora -->", "<!-- aberto", "-->", "﻿", "**forte** e [x](https://y.br/z)"]


def walk(text):
    """One line at a time, holding the block that is open."""
    if text is None:
        return []
    text = text[1:] if text.startswith("﻿") else text
    found = re.match(r"---\n", text) and text.find("\n---", 3)
    if found and found > 0:
        text = text[found + 4 :]
    text = re.sub(r"<!--.*?-->", "", text, flags=re.S).strip(" \t\n\r﻿")
    out = []
    for c, chunk in enumerate(re.split("\n{2,}", text)):
        open_ = None
        at = -1
        for line in (x.strip(" \t﻿") for x in chunk.split("\n")):
            if not line:
                continue
            at += 1
            shape = "hr" if line == "---" else "h" if re.match(r"#{1,3}\s", line) else "ul" if re.match(r"-\s", line) else "ol" if re.match(r"\d+\.\s", line) else "table" if line[0] == "|" else "p"
            rest = re.sub(r"^(#{1,3}|-|\d+\.)\s+", "", line) if shape in ("h", "ul", "ol") else line
            if shape == "p" and open_ and open_[2] == "ol":
                open_[3][-1] += " " + line
            elif open_ and open_[2] == shape and shape in ("p", "ul", "ol", "table"):
                open_[3].append(rest)
            else:
                extra = len(line.split()[0]) if shape == "h" else line.split(".")[0] if shape == "ol" else None
                open_ = (c, at, shape, [rest], extra)
                out.append(open_)
    done = []
    for c, at, kind, parts, extra in out:
        rows = None
        if kind == "table":
            parts = [x for x in parts if not re.fullmatch(r"\|?(?:\s*:?-{3,}:?\s*\|)+\s*:?-{3,}:?\s*\|?", x)]
            rows = [[y.strip() for y in re.sub(r"\|$", "", x[1:]).split("|")] for x in parts]
            if not rows:
                continue
        done.append((c, at, kind, extra if kind == "h" else None, extra if kind == "ol" else None, " ".join(parts) if kind in "hp" else None, parts if kind in ("ul", "ol") else None, rows))
    return done


def made(rows):
    return [(r["chunk"], r["at"], r["kind"], r["level"], r["start"], r["text"], r["items"], r["rows"]) for r in rows]


def test_random_texts(spark):
    rnd = random.Random(11)
    texts = ["\n".join(rnd.choices(LINES, k=rnd.randint(0, 25))) for _ in range(400)]
    texts += ["---\na: 1\n---\n# T", "---\n---\nx", "---\nsem fim", "﻿---\na\n---x\ny", None, "", " \n\n ", "1. a\nb\nc\n2. d\n# h\ne\n3. f"]
    got = {}
    for r in V.blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(texts):
        assert made(sorted(got.get(i, []), key=lambda r: (r["chunk"], r["at"]))) == walk(text), repr(text)


def test_long_list_repeated_rows_and_clashing_columns(spark):
    long = "\n".join(f"{i}. item\nsegue" for i in range(1, 20001))
    rows = spark.createDataFrame([(1, long, "x", 5), (1, long, "x", 5)], "doc_id int, text string, kind string, _other int")
    got = V.blocks(rows).collect()
    assert [(r["kind"], len(r["items"]), r["_other"]) for r in got] == [("ol", 20000, 5)] * 2
    assert got[0]["items"][-1] == "item segue"
    assert V.blocks(rows.limit(0)).count() == 0


@pytest.mark.parametrize(
    "line, want",
    [
        (r"a \*b\* **c\_d** e", [("text", "a *b* ", None), ("strong", "c_d", None), ("text", " e", None)]),
        (r"[x\#](https://y.br/z)[m](mailto:a@b)", [("link", "x#", "https://y.br/z"), ("link", "m", "mailto:a@b")]),
        ("[x](ftp://y) **a*b**", [("text", "[x](ftp://y) **a*b**", None)]),
        ("", []),
    ],
)
def test_spans(spark, line, want):
    got = spark.createDataFrame([(line,)], "t string").select(V.spans(F.col("t")).alias("s")).first()["s"]
    assert [tuple(x) for x in got] == want


def test_spans_of_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(V.spans(F.col("t")).alias("s")).first()["s"] is None
