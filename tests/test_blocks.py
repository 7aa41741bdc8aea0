"""The chain from lines to Markdown against a plain walk over each page, on random pages and on single cases."""

import random
import re

import pytest

from lavra.operators import blocks as B

SCHEMA = "doc_id long, page int, line int, plain string, x double, y double, width double, size double, edge double, bold_ratio double, leader boolean, urls array<string>, cells array<string>, splits array<double>"
PLAINS = [
    "uma linha comum do texto que segue", "Uma linha que acaba aqui.", "a palavra no fim se quebra em juris-", "dição eleitoral", "Classe: Recurso", "DIÁRIO OFICIAL", "Sumário ...... 3", "1. primeiro item",
    "2) segundo item", "- traço", "• bala", "Despacho", "", "  ", "(entre parênteses)", "Outro parágrafo começa", "12 de maio", "Título em negrito", "acaba em ponto?", "a | b",
]
UNITS = ("Processo", "Classe", "Despacho")


def is_field(t):
    return bool(re.match(r"^[A-ZÀ-Ý][\w .()/-]{1,60}\s*:\s+\S", t))


def is_rubric(t):
    letters = re.sub(r"[^A-Za-zÀ-ÿ]", "", t)
    return 3 <= len(t) <= 56 and t[-1] not in ".!?,;:" and ":" not in t and len(letters) >= 4 and sum(c.isupper() for c in letters) / len(letters) > 0.85


def listed(t):
    if m := re.match(r"^(\d{1,3})[.)]\s+(\S.*)$", t):
        return "ol", m[2], int(m[1])
    if m := re.match(r"^[•-]\s+(\S.*)$", t):
        return "ul", m[1], 0
    return None


def may_join(a, b):
    left, right = a.strip()[:-1].split(" ")[-1], re.split(r"[^a-zà-ÿ]", b.strip().split(" ")[0], flags=re.I)[0]
    return len(left) >= 2 and len(right) >= 2 and not (len(left) >= 4 and len(right) >= 4)


def joint(p, q):
    gap, size = q["y"] - p["y"], max(p["size"], q["size"], 1)
    lead = lambda r: r["leader"] or "...." in r["plain"]
    lower = q["plain"][:1].islower()
    reasons = [
        gap > 1.85 * size, abs(p["size"] - q["size"]) > 0.22 * size, q["plain"].strip().startswith(UNITS), is_field(q["plain"]), is_field(p["plain"]) and not lower,
        is_rubric(p["plain"]) or is_rubric(q["plain"]), lead(p) or lead(q), listed(q["plain"]) is not None,
    ]
    if any(reasons):
        return "break"
    if p["plain"].endswith("-") and may_join(p["plain"], q["plain"]) and lower and len(p["plain"]) >= 20 and gap < 1.75 * size:
        return "hyphen"
    if (lower or q["plain"][:1] in ("(", "“", '"')) and gap < 1.55 * size:
        return "space"
    if p["x"] + p["width"] < p["edge"] - max(36, 2.8 * p["size"]):
        return "break"
    if re.search(r"[.!?…]$", p["plain"]) and re.match(r"^[A-ZÀ-Ý\d“\"]", q["plain"]) and gap > 1.25 * size:
        return "break"
    return "space" if gap < 1.7 * size else "break"


def table_end(ls, i):
    a = ls[i]
    closed = lambda r: is_field(r["plain"]) or is_rubric(r["plain"]) or listed(r["plain"])
    if not a["cells"] or len(a["cells"]) < 2 or len(a["splits"]) < 2 or closed(a) or any(c.strip()[:1] in (":", "·") and c.strip() for c in a["cells"]):
        return i
    k = i + 1
    while k < len(ls) and ls[k]["cells"] and len(ls[k]["cells"]) == len(a["cells"]) and len(ls[k]["splits"]) == len(a["splits"]) and not closed(ls[k]):
        if any(abs(u - v) > 16 for u, v in zip(a["splits"], ls[k]["splits"], strict=True)) or abs(ls[k]["size"] - a["size"]) > 0.28 * a["size"] or ls[k]["y"] - ls[k - 1]["y"] > 1.9 * ls[k]["size"]:
            break
        k += 1
    return k if k - i >= 3 else i


def level(r, body):
    t, ratio, item = r["plain"], r["size"] / body, listed(r["plain"])
    if not 2 <= len(t) <= 160 or (item and ratio < 1.2) or is_field(t) or r["leader"] or "...." in t:
        return None
    if is_rubric(t):
        return 2
    by_size = 1 if ratio >= 1.7 else 2 if ratio >= 1.28 else 3
    if len(t) <= 140 and (ratio >= 1.45 or (ratio >= 1.18 and not re.search(r"[.!?…]$", t))):
        return by_size
    return 3 if r["bold_ratio"] >= 0.8 and ratio >= 0.96 and len(t) <= 90 and t[-1] not in ".!?:,;" and not item else None


def walk(ls):
    """Blocks of one page."""
    weights = sorted((r["size"], len(r["plain"])) for r in ls if r["plain"])
    run, body = 0, 12.0
    for size, n in weights:
        run += n
        if run >= sum(n for _, n in weights) / 2:
            body = size
            break
    out, open_ = [], None
    i = 0
    while i < len(ls):
        r = ls[i]
        if (end := table_end(ls, i)) > i:
            out.append({"kind": "table", "rows": [x["cells"] for x in ls[i:end]]})
            i, open_ = end, None
            continue
        item = listed(r["plain"])
        kind = joint(ls[i - 1], r) if i else "break"
        if lv := level(r, body):
            out.append({"kind": "heading", "level": lv, "text": r["plain"], "urls": r["urls"]})
            open_ = None
        elif item:
            if not (open_ and open_["kind"] == item[0]):
                open_ = {"kind": item[0], "items": []}
                out.append(open_)
            open_["items"].append({"n": item[2], "text": item[1], "urls": list(r["urls"])})
        else:
            to = None
            if open_ and open_["kind"] == "para" and kind != "break":
                to = open_
            if open_ and open_["kind"] != "para" and kind != "break" and r["y"] - ls[i - 1]["y"] < 1.7 * r["size"] and r["x"] >= ls[i - 1]["x"] - 2:
                to = open_["items"][-1]
            if to:
                to["text"] = to["text"][:-1] + r["plain"] if kind == "hyphen" else f"{to['text']} {r['plain']}"
                to["urls"] = list(dict.fromkeys([*to["urls"], *r["urls"]]))
            else:
                open_ = {"kind": "para", "text": r["plain"], "urls": list(r["urls"])}
                out.append(open_)
        i += 1
    for b in out:
        if b["kind"] == "para":
            b["text"] = b["text"].strip()
    return [b for b in out if b["kind"] != "para" or b["text"]]


def random_page(r, n):
    ls, y, grid = [], 0.0, [50.0, 150.0, 250.0]
    for k in range(n):
        size = r.choice([10.0, 10.0, 10.0, 10.0, 13.0, 18.0])
        y += size * r.choice([1.0, 1.2, 1.4, 1.6, 1.72, 1.8, 2.5]) if r.random() < 0.4 else 12.0
        cells = r.random() < 0.45
        if cells:
            grid = [g + r.choice([0, 0, 6, -6, 12]) for g in grid] if r.random() < 0.8 else [50.0, 150.0, 250.0]
        row = {
            "line": k, "plain": r.choice(PLAINS), "x": r.choice([50.0, 50.0, 40.0, 60.0]), "y": y, "width": r.choice([100.0, 230.0, 250.0]), "size": 10.0 if cells else size, "edge": 300.0,
            "bold_ratio": r.choice([0.0, 0.0, 0.0, 0.9]), "leader": r.random() < 0.03, "urls": r.choice([[], [], [], ["https://a.org"], ["https://b.org", "https://c.org"]]),
            "cells": [r.choice(["um", "dois", ": x", "", "a | b"]) if r.random() < 0.2 else "c"] + ["d", "e"] if cells else None, "splits": list(grid) if cells else None,
        }
        ls.append(row)
    return ls


def frame(spark, pages):
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")][2:]
    return spark.createDataFrame([(d, p, *[r[c] for c in names]) for d, p, ls in pages for r in ls], SCHEMA)


def test_random_pages(spark):
    r = random.Random(17)
    pages = [(k // 4, k % 4 + 1, random_page(r, r.randrange(1, 40))) for k in range(240)]
    got = {}
    for b in B.lines_to_blocks(frame(spark, pages)).collect():
        got.setdefault((b.doc_id, b.page), []).append(b)
    kinds = set()
    for d, p, ls in pages:
        want, own = walk(ls), sorted(got.get((d, p), []), key=lambda b: b.block)
        assert [b.block for b in own] == list(range(len(want)))
        for b, w in zip(own, want, strict=True):
            kinds.add(b.kind)
            assert b.kind == w["kind"], (d, p, b, w)
            assert (b.level, b.text, b.urls) == (w.get("level"), w.get("text"), w.get("urls")), (d, p, b, w)
            assert (b["items"] and [i.asDict() for i in b["items"]]) == w.get("items"), (d, p, b, w)
            assert b.rows == w.get("rows"), (d, p, b, w)
    assert kinds == {"table", "heading", "ol", "ul", "para"}


def row(k, y, splits=(), **more):
    splits = list(splits)
    return {"line": k, "plain": "c d e", "x": 50.0, "y": y, "width": 200.0, "size": 10.0, "edge": 300.0, "bold_ratio": 0.0, "leader": False, "urls": [], "cells": ["c"] * len(splits) or None, "splits": splits or None} | more


@pytest.mark.parametrize(
    ("splits", "want"),
    [
        ([[50.0, 150.0 + 12 * k] for k in range(6)], []),  # each step is within 16, the sum is not
        ([[50.0, 150.0 + 7 * k] for k in range(6)], [0, 0, 0, 3, 3, 3]),
        ([[50.0, 150.0], [50.0, 150.0], [50.0, 190.0], [50.0, 190.0], [50.0, 190.0]], [2, 2, 2]),  # the first two begin nothing
        ([[50.0]] * 5, []), ([[50.0, 150.0]] * 2, []), ([[50.0, 150.0]] * 4, [0] * 4),
    ],
)
def test_grids_that_drift(spark, splits, want):
    got = B.table_runs(frame(spark, [(1, 1, [row(k, 12.0 * k, s) for k, s in enumerate(splits)])])).orderBy("line").collect()
    assert [g.run for g in got] == want


def test_joints_one_by_one(spark):
    base = row(0, 0.0, plain="uma linha comum do texto", width=250.0)
    hyphen = "a palavra no fim se quebra em ju-"
    cases = [
        ("space", {}, {"plain": "segue"}), ("break", {}, {"plain": "segue", "y": 19.0}), ("break", {}, {"plain": "segue", "size": 13.0}), ("break", {}, {"plain": "Despacho"}), ("break", {}, {"plain": "Autor: Fulano"}),
        ("break", {"plain": "Autor: Fulano"}, {"plain": "De tal"}), ("space", {"plain": "Autor: Fulano"}, {"plain": "de tal"}), ("break", {"plain": "DIÁRIO"}, {"plain": "segue"}), ("break", {}, {"plain": "fim ..... 3"}),
        ("break", {}, {"plain": "1. item"}), ("hyphen", {"plain": hyphen}, {"plain": "risdição", "y": 17.0}), ("space", {"plain": "curta ju-"}, {"plain": "risdição"}), ("break", {"width": 100.0}, {"plain": "Segue"}),
        ("space", {"width": 100.0}, {"plain": "segue"}), ("break", {"plain": "Acabou."}, {"plain": "Segue", "y": 13.0}), ("space", {"plain": "Acabou."}, {"plain": "Segue", "y": 12.0}), ("break", {}, {"plain": "Segue", "y": 17.5}),
    ]
    pages = [(k, 1, [base | p, base | {"line": 1, "y": 12.0} | q]) for k, (_, p, q) in enumerate(cases)]
    got = {j.doc_id: j.joint for j in B.joints(frame(spark, pages)).filter("line = 1").collect()}
    assert [got[k] for k in range(len(cases))] == [c[0] for c in cases]


def test_markdown_and_odd_rows(spark):
    ls = [
        row(0, 0.0, plain="DIÁRIO [1]"), row(1, 12.0, plain="texto", urls=["https://a.org"]), row(2, 40.0, plain="1. um"),
        row(3, 52.0, plain="2. dois", urls=["u", "v"]), *[row(k, 60.0 + 12 * k, [50.0, 150.0], cells=["a|b", f"c{k}"]) for k in (4, 5, 6)],
    ]
    md = B.markdown(B.lines_to_blocks(frame(spark, [(1, 1, ls)]))).first().md
    assert md == "## DIÁRIO \\[1\\]\n\n[texto](https://a.org)\n\n1. um\n2. dois (<u>, <v>)\n\n| a\\|b | c4 |\n| --- | --- |\n| a\\|b | c5 |\n| a\\|b | c6 |"
    short = frame(spark, [(1, 1, ls)]).select("doc_id", "page", "line", "plain", "x", "y", "width", "size", "edge")
    assert [b.kind for b in B.lines_to_blocks(short).orderBy("block").collect()] == ["heading", "para", "ol", "para"]
    assert B.lines_to_blocks(short.limit(0)).count() == 0
    null = short.selectExpr("doc_id", "page", "line", "cast(null as string) plain", "x", "cast(null as double) y", "width", "size", "edge")
    assert B.lines_to_blocks(null).count() == 0
