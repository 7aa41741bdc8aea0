"""The filter audit, the source audit and the license scan against plain Python."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lavra.llm import filter_audit, licenses, source_audit

DOCS = "doc_id long, text string, part string, size long, mask int, digest int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, p, 1, 7, 0) for i, t, p in rows], DOCS)  # extra columns clash with own names


def own(text):
    ws = re.findall("[^\x20\x09-\x0d]+", text)
    fails = [len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text))]
    return sum(1 << i for i, f in enumerate(fails) if f)


def by_hand(rows):
    """The masks, with null doc_ids after all others."""
    age = lambda i: (i is None, i or 0)
    first = {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", age(i)), age(i))
    return sorted((str(i), p, own(t or "") | (16 if age(i) > first[t or ""] else 0)) for i, t, p in rows)


def sample(n=600):
    """A third of the rows is one text; others are short, repetitive, loud, or have signs; ids are null or repeat."""
    r = random.Random(3)
    long_ = [" ".join(f"{'W' if k % 3 == 0 else 'w'}{r.randrange(90 if k % 2 else 900)}" for _ in range(230)) for k in range(12)]
    rows = []
    for i in range(n):
        text = "the hot text" if i % 3 == 0 else r.choice([*long_, "", None, " \t", "short", "a & b", "LOUD", "Ünï 🙂 çödé"])
        rows.append((None if i % 17 == 0 else i // 2 if i % 5 == 0 else i, text, r.choice(["a", "b", ""])))
    return rows


@pytest.mark.parametrize("per_range", [3, 10_000])
def test_masks(spark, monkeypatch, per_range):
    """Ranges of three rows cut the group of copies, the null ids and the repeated rows in many places."""
    monkeypatch.setattr(filter_audit, "ROWS_PER_RANGE", per_range)
    rows = sample()
    got = filter_audit.failures(docs(spark, rows).repartition(7)).collect()
    assert sorted((str(g.doc_id), g.part, g["mask"]) for g in got) == by_hand(rows)


def test_masks_of_rows_that_repeat_wholly(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "ROWS_PER_RANGE", 5)
    rows = [(4, "same", "a")] * 90 + [(5, "same", "a")] * 40 + [(None, "same", "b")] * 30 + [(None, "other", "b")] * 20
    got = filter_audit.failures(docs(spark, rows)).collect()
    assert sorted((str(g.doc_id), g.part, g["mask"]) for g in got) == by_hand(rows)


def test_masks_under_one_fingerprint(spark, monkeypatch):
    """Texts of equal fingerprints are told apart by themselves, over borders too."""
    monkeypatch.setattr(filter_audit, "ROWS_PER_RANGE", 4)
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *c: F.lit(1).cast("bigint"))
    rows = [(i, f"text {i % 4}", "a") for i in range(80)]
    got = filter_audit.failures(docs(spark, rows)).collect()
    assert sorted((str(g.doc_id), g.part, g["mask"]) for g in got) == by_hand(rows)


def test_report(spark):
    rows = sample()
    labels = [(1, 1, 0), (3, 1, 1), (3, 0, 1), (7, None, 1), (None, 1, 1), (11, 1, None), (999, 1, 1), *[(i, i % 2, i % 3 % 2) for i in range(20, 300)]]
    masked = [(None if i == "None" else int(i), p, m) for i, p, m in by_hand(rows)]
    failed = spark.createDataFrame(masked, "doc_id long, part string, mask int")
    got = filter_audit.report(filter_audit.part_counters(failed, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    want, shapley = {}, Counter()
    for part in {p for _, p, _ in masked}:
        for order in itertools.permutations("ABCDE"):
            left = [m for m in masked if m[1] == part]
            gone = []
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                now = [m for m in left if m[2] & bit]
                left = [m for m in left if not m[2] & bit]
                redundant = sum(1 for m in gone if m[2] & bit)
                gone += now
                only = sum(1 for m in masked if m[1] == part and m[2] == bit)
                want[part, "".join(order), step] = (len(left), len(now), redundant, only, sum(m[0] in good for m in now), sum(m[0] in toxic for m in now))
                shapley[part, f] += len(now)
    assert len(got) == len(want) == 3 * 600
    for g in got:
        assert (g.kept, g.removed, g.redundant, g.unique_fails, g.good_lost, g.toxic_lost) == want[g.part, g.filter_order, g.step]
        assert g.shapley == shapley[g.part, g.filter_order[g.step - 1]]


def test_divergence(spark):
    r = random.Random(5)
    vocabulary = ["Über", "a", "B", "çé", "x9y", "Zz", "naïve", "ÀB", "q"]
    rows = [(r.choice(["en", "de", None]), r.choice(["s", "S", "é", None, ""]), " ".join(r.choices(vocabulary, k=r.randrange(9))).replace("q", "q-Q_q")) for _ in range(60)]
    rows += [("fr", "alone", "un deux trois"), ("fr", "alone", "un"), ("it", "a", "uno"), ("it", "b", None), ("en", "empty", None)]
    rows += [rows[0]] * 3
    got = source_audit.divergence(spark.createDataFrame([(*x, 1, 2, "t") for x in rows], "lang string, source string, text string, n long, total long, term string").repartition(4), most_terms=3).collect()
    count, seen, groups = defaultdict(Counter), defaultdict(set), set()
    for i, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            count[lang, source][t] += 1
            seen[lang, t].add(i)
    want = []
    for lang, source in groups:
        kept = [t for (x, t), s in seen.items() if x == lang and len(s) >= 3]
        others = [s for x, s in groups if x == lang]
        whole = Counter()
        for s in others:
            whole.update(count[lang, s])
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept))  # noqa: B023, E731
        f = lambda a, b, t: (p(a, t) - p(b, t)) ** 2 // p(b, t)  # noqa: B023, E731
        mine = count[lang, source]
        pair = [(sum(f(mine, count[lang, o], t) for t in kept), o) for o in others if o != source]
        term = [(f(mine, whole, t), t) for t in kept if mine[t] and p(mine, t) > p(whole, t)]
        for part, xs in (("pair", pair), ("term", term)):
            for rank, (value, item) in enumerate(sorted(xs, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or rank <= 3:
                    want.append((lang, source, part, item, value, rank))
    assert sorted(map(tuple, got)) == sorted(want)
    assert ("fr", "alone") in groups and not any(w[0] == "fr" for w in want) and ("it", "a", "pair", "b", 0, 1) in want


def test_shares_of_large_counts(spark):
    df = spark.createDataFrame([(10**15 - 1, 3 * 10**15 + 7), (0, 10**17), (9 * 10**17, 9 * 10**17 + 1)], "n long, total long")
    got = df.select(source_audit.share(F.col("n"), F.col("total")).alias("p")).collect()
    assert [g.p for g in got] == [1 + 10**9 * (n + 1) // t for n, t in [(10**15 - 1, 3 * 10**15 + 7), (0, 10**17), (9 * 10**17, 9 * 10**17 + 1)]]


LICENSES = [
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"), ("MIT-License mit\nLICENSE", "mit"), ("mit einer Lizenz", ""), ("GPLv3 licence", "gpl-3.0"),
    ("GNU Lesser General Public License v2.1 or any later version", "gpl,lgpl-2.1-or-later"), ("the Affero General Public License, version 3", "agpl-3.0,gpl"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"), ("under the 3-clause BSD license", "bsd-3-clause"), ("CC BY-NC-SA 4.0 (Creative Commons)", "cc-by-nc-sa-4.0"),
    ("Mozilla Public License 1.1", "mpl-1.1"), ("Mozilla Public License 1.0", "mpl-1.0"), ("Mozilla Public Licence", "mpl"), (None, ""), ("", ""), ("Copyright (c) 2020 A. All rights reserved.", "all-rights-reserved,copyright"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated", "mit"), ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"), ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
]


def test_licenses(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    r = random.Random(7)
    heads = sorted({h for _, h, *_ in licenses.rules()} | {"license", "version", "2", "0", "3", "the", "under", "public", "general", "gnu", "or", "later"})
    texts = [t for t, _ in LICENSES] + [" licence ".join(r.sample([t for t, _ in LICENSES if t], 5)) for _ in range(30)]
    texts += [" ".join(r.choice(heads) for _ in range(400)) for _ in range(20)] + ["Apache License 2 " * 3000, "x " * 40 + "under the terms of the mit license" + " x" * 40]
    table = pa.table({"doc_id": pa.array([*range(len(texts) - 1), None], pa.int64()), "text": pa.array(texts, pa.string()), "base": [1] * len(texts), "places": [1] * len(texts)})
    pq.write_table(table, tmp_path / "documents.parquet")
    got = licenses.op13_license_scan(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({licenses.SQL['op13_license_scan']})").fetchall()
    got = got.collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    by_id = {texts[-1 if g.doc_id is None else g.doc_id]: g for g in got}
    assert {t: by_id[t].labels for t, _ in LICENSES} == dict(LICENSES)
    spam = by_id[texts[-2]]
    assert (spam.n_base, spam.first_word, spam.last_word, spam.labels) == (3000, 0, 8997, "apache,apache-2.0")


def test_many_hand_written_rules():
    made = licenses.rules()
    assert len({p for _, _, p, _, _ in made}) > 200 and [n for n, *_ in made] == list(range(len(made)))
    for *_, pattern, _, _ in made:
        re.compile(pattern)


def test_scan_keeps_columns_and_gives_spans(spark):
    df = spark.createDataFrame([("k", "All of it is released under the terms of the MIT License today.")], "key string, text string")
    row = licenses.scan(df).first()
    assert row.key == "k" and [(p.start, p.stop, p.label, p.sure) for p in row.places] == [(4, 12, "mit", 95)] and [(b["at"], b.label) for b in row.base] == [(10, "mit")]
