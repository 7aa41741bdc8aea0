"""Changes and their undoing against lists of states."""

import random

from lavra.operators import history as H

SCHEMA = "doc_id long, state int, act string"


def test_random_changes(spark):
    r = random.Random(19)
    plain = {d: [[f"{d}a", f"{d}b"]] for d in range(6)}  # states, today's last
    rows = lambda: spark.createDataFrame([(d, None if k == len(ss) - 1 else k, a) for d, ss in plain.items() for k, s in enumerate(ss) for a in s], SCHEMA)
    now = rows()
    for turn in range(7):
        some = r.sample(range(6), 3)
        if turn in (2, 5):
            now = H.undo(now, spark.createDataFrame([(d,) for d in [*some, some[0], 99]], "doc_id long"))
            for d in some:
                if len(plain[d]) > 1:
                    plain[d].pop()
        else:
            new = {d: [f"{d}{turn}{k}" for k in range(r.randrange(1, 3))] for d in some}
            now = H.push(now, spark.createDataFrame([(d, a) for d, acts in new.items() for a in acts], "doc_id long, act string"), most=2)
            for d, acts in new.items():
                plain[d] = [*plain[d], acts][-3:]
        now = spark.createDataFrame(now.collect(), SCHEMA)
    for back in (0, 1, 2, 3):
        got: dict[int, list[str]] = {}
        for x in H.version(now, back).collect():
            got.setdefault(x.doc_id, []).append(x.act)
        assert {d: sorted(a) for d, a in got.items()} == {d: sorted(ss[-1 - back]) for d, ss in plain.items() if len(ss) > back}


def test_odd_rows(spark):
    acts = spark.createDataFrame([(None, None, "x"), (None, 0, "y"), (1, None, "a"), (2, None, "b"), (2, 0, "c")], SCHEMA)
    assert sorted(map(tuple, H.undo(acts, acts.select("doc_id")).collect()), key=str) == sorted([(None, None, "x"), (None, 0, "y"), (1, None, "a"), (2, None, "c")], key=str)
    new = spark.createDataFrame([(7, "n")], "doc_id long, act string")
    assert H.push(acts, new).count() == 6 and H.push(acts.limit(0), new).collect() == [(7, None, "n")] and H.undo(acts.limit(0), new).count() == 0
