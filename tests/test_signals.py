"""The cursor of the stream of signals: pages, restarts, repeats, a shortened log."""

import pyarrow as pa
import pyarrow.parquet as pq

from lavra.streaming import signals


def put(folder, name, ids, **more):
    folder.mkdir(exist_ok=True)
    n = len(ids)
    columns = {"id": pa.array(ids, pa.int64()), "sender": pa.array(["a"] * n), "kind": pa.array([None] * n, pa.string()), "payload": pa.array([f"{name}-{i}" for i in ids])}
    pq.write_table(pa.table(columns | more), folder / f"{name}.parquet")


def test_pages(tmp_path):
    log = tmp_path / "log"
    pages = signals._Pages(f"file://{log}", 3)
    assert pages.read({"since": 0})[1] == {"since": 0}
    put(log, "y", [9, 4, 4, None, 1, 4])
    put(log, "x", [2, 9], other=pa.array([1, 2]))
    at, seen = pages.initialOffset(), []
    for _ in range(5):
        before = at
        rows, at = pages.read(at)
        rows = list(rows)
        assert sorted(rows) == sorted(pages.readBetweenOffsets(before, at))
        seen.append([r[0] for r in rows])
    assert seen == [[1, 2, 4, 4, 4], [9, 9], [], [], []] and at == {"since": 9}


def test_restart_and_repeats(spark, tmp_path):
    spark.dataSource.register(signals.Signals)
    log, out = tmp_path / "log", tmp_path / "out"

    def drain():
        stream = spark.readStream.format("signals").option("limit", 4).load(str(log)).writeStream.format("parquet")
        query = stream.option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r["payload"] for r in spark.read.schema(signals.SCHEMA).parquet(str(out)).collect())

    put(log, "a", list(range(1, 11)))
    first = drain()
    assert first == sorted(f"a-{i}" for i in range(1, 11))
    put(log, "b", [3, 10, 11, 12])  # two of them were given before
    assert drain() == sorted(first + ["b-11", "b-12"])
    (log / "b.parquet").unlink()  # the greatest id of the log is below the cursor now
    assert len(drain()) == 12
    put(log, "c", [12, 13])
    assert drain() == sorted(first + ["b-11", "b-12", "c-13"])
