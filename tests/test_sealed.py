"""Sealed backups: round trip, the tree against plain Python, and what is refused."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lavra.operators import sealed
from lavra.operators import store as B


@pytest.fixture(scope="module")
def entries(spark):
    docs = spark.range(200).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("texto çé "), F.col("id").cast("string")).alias("faithful"))
    return B.backup(docs, spark.createDataFrame([("1", bytes([0x25, 0x50, 0, 0xFF])), ("7", b"")], "id string, data binary")).cache()


def test_round_trip_and_tree(spark, entries, tmp_path):
    told = sealed.seal(entries.repartition(5), str(tmp_path / "b"))
    assert (told["docs"], told["blobs"]) == (200, 2) and sealed.levels(202) == 1
    got = {(r.kind, r.id): bytes(r.data) for r in sealed.unseal(spark, str(tmp_path / "b")).collect()}
    assert got["blob", "1"] == bytes([0x25, 0x50, 0, 0xFF]) and got["blob", "7"] == b"" and json.loads(got["doc", "5"])["faithful"] == "texto çé 5"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    packed = lambda **x: json.dumps(x, separators=(",", ":"))
    groups: dict[str, list[str]] = {}
    for r in entries.collect():
        groups.setdefault(sha(packed(kind=r.kind, id=r.id))[:1], []).append(sha(packed(kind=r.kind, id=r.id, bytes=r.bytes, sha256=r.sha256)))
    assert told["digest"] == sha(",".join(sorted(sha(",".join(sorted(g))) for g in groups.values())))
    assert sealed.seal(entries.limit(0), str(tmp_path / "e"))["docs"] == 0 and sealed.unseal(spark, str(tmp_path / "e")).count() == 0


def test_one_change_is_refused(spark, entries, tmp_path):
    told = sealed.manifest(entries)
    other = F.regexp_replace(F.base64(F.concat(F.unbase64("payload"), F.lit(b"x"))), "\\s", "")
    one = (F.col("kind") == "doc") & (F.col("id") == "9")
    changed = {
        "payload": entries.withColumn("payload", F.when(one, other).otherwise(F.col("payload"))),
        "payload and its digest": entries.withColumn("sha256", F.when(one, F.sha2(F.concat(F.unbase64("payload"), F.lit(b"x")), 256)).otherwise(F.col("sha256"))).withColumn("payload", F.when(one, other).otherwise(F.col("payload"))),
        "stated digest": entries.withColumn("sha256", F.when(one, F.lit("0" * 64)).otherwise(F.col("sha256"))),
        "no base64": entries.withColumn("payload", F.when(one, F.lit("%")).otherwise(F.col("payload"))),
        "missing": entries.filter(~one), "twice": entries.unionByName(entries.filter(one)), "renamed": entries.withColumn("id", F.when(one, F.lit("999")).otherwise(F.col("id"))),
    }
    for k, (name, rows) in enumerate(changed.items()):
        rows.write.parquet(str(tmp_path / str(k) / "entries"))
        spark.createDataFrame([(json.dumps(told),)], "value string").write.text(str(tmp_path / str(k) / "manifest"))
        with pytest.raises(sealed.Broken):
            sealed.unseal(spark, str(tmp_path / str(k)))
            pytest.fail(name)
    for k, text in enumerate([json.dumps(told | {"bytes": told["bytes"] + 1}), json.dumps(told | {"version": 2}), "{", json.dumps(told | {"digest": "0" * 64})]):
        path = tmp_path / f"m{k}"
        entries.write.parquet(str(path / "entries"))
        spark.createDataFrame([(text,)], "value string").write.text(str(path / "manifest"))
        with pytest.raises(sealed.Broken):
            sealed.unseal(spark, str(path))


def test_query_of_many_entries_is_its_sql(spark, tmp_path):
    """26,250 entries, over the 16,384 from which the operator's own tree has three levels."""
    import duckdb

    from lavra.plans import registry

    rows = "SELECT range AS c_custkey, 'Customer#' || range AS c_name, 1::INT AS c_nationkey, 0.5::DOUBLE AS c_acctbal, 'M' || range % 5 AS c_mktsegment FROM range(15000)"
    con = duckdb.connect()
    con.sql(f"COPY ({rows}) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    want = con.sql(registry.SQL["backup_seal"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["backup_seal"](spark, str(tmp_path)).collect()]
    assert got == want and sealed.levels(got[0][2] + got[0][3]) == 3
