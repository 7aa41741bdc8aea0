"""A versioned store of tables. A version is a commit: a small file that lists, for each table, the folders that hold
its rows, and notes. A write that replaces lists new folders only; one that appends lists the folders of the version
before and new ones, so that what is written grows with what is new.

A commit is written whole under a name of its own and then renamed to its number, which must not exist: a crash
leaves no half commit, only folders that none lists. A writer names the version it has read; if another one was
committed since, its rename fails and so does it. The rename is atomic on HDFS and on local file systems up to a
short race between two writers of one machine; on an object store without rename, put `commits` on one that has it.

Each row of a table is in the folder of the write that brought it. `compact` lists one folder in place of many.
Readers of a version see its folders only, so that nothing they read is ever changed or removed."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_NOTE = "note"


class Conflict(Exception):
    """Another version was committed since the one that was read."""


class Failed(Exception):
    """An earlier write through this writer failed; it takes no other until told to retry."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def version(spark: SparkSession, path: str) -> int:
    """Number of the version in force; 0 for a store without any."""
    fs, at = _fs(spark, f"{path}/commits")
    if not fs.exists(at):
        return 0
    return max((int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()), default=0)


def _entries(spark: SparkSession, path: str, number: int) -> list[tuple[str, str]]:
    """Lines of a commit: table and folder, or 'note' and its text."""
    if number == 0:
        return []
    rows = spark.read.text(f"{path}/commits/{number}", wholetext=True).collect()  # a line for each folder
    return [tuple(line.split("\t", 1)) for line in rows[0]["value"].splitlines() if line]


def notes(spark: SparkSession, path: str, number: int) -> set[str]:
    """What commits up to a version have noted."""
    return {text for kind, text in _entries(spark, path, number) if kind == _NOTE}


def folders(spark: SparkSession, path: str, table: str, number: int) -> list[str]:
    return [f"{path}/data/{folder}/{table}" for name, folder in _entries(spark, path, number) if name == table]


def read(spark: SparkSession, path: str, table: str, number: int | None = None) -> DataFrame:
    """A table of a version, the one in force unless a number is given."""
    number = version(spark, path) if number is None else number
    parts = folders(spark, path, table, number)
    if not parts:
        raise FileNotFoundError(f"no {table} in version {number} of {path}")
    return spark.read.parquet(*parts)


def _commit(spark: SparkSession, path: str, entries: list[tuple[str, str]], number: int) -> int:
    jvm = spark.sparkContext._jvm
    fs, temporary = _fs(spark, f"{path}/commits/_{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    out.write(bytearray("".join(f"{kind}\t{text}\n" for kind, text in entries).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(temporary, _fs(spark, f"{path}/commits/{number}")[1], rename)
    except Py4JJavaError as e:
        fs.delete(temporary, False)
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise Conflict(f"version {number} of {path} was committed by another writer") from e
        raise
    return number


def _put(spark: SparkSession, path: str, tables: dict[str, DataFrame], based_on: int) -> list[tuple[str, str]]:
    if version(spark, path) != based_on:
        raise Conflict(f"{path} is no longer at version {based_on}")
    name = uuid.uuid4().hex
    for table, df in tables.items():
        df.write.parquet(f"{path}/data/{name}/{table}")
    return [(table, name) for table in tables]


def write(spark: SparkSession, path: str, tables: dict[str, DataFrame], based_on: int, note: str | None = None) -> int:
    """Write all tables as one version that has nothing else; gives its number. based_on: the version that the
    tables come from."""
    entries = _put(spark, path, tables, based_on)
    return _commit(spark, path, entries + ([(_NOTE, note)] if note else []), based_on + 1)


def append(spark: SparkSession, path: str, tables: dict[str, DataFrame], based_on: int, note: str | None = None) -> int:
    """Add rows to tables, which may be new; other tables and all notes stay. Gives the new version's number."""
    entries = _put(spark, path, tables, based_on)
    return _commit(spark, path, _entries(spark, path, based_on) + entries + ([(_NOTE, note)] if note else []), based_on + 1)


def compact(spark: SparkSession, path: str, table: str, based_on: int) -> int:
    """A version in which a table's rows are in one folder; notes and other tables stay."""
    own = _put(spark, path, {table: read(spark, path, table, based_on)}, based_on)
    return _commit(spark, path, [e for e in _entries(spark, path, based_on) if e[0] != table] + own, based_on + 1)


class Writer:
    """Writes that go one after the other and stop at the first failure: every later one is refused with the cause
    until `retry` is called, which reads the version in force again. Nothing is lost meanwhile: what was refused was
    never written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.failure = spark, path, None
        self.at = version(spark, path)

    def put(self, tables: dict[str, DataFrame], note: str | None = None, replace: bool = True) -> int:
        if self.failure:
            raise Failed("an earlier write failed") from self.failure
        try:
            self.at = (write if replace else append)(self.spark, self.path, tables, self.at, note)
        except Exception as e:
            self.failure = e
            raise
        return self.at

    def retry(self) -> int:
        """Take writes again, on the version in force now."""
        self.failure, self.at = None, version(self.spark, self.path)
        return self.at
