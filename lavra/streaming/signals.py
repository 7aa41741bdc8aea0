"""A stream of small signals by a cursor: each page is what a log holds beyond the greatest id given so far.

    spark.dataSource.register(signals.Signals)
    spark.readStream.format("signals").option("limit", 1000).load(folder)

The log is a folder, mounted where the driver runs, of Parquet files with id, sender, kind and payload; new files may come at any time. The cursor is the
stream's offset, kept in its checkpoint, and only grows: rows whose id is not beyond it are never given again, whether
they are repeated in a later file or the log was shortened. Rows of one id that are there together are given together, so
a page may be longer than its limit; those that come later with an id already passed are late and not given, as for any
poll by a cursor. A null id has no place and is not given; null values of other columns are; more columns are left out;
an empty or missing folder gives nothing yet.

A page is read by the driver and holds at most `limit` rows beside those of its last id: this is for signals. Documents
come by ingest.arriving, whose files the executors read."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "id bigint, sender string, kind string, payload string"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class _Pages(SimpleDataSourceStreamReader):
    def __init__(self, folder: str, limit: int) -> None:
        self.folder, self.limit = folder, limit

    def _between(self, since: int, end: int | None) -> pa.RecordBatchReader | list:
        at = self.folder.removeprefix("file://")
        if not Path(at).is_dir():
            return []
        files = pads.dataset(sorted(map(str, Path(at).glob("*.parquet"))), format="parquet")
        if not files.files:
            return []
        beyond = pc.field("id") > since
        return files.to_batches(columns=_COLUMNS, filter=beyond if end is None else beyond & (pc.field("id") <= end))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"since": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """The next page: the rows of the least ids beyond the cursor."""
        page = None
        for batch in self._between(start["since"], None):
            got = pa.Table.from_batches([batch])
            page = (got if page is None else pa.concat_tables([page, got])).sort_by("id")
            if page.num_rows > self.limit:  # never more than a page and a batch
                page = page.filter(pc.field("id") <= page["id"][self.limit - 1])
        if page is None or page.num_rows == 0:
            return iter([]), start
        return _rows(page), {"since": max(start["since"], page["id"][-1].as_py())}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """A page again, after a failure."""
        for batch in self._between(start["since"], end["since"]):
            yield from _rows(pa.Table.from_batches([batch]).sort_by("id"))


def _rows(page: pa.Table) -> Iterator[tuple]:
    return iter([tuple(r[c] for c in _COLUMNS) for r in page.to_pylist()])


class Signals(DataSource):
    @classmethod
    def name(cls) -> str:
        return "signals"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Pages(self.options["path"], int(self.options.get("limit", 1000)))
