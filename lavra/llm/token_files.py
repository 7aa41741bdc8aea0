"""Token-id files with a minimal perfect hash index.

Documents are put in order of doc_id by ranges, encoded, and written as segments of about `SEGMENT_IDS` ids.
A segment holds the raw ids (little-endian unsigned 32 bits), its documents' keys in order, and an index:
a hash-and-displace minimal perfect hash over the keys, with a table of (fingerprint, offset, length) by
slot, so that a key is found in constant time and a key that is not there is told by its fingerprint.
Segments are rows of a Parquet table in the shared folder: any store that Spark writes will do, and
first_key / last_key let a reader skip segments.

Each piece of text that the vocabulary's pattern yields is encoded by the tokenizers library once and kept
in a bounded table, and so are the ids of what stands between blanks, as the same words come again and again.

Defined results: null is the empty text, which has the end id only; null doc_ids come first and are found
with key None; rows of one doc_id keep an order (by hash of the text) and are told apart by their occurrence
number; an empty table gives an empty file; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .bpe import _gather, byte_symbols, vocabulary_path
from .common import new_path, partitions, small_batches, table, tidied

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
SEGMENT_IDS = 1 << 20
#: Chunks and pieces, and characters of each, that a worker keeps; a full table keeps the frequent ones.
MOST_KNOWN = 500_000
MOST_CHARS = 16_000_000
#: White space but the blank itself.
WHITE = frozenset("\t\n\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
# Fixed value: the splitting pattern of byte-level vocabularies. Runs of letters and digits are tried first: they
# cannot begin at an apostrophe, so the pieces are the same.
PATTERN = r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
ENTRY = np.dtype([("fingerprint", "<u4"), ("length", "<u4"), ("offset", "<u8")])


class Table(dict):
    """Numbers of strings, given as they are asked for, and the ids of each number."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.chars = 0
        self.ids, self.starts, self.lengths, self.seen = np.empty(0, "<u4"), *(np.empty(0, np.int64) for _ in range(3))

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number

    def numbers(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def put(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Add the ids of the new numbers, in order."""
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(lengths) - lengths]
        self.lengths, self.ids = np.r_[self.lengths, lengths], np.r_[self.ids, ids]
        self.seen = np.r_[self.seen, np.zeros(len(lengths), np.int64)]
        self.chars += sum(map(len, self.new))
        self.new = []

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbers one after the other, and how many each has."""
        self.seen += np.bincount(at, minlength=len(self.seen))
        lengths = self.lengths[at]
        return _gather(self.ids, self.starts[at], lengths), lengths

    def thinned(self, most: int, most_chars: int) -> Table:
        """Itself, or, when it is full, a new one of what was asked for again, at most a quarter as much."""
        if len(self) < most and self.chars < most_chars:
            return self
        out, keys, kept = type(self)(), list(self), np.flatnonzero(self.seen > 1)
        kept = kept[np.argsort(-self.seen[kept], kind="stable")[: most // 4]].tolist()
        out.new = [keys[i] for i in kept]
        if sum(map(len, out.new)) > most_chars // 4:
            return type(self)()
        out.update(zip(out.new, range(len(kept)), strict=True))
        out.put(*self.of(np.array(kept, np.int64)))
        return out


class Chunks(Table):
    """Of what stands between blanks; the key of a text's start has a blank before it."""

    def __missing__(self, key: str) -> int:
        """A new number; -1 if white space follows the blank before the key."""
        return -1 if not key or key[0] in WHITE else super().__missing__(key)


def _keys(split: list[str]) -> list[str]:
    split[0] = " " + split[0]
    return split


class Encoder:
    """Ids of texts as bytes. The library encodes each piece that is not known. No piece reaches over a blank that has other
    than white space behind it, so a text is looked up by the chunks between such blanks, most of which came before."""

    def __init__(self, path: str, most: int = MOST_KNOWN, most_chars: int = MOST_CHARS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern, self.edge = regex.compile(PATTERN), regex.compile(r" (?=\P{White_Space})")
        self.by_piece = Tokenizer(self.tokenizer.model)  # takes pieces of byte symbols on lines of their own
        self.by_piece.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        symbols = byte_symbols()
        if lacking := [c for c in symbols if c not in vocab]:
            raise ValueError(f"the vocabulary lacks symbols of bytes: {lacking[:5]}")
        self.symbols = dict(enumerate(symbols)) | {0xFF: "\n"}  # no text in UTF-8 has that byte
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.n_bytes[list(vocab.values())] = [len(t) for t in vocab]
        self.most, self.most_chars = most, most_chars
        self.pieces, self.chunks = Table(), Chunks()

    def _learn_pieces(self) -> None:
        new = self.pieces.new
        for at in range(0, len(new), 20_000):
            raw = [p.encode() for p in new[at : at + 20_000]]
            line = b"\xff".join(raw).decode("latin-1").translate(self.symbols)
            got = np.array(self.by_piece.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.n_bytes[got]), np.cumsum([len(p) for p in raw])) + 1
            self.pieces.new = new[at : at + 20_000]
            self.pieces.put(got, np.diff(ends, prepend=0))

    def _learn_chunks(self) -> None:
        """Ids of the new chunks. A key that begins with a blank is the start of a text without that blank."""
        new, self.pieces = self.chunks.new, self.pieces.thinned(self.most, self.most_chars)
        odd = {i: self.pattern.findall(c[1:] if c[0] == " " else " " + c) for i, c in enumerate(new) if " " in c}
        plain = [c for c in new if " " not in c]
        found = self.pattern.findall(" " + " ".join(plain)) if plain else []
        first = np.flatnonzero(np.fromiter((p[0] == " " for p in found), bool, len(found)))  # a piece of each chunk
        counts = np.zeros(len(new), np.int64)
        is_odd = np.zeros(len(new), bool)
        is_odd[list(odd)] = True
        counts[~is_odd], counts[is_odd] = np.diff(first, append=len(found)), [len(x) for x in odd.values()]
        at = np.empty(counts.sum(), np.int64)
        of_odd = np.repeat(is_odd, counts)
        at[~of_odd], at[of_odd] = self.pieces.numbers(found), self.pieces.numbers([p for x in odd.values() for p in x])
        self._learn_pieces()
        ids, lengths = self.pieces.of(at)
        before = np.r_[0, np.cumsum(lengths)]
        to = np.cumsum(counts)
        self.chunks.put(ids, before[to] - before[to - counts])

    def encode(self, texts: list[str]) -> list[bytes]:
        self.chunks = self.chunks.thinned(self.most, self.most_chars)
        plain = [not any(s in t for s in self.special) for t in texts]
        at = []
        for t in (t if p else "" for t, p in zip(texts, plain, strict=True)):
            at.append(self.chunks.numbers(_keys(t.split(" "))))
            if at[-1].min() < 0:
                at[-1] = self.chunks.numbers(_keys(self.edge.split(t)))
        self._learn_chunks()
        ids, lengths = self.chunks.of(np.concatenate(at)) if at else (np.empty(0, "<u4"), np.empty(0, np.int64))
        ends = np.r_[0, np.cumsum(lengths)][np.cumsum([0, *map(len, at)])].tolist()
        return [
            ids[ends[i] : ends[i + 1]].tobytes() if p else np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
            for i, p in enumerate(plain)
        ]


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One encoder for each worker process, so that tasks that follow one another share its bounded table."""
    return Encoder(path)


def key_hash(keys: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """64-bit mix of unsigned 64-bit keys; an array of seeds is matched with the keys by broadcasting."""
    with np.errstate(over="ignore"):
        x = keys + (np.asarray(seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def as_keys(ids: np.ndarray, occurrences: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """Keys of rows: doc_id (0 where null), occurrence number, whether doc_id is null."""
    return key_hash(ids.astype(np.int64).view(np.uint64), 1000 + 2 * occurrences.astype(np.int64) + nulls)


def as_key(doc_id: int | None, occurrence: int = 0) -> np.uint64:
    return as_keys(np.array([doc_id or 0]), np.array([occurrence]), np.array([doc_id is None]))[0]


@dataclass(frozen=True)
class PerfectHash:
    """seeds[bucket]: a seed that spreads the bucket's keys over free slots, or -1 - slot for a single key."""

    n: int
    seeds: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        buckets = max(1, -(-n // 4))
        home = key_hash(keys, 0) % np.uint64(buckets)
        order = np.argsort(home, kind="stable")
        starts = np.searchsorted(home[order], np.arange(buckets + 1, dtype=np.uint64))
        sizes = np.diff(starts)
        seeds, taken = np.zeros(buckets, np.int32), np.zeros(n, bool)
        by_size = np.argsort(-sizes, kind="stable")
        for b in by_size[sizes[by_size] > 1]:
            own = keys[order[starts[b] : starts[b + 1]]]
            at, width = 1, 16
            while True:  # the least seed that serves, looked for in growing blocks
                slots = key_hash(own[None, :], np.arange(at, at + width)[:, None]) % np.uint64(n)
                apart = np.diff(np.sort(slots, axis=1), axis=1).all(axis=1)
                good = np.flatnonzero(apart & ~taken[slots].any(axis=1))
                if len(good):
                    break
                at, width = at + width, min(4 * width, 4096)
            seeds[b], taken[slots[good[0]]] = at + good[0], True
        single = by_size[sizes[by_size] == 1]
        seeds[single] = -1 - np.flatnonzero(~taken)[: len(single)]
        return cls(n, seeds)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot below n for any key; for the keys it was built on, each its own."""
        seed = self.seeds[key_hash(keys, 0) % np.uint64(len(self.seeds))].astype(np.int64)
        spread = (key_hash(keys, np.maximum(seed, 0)) % np.uint64(self.n)).astype(np.int64)
        return np.where(seed < 0, -1 - seed, spread)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (key_hash(keys, 999_983) >> np.uint64(32)).astype(np.uint32)


SEGMENT = "segment bigint, first_key bigint, last_key bigint, n_docs bigint, n_ids bigint, keys binary, occurrences binary, nulls binary, seeds binary, entries binary, payload binary"


def _segment(number: int, docs: list[tuple[int | None, int, bytes]]) -> dict:
    numbers = np.array([d or 0 for d, _, _ in docs], "<i8")
    occurrences, nulls = np.array([o for _, o, _ in docs], "<i4"), np.array([d is None for d, _, _ in docs], bool)
    keys = as_keys(numbers, occurrences, nulls)
    index = PerfectHash.build(keys)
    lengths = np.array([len(p) // 4 for _, _, p in docs], np.uint64)
    entries = np.zeros(len(docs), ENTRY)
    at = index.slots(keys)
    entries["fingerprint"][at], entries["length"][at] = fingerprint(keys), lengths
    entries["offset"][at] = np.cumsum(lengths) - lengths
    ids = [d for d, _, _ in docs if d is not None]
    return {
        "segment": number, "first_key": ids[0] if ids else None, "last_key": ids[-1] if ids else None, "n_docs": len(docs), "n_ids": int(lengths.sum()),
        "keys": numbers.tobytes(), "occurrences": occurrences.tobytes(), "nulls": nulls.tobytes(),
        "seeds": index.seeds.astype("<i4").tobytes(), "entries": entries.tobytes(), "payload": b"".join(p for _, _, p in docs),
    }


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode docs(doc_id, text) and write the file, in ascending doc_id."""
    spark = docs.sparkSession
    schema = pa.schema([(n, {"bigint": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in SEGMENT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = encoder_of(vocabulary), np.array([end_id], "<u4").tobytes()
        number, held, waiting = TaskContext.get().partitionId() << 32, 0, []
        last, occurrence = object(), 0
        for b in small_batches(batches, most_bytes=4 << 20):
            for d, payload in zip(b["doc_id"].to_pylist(), encoder.encode([t or "" for t in b["text"].to_pylist()]), strict=True):
                last, occurrence = d, occurrence + 1 if d == last else 0
                waiting.append((d, occurrence, payload + end))
                held += len(payload) // 4 + 1
                if held >= segment_ids:
                    yield pa.RecordBatch.from_pylist([_segment(number, waiting)], schema)
                    number, held, waiting = number + 1, 0, []
        if waiting:
            yield pa.RecordBatch.from_pylist([_segment(number, waiting)], schema)

    n = partitions(spark, docs.count(), 4096)
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(tidied(run), SEGMENT).write.parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT).parquet(path)


def lookup(row: dict, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
    """The ids of one document of a segment, by its index; None if the segment lacks it."""
    key = np.array([as_key(doc_id, occurrence)], np.uint64)
    entries = np.frombuffer(row["entries"], ENTRY)
    if not len(entries):
        return None
    e = entries[PerfectHash(len(entries), np.frombuffer(row["seeds"], "<i4")).slots(key)[0]]
    if e["fingerprint"] != fingerprint(key)[0]:
        return None
    return np.frombuffer(row["payload"], "<u4", int(e["length"]), int(e["offset"]) * 4)


def find(spark: SparkSession, path: str, doc_id: int | None, occurrence: int = 0) -> list[int] | None:
    """Keyed access: only segments whose range holds the key are read (for None those that hold a null)."""
    within = (F.col("first_key") <= doc_id) & (F.col("last_key") >= doc_id) if doc_id is not None else F.expr("exists(sequence(1, length(nulls)), i -> substring(nulls, i, 1) = X'01')")
    near = segments(spark, path).filter(within).select("seeds", "entries", "payload")
    for row in near.toLocalIterator():  # one segment, or the few that share an edge
        got = lookup(row.asDict(), doc_id, occurrence)
        if got is not None:
            return got.tolist()
    return None


def read(spark: SparkSession, path: str) -> DataFrame:
    """All documents of a file by its index: doc_id, start, n_tokens, ids_crc32, segment, found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, occurrences, nulls = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["occurrences"], "<i4"), np.frombuffer(row["nulls"], bool)
                keys = as_keys(ids, occurrences, nulls)
                entries = np.frombuffer(row["entries"], ENTRY)
                e = entries[PerfectHash(len(entries), np.frombuffer(row["seeds"], "<i4")).slots(keys)]
                payload = memoryview(row["payload"])
                crc = [zlib.crc32(payload[o * 4 : (o + n) * 4]) for o, n in zip(e["offset"].tolist(), e["length"].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=nulls), pa.array(e["offset"].astype(np.int64)), pa.array(e["length"].astype(np.int64)), pa.array(crc, pa.int64()),
                     pa.array(np.full(len(ids), row["segment"])), pa.array(e["fingerprint"] == fingerprint(keys))],
                    ["doc_id", "at", "n_tokens", "ids_crc32", "segment", "found"],
                )

    every = segments(spark, path)
    rows = every.select("segment", "keys", "occurrences", "nulls", "seeds", "entries", "payload").mapInArrow(
        run, "doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint, segment bigint, found boolean"
    )
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # one row for each million ids
    base = every.select("segment", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return rows.join(base, "segment").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "segment", "found")


def op2_hash_indexed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written, and read back by the index."""
    path = new_path(spark, "token-ids")
    write(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path(VOCABULARY), path)
    lost = F.raise_error(F.lit("the index lacks a document of its own segment"))
    rows = read(spark, path).withColumn("start", F.when(F.col("found"), F.col("start")).otherwise(lost.cast("bigint")))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


SQL: dict[str, str] = {}
