"""Substring dedup: windows of words that start in an earlier document are removed.

The suffixes of all documents (each word starts one) are split by their first words: prefixes of one word
first, and a prefix that more than `limit` suffixes share is lengthened by a word until it fits or is `WINDOW`
words long (then it is a single deep node). Sizes come from one counting pass: a slice of the text reports the
prefixes, of every length, that hold at least half of the share limit / all of its suffixes, so that a sum is
short by less than limit / 2, and a prefix is lengthened above limit / 2. Short prefixes are packed together
into groups of about limit / 2 suffixes; a group is one subtree, held as its sorted suffixes: neighbours whose
common prefix has `WINDOW` words or more are below one deep node. The label of that node is kept as a 64-bit
hash; labels are compared inside a group only, so that of n windows about n * limit / 2 ** 65 pairs are
confused (0.3 pairs for 10 ** 13 windows in groups of 2 ** 20).

A slice first merges its own suffixes: of a repeated window only the least document of the slice is sent on,
and the slice's other documents are told at once. So a window that a third of all documents hold is one row
for each slice in the subtree's task. Subtrees answer to ranges of documents, which then cut the marked
windows out of their texts: three exchanges, one of them of the texts.

Defined results: null and blank texts have no words; texts shorter than a window keep all; windows that
repeat inside one document only stay; rows of one doc_id are the same document; a null doc_id comes after
all others (its rows are spread by a hash of their text); an empty table gives an empty result; other
columns pass through `clean`, those named n_words, n_removed and spans are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import give_back, table, tidied, word_hashes

WINDOW = 13
_SPACE = re.compile("[\x20\x09-\x0d]+")
#: Suffixes that may share a prefix: at least this many, more only where there would be over MOST_GROUPS groups.
LIMIT = 1 << 20
MOST_GROUPS = 1 << 18
#: Documents for each range of the last step.
RANGE_DOCS = 1024
#: Words that are sorted at once: some ten arrays of 8 bytes a word.
SLICE_WORDS = 800_000
_PHI = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LAST = (1 << 63) - 1
#: The seed of Spark's xxhash64, so that words hashed here are those hashed there.
SPARK_SEED = 42


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def window_starts(offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Place of each window's first word, and the number of its document."""
    counts = np.maximum(0, np.diff(offsets) - size + 1)
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    return np.arange(len(doc)) + np.repeat(offsets[:-1] - np.cumsum(counts) + counts, counts), doc


def window_hashes(flat: np.ndarray, start: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Hash of the window of word hashes (uint64) at each start."""
    x = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            x *= _PHI
            x += flat[start + j]
    return _mix(x)


def longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a prefix and one more word, independent of `window_hashes`."""
    with np.errstate(over="ignore"):
        return _mix((prefix ^ _PHI) * _STEP + word)


def frequent(flat: np.ndarray, start: np.ndarray, share: float, size: int = WINDOW) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, prefixes, counts) of the prefixes that hold at least `share` of the suffixes at start."""
    least = max(2.0, share * len(start))
    prefix = np.zeros(len(start), np.uint64)
    for length in range(1, size):
        prefix = longer(prefix, flat[start + length - 1])
        names, turn, counts = np.unique(prefix, return_inverse=True, return_counts=True)
        heavy = counts >= least
        if not heavy.any():
            return
        yield length, names[heavy], counts[heavy]
        go = heavy[turn]
        start, prefix = start[go], prefix[go]


def closed_prefixes(flat: np.ndarray, start: np.ndarray, opened: list[np.ndarray]) -> np.ndarray:
    """The shortest prefix of each suffix that is not open; opened[i]: sorted open prefixes of i + 1 words."""
    prefix = longer(np.zeros(len(start), np.uint64), flat[start])
    at = np.arange(len(start))
    for length, names in enumerate(opened, 1):
        if not len(names) or not len(at):
            break
        p = prefix[at]
        at = at[names[np.minimum(np.searchsorted(names, p), len(names) - 1)] == p]
        prefix[at] = longer(prefix[at], flat[start[at] + length])
    return prefix


def covered(n_words: int, starts: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Which words lie in a window that begins at one of starts."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _planes(x: np.ndarray) -> bytes:
    """Sorted unsigned numbers as byte planes of their differences, which compress well."""
    return np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


_SENT = "bucket bigint, to_range int, hashes binary, docs binary, ids binary, salts binary"
_SENT_SCHEMA = pa.schema([("bucket", pa.int64()), ("to_range", pa.int32()), *((c, pa.binary()) for c in ("hashes", "docs", "ids", "salts"))])


def _small(x: np.ndarray) -> bytes:
    """Numbers from 0 as byte planes of the least width that holds them, after a byte with that width."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_small(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    return sum((plane.astype(np.int64) << (8 * i) for i, plane in enumerate(planes)), np.int64(0))


def _long_hash(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """xxHash64 of 8 bytes each, as Spark's xxhash64 takes a bigint."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    with np.errstate(over="ignore"):
        k = x * p2
        h = (seed + p5 + np.uint64(8)) ^ (((k << np.uint64(31)) | (k >> np.uint64(33))) * p1)
        h = ((h << np.uint64(27)) | (h >> np.uint64(37))) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def _range_of(ids: np.ndarray, salts: np.ndarray, ranges: int) -> np.ndarray:
    """`range_number` in numpy."""
    x = _long_hash(salts.view(np.uint64), _long_hash(ids.view(np.uint64), np.uint64(SPARK_SEED)))
    return (x.view(np.int64) % ranges).astype(np.int32)


def range_number(own: Column, salt: Column, ranges: int) -> Column:
    return F.pmod(F.xxhash64(own, salt), F.lit(ranges)).cast("int")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Flat word hashes, offsets, ids and salts of about SLICE_WORDS words at a time (one document at least)."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def joined() -> tuple[np.ndarray, ...]:
        flat, lengths, ids, salts = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return flat, np.r_[0, np.cumsum(lengths)], ids, salts

    for b in batches:
        offsets = b["h"].offsets.to_numpy().astype(np.int64)
        flat = b["h"].values.to_numpy(zero_copy_only=False).view(np.uint64)
        ids, salts = b["id"].to_numpy(), b["salt"].to_numpy()
        at = 0
        while at < len(ids):
            to = min(len(ids), max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_WORDS - n, "right")) - 1))
            held.append((flat[offsets[at] : offsets[to]].copy(), np.diff(offsets[at : to + 1]), ids[at:to].copy(), salts[at:to].copy()))
            n += int(offsets[to] - offsets[at])
            at = to
            if n >= SLICE_WORDS:
                yield joined()
                n = 0
    if held:
        yield joined()


def _answers(hashes: np.ndarray, docs: np.ndarray, ids: np.ndarray, salts: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(range, hashes, docs, ids) of marked windows; docs: places in ids."""
    if not len(docs):
        return
    to = _range_of(ids, salts, ranges)[docs]
    order = np.lexsort((hashes, to))
    to, hashes, docs = to[order], hashes[order], docs[order]
    starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    for a, b in zip(starts, [*starts[1:], len(to)], strict=True):
        own, place = np.unique(ids[docs[a:b]], return_inverse=True)
        yield int(to[a]), _planes(hashes[a:b]), _small(place), _planes(own.view(np.uint64))


def _count(share: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, offsets, _, _ in _slices(batches):
            start, _ = window_starts(offsets, size)
            found = [(0, np.zeros(1, np.uint64), np.array([len(start)])), *frequent(flat, start, share, size)]
            columns = np.concatenate([np.full(len(p), n) for n, p, _ in found]), np.concatenate([p for _, p, _ in found]), np.concatenate([c for *_, c in found])
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1].view(np.int64)), pa.array(columns[2], pa.int64())], ["length", "prefix", "n"])

    return run


def _send(opened: list[np.ndarray], buckets: int, ranges: int, size: int):
    def one(flat: np.ndarray, offsets: np.ndarray, ids: np.ndarray, salts: np.ndarray) -> Iterator[pa.RecordBatch]:
        by_id = np.lexsort((salts, ids))
        rank = np.empty(len(ids), np.int32)
        rank[by_id] = np.arange(len(ids))
        ids, salts = ids[by_id], salts[by_id]
        start, doc = window_starts(offsets, size)
        if not len(start):
            return
        h, d = window_hashes(flat, start, size), rank[doc]
        bucket = (closed_prefixes(flat, start, opened) % np.uint64(buckets)).astype(np.int64)
        del start, doc
        order = np.lexsort((d, h))
        h, d, bucket = h[order], d[order], bucket[order]
        del order
        new_row = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
        h, d, bucket = h[new_row], d[new_row], bucket[new_row]
        first = np.r_[True, h[1:] != h[:-1]]
        least = ids[d[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]]
        later = ids[d] > least
        rows: list[tuple] = []
        for to, hs, ds, own in _answers(h[later], d[later], ids, salts, ranges):
            rows.append((to % buckets, to, hs, ds, own, None))
        h, d, bucket = h[~later], d[~later], bucket[~later]
        order = np.argsort(bucket, kind="stable")
        h, d, bucket = h[order], d[order], bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(starts, [*starts[1:], len(h)], strict=True):
            own, place = np.unique(d[a:b], return_inverse=True)
            rows.append((int(bucket[a]), None, _planes(h[a:b]), _small(place), _planes(ids[own].view(np.uint64)), salts[own].tobytes() if salts[own].any() else None))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SENT_SCHEMA)], schema=_SENT_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _slices(batches):
            yield from one(*piece)

    return run


def _subtree(ranges: int):
    """Deep nodes of one group of prefixes: every document of a window but its least is marked."""

    def marks(group: pa.Table) -> pa.Table:
        to, hashes, docs, ids, salts, n = [], [], [], [], [], 0
        for t, h, d, i, s in zip(*(group[c].to_pylist() for c in ("to_range", "hashes", "docs", "ids", "salts")), strict=True):
            if t is not None:
                to.append((t, h, d, i))
                continue
            own = _from_planes(i).view(np.int64)
            hashes.append(_from_planes(h))
            docs.append((_from_small(d) + n).astype(np.int32))
            ids.append(own)
            salts.append(np.zeros(len(own), np.int64) if s is None else np.frombuffer(s, np.int64))
            n += len(own)
        if hashes:
            h, d, i, s = np.concatenate(hashes), np.concatenate(docs), np.concatenate(ids), np.concatenate(salts)
            hashes.clear(), docs.clear()
            order = np.lexsort((i[d], h))
            h, d = h[order], d[order]
            first = np.r_[True, h[1:] != h[:-1]]
            least = i[d[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]]
            marked = i[d] > least
            to += _answers(h[marked], d[marked], i, s, ranges)
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({c: pa.array([x[k] for x in to], kind) for k, (c, kind) in enumerate(zip(("to_range", "hashes", "docs", "ids"), kinds, strict=True))})

    def run(group: pa.Table) -> pa.Table:
        out = marks(group)
        give_back()
        return out

    return run


def open_prefixes(rows: DataFrame, most_words: int, size: int, limit: int) -> tuple[list[np.ndarray], int]:
    """Prefixes to be lengthened, by length, and the number of suffixes. rows(id, salt, h). At most
    2 * MOST_GROUPS prefixes of each length reach the driver, since each holds over limit / 2 suffixes."""
    counted = rows.mapInArrow(tidied(_count(limit / 2 / max(1, most_words), size)), "length int, prefix bigint, n bigint")
    found = counted.groupBy("length", "prefix").agg(F.sum("n").alias("n")).filter((F.col("length") == 0) | (F.col("n") > limit // 2)).collect()
    of = lambda k: np.sort(np.array([r["prefix"] for r in found if r["length"] == k], np.int64).view(np.uint64))
    return [of(k) for k in range(1, size)], sum(r["n"] for r in found if r["length"] == 0)


def clean(docs: DataFrame, size: int = WINDOW, limit: int = LIMIT, digest_only: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) with n_words, n_removed, spans (start and length in words of what was removed:
    unions of its repeated windows) and text holding the kept words. Texts of which nothing goes stay as they
    are. digest_only: doc_id, n_words, n_removed, kept_sha256 instead."""
    docs = docs.drop("n_words", "n_removed", "spans")
    rows, total = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    most_words = (total or 0) // 2 + rows
    limit = max(limit, -(-most_words // MOST_GROUPS))
    ranges = max(1, -(-rows // RANGE_DOCS))
    own = F.coalesce("doc_id", F.lit(_LAST))
    salt = F.when(F.col("doc_id").isNull(), F.shiftrightunsigned(F.xxhash64("text"), 40)).otherwise(0).cast("bigint")
    suffixes = docs.select(own.alias("id"), salt.alias("salt"), word_hashes(F.col("text")).alias("h")).filter(F.size("h") >= size)
    opened, n = open_prefixes(suffixes, most_words, size, limit) if most_words > limit else ([], 0)
    buckets = max(1, -(-2 * n // limit))
    sent = suffixes.mapInArrow(tidied(_send(opened, buckets, ranges, size)), _SENT)
    answers = sent.groupBy("bucket").applyInArrow(_subtree(ranges), "to_range int, hashes binary, docs binary, ids binary")
    kept_fields = [StructField("doc_id", LongType())] if digest_only else list(docs.schema.fields)
    new = [StructField("n_words", LongType()), StructField("n_removed", LongType())]
    new.append(StructField("kept_sha256", StringType()) if digest_only else StructField("spans", ArrayType(ArrayType(IntegerType()))))
    schema = StructType([*kept_fields, *new])

    def kept_of(left: pa.Table, right: pa.Table) -> pa.Table:
        from xxhash import xxh64_intdigest

        marked: dict[int, list[np.ndarray]] = {}
        for h, d, i in zip(*(right[c].to_pylist() for c in ("hashes", "docs", "ids")), strict=True):
            hs, ds = _from_planes(h), _from_planes(i).view(np.int64)[_from_small(d)]
            order = np.argsort(ds, kind="stable")
            hs, ds = hs[order], ds[order]
            starts = np.flatnonzero(np.r_[True, ds[1:] != ds[:-1]])
            for a, b in zip(starts, [*starts[1:], len(ds)], strict=True):
                marked.setdefault(int(ds[a]), []).append(hs[a:b])
        n_words, n_removed, third, texts = [], [], [], []
        for doc_id, text in zip(left["doc_id"].to_pylist(), left["text"].to_pylist(), strict=True):
            hs = marked.get(_LAST if doc_id is None else doc_id)
            ws = text_words(text)
            n = len(ws)
            gone = np.zeros(n, bool)
            if hs is not None and n >= size:
                flat = np.array([xxh64_intdigest(x.encode("utf-8", "surrogatepass"), SPARK_SEED) for x in ws], np.uint64)
                w = window_hashes(flat, np.arange(n - size + 1), size)
                gone = covered(n, np.flatnonzero(np.isin(w, np.concatenate(hs))), size)
            n_words.append(n)
            n_removed.append(int(gone.sum()))
            if digest_only or n_removed[-1]:
                kept = " ".join(ws if not n_removed[-1] else [x for x, g in zip(ws, gone.tolist(), strict=True) if not g])
            else:
                kept = text
            if digest_only:
                third.append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
            else:
                texts.append(kept)
                edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
                third.append([[int(a), int(b - a)] for a, b in zip(edges[::2], edges[1::2], strict=True)])
        columns = {f.name: pa.array(texts, pa.string()) if f.name == "text" else left[f.name] for f in kept_fields}
        columns |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
        columns[new[-1].name] = pa.array(third, pa.string() if digest_only else pa.list_(pa.list_(pa.int32())))
        return pa.table(columns)

    def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
        out = kept_of(left, right)
        give_back()
        return out

    columns = ["doc_id", "text"] if digest_only else docs.columns
    left = docs.select(*columns, range_number(own, salt, ranges).alias("to_range__"))
    return left.groupBy("to_range__").cogroup(answers.groupBy("to_range")).applyInArrow(cut_out, schema)


def text_words(text: str | None) -> list[str]:
    return [w for w in _SPACE.split(text or "") if w]


def op8_prefix_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and digest of the kept words of all documents."""
    return clean(table(spark, sf_dir, "documents", "doc_id", "text"), digest_only=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL: dict[str, str] = {
    "op8_prefix_subtrees": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM p),
f AS (SELECT k, min(doc_id) AS least FROM h GROUP BY k),
m AS (SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 13)) AS i FROM h JOIN f ON h.k = f.k AND h.doc_id > f.least),
g AS (SELECT doc_id, list(i) AS gone FROM m GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE [x for x, j in ws if NOT list_contains(gone, j)] END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""
}
