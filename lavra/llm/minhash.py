"""MinHash near-dedup by BagMinHash on weighted word shingles.

A document is the bag of its five-word shingles. A shingle of weight w owns the cells [0, 1), [1, 2), [2, 4),
... up to w (dyadic, so that a few levels cover any weight); each cell is a Poisson process whose points come
in ascending order, every point belonging to one random component and, in the upper cells, to one unit of
weight, which is thinned away beyond w. A component's value is its earliest point. Two bags agree in a
component with the probability of their weighted Jaccard similarity. A shingle stops once its next point
comes after all components of its document are taken by earlier ones: one or two points for most shingles.

Components are cut into `BANDS` bands of `ROWS`; texts that share a band are candidates. A pair of similarity
0.8 shares none with a probability of 0.00015 (one of 0.85: of 2e-7), one of 0.3 shares some with 0.003. Equal
texts are one node, whatever their doc_ids. No pairs of a bucket are listed: each member is verified against
the bucket's least node (exact overlap of the two multisets), verified links give classes, and where a group
of candidates still falls into several classes, all texts outside its largest class are compared with the
whole group, in blocks of bounded size and by products of count matrices, so that no link between different
texts is lost.

Defined results: documents without words, null ones too, are copies of each other and near to nothing else;
texts under five words are one shingle; a null doc_id comes after all others; classes are named by their
least doc_id (null if all are); repeated rows share their class, and different texts under one doc_id need
not; an empty table gives an empty result; other columns are ignored by `classes` and kept by `dedup`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, tidied, word_hashes

SHINGLE = 5
LIKE = 0.8
BANDS, ROWS = 48, 8
QUERY_BLOCK, DATA_BLOCK = 256, 1024
SLICE_WORDS = 400_000
_PHI = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def bags(flat: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, shingle hash and weight of every distinct shingle of each document, sorted."""
    n = np.diff(offsets)
    span = np.minimum(n, size)
    counts = np.where(n > 0, n - span + 1, 0)
    doc = np.repeat(np.arange(len(n)), counts)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    x = np.zeros(len(doc), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            use = j < span[doc]
            x = np.where(use, x * _PHI + flat[np.minimum(start + j, max(0, len(flat) - 1))] + np.uint64(1), x)
    x = _mix(x)
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    if not len(x):
        return doc, x, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (x[1:] != x[:-1])])
    return doc[first], x[first], np.diff(np.r_[first, len(x)])


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """n_docs x m values; those of documents without shingles are infinite. Integer weights."""
    best = np.full(n_docs * m, np.inf)
    levels = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    row = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    length = np.where(level == 0, 1.0, low)
    with np.errstate(over="ignore"):
        seed = _mix(shingle[row] + level.astype(np.uint64) * _PHI)
    owner, w, time = doc[row], weight[row].astype(float), np.zeros(len(row))
    step = 0
    while len(seed):
        with np.errstate(over="ignore"):
            a = _mix(seed + np.uint64(2 * step + 1) * _PHI)
            b = _mix(seed + np.uint64(2 * step + 2) * _PHI)
        time = time - np.log(_unit(a)) / (m * length)
        part = (b >> np.uint64(32)).astype(np.int64) * m >> 32
        inside = low + length * ((b & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
        ok = (low == 0) | (np.floor(inside) < w)
        np.minimum.at(best, owner[ok] * m + part[ok], time[ok])
        if step % 2 == 1 or len(seed) < 100_000:
            latest = best.reshape(n_docs, m).max(1)
            go = time < latest[owner]
            seed, owner, w, time, low, length = seed[go], owner[go], w[go], time[go], low[go], length[go]
        step += 1
    return best.reshape(n_docs, m)


def bands(values: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = values.view(np.uint64).reshape(len(values), n_bands, rows)
    x = np.broadcast_to(np.arange(n_bands, dtype=np.uint64) * _PHI, bits.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for j in range(rows):
            x = _mix(x * _PHI + bits[:, :, j])
    return x.view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut to about SLICE_WORDS words, with flat word hashes and offsets."""
    for b in batches:
        offsets = b["h"].offsets.to_numpy().astype(np.int64)
        flat = b["h"].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        at = 0
        while at < b.num_rows:
            to = min(b.num_rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_WORDS, "right")) - 1))
            yield b.slice(at, to - at), flat[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def sketch(rows: DataFrame) -> DataFrame:
    """rows(doc_id, h1, h2, h array<bigint>) to doc_id, h1, h2, bands (empty for documents without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, flat, offsets in _slices(batches):
            doc, x, w = bags(flat, offsets)
            got = bands(signatures(doc, x, w, b.num_rows))
            some = np.diff(offsets) > 0
            flat_bands = got[some].ravel()
            ends = np.r_[0, np.cumsum(some * BANDS)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["h1"], b["h2"], pa.ListArray.from_arrays(ends, pa.array(flat_bands))], ["doc_id", "h1", "h2", "bands"])

    return rows.mapInArrow(tidied(run), "doc_id bigint, h1 bigint, h2 bigint, bands array<bigint>")


def elements(rows: DataFrame) -> DataFrame:
    """rows(id, h) to id and elems: the bag as a set, a shingle's i-th occurrence being an element of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, flat, offsets in _slices(batches):
            doc, x, w = bags(flat, offsets)
            row = np.repeat(np.arange(len(doc)), w)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(w) - w, w)
            with np.errstate(over="ignore"):
                e = np.where(turn == 0, x[row], _mix(x[row] + turn.astype(np.uint64) * _PHI)).view(np.int64)
            ends = np.r_[0, np.cumsum(np.bincount(doc[row], minlength=b.num_rows))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["id"], pa.ListArray.from_arrays(ends, pa.array(e))], ["id", "elems"])

    return rows.mapInArrow(tidied(run), "id bigint, elems array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) to node, label: the least node of each connected component. Labels move along edges and
    jump to their labels' labels, each round written to the shared folder, until none changes."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = now.join(near.select(F.col("a").alias("node"), "m"), "node").select("node", F.least("label", "m").alias("to"), "label")
        jump = now.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = cut(step.join(jump, "to").select("node", F.least("to", "far").alias("label"), (F.least("to", "far") != F.col("label")).alias("moved")), "labels")
        now = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return now


def stars(edges: DataFrame) -> DataFrame:
    """edges(a, b), each a with few b, to edges(a, b) of the same components: each a and its other b hang on its
    least b. Nodes that share their neighbours give one edge each and share the rest, where all pairs of a node and
    its neighbours went into every round of `components`."""
    near = edges.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("bs"))
    own = near.select("a", F.col("m").alias("b"))
    rest = near.select("m", F.array_sort(F.array_remove("bs", F.col("m"))).alias("bs")).distinct()
    return own.unionByName(rest.select(F.explode("bs").alias("a"), F.col("m").alias("b")).distinct())


def similarity(a: str, b: str) -> Column:
    """Jaccard similarity of two array columns without repeated elements."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _compare(like: float):
    """Links between a block of documents and a block of their candidate group, by products of 0/1 matrices
    over the elements that both blocks hold; one link for each document and other class."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            (qi, ql, qn, qd, qe), (di, dl, dn, dd, de) = ((*(t[c].to_numpy() for c in ("id", "label")), *_rows_of(t["elems"])) for t in (left, right))
            shared = np.intersect1d(qe, de)
            common = np.zeros((len(qi), len(di)), np.float32)
            qs, ds = np.searchsorted(shared, qe), np.searchsorted(shared, de)
            qk, dk = (shared[np.minimum(s, max(0, len(shared) - 1))] == e if len(shared) else np.zeros(len(e), bool) for s, e in ((qs, qe), (ds, de)))
            qd, qs, dd, ds = qd[qk], qs[qk], dd[dk], ds[dk]
            for at in range(0, len(shared), 4096):
                width = min(4096, len(shared) - at)
                a, b = np.zeros((len(qi), width), np.float32), np.zeros((len(di), width), np.float32)
                use, use2 = (qs >= at) & (qs < at + width), (ds >= at) & (ds < at + width)
                a[qd[use], qs[use] - at] = 1
                b[dd[use2], ds[use2] - at] = 1
                common += a @ b.T
            near = (common >= like * (qn[:, None] + dn[None, :] - common) - 1e-6) & (ql[:, None] != dl[None, :]) & (common > 0)
            seen = set()
            for i, j in zip(*np.nonzero(near), strict=True):
                if (i, dl[j]) not in seen:
                    seen.add((i, dl[j]))
                    links.append((int(qi[i]), int(di[j])))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return run


def _rows_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    n = np.diff(column.offsets.to_numpy().astype(np.int64))
    return n, np.repeat(np.arange(len(n)), n), column.flatten().to_numpy(zero_copy_only=False)


def links(texts: Callable[[DataFrame], DataFrame], buckets: DataFrame, like: float = LIKE) -> DataFrame:
    """Classes of the nodes that have links: node, label. buckets(bucket, id): bands of the nodes;
    texts(ids): id and text of the nodes ids(id)."""
    hubs = buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("bucket", "hub")
    pairs = cut(buckets.join(hubs, "bucket").filter("id <> hub").select("id", "hub").distinct(), "pairs")
    ids = pairs.select("id").unionByName(pairs.select(F.col("hub").alias("id"))).distinct()
    bag = cut(elements(texts(ids).select("id", word_hashes(F.col("text")).alias("h"))), "bags")
    one, two = bag.select("id", F.col("elems").alias("x")), bag.select(F.col("id").alias("hub"), F.col("elems").alias("y"))
    verified = pairs.join(one, "id").join(two, "hub").filter(similarity("x", "y") >= like).select(F.col("id").alias("a"), F.col("hub").alias("b"))
    verified = cut(verified, "links")
    label = components(stars(verified))
    group = components(stars(pairs.select(F.col("id").alias("a"), F.col("hub").alias("b")))).select(F.col("node").alias("id"), F.col("label").alias("grp"))
    known = group.join(label.withColumnRenamed("node", "id"), "id", "left").select("id", "grp", F.coalesce("label", "id").alias("label"))
    sizes = known.groupBy("grp", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("grp").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("classes"), F.sum("n").alias("all")).filter("classes > 1")
    open_ = known.join(largest.select("grp", F.col("top.label").alias("top"), F.col("all")), "grp").withColumn("minor", F.col("label") != F.col("top"))
    minor = open_.filter("minor").groupBy("grp").agg(F.count("*").alias("minors"))
    open_ = cut(open_.join(minor, "grp"), "open")
    blocks = lambda n, per: F.ceil(F.col(n) / F.lit(per)).cast("int")
    own = lambda n, per: F.pmod(F.xxhash64("id"), blocks(n, per)).cast("int")
    held = open_.join(bag, "id")
    by = ["grp", "qb", "db"]
    left = (
        held.filter("minor").withColumn("qb", own("minors", QUERY_BLOCK))
        .withColumn("db", F.explode(F.sequence(F.lit(0), blocks("all", DATA_BLOCK) - 1))).select(*by, "id", "label", "elems")
    )
    right = (
        held.withColumn("db", own("all", DATA_BLOCK))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), blocks("minors", QUERY_BLOCK) - 1))).select(*by, "id", "label", "elems")
    )
    more = left.groupBy(*by).cogroup(right.toDF(*right.columns).groupBy(*by)).applyInArrow(_compare(like), "a bigint, b bigint")
    known_links = label.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    return components(cut(known_links.unionByName(more), "all-links"))


def classes(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """docs(doc_id, text), a row each, to doc_id, h1, h2 (hashes of the text), class_id and kept: whether
    doc_id and text are those of the class's least document."""
    hashes = F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", *hashes)
    sketched = cut(sketch(texts.select("doc_id", "h1", "h2", word_hashes(F.col("text")).alias("h"))), "sketch")
    # equal texts are one node: equal 128-bit hashes, and all without words together; written once, so that
    # the numbers of the nodes stay what they are
    blank = F.size("bands") == 0
    keys = sketched.select("doc_id", "h1", "h2", F.when(~blank, F.col("h1")).alias("k1"), F.when(~blank, F.col("h2")).alias("k2"), "bands")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")).alias("least")
    first = keys.groupBy("k1", "k2").agg(least, F.any_value("bands").alias("bands"))
    first = cut(first.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def text_of(ids: DataFrame) -> DataFrame:
        wanted = first.join(ids.withColumnRenamed("id", "node"), "node", "left_semi").select("k1", "k2", "node", F.col("least.doc_id").alias("least_id"))
        held = texts.join(wanted, (texts["h1"] == wanted["k1"]) & (texts["h2"] == wanted["k2"]) & texts["doc_id"].eqNullSafe(wanted["least_id"]))
        return held.groupBy(F.col("node").alias("id")).agg(F.any_value("text").alias("text"))

    buckets = first.select(F.col("node").alias("id"), F.explode("bands").alias("bucket"))
    found = links(text_of, buckets, like)
    labelled = first.join(found, "node", "left").select("k1", "k2", "least", F.coalesce("label", "node").alias("label"))
    names = labelled.groupBy("label").agg(F.min("least").alias("name"))
    named = labelled.join(names, "label").select("k1", "k2", "name")
    got = keys.drop("bands").join(named, keys["k1"].eqNullSafe(named["k1"]) & keys["k2"].eqNullSafe(named["k2"]))
    kept = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2") == F.col("name")
    return got.select("doc_id", "h1", "h2", F.col("name.doc_id").alias("class_id"), F.coalesce(kept, F.lit(False)).alias("kept"))


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of all documents; one document of each class, the least, is kept."""
    got = classes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return got.select("doc_id", "class_id", F.col("kept").cast("int").alias("keep"))


def dedup(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """docs without all but the least document of each class (ties of doc_id: of least hash of the text). Of
    rows that repeat both doc_id and text one stays."""
    hashes = {"h1__": F.xxhash64(F.coalesce("text", F.lit(""))), "h2__": F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))}
    got = cut(classes(docs, like).filter("kept").groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("n")), "kept")
    kept = got.select(F.col("doc_id").alias("kept__"), F.col("h1").alias("k1__"), F.col("h2").alias("k2__"))
    rows = docs.withColumns(hashes)
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(F.col("kept__")) & (F.col("h1__") == F.col("k1__")) & (F.col("h2__") == F.col("k2__")), "left_semi")
    if not got.filter("n > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", "h1__", "h2__"])
    return rows.drop(*hashes)


SQL: dict[str, str] = {}
