"""Results against SQL, brute force, the tokenizers library and held-out labels, on whole small tables."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from lavra.llm import bpe, fingerprints, knn, minhash, mixing, quality, registry, sharding, token_files, toxicity

DATA = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DATA}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(registry.SQL[name]).df()
    cols = sorted(want.columns)
    got = registry.QUERIES[name](spark, DATA).toPandas()
    pd.testing.assert_frame_equal(*(x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want)), check_dtype=False)


def test_word_bpe(spark, docs):
    lib = Tokenizer.from_file(bpe.vocabulary_path(bpe.VOCABULARY))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = registry.QUERIES["op9_numpy_bpe"](spark, DATA).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert tuple(got.loc[i]) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    own = bpe.WordBpe(bpe.vocabulary_path(bpe.VOCABULARY))
    for t in ("", "a" * 3000, "abcabc" * 500 + "!!" * 900, "ΟΔΟΣ İstanbul ẞ<|endoftext|>Y", "it's 12 don't x\x85y\x1cz", "日本語 🙂🙂"):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_word_bpe_in_parts_and_with_a_small_table(spark, monkeypatch):
    """Texts cut into parts, tables that are emptied often, and texts of odd characters, as the library does them."""
    path = bpe.vocabulary_path(bpe.VOCABULARY)
    lib = Tokenizer.from_file(path)
    monkeypatch.setattr(bpe, "PART", 7)
    own = bpe.WordBpe(path, most_words=5)
    signs = ["a", "B", "é", "\u0301", " ", "\n", "\t", "\x1c", "\x85", "\u3000", "'s", "'T", "1", "²", "🙂", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "Σ", "日", "!!", "\u200d", "ǅ"]
    rng = np.random.default_rng(4)
    texts = ["", " ", "\n", *("".join(rng.choice(signs, int(n))) for n in rng.integers(0, 40, 400))]
    flat, ends = own.encode_all(texts)
    joined = own.joined(flat, ends).to_pylist()
    for i, t in enumerate(texts):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert flat[ends[i] : ends[i + 1]].tolist() == ids and joined[i] == lib.decode(ids, skip_special_tokens=False)
    rows = spark.createDataFrame([(1, [320, None, -5, 10**6, 320]), (2, None), (3, [])], "n int, token_ids array<int>")
    assert {r["n"]: r["decoded"] for r in bpe.decode(rows, path).collect()} == {1: lib.decode([320, 320]), 2: "", 3: ""}


def test_token_files(spark, docs, tmp_path):
    lib = Tokenizer.from_file(bpe.vocabulary_path(token_files.VOCABULARY))
    path = str(tmp_path / "ids")
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    token_files.write(source, bpe.vocabulary_path(token_files.VOCABULARY), path, segment_ids=20_000)
    got = token_files.read(spark, path).toPandas().set_index("doc_id")
    start = 0
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got.loc[i].start, got.loc[i].n_tokens, got.loc[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.find(spark, path, int(docs.doc_id[7])) == [*lib.encode(docs.text[7], add_special_tokens=False).ids, 0]
    assert token_files.find(spark, path, 10**9) is None
    nulls = spark.createDataFrame([(None, "no id"), (4, "four"), (None, "nor here")], "doc_id long, text string")
    token_files.write(nulls, bpe.vocabulary_path(token_files.VOCABULARY), str(tmp_path / "nulls"))
    ids = [token_files.find(spark, str(tmp_path / "nulls"), None, i) for i in (0, 1)]
    assert sorted(ids) == sorted([*lib.encode(t, add_special_tokens=False).ids, 0] for t in ("no id", "nor here"))


def test_token_files_encoder_with_odd_texts_and_small_tables():
    """Texts of odd characters as the library encodes them, with tables that are often full, and each alone."""
    path = bpe.vocabulary_path(token_files.VOCABULARY)
    lib = Tokenizer.from_file(path)
    own, none_kept = token_files.Encoder(path, most=40), token_files.Encoder(path, most_chars=1)
    signs = ["a", "Be", "é", "\u0301", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "'s", "'T", "'", "1", "²", "🙂", "<|endoftext|>", "<|", "Ċ", "日", "!!", "\u200d", "\ufeff", "\x00"]
    rng = np.random.default_rng(5)
    texts = ["", " ", "\n", "  a", "a  ", "a \n b", " a", "a\n b", *("".join(rng.choice(signs, int(n))) for n in rng.integers(0, 30, 1500))]
    want = [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.encode([]) == []
    for encoder in (own, none_kept, token_files.Encoder(path)):
        assert [x for at in range(0, len(texts), 50) for x in encoder.encode(texts[at : at + 50])] == want
        assert [encoder.encode([t])[0] for t in texts[:200]] == want[:200]


def test_token_files_encoder_splits_known_words_once():
    """What stands between blanks is split by the pattern when it is new, not each time it comes."""
    own = token_files.Encoder(bpe.vocabulary_path(token_files.VOCABULARY))
    split = []

    class Counted:
        def findall(self, text, pattern=own.pattern):
            split.append(len(text))
            return pattern.findall(text)

    own.pattern = Counted()
    texts = [" ".join(f"word{i % 300}, and" for i in range(j, j + 2000)) for j in range(20)]
    own.encode(texts), own.encode(texts)
    assert sum(split) < sum(map(len, texts)) / 50


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_perfect_hash(n):
    keys = token_files.key_hash(np.arange(n, dtype=np.uint64), 77)
    slots = token_files.PerfectHash.build(keys).slots(keys)
    assert sorted(slots) == list(range(n))


def test_near_duplicates(spark, docs):
    bags = []
    for t in docs.text:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        bags.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter())
    root = list(range(len(bags)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            both = sum(min(n, bags[j][k]) for k, n in a.items() if k in bags[j])
            if both and both >= 0.8 * (sum(a.values()) + sum(bags[j].values()) - both) - 1e-9:
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = registry.QUERIES["op6_bagminhash"](spark, DATA).toPandas().set_index("doc_id").class_id
    assert all(got[docs.doc_id[i]] == docs.doc_id[find(i)] for i in range(len(bags)) if bags[i])


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        a = rng.integers(0, 6, 60)
        b = np.where(rng.random(60) < 0.7, a, rng.integers(0, 6, 60))
        x = rng.integers(0, 2**63, 60).astype(np.uint64)
        s = minhash.signatures(np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)], np.r_[x[a > 0], x[b > 0]], np.r_[a[a > 0], b[b > 0]], 2)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.015


def test_a_chain_without_the_hub_keeps_its_links(spark):
    """Members of a bucket that are near to each other but not to its least document."""
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in range(400)]
    texts = []
    for k in range(40):
        w = list(base)
        for p in rng.choice(400, int(rng.integers(1, 14)), replace=False):
            w[p] = f"x{k}-{p}"
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(df).collect()}
    sets = [set(zip(*(t.split()[j:] for j in range(5)), strict=False)) for t in texts]
    for i in range(40):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                assert got[i] == got[j]


def test_dedup_keeps_unlike_texts_of_one_id(spark):
    rows = [
        (3, "a b c d e f g h i j", 1), (7, "a b c d e f g h i j k", 2), (7, "quite another text it is", 3), (None, "x y z u v w", 4), (None, "m n o p q r", 5),
        (2**63 - 1, "x y z u v w", 6), (3, "a b c d e f g h i j", 7), (8, None, 8), (9, " ", 9),
    ]
    got = minhash.dedup(spark.createDataFrame(rows, "doc_id long, text string, h1 int")).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got if r["text"]) == [
        (-1, "m n o p q r"), (3, "a b c d e f g h i j"), (7, "quite another text it is"), (2**63 - 1, "x y z u v w")
    ]
    assert [(r["doc_id"], r["h1"]) for r in got if not r["text"]] == [(8, 8)]


def test_band_recall_at_the_threshold():
    """Pairs of similarity 0.8 share a band nearly always, dissimilar ones hardly ever."""
    rng = np.random.default_rng(5)
    met, far = 0, 0
    for _ in range(60):
        x = rng.integers(0, 2**63, 400).astype(np.uint64)
        for common, n in ((320, 360), (100, 300)):
            a, b = x[:n], np.r_[x[:common], x[360:][: n - common]] if n == 360 else np.r_[x[:common], rng.integers(0, 2**63, n - common).astype(np.uint64)]
            s = minhash.signatures(np.r_[np.zeros(len(a), int), np.ones(len(b), int)], np.r_[a, b], np.ones(len(a) + len(b), np.int64), 2)
            shared = (minhash.bands(s)[0] == minhash.bands(s)[1]).any()
            met, far = met + (shared and n == 360), far + (shared and n == 300)
    assert met >= 59 and far <= 3


def test_fingerprints(spark, docs):
    got = registry.QUERIES["op4_weighted_samples"](spark, DATA).toPandas().set_index("doc_id")
    down = docs[::-1].reset_index(drop=True)
    words = lambda t: collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", t))
    errors, further = [], []
    for i, t in enumerate(down.text):
        nxt = down.text[(i + 1) % len(down)]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        row = got.loc[down.doc_id[i]]
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and row.n_chars == len(t)
        a, b = words(t), words(edited)
        c = words(nxt)
        errors.append(row.near_edited - sum((a & b).values()) / max(1, sum((a | b).values())))
        after = got.loc[down.doc_id[(i + 1) % len(down)]].fingerprint
        assert row.near_next == pytest.approx(np.mean([row.fingerprint[j : j + 4] == after[j : j + 4] for j in range(0, len(after), 4)]))
        further.append(row.near_next - sum((a & c).values()) / max(1, sum((a | c).values())))
    assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.2 and abs(np.mean(further)) < 0.04 and np.std(further) < 0.2


def test_order_of_far_and_missing_ids(spark):
    """Ids at both ends of bigint, one far away from all others, ties and nulls follow each other in order."""
    rng = np.random.default_rng(2)
    ids = [-(2**63), 2**63 - 1, 10**15, None, None, None, 7, 7, *map(int, rng.choice(3000, 400, replace=False) + 10)]
    rows = [(i, f"text {n}") for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.neighbours(df, 8).filter("not pad").collect()
    assert len(got) == len(rows)
    follows = {r["text"]: r["next_text"] for r in got}
    assert len(set(follows.values())) == len(rows)
    of, text, seen = dict((t, i) for i, t in rows), next(t for i, t in rows if i == 2**63 - 1), []
    for _ in rows:
        seen.append(of[text])
        text = follows[text]
    known = [i for i in seen if i is not None]
    assert text == "text 1" and known == sorted(known, reverse=True) and seen[len(known) :] == [None] * 3
    assert fingerprints.cells(df, 8).groupBy("cell").count().agg({"count": "max"}).first()[0] < 60


def test_sharding_and_rebalancing(spark):
    shards = registry.QUERIES["op3_virtual_slots"](spark, SMALL).toPandas().groupby("shard")["size"].sum()
    assert len(shards) == 16 and shards.max() < 1.01 * shards.min()
    slots = spark.createDataFrame([(i, (i * 37) % 101 + 1) for i in range(200)], "slot int, bytes long")
    one = sharding.assign(slots, 4).cache()
    two = sharding.rebalance(one, slots, 5).toPandas().set_index("slot")
    before = one.toPandas().set_index("slot")
    moved = two.shard != before.shard.loc[two.index]
    assert set(two.version) == {2} and set(two.shard[moved]) == {4} and len(two) == 200
    load = slots.toPandas().set_index("slot").bytes.groupby(two.shard).sum()
    assert load.max() < 1.1 * load.mean()


def test_a_stored_map_is_used_and_edited(spark, tmp_path, docs):
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    path = str(tmp_path / "map")
    one = sharding.shard(source, 4, 64, path).toPandas()
    again = sharding.shard(source, 4, 64, path).toPandas()
    assert len(one) == len(again) == len(docs) and (one.sort_values("doc_id").shard.tolist() == again.sort_values("doc_id").shard.tolist())
    grown = sharding.shard(source, 5, 64, path).toPandas()
    assert len(grown) == len(docs) and set(grown.shard) == set(range(5)) and sharding.load(spark, path).first()["version"] == 2
    moved = one.merge(grown, on="doc_id")
    assert (moved.shard_y[moved.shard_x != moved.shard_y] == 4).mean() > 0.9
    with pytest.raises(Exception, match="(?i)already exists"):
        sharding.store(spark, sharding.load(spark, path, 1), path)


def test_shards_row_by_row(spark, docs):
    got = registry.QUERIES["op3_virtual_slots"](spark, DATA).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        data = (t or "").encode()
        assert (got.loc[i, "size"], got.loc[i, "text_crc32"], got.loc[i, "law"]) == (len(data) + 1, zlib.crc32(data), "bytes")
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_mixing_targets(spark):
    got = registry.QUERIES["op10_weighted_mix"](spark, SMALL).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    src = pd.read_parquet(f"{SMALL}/documents.parquet", columns=["doc_id", "source"])
    each = got.merge(src).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"), source_size=("source_size", "first"))
    assert (abs(each.taken - each.target) <= each.most).all() and (each.target <= 2 * each.source_size + 1e-6).all()
    assert abs(each.target.sum() - 1.5 * each.source_size.sum()) < 1
    assert mixing.WEIGHTS == (3, 1, 2)


def test_held_out_toxicity(spark):
    got = toxicity.op7_lexicon_toxicity(spark, SMALL).toPandas()
    both = got[got.held_out].merge(pd.read_parquet(f"{SMALL}/labels.parquet"), on="doc_id")
    assert both[both.toxic == 0].predicted.mean() < 0.05 and both[both.toxic == 1].predicted.mean() > 0.6
    assert toxicity.fold("ST0PID іdiоt, naïve!") == " stopid idiot naive "


def test_quality_keeps_the_good(spark):
    got = quality.op5_weak_quality(spark, SMALL).toPandas().merge(pd.read_parquet(f"{SMALL}/labels.parquet"), on="doc_id")
    assert got[got.quality == 1].keep.mean() > 0.97 and got[got.quality == 0].keep.mean() < 0.1


def _brute_top(rows, k):
    out = {}
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        v = min(v for i, v in rows if i == q)
        ranked = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)
        out[q] = [(i, -s) for s, i in ranked[:k]]
    return out


@pytest.mark.parametrize("big", [60, 2**30])
def test_top_k_against_brute_force(spark, big):
    """Clusters, repeated rows and ids, ties, and components whose products leave exact doubles."""
    rng = np.random.default_rng(big % 97)
    centres = rng.integers(-big, big, (6, 5))
    rows = [(int(i), [int(c) for c in centres[i % 6] + rng.integers(-3, 4, 5)]) for i in range(700)]
    rows += [(50, rows[50][1]), (50, rows[51][1]), (100, rows[100][1]), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, i % 50 == 0) for i, v in rows], "vec_id long, v array<long>, is_query boolean")
    got = collections.defaultdict(list)
    for r in sorted(knn.top_k(df, 4, rows_per_pivot=40).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == _brute_top(rows, 4)


def test_vectors_go_where_they_are_needed_only():
    """In clustered vectors a group needs few vectors, and always the true answers."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 100, (40, 16))
    x = np.round(centres[np.arange(2000) % 40] + rng.normal(0, 2, (2000, 16)))
    pivots = x[:40]
    cell = ((x[:, None] - pivots) ** 2).sum(2).argmin(1)
    far = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
    groups = []
    for c in sorted(set(cell)):
        q = np.flatnonzero(cell == c)[::7]
        own = np.sort(x[q] @ x[cell == c].T, 1)[:, -5].min()
        groups.append((c, far[q].max(), np.sqrt((x[q] ** 2).sum(1)).max(), own, len(groups)))
    row, g = knn.Needs(groups, pivots).of(x)
    assert len(row) < 3 * len(x)
    sent = set(zip(row.tolist(), g.tolist(), strict=True))
    for c, *_, group in groups:
        for q in np.flatnonzero(cell == c)[::7]:
            assert all((j, group) in sent for j in np.argsort(-(x @ x[q]))[:5].tolist())
