"""BPE encoding and decoding by batched merge rounds on numpy arrays.

The words that a batch of texts does not share with earlier ones are laid out as one flat array of symbol
ids. In each round every neighbouring pair of a word is looked up by binary search over the sorted pair
keys, the pair of lowest rank of each word (its first place, of equals) is merged, and words without a
known pair leave. What a chunk between blanks became is kept in a bounded table, from whose flat ids whole
batches are gathered, so that frequent words are split and merged once.

The vocabulary file (public `tokenizers` JSON, a path) has a normaliser (NFC, white space to one blank, lower
case), a splitting pattern, byte-level symbols and a word-end mark; special tokens are cut out of the raw
text first. Decoding joins the tokens with blanks, as that file names no decoder.

Defined results: null is the empty text, which has no ids; very long words are merged by a heap, in
n log n steps; repeated rows are encoded each; other columns pass through untouched.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import give_back, small_batches, table, tidied

VOCABULARY = "word_bpe_49k.json"
#: Chunks between blanks, and characters of them, kept with their ids by each worker; a full table is emptied.
MOST_WORDS = 100_000
MOST_CHARS = 4_000_000
#: Characters that are split into chunks at once.
PART = 250_000
#: Words of more symbols are merged by a heap.
LONG = 64


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next unused one from 256 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(other)) for b in range(256)]


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of values that begin at starts, one after the other."""
    to = np.cumsum(lengths)
    return values[np.repeat(starts - to + lengths, lengths) + np.arange(lengths.sum())]


class WordBpe:
    def __init__(self, path: str, most_words: int = MOST_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"^\s", r"^\p{White_Space}")
        self.pattern = regex.compile("\n|" + pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = np.array([vocab.get(s, -1) for s in symbols], np.int64)
        self.final = np.array([vocab.get(s + end, -1) for s in symbols], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = max(self.tokens) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)  # by rank
        self.most_words = most_words
        if any(" " in t or "\n" in t for t in self.special):
            raise ValueError("special tokens with blanks are not supported")
        self.names = pa.array([self.tokens.get(i, "") for i in range(self.size)], pa.string())
        self.decimals = pa.array([str(i) for i in range(self.size)], pa.string())
        self.is_token = np.array([i in self.tokens for i in range(self.size)])
        self._clear()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, len(made) if it is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.made))

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each word has."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        flat = self.inner[data]
        ends = np.cumsum(lengths)
        flat[ends - 1] = self.final[data[ends - 1]]
        long = np.flatnonzero(lengths > LONG)
        made = [self._merge_long(flat[ends[i] - lengths[i] : ends[i]]) for i in long]
        owners = [np.full(len(x), i) for i, x in zip(long, made, strict=True)]
        owner = np.repeat(np.arange(len(words)), lengths)
        short = np.repeat(lengths <= LONG, lengths)
        sym, owner = flat[short], owner[short]
        none = len(self.made)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank = np.full(len(sym), none)
            if len(sym) > 1:
                inside = np.flatnonzero(owner[1:] == owner[:-1])
                rank[inside] = self.rank(sym[inside], sym[inside + 1])
            sizes = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            each = np.repeat(least, sizes)
            done = each == none
            made.append(sym[done])
            owners.append(owner[done])
            # the first place of the least rank in each word still open
            place = np.where((rank == each) & ~done, np.arange(len(sym)), len(sym))
            first = np.minimum.reduceat(place, starts)[least != none]
            sym[first] = self.made[rank[first]]
            keep = ~done
            keep[first + 1] = False
            sym, owner = sym[keep], owner[keep]
        ids, owner = np.concatenate([np.empty(0, np.int64), *made]), np.concatenate([np.empty(0, np.int64), *owners])
        ids, owner = ids[ids >= 0], owner[ids >= 0]
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _merge_long(self, flat: np.ndarray) -> np.ndarray:
        """One word with a heap of (rank, place) over a doubly linked list."""
        sym = flat.tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = len(self.made)
        pair = lambda i: int(self.rank(np.array([sym[i]]), np.array([sym[after[i]]]))[0]) if after[i] < n else none
        ranks = self.rank(flat[:-1], flat[1:]).tolist()
        heap = [(r, i) for i, r in enumerate(ranks) if r < none]
        heapq.heapify(heap)
        live = [True] * n
        while heap:
            r, i = heapq.heappop(heap)
            if not live[i] or pair(i) != r:
                continue
            j = after[i]
            sym[i], live[j] = int(self.made[r]), False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (new := pair(k)) < none:
                    heapq.heappush(heap, (new, k))
        return np.array([s for s, a in zip(sym, live, strict=True) if a], np.int64)

    def pieces(self, chunks: list[str]) -> list[str]:
        """Words and special tokens of all chunks in order, with a line break after each chunk."""
        def plain(text: str) -> list[str]:
            return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

        text = "".join([c + "\n" for c in chunks])
        out: list[str] = []
        for part in self.cut.split(text) if self.cut else [text]:
            out += [part] if part in self.special else plain(part)
        return out

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.ends, self.chars = np.empty(0, np.int32), np.zeros(1, np.int64), 0

    def learn(self, chunks: set[str]) -> None:
        """Put the ids of all chunks into the table."""
        new = [c for c in chunks if c not in self.place]
        if len(self.place) + len(new) > self.most_words or self.chars + sum(map(len, new)) > MOST_CHARS:
            self._clear()
            new = list(chunks)
        if not new:
            return
        pieces = self.pieces(new)
        words = sorted(set(pieces) - self.special.keys() - {"\n"})
        ids, counts = self.merge(words)
        ids, counts = np.r_[ids, list(self.special.values())], np.r_[counts, np.ones(len(self.special), np.int64), 0]
        number = {w: i for i, w in enumerate([*words, *self.special, "\n"])}
        at = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        starts = np.cumsum(counts) - counts
        lengths = counts[at]
        self.ids = np.r_[self.ids, _gather(ids, starts[at], lengths).astype(np.int32)]
        self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(lengths)[at == len(counts) - 1]]
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.chars += sum(map(len, new))

    def _look_up(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of each part. Nothing that the vocabulary joins crosses a blank, so the chunks between blanks are
        looked up by themselves."""
        split = [p.replace("\n", " ").split(" ") for p in parts]
        self.learn(set().union(*split))
        at = np.concatenate([np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks)) for chunks in split])
        lengths = self.ends[at + 1] - self.ends[at]
        ids = _gather(self.ids, self.ends[at], lengths)
        return np.split(ids, np.cumsum(lengths)[np.cumsum([len(c) for c in split])[:-1] - 1])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins, with the end. Texts are taken in parts of about
        PART characters that end before a blank, and short texts together, so that the chunks at hand stay bounded."""
        found: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        parts: list[str] = []
        owners: list[int] = []

        def take() -> None:
            for i, ids in zip(owners, self._look_up(parts) if parts else [], strict=True):
                counts[i] += len(ids)
                found.append(ids)
            parts.clear(), owners.clear()

        chars = 0
        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                blank = text.find(" ", at + PART)
                to = len(text) if blank < 0 else blank
                parts.append(text[at:to])
                owners.append(i)
                chars += to - at
                at = to
                if chars >= PART:
                    take()
                    chars = 0
        take()
        return np.concatenate([np.empty(0, np.int32), *found]), np.r_[0, np.cumsum(counts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def joined(self, ids: np.ndarray, ends: np.ndarray, names: pa.Array | None = None) -> pa.Array:
        """For each run of ids their tokens (names: other strings) joined by blanks; ids that the vocabulary lacks
        are left out."""
        known = (ids >= 0) & (ids < self.size)
        known[known] = self.is_token[ids[known]]
        if not known.all():
            ids, ends = ids[known], np.r_[0, np.cumsum(known)][ends]
        strings = (self.names if names is None else names).take(pa.array(ids, pa.int32()))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), strings), " ")

    def decode(self, ids: list[int]) -> str:
        return self.joined(np.array(ids, np.int64), np.array([0, len(ids)]))[0].as_py()

    def digests(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[str]]:
        """Numbers of ids, SHA-256 of the ids and of the decoded text, for each text."""
        ids, ends = self.encode_all(texts)
        hexed = [[hashlib.sha256(s).hexdigest() for s in self.joined(ids, ends, names).cast(pa.binary()).to_pylist()] for names in (self.decimals, self.names)]
        return np.diff(ends), *hexed


@functools.lru_cache(maxsize=1)
def worker_bpe(path: str) -> WordBpe:
    """The encoder that the tasks of a worker process share."""
    bpe = WordBpe(path)
    give_back()  # what reading the vocabulary left
    return bpe


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """docs with token_ids, for every whole text; decoded: and with the text that these ids give back.
    Columns of these names are replaced."""
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for b in small_batches(batches):
            flat, ends = bpe.encode_all([t or "" for t in b["text"].to_pylist()])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            new = {"token_ids": ids} | ({"decoded": bpe.joined(flat, ends)} if decoded else {})
            yield pa.RecordBatch.from_arrays([*b.columns, *new.values()], [*b.schema.names, *new])

    docs = docs.drop("token_ids", *(["decoded"] if decoded else []))
    schema = StructType(list(docs.schema.fields)).add("token_ids", ArrayType(IntegerType()))
    return docs.mapInArrow(tidied(run), schema.add("decoded", StringType()) if decoded else schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows(token_ids, ...) with decoded; null ids and null lists are left out, and give the empty text."""
    from pyspark.sql.types import StringType, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for b in small_batches(batches):
            lists = b["token_ids"].to_pylist()
            flat = np.array([-1 if i is None else i for ids in lists for i in ids or []], np.int64)
            text = bpe.joined(flat, np.r_[0, np.cumsum([len(ids or []) for ids in lists])].astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, "decoded"])

    rows = rows.drop("decoded")
    return rows.mapInArrow(tidied(run), StructType(list(rows.schema.fields)).add("decoded", StringType()))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for b in small_batches(batches):
            n, ids, decoded = bpe.digests([t or "" for t in b["text"].to_pylist()])
            cols = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op9_numpy_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded texts of all documents."""
    return digests(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path(VOCABULARY))


SQL: dict[str, str] = {}
