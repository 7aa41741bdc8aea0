"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (-1) or nothing (0) on every document. The votes form at
most 3 ** len(LABELLERS) patterns; patterns are counted over all documents, and expectation-maximisation on
those counts estimates, for either class, how often each labeller votes what, and how common the class is.
The posteriors of a bounded sample (`MOST_TRAINING` documents of least hash) train a linear scorer on hashed
features: the shapes of words (letter classes and signs, runs cut to one), and levels of the statistics.
A document is kept if the scorer gives it `CUT` or more. No hand-made label takes part.

Two passes over whole texts; pattern counts and the sample's hashed features are all that reaches the driver.

Defined results: null and blank texts have no words, are voted bad by the length labeller and are rejected
unless the scorer says otherwise; repeated rows are judged each; ties of the sample's hash go by doc_id;
an empty table gives an empty result; other columns pass through `judge` untouched.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, tidied

DIMS = 512
MOST_TRAINING = 20_000
CUT = 0.5
MOST_FALSE_ALARMS = 0.002

#: Bytes to classes: lower-case letters and bytes beyond ASCII a, upper case A, digits 0, white space a blank.
_CLASS = bytes(
    97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b in b" \t\n\v\f\r" else b for b in range(256)
)
_RUN = re.compile(rb"(.)\1+")
_PLAIN = b"aA0 .,;:'-()\"?"


@dataclass(frozen=True)
class Stats:
    n_words: int
    same: float  # words equal to the word before
    distinct: float  # log of distinct words to log of words
    upper: float  # upper-case words of all with letters
    signs: float  # signs other than . , ; : ' - ( ) " ? of all characters
    ends: float  # ends of sentences for each word
    word_len: float
    lines: float  # distinct lines of all
    shapes: Counter


def stats(text: str | None) -> Stats:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    ws = raw.split()  # bytes are split at just the white space of the word contracts
    n = len(ws)
    classes = raw.translate(_CLASS)
    shapes: Counter = Counter()
    for s, c in Counter(classes.split()).items():  # few are distinct: runs are cut in those only
        shapes[_RUN.sub(rb"\1", s)] += c
    with_letters = sum(c for s, c in shapes.items() if b"a" in s or b"A" in s)
    upper = sum(c for s, c in shapes.items() if b"A" in s and b"a" not in s)
    lines = [x for x in text.split("\n") if x]
    return Stats(
        n,
        sum(map(operator.eq, ws, ws[1:])) / max(1, n - 1),
        float(np.log(max(1, len(set(ws)))) / np.log(n)) if n > 1 else 1.0,
        upper / max(1, with_letters),
        len(classes.translate(None, _PLAIN)) / max(1, len(classes)),
        sum(c for s, c in shapes.items() if s[-1:] in b".!?") / max(1, n),
        len(text) / max(1, n) - 1,
        len(set(lines)) / max(1, len(lines)),
        shapes,
    )


def _vote(good: bool, bad: bool) -> int:
    return -1 if bad else int(good)


# The labellers and their thresholds.
LABELLERS = {
    "length": lambda s: _vote(s.n_words >= 20, s.n_words == 0),
    "stutter": lambda s: _vote(s.same < 0.03, s.same > 0.15),
    "variety": lambda s: 0 if s.n_words < 30 else _vote(s.distinct > 0.82, s.distinct < 0.65),
    "shouting": lambda s: _vote(s.upper < 0.15, s.upper > 0.5),
    "signs": lambda s: _vote(s.signs < 0.01, s.signs > 0.05),
    "sentences": lambda s: 0 if s.n_words < 30 else _vote(0.02 <= s.ends <= 0.3, s.ends < 0.003 or s.ends > 0.5),
    "word_length": lambda s: _vote(3 <= s.word_len <= 11, s.word_len < 2 or s.word_len > 16),
    "lines": lambda s: _vote(s.lines > 0.8, s.lines < 0.4),
}


def votes(s: Stats) -> list[int]:
    return [f(s) for f in LABELLERS.values()]


def hashed(s: Stats, dims: int = DIMS) -> dict[int, float]:
    """Hashed features: square root of the share of each word shape (so that a text's shapes have norm 1),
    and a 1 for the level of each statistic."""
    out: dict[int, float] = {}
    for shape, c in s.shapes.items():
        j = zlib.crc32(shape) % (dims - 1)
        out[j] = out.get(j, 0.0) + (c / max(1, s.n_words)) ** 0.5
    levels = {"n": min(12, s.n_words.bit_length()), "same": min(20, int(s.same * 40)), "distinct": int(s.distinct * 20), "upper": int(s.upper * 10),
              "signs": min(20, int(s.signs * 200)), "ends": min(20, int(s.ends * 40)), "len": min(20, int(s.word_len)), "lines": int(s.lines * 5)}
    for k, v in levels.items():
        j = zlib.crc32(f"{k}={v}".encode()) % (dims - 1)
        out[j] = out.get(j, 0.0) + 1.0
    out[dims - 1] = 1.0
    return out


@dataclass(frozen=True)
class LabelModel:
    """prior: share of good documents; rates[class][labeller][vote + 1]."""

    prior: float
    rates: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        k = np.arange(patterns.shape[1])
        logs = [np.log(p) + np.where(patterns == 0, 0, np.log(self.rates[c][k, patterns + 1])).sum(1) for c, p in ((0, 1 - self.prior), (1, self.prior))]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation with half a vote of smoothing. It starts from "good unless someone votes bad",
    and a labeller is taken to call a good document bad in `MOST_FALSE_ALARMS` of the cases at most: without
    that bound the two classes drift to whatever splits the patterns best, since kinds of bad documents that
    trip one labeller each look unlike one another."""
    post = np.where((patterns < 0).any(1), 0.05, 0.95) if len(patterns) else np.zeros(0)
    model = LabelModel(0.5, np.full((2, patterns.shape[1], 3), 1 / 3))
    for _ in range(rounds):
        rates = np.empty_like(model.rates)
        for c, w in ((0, (1 - post) * counts), (1, post * counts)):
            for v in range(3):
                rates[c, :, v] = ((patterns == v - 1) * w[:, None]).sum(0) + 0.5
        rates[:, :, 1] = 1e-9  # a labeller that does not vote says nothing: short texts are not bad for it
        rates /= rates.sum(2, keepdims=True)
        spare = np.maximum(0, rates[1, :, 0] - MOST_FALSE_ALARMS)
        rates[1, :, 0] -= spare
        rates[1, :, 2] += spare
        prior = float(np.clip(((post * counts).sum() + 1) / (counts.sum() + 2), 0.01, 0.99))
        model = LabelModel(prior, rates)
        new = model.posterior(patterns)
        done = len(post) == 0 or np.abs(new - post).max() < 1e-7
        post = new
        if done:
            break
    return model


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps with a ridge."""
    theta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - y) / max(1, len(y)) + penalty * theta
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x / max(1, len(y)) + penalty * np.eye(len(theta))
        step = np.linalg.solve(h, grad)
        theta = theta - step
        if np.abs(step).max() < 1e-4:
            break
    return theta


def _votes_of(docs: DataFrame) -> DataFrame:
    """How often each pattern of votes occurs in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            c = Counter(tuple(votes(stats(t.as_py()))) for t in b["text"])
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in c], pa.list_(pa.int32())), pa.array(c.values(), pa.int64())], ["votes", "n"])

    return docs.select("text").mapInArrow(tidied(run), "votes array<int>, n bigint")


def _features_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            got = [stats(t.as_py()) for t in b["text"]]
            sparse = [hashed(s) for s in got]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([votes(s) for s in got], pa.list_(pa.int32())),
                    pa.array([list(h) for h in sparse], pa.list_(pa.int32())),
                    pa.array([list(h.values()) for h in sparse], pa.list_(pa.float32())),
                ],
                ["votes", "at", "value"],
            )

    return docs.select("text").mapInArrow(tidied(run), "votes array<int>, at array<int>, value array<float>")


@dataclass(frozen=True)
class Classifier:
    labels: LabelModel
    weights: np.ndarray


def fit(docs: DataFrame, most: int = MOST_TRAINING) -> Classifier:
    counted = _votes_of(docs).groupBy("votes").agg(F.sum("n").alias("n")).toPandas()
    patterns = np.array(list(counted["votes"]), dtype=int).reshape(-1, len(LABELLERS))
    labels = fit_labels(patterns, counted["n"].to_numpy(float))
    ids = docs.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = _features_of(docs.join(F.broadcast(ids), "doc_id").select("text")).limit(2 * most).toPandas()  # the ids bound it, unless rows repeat
    x = np.zeros((len(sample), DIMS), np.float32)
    for i, (at, value) in enumerate(zip(sample["at"], sample["value"], strict=True)):
        x[i, at] = value
    y = labels.posterior(np.array(list(sample["votes"]), dtype=int).reshape(-1, len(LABELLERS)))
    return Classifier(labels, fit_linear(x, y))


def judge(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with quality_score, quality_posterior (of the label model) and keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            got = [stats(t.as_py()) for t in b["text"]]
            z = np.array([sum(model.weights[j] * v for j, v in hashed(s).items()) for s in got], dtype=float)
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            post = model.labels.posterior(np.array([votes(s) for s in got], dtype=int).reshape(-1, len(LABELLERS)))
            new = [pa.array(score), pa.array(post), pa.array(score >= CUT)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "quality_score", "quality_posterior", "keep"])

    from pyspark.sql.types import BooleanType, DoubleType, StructType

    clash = [c for c in docs.columns if c in ("quality_score", "quality_posterior", "keep")]
    docs = docs.drop(*clash)
    schema = StructType(list(docs.schema.fields)).add("quality_score", DoubleType()).add("quality_posterior", DoubleType()).add("keep", BooleanType())
    return docs.mapInArrow(tidied(run), schema)


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents and whether they are kept."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return judge(docs, fit(docs)).select("doc_id", "quality_score", "quality_posterior", F.col("keep").cast("int").alias("keep"))


SQL: dict[str, str] = {}
