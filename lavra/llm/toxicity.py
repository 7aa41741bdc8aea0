"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding: compatibility decomposition without marks, lower case, look-alike letters of other alphabets to
Latin, digits and signs that stand for letters to those letters, everything else to single blanks.

`fit` learns from a bounded sample of labelled rows (`MOST_LABELLED`, those of least hash): words and word
beginnings whose share of toxic documents is beyond chance get their log odds as weight; two-word phrases
around lexicon words that only clean documents hold become exceptions; a logistic curve over the summed
weight and the weight per hundred words turns hits into a score. Only sums and the sample's statistics
reach the driver. `score` then works on every whole text, one pass, no shuffle.

Defined results: null and blank texts have no hits and get the score of no hits; labels that are null,
or of documents that do not exist, are ignored; a document with several labels counts once, as toxic if any
says so; with no labels at all the lexicon is empty and all scores are 0.05; repeated rows are scored each;
other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MOST_LABELLED = 20_000
MOST_TERMS = 5_000
MOST_EXCEPTIONS = 1_000
CUT = 0.7

# Letters of other alphabets that look like Latin ones, and signs that stand for letters.
LOOK_ALIKES = "аaвbсcеeнhіiјjкkмmоoрpѕsтtхxуyԁdɡgոnսuαaβbεeηnιiκkνvοoρpτtυuχxıiłløoßs"
SIGNS = "0o1i3e4a5s7t8b@a$s!i"
_FOLD = {ord(a): b for a, b in zip(LOOK_ALIKES[::2] + SIGNS[::2], LOOK_ALIKES[1::2] + SIGNS[1::2], strict=True)}
_GAP = re.compile(r"[\W_]+")
#: A sign counts as a letter only inside a word, so that the mark at the end of a sentence stays a gap.
_SIGN = re.compile(r"(?<=\w)[@$!](?=\w)|(?<!\w)[@$](?=\w)")
_MARKS = re.compile("[̀-ͯ]+")


def fold(text: str | None) -> str:
    """Folded words, joined and enclosed by single blanks."""
    text = (text or "").lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    if _SIGN.search(text):
        text = _SIGN.sub(lambda m: _FOLD[ord(m[0])], text)
    return f" {_GAP.sub(' ', text).strip().translate(_FOLD)} "


@dataclass(frozen=True)
class Lexicon:
    """weights: of patterns " word " and " beginning"; exceptions: phrases " a b " inside which hits do not
    count; curve: constant, slope of ln(1 + weight), slope of ln(1 + weight per hundred words)."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-2.94, 2.0, 0.5)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for p, w in self.weights.items():
            a.add_word(p, (len(p), w, p))
        for p in self.exceptions:
            a.add_word(p, (len(p), None, p))
        if len(a):
            a.make_automaton()
        return a

    def hits(self, automaton, folded: str) -> list[tuple[int, float, str]]:
        """Start, weight and pattern of the hits that no exception covers, one (the heaviest) for each word."""
        if not len(automaton):
            return []
        best: dict[int, tuple[float, str]] = {}
        excused: list[tuple[int, int]] = []
        for end, (n, w, p) in automaton.iter(folded):
            at = end - n + 1
            if w is None:
                excused.append((at, end))
            elif w > best.get(at, (0.0, ""))[0]:
                best[at] = (w, p)
        return [(at, w, p) for at, (w, p) in best.items() if not any(a <= at < b for a, b in excused)]

    def score(self, automaton, folded: str) -> tuple[float, int]:
        hits = self.hits(automaton, folded)
        n_words = max(1, folded.count(" ") - 1)
        z = float(np.dot(self.curve, _features(sum(w for _, w, _ in hits), n_words)))
        return 1 / (1 + float(np.exp(-np.clip(z, -30, 30)))), len(hits)


def _features(weight: float, n_words: int) -> list[float]:
    return [1.0, float(np.log1p(weight)), float(np.log1p(100 * weight / n_words))]


def _terms(folded: str) -> set[str]:
    """Patterns that a document votes for: its words of 3 letters or more and their beginnings of 4 to 7."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(4, min(8, len(w))))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, keep: Column, most: int = MOST_LABELLED) -> DataFrame:
    """text and toxic of the labelled documents for which keep holds, at most `most`: the ids are chosen
    first (by hash), so that only those texts move; the chosen ids are the bound of what is broadcast."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _term_counts(rows: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean, toxic = Counter(), Counter()
            for text, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                (toxic if y else clean).update(_terms(fold(text)))
            every = sorted(clean.keys() | toxic.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(every), pa.array([toxic[t] for t in every], pa.int64()), pa.array([clean[t] for t in every], pa.int64())], ["term", "toxic", "clean"]
            )

    return rows.mapInArrow(count, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _phrases(rows: DataFrame, found: Lexicon) -> DataFrame:
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = found.automaton()
        for b in batches:
            out: list[tuple[str, int, int]] = []
            weights: list[tuple[float, int, int]] = []
            for text, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                folded = fold(text)
                hits = found.hits(a, folded)
                seen = set()
                for at, _, _ in hits:
                    end = folded.index(" ", at + 1)
                    left = folded.rfind(" ", 0, at)
                    right = folded.find(" ", end + 1)
                    if left >= 0:
                        seen.add(folded[left : end + 1])
                    if right >= 0:
                        seen.add(folded[at : right + 1])
                out += [(p, int(bool(y)), 1 - int(bool(y))) for p in seen]
                weights.append((sum(w for _, w, _ in hits), max(1, folded.count(" ") - 1), int(bool(y))))
            n = len(out)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out] + [None] * len(weights), pa.string()),
                    pa.array([x[1] for x in out] + [x[2] for x in weights], pa.int64()),
                    pa.array([x[2] for x in out] + [1 - x[2] for x in weights], pa.int64()),
                    pa.array([None] * n + [x[0] for x in weights], pa.float64()),
                    pa.array([None] * n + [x[1] for x in weights], pa.int64()),
                ],
                ["phrase", "toxic", "clean", "weight", "n_words"],
            )

    return rows.mapInArrow(contexts, "phrase string, toxic bigint, clean bigint, weight double, n_words bigint")


def _curve(weight: np.ndarray, n_words: np.ndarray, toxic: np.ndarray, penalty: float = 1e-3) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, slopes not negative, a weak penalty."""
    if not toxic.any() or toxic.all():
        return Lexicon.curve
    x = np.stack([np.ones_like(weight), np.log1p(weight), np.log1p(100 * weight / n_words)], 1)
    theta = np.array([-2.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - toxic) / len(toxic) + penalty * theta * [0, 1, 1]
        h = (x * (p * (1 - p))[:, None]).T @ x / len(toxic) + np.diag([1e-9, penalty, penalty])
        step = np.linalg.solve(h, grad)
        theta = theta - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        theta[1:] = np.maximum(theta[1:], 0)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in theta)


def fit(rows: DataFrame, chance: float = 1e-5, least: float = 4.0) -> Lexicon:
    """The lexicon of rows(text, toxic 0/1). A term enters if its log odds are `least` or more and so many
    toxic documents would hold it by chance with a probability under `chance` only."""
    n_toxic, n_clean = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not n_toxic or not n_clean:
        return Lexicon(curve=(-2.9444389791664403, 2.0, 0.5))
    odds = F.log((F.col("toxic") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n_clean + 1.0))
    base = n_toxic / (n_toxic + n_clean)
    n = F.col("toxic") + F.col("clean")
    # the Chernoff bound of the binomial tail
    share = F.col("toxic") / n
    tail = -n * (share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0))
    top = (
        _term_counts(rows)
        .filter("toxic > 0")
        .withColumn("weight", odds)
        .filter((F.col("weight") >= least) & (tail <= float(np.log(chance))) & (share > base))
        .orderBy(F.desc("toxic"), F.length("term"), "term")
        .limit(MOST_TERMS)
    )
    weights: dict[str, float] = {}
    for r in top.collect():  # at most MOST_TERMS rows; a term that a kept, no weaker beginning covers adds nothing
        starts = [r["term"][:k] for k in range(5, len(r["term"]))]
        if not any(weights.get(s, 0) >= r["weight"] - 1e-9 for s in starts):
            weights[r["term"]] = r["weight"]
    found = Lexicon(weights)
    seen = _phrases(rows, found)
    excused = (
        seen.filter("phrase is not null").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter("clean >= 3 and toxic = 0").orderBy(F.desc("clean"), "phrase").limit(MOST_EXCEPTIONS)
    )
    found = Lexicon(weights, tuple(r["phrase"] for r in excused.collect()))
    # hits of the sample without what is now excused: three numbers for each labelled row
    table = _phrases(rows, found).filter("phrase is null").select("weight", "n_words", "toxic").toPandas()
    curve = _curve(table["weight"].to_numpy(float), table["n_words"].to_numpy(float), table["toxic"].to_numpy(float))
    return Lexicon(weights, found.exceptions, curve)


def score(docs: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """Score and number of hits of each row's text, with the columns named in keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in batches:
            got = [lexicon.score(a, fold(t.as_py())) for t in b["text"]]
            cols = [b[k] for k in keep] + [pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "score", "n_hits"])

    kept = docs.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)
    return kept.mapInArrow(run, f"{fields}, score double, n_hits bigint")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; the lexicon is learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    rows = training_rows(docs, labels, ~held_out(F.col("doc_id")))
    lexicon = fit(rows.cache())
    rows.unpersist()
    return score(docs, lexicon, "doc_id").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "n_hits"
    )


SQL: dict[str, str] = {}
