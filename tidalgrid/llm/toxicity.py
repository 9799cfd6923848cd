"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities: lexicon words (a lexicon of words and word beginnings, learned from labelled
texts by log-odds), lexicon words near the second person, capitals, exclamation and question marks, and spellings
with signs or digits inside words. The trees are fitted to the logistic loss; out-of-fold scores are calibrated by
pool-adjacent-violators.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalgrid.llm.common import Scratch, bytes_column

#: At most so many labelled rows, taken by the order of a hash of doc_id, train the model.
MOST_ROWS = 20_000
#: Second-person words of English, German, French and Spanish (fixed values).
SECOND = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen euch euer ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split()
)
#: Signs and digits that stand for letters (fixed values).
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")
EDGE = " .,;:!?\"'()[]{}<>|*-_#"
MIXED = re.compile(r"[^\W\d_][\d@$!*|.\-_]+[^\W\d_]")
SIGNS = re.compile(r"[*.\-_]")
UPPER = bytes(range(65, 91))

FEATURES = ["lexicon", "hits", "strongest", "second", "near_second", "shouted", "capitals", "exclaim", "question", "obfuscated", "unmasked", "length"]


def terms(word: str) -> list[str]:
    """What a lower-case word can match: itself, and its beginnings of 4 to 6 letters, marked by a star."""
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)]


class Features:
    """Maps texts to rows of features; what is known of a word is kept in a bounded table."""

    def __init__(self, lexicon: dict[str, int], most: int = 400_000):
        self.lexicon, self.most, self.known = lexicon, most, {}

    def level(self, word: str) -> int:
        return max((self.lexicon.get(t, 0) for t in terms(word)), default=0)

    def code(self, raw: bytes) -> int:
        """Bits 0-2: lexicon level; 3: second person; 4: shouted; 5: signs inside; 6: in the lexicon without them."""
        got = self.known.get(raw)
        if got is None:
            core = raw.decode("utf-8", "replace").strip(EDGE)
            word = core.lower()
            got = self.level(word) | (word in SECOND) << 3 | (len(core) > 1 and core.isupper()) << 4
            if MIXED.search(core):
                got |= 32
                plain = word.translate(LOOKALIKE)
                if not got & 7 and max(self.level(plain), self.level(SIGNS.sub("", plain))):
                    got |= 64
            if len(self.known) < self.most:
                self.known[raw] = got
        return got

    def row(self, text: bytes) -> list[float]:
        words = text.split()
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        codes = np.frombuffer(bytes(map(self.code, words)), np.uint8)
        level = codes & 7
        hit, second = np.flatnonzero((level > 0) | (codes & 64 > 0)), np.flatnonzero(codes & 8)
        near = 0
        if len(hit) and len(second):
            at = np.searchsorted(second, hit)
            gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - hit), np.abs(second[np.maximum(at - 1, 0)] - hit))
            near = int((gap <= 5).sum())
        size = len(text)
        return [
            float(level.sum()) / n, float(np.log1p(len(hit))), float(level.max()), len(second) / n, near / n, float((codes & 16 > 0).sum()) / n,
            (size - len(text.translate(None, UPPER))) / size, text.count(b"!") / n, text.count(b"?") / n,
            float((codes & 32 > 0).sum()) / n, float((codes & 64 > 0).sum()), float(np.log1p(n)),
        ]


class Trees:
    """Gradient-boosted regression trees of a fixed depth for the logistic loss, over binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self.binned(x)
        mean = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(mean / (1 - mean)))
        raw, self.trees = np.full(len(y), self.start), []
        leaves = 1 << self.depth
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node = np.ones(len(y), np.int64)
            feature, cut = np.zeros(leaves, np.int64), np.full(leaves, self.bins, np.int64)
            for level in range(self.depth):
                first, count = 1 << level, 1 << level
                best = np.full(count, 1e-6)
                for k in range(x.shape[1]):
                    at = (node - first) * self.bins + b[:, k]
                    sums = [np.bincount(at, w, count * self.bins).reshape(count, -1).cumsum(axis=1) for w in (g, h)]
                    (gl, hl), (gt, ht) = sums, [s[:, -1:] for s in sums]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    top = gain.argmax(axis=1)
                    value = gain[np.arange(count), top]
                    better = value > best
                    best[better] = value[better]
                    feature[first : first + count][better] = k
                    cut[first : first + count][better] = top[better]
                node = 2 * node + (b[np.arange(len(y)), feature[node]] > cut[node])
            gs, hs = (np.bincount(node - leaves, w, leaves) for w in (g, h))
            leaf = self.rate * gs / (hs + 1)
            raw += leaf[node - leaves]
            self.trees.append((feature, cut, leaf))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (b[rows, feature[node]] > cut[node])
            out += leaf[node - len(leaf)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, rate) of the least-squares increasing fit; equal scores are one place."""
    values, at = np.unique(score, return_inverse=True)
    ones, sizes = np.bincount(at, y, len(values)), np.bincount(at, minlength=len(values))
    blocks: list[list[float]] = []
    for s, t, n in zip(values.tolist(), ones.tolist(), sizes.tolist()):
        blocks.append([t, float(n), s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, n, at = blocks.pop()
            last = blocks[-1]
            last[2] = (last[2] * last[1] + at * n) / (last[1] + n)
            last[0] += total
            last[1] += n
    return np.array([b[2] for b in blocks]), np.array([(b[0] + 0.01) / (b[1] + 0.02) if b[1] > 1 else b[0] for b in blocks])


class Model:
    """Lexicon, trees and calibration; without both labels among the training rows, a constant."""

    def __init__(self, lexicon: dict[str, int], x: np.ndarray, y: np.ndarray, folds: int = 3):
        self.lexicon, self.trees = lexicon, None
        self.rate = float(y.mean()) if len(y) else 0.0
        if len(np.unique(y)) < 2 or len(y) < 2 * folds:
            return
        out = np.zeros(len(y))
        for k in range(folds):
            held = np.arange(len(y)) % folds == k
            out[held] = Trees().fit(x[~held], y[~held]).raw(x[held])
        self.knots = isotonic(out, y)
        self.trees = Trees().fit(x, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.rate)
        raw = self.trees.raw(x)
        calibrated = np.interp(raw, *self.knots)
        # a little of the uncalibrated score keeps the order within the flat parts
        return np.clip(0.999 * calibrated + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


def term_counts(rows: DataFrame, among: frozenset | None) -> DataFrame:
    """term, n: in how many texts a term occurs; of ``among`` only, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in bytes_column(batch.column(0)):
                words = {w.decode("utf-8", "replace").strip(EDGE).lower() for w in set(text.split())}
                found = {t for w in words if len(w) > 2 for t in terms(w)}
                counts.update(found if among is None else found & among)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return rows.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(rows: DataFrame) -> dict[str, int]:
    """Levels 1 to 7 by log-odds of terms in rows(text, toxic); all terms, as the rows are bounded."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    least = max(3, round(0.004 * bad))
    some = term_counts(rows.where("toxic = 1"), None).where(F.col("n") >= least).collect()
    positive = {r["term"]: r["n"] for r in some}
    if not positive:
        return {}
    negative = {r["term"]: r["n"] for r in term_counts(rows.where("toxic = 0"), frozenset(positive)).collect()}
    odds = {t: float(np.log((n + 0.5) / (bad + 1)) - np.log((negative.get(t, 0) + 0.5) / (good + 1))) for t, n in positive.items()}
    return {t: int(np.clip(round(v), 1, 7)) for t, v in sorted(odds.items()) if v > 2.0}


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, most_rows: int = MOST_ROWS, seed: str = "") -> Model:
    """Learns from labels(doc_id, toxic); at most ``most_rows`` of them, so they can be sent to all tasks."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most_rows)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one text an id, so the rows are bounded as well
    rows = scratch.save(rows, "labelled")
    lexicon = learn_lexicon(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(lexicon)
        for batch in batches:
            x = [made.row(t) for t in bytes_column(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    got = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "toxic").mapInArrow(run, "doc_id long, toxic int, x array<double>")
    data = sorted((tuple(r["x"]), r["toxic"]) for r in got.collect())  # no order of ids may reach the model
    x = np.array([d[0] for d in data]).reshape(len(data), len(FEATURES))
    return Model(lexicon, x, np.array([d[1] for d in data], float))


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text).

    Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2. A null text scores as an empty one;
    a null doc_id is returned as null (held_out null); repeated rows score the same; without labels, or with one kind
    only, all rows get the rate of label 1. Neither language, source nor id are inputs; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(docs, labels.where(~held), scratch, most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(model.lexicon)
        for batch in batches:
            x = np.array([made.row(t) for t in bytes_column(batch.column(1))]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
