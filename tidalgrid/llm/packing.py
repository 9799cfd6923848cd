"""Packing by cutting-stock column generation.

Each document's tokens are cut into full pieces, perhaps half a piece, and a remainder. The histogram of lengths (at most 1024 numbers,
whatever the corpus) is a cutting-stock problem: a linear programme over patterns of lengths that fit a sequence,
whose columns a knapsack dynamic programme prices. Rounded down, each pattern is used so many times; what rounding
leaves, at most a few per pattern, is placed first-fit-decreasing. Documents are ranked within their length by counts
per task, and a document's rank tells its pattern, sequence and offset by arithmetic, without a global sort.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidalgrid.llm.common import Scratch
from tidalgrid.llm.token_counts import byte_alphabet

CAPACITY = 1024

#: How byte-level BPE cuts texts into pieces (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Whole texts to little-endian 32-bit ids of a byte-level BPE file of the ``tokenizers`` library.

    If the file's ids follow the order of its merges, the vocabulary is handed to the faster ``tiktoken``, special
    strings being cut out first; otherwise the library itself encodes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task keeps to its own core
        spec = json.load(open(path, encoding="utf-8"))
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model.get("merges", [])]
        made = [model["vocab"].get(a + b, -1) for a, b in pairs]
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        plain = plain and not spec.get("normalizer") and not model.get("ignore_merges") and made == sorted(made)
        self.path, self.fast, self.model = path, None, None
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        if plain:
            import tiktoken

            ranks = {raw(k): v for k, v in model["vocab"].items() if all(c in alphabet for c in k) and k not in self.special}
            self.fast = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _library(self, texts: list[str]) -> list[bytes]:
        if self.model is None:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(self.path)
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bytes:
        try:
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        except BaseException as error:  # very long white space is beyond the fast library's pattern matcher, which panics
            if type(error).__name__ != "PanicException":
                raise
            return self._library([text])[0]

    def batch(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return self._library(texts)
        out = []
        for text in texts:
            if self.cut is None or not self.cut.search(text):
                out.append(self._plain(text))
            else:
                out.append(b"".join(self.special.get(part) or self._plain(part) for part in self.cut.split(text) if part))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: full ones, half a sequence if that much is left, and the rest.

    Without the cut at a half, corpora with many remainders of over half a sequence can't be packed without padding.
    """
    out = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    at = len(out) * capacity
    if n - at >= capacity // 2:
        out.append((at, capacity // 2))
        at += capacity // 2
    return [*out, (at, n - at)] if n > at else out


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece, with its task and its rank there within its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, task = encoder(tokenizer), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):  # a slice at a time, to keep little in memory
                part = batch.slice(lo, 512)
                cols: list[list] = [[] for _ in range(7)]
                for doc, data in zip(part.column(0).to_pylist(), made.batch([t or "" for t in part.column(1).to_pylist()])):
                    data += end
                    n = len(data) // 4
                    for start, size in cuts(n, capacity):
                        row = (doc, start, size, zlib.crc32(data[4 * start : 4 * (start + size)]), n, task, seen[size])
                        seen[size] += 1
                        for c, v in zip(cols, row):
                            c.append(v)
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, rank long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def knapsack(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of lengths within the capacity, by dynamic programming; copies per length."""
    worth = np.zeros(capacity + 1)
    worth[lengths] = np.maximum(value, 0)
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for w in range(1, capacity + 1):
        total = best[w - 1 :: -1][:w] + worth[1 : w + 1]
        k = int(total.argmax())
        best[w], took[w] = total[k], k + 1
    copies, w = np.zeros(capacity + 1, np.int64), capacity
    while w > 0 and best[w] > 0:
        if worth[took[w]] > 0:
            copies[took[w]] += 1
        w -= took[w]
    return float(best[capacity]), copies[lengths]


def starting_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """A feasible basis with little waste: fill a pattern around the largest length left, use it until one is used up."""
    n = len(lengths)
    left, alive, patterns = demand.astype(float).copy(), np.ones(n, bool), np.zeros((n, n), np.int64)
    for _ in range(n):
        at = np.flatnonzero(alive)
        top = at[-1]
        copies = np.zeros(n, np.int64)
        fits = at[lengths[at] <= capacity - lengths[top]]
        if len(fits):
            share = left[fits] * lengths[fits]
            worth = lengths[fits] * (1 + 1e-3 * share / max(share.max(), 1e-9))
            copies[fits] = knapsack(worth, lengths[fits], capacity - int(lengths[top]))[1]
        copies[top] += 1
        used = np.flatnonzero(copies)
        ratio = left[used] / copies[used]
        r = used[int(ratio.argmin())]
        left = np.maximum(left - ratio.min() * copies, 0)
        left[r] = 0
        alive[r] = False
        patterns[r] = copies
    return patterns


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots; plain array arithmetic, so no library threads start in the driver."""
    n = len(matrix)
    work = np.concatenate([matrix.astype(float), np.eye(n)], axis=1)
    for k in range(n):
        p = k + int(np.abs(work[k:, k]).argmax())
        if p != k:
            work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        rows = np.flatnonzero(factor)
        work[rows] -= factor[rows, None] * work[k]
    return work[:, n:]


def generate(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4, most: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Column generation by the revised simplex method: patterns (rows: copies per length) and how often each is used.

    Ends when the value is within ``gap`` of the larger of Farley's and the volume bound.
    """
    n = len(lengths)
    patterns = starting_basis(lengths, demand, capacity)
    inverse = inverted(patterns.T)
    used = np.maximum((inverse * demand).sum(axis=1), 0)
    bound = float((lengths * demand).sum()) / capacity
    for k in range(most):
        if k % 500 == 499:
            inverse = inverted(patterns.T)
            used = np.maximum((inverse * demand).sum(axis=1), 0)
        dual = inverse.sum(axis=0)
        value, column = knapsack(dual, lengths, capacity)
        total = used.sum()
        bound = max(bound, float((dual * demand).sum()) / max(value, 1.0))
        if value <= 1 + 1e-9 or total <= bound * (1 + gap):
            break
        direction = (inverse * column).sum(axis=1)
        ratio = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1), np.inf)
        r = int(ratio.argmin())
        step = ratio[r]
        used -= step * direction
        used[r] = step
        np.maximum(used, 0, out=used)
        row = inverse[r] / direction[r]
        direction[r] = 0
        inverse -= np.outer(direction, row)
        inverse[r] = row
        patterns[r] = column
    return patterns, used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """Per length, its slots by rank: columns first rank, copies a sequence, first sequence, offset of the first copy.

    Rank k of a slot's row is copy k % copies of sequence first + k // copies.
    """
    slots: dict[int, list] = {x: [] for x in histogram}
    ranks = dict.fromkeys(histogram, 0)
    sequence = 0

    def place(copies: dict[int, int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for x, a in sorted(copies.items(), reverse=True):
            slots[x].append((ranks[x], a, sequence, offset))
            ranks[x] += a * times
            offset += a * x
        sequence += times

    if n := histogram.get(capacity):
        place({capacity: 1}, n)
    lengths = np.array(sorted(x for x in histogram if x < capacity), np.int64)
    if len(lengths):
        left = np.array([histogram[int(x)] for x in lengths], np.int64)
        patterns, used = generate(lengths, left.astype(float), capacity)
        for pattern, times in zip(patterns, np.floor(used + 1e-6).astype(np.int64)):
            times = min([int(times), *(int(left[i] // pattern[i]) for i in np.flatnonzero(pattern))])
            if times > 0:
                place({int(lengths[i]): int(pattern[i]) for i in np.flatnonzero(pattern)}, times)
                left -= pattern * times
        # what rounding leaves: no more than the patterns hold once
        free: list[list] = []
        for x, n in sorted(zip(lengths.tolist(), left.tolist()), reverse=True):
            for _ in range(n):
                at = next((b for b in free if b[0] >= x), None)
                if at is None:
                    free.append(at := [capacity, {}])
                at[0] -= x
                at[1][x] = at[1].get(x, 0) + 1
        for _, copies in free:
            place(copies, 1)
    return {x: np.array(s, np.int64) for x, s in slots.items() if s}


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece of docs(doc_id, text).

    A document is its ids and then ``end_id``; a null or empty text is that id alone; rows that repeat an id are packed
    each; a null doc_id is returned as null; an empty table gives no pieces; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.save(pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = scratch.save(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    slots = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                mine = slots[int(x)]
                row = mine[np.searchsorted(mine[:, 0], rank[at], side="right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + k // row[:, 1]
                offset[at] = row[:, 3] + k % row[:, 1] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = cut.join(bases, ["task", "length"]).select(*names, (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
