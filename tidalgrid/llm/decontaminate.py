"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with whole documents.

A window is 13 consecutive words of an item (all of a shorter item). Each window is a set of word shingles (3 words,
or all of a shorter window); containment of a whole window needs all of them, so the necessary prefix is the rarest
one, rarity being counted over all documents. Documents are joined on these prefix shingles; the shingle's place must
leave room for the window's head and tail (positional and length bounds); then the words are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalgrid.llm.common import ALNUM, BASE_A, Scratch, WordHashes, as_long, bytes_column, rolling

SPAN, SHINGLE = 13, 3
#: Benchmark text is joined in blocks of about so many bytes; each block is sent to all tasks.
BLOCK_BYTES = 2 << 20


class Windows:
    """The distinct windows of a block of items, with the shingles that they hold; words are numbers, lists are flat."""

    def __init__(self, items: list[tuple[int, bytes]], span: int):
        table, places = WordHashes(most=0), {}
        self.numbers: dict[bytes, int] = {}
        words_of, items_of, self.grams = [], [], []
        for item, text in items:
            words = text.translate(ALNUM).split()
            n = min(span, len(words))
            if not n:
                continue
            ids = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int32)
            g = min(SHINGLE, n)
            grams = rolling(np.fromiter((table[w] for w in words), np.uint64, len(words)), g, BASE_A)
            for i in range(len(words) - n + 1):
                at = places.setdefault(ids[i : i + n].tobytes(), len(words_of))
                if at == len(words_of):
                    words_of.append(ids[i : i + n])
                    items_of.append({item})
                    self.grams.append((g, grams[i : i + n - g + 1]))
                else:
                    items_of[at].add(item)
        flat = lambda lists, kind: (np.cumsum([0, *map(len, lists)]), np.concatenate([np.fromiter(x, kind, len(x)) for x in lists] or [np.empty(0, kind)]))
        self.words, self.items = flat(words_of, np.int32), flat([sorted(x) for x in items_of], np.int64)
        self.sizes = sorted({g for g, _ in self.grams})
        self.universe = {g: np.unique(np.concatenate([x for k, x in self.grams if k == g])) for g in self.sizes}

    def prefixes(self, counts: dict[tuple[int, int], int]) -> None:
        """Chooses each window's rarest shingle, by (size, value) -> count; the first of equals."""
        rows: dict[int, list[tuple[int, int, int]]] = {g: [] for g in self.sizes}
        for w, (g, grams) in enumerate(self.grams):
            offset = min(range(len(grams)), key=lambda i: counts.get((g, int(grams[i])), 0))
            rows[g].append((int(grams[offset]), w, offset))
        self.tokens, self.first, self.entries = {}, {}, {}
        for g, found in rows.items():
            found.sort()
            self.tokens[g], start = np.unique(np.array([r[0] for r in found], np.uint64), return_index=True)
            self.first[g] = np.append(start, len(found))
            self.entries[g] = np.array([r[1:] for r in found], np.int64).reshape(-1, 2)
        del self.grams, self.universe


def _sieve(values: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[values & np.uint64((1 << 20) - 1)] = True
    return bits


def _lookup(grams: np.ndarray, bits: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of grams that are among the sorted values, and their indices there."""
    at = np.flatnonzero(bits[grams & np.uint64((1 << 20) - 1)])
    k = np.minimum(np.searchsorted(values, grams[at]), len(values) - 1)
    same = values[k] == grams[at]
    return at[same], k[same]


def shingle_counts(docs: DataFrame, windows: Windows) -> DataFrame:
    """size, value, n: how often the block's shingles occur in all documents."""
    universe = windows.universe

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        bits = {g: _sieve(v) for g, v in universe.items()}
        counts = {g: np.zeros(len(v), np.int64) for g, v in universe.items()}
        for batch in batches:
            for text in bytes_column(batch.column(0)):
                words = text.translate(ALNUM).split()
                h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
                for g, values in universe.items():
                    if len(h) >= g:
                        np.add.at(counts[g], _lookup(rolling(h, g, BASE_A), bits[g], values)[1], 1)
        for g, c in counts.items():
            some = c > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), g, np.int32)), pa.array(as_long(universe[g][some])), pa.array(c[some])], names=["size", "value", "n"])

    made = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "size int, value long, n long")
    return made.groupBy("size", "value").agg(F.sum("n").alias("n"))


def hits(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """doc_id, key, n_words, spans (lo, hi: words hit, end exclusive, merged), items (ids with occurring windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, windows = WordHashes(), shared.value
        bits = {g: _sieve(v) for g, v in windows.tokens.items()}
        (word_ends, all_words), (item_ends, all_items), numbers = windows.words, windows.items, windows.numbers
        for batch in batches:
            sizes, spans, items = [], [], []
            for text in bytes_column(batch.column(2)):
                words = text.translate(ALNUM).split()
                h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
                found, mine, ids = [], set(), None
                for g, values in windows.tokens.items():
                    if len(h) < g:
                        continue
                    places, which = _lookup(rolling(h, g, BASE_A), bits[g], values)
                    if len(places) and ids is None:
                        ids = np.fromiter((numbers.get(w, -1) for w in words), np.int32, len(words))
                    first, entries = windows.first[g], windows.entries[g]
                    for p, k in zip(places.tolist(), which.tolist()):
                        for w, offset in entries[first[k] : first[k + 1]].tolist():
                            want, start = all_words[word_ends[w] : word_ends[w + 1]], p - offset
                            if start >= 0 and start + len(want) <= len(ids) and (ids[start : start + len(want)] == want).all():
                                found.append((start, start + len(want)))
                                mine.update(all_items[item_ends[w] : item_ends[w + 1]].tolist())
                found.sort()
                merged: list[dict] = []
                for lo, hi in found:
                    if merged and lo <= merged[-1]["hi"]:
                        merged[-1]["hi"] = max(hi, merged[-1]["hi"])
                    else:
                        merged.append({"lo": lo, "hi": hi})
                sizes.append(len(words))
                spans.append(merged)
                items.append(sorted(mine))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), pa.array(items, pa.list_(pa.int64()))],
                names=["doc_id", "key", "n_words", "spans", "items"],
            )

    schema = "doc_id long, key string, n_words long, spans array<struct<lo:int,hi:int>>, items array<long>"
    return docs.select("doc_id", "key", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items, contaminated for every row of docs(doc_id, text).

    A word is hit if an occurrence of a window of any benchmark(item_id, text) covers it; ``contaminated`` is n_hit > 0
    and 20 * n_hit >= n_words. Null or empty texts have no words and are clean; items with a null id or no words are
    left out; repeated items count once; a null doc_id is returned as null. With an empty benchmark all is clean. Each
    row gives a row, however many blocks of ``block_bytes`` the benchmark needs. Other columns are not read.
    """
    bench = benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("binary").alias("text"))
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    # several blocks give a row of a document each; rows of one id and text give the same
    key = F.sha2(F.col("text").cast("binary"), 256) if blocks > 1 else F.lit(None).cast("string")
    docs = docs.select("doc_id", key.alias("key"), "text")
    scratch, made = Scratch(docs.sparkSession, "benchmark"), None
    for k in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        windows = Windows([(r["item_id"], bytes(r["text"])) for r in part.collect()], span)
        counts = shingle_counts(docs, windows).collect() if windows.sizes else []
        windows.prefixes({(r["size"], r["value"] & (2**64 - 1)): r["n"] for r in counts})
        got = hits(docs, docs.sparkSession.sparkContext.broadcast(windows))
        if blocks > 1:
            got = scratch.save(got, f"hits{k}")
        made = got if made is None else made.unionByName(got)
    if blocks > 1:
        made = made.groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda acc, x: F.struct((acc["n"] + F.greatest(x["hi"] - F.greatest(x["lo"], acc["end"]), F.lit(0))).alias("n"), F.greatest(x["hi"], acc["end"]).alias("end"))
        n_hit = F.aggregate(F.array_sort("spans"), start, step, lambda acc: acc["n"].cast("long"))
        rows, made = docs.select(F.col("doc_id").alias("d"), F.col("key").alias("k")), made.withColumn("n_hit", n_hit)
        made = rows.join(made.hint("merge"), F.col("d").eqNullSafe(F.col("doc_id")) & F.col("k").eqNullSafe(F.col("key"))).drop("doc_id").withColumnRenamed("d", "doc_id")
        n_hit = F.col("n_hit")
    else:
        n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["hi"] - x["lo"]))
    made = made.select("doc_id", "n_words", n_hit.alias("n_hit"), "items")
    return made.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
