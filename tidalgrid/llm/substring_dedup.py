"""Substring deduplication with a log-structured index of window fingerprints.

A window is 20 consecutive words. Each window is represented by its anchor, the least of the hashes of its 8-word runs;
equal windows have equal anchors, and neighbours mostly share one, so about a seventh of the windows are indexed.
An anchor's zone is the text of all windows that it stands for. The index is a list of sorted, immutable runs of
(anchor, zone, first place), bucketed by anchor, so that a batch is merge-joined with each run without moving it;
the batch's own keys become the next run, and runs are compacted when there are too many.

Zones that are equal (128 bits of two independent hashes) are repeats as a whole. Where an anchor has several zones,
their windows are verified one by one: the words are read again, at the zones' first places only, and compared by 128
bits of two independent hashes of all 20 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalgrid.llm.common import BASE_A, BASE_B, Scratch, as_long, bytes_column, mix, ranges, rolling, tidy

WINDOW, GRAM = 20, 8

SITE = ["doc_id", "pos", "lo", "hi"]


class _Words:
    """Two independent hashes of each word, and of any range of words."""

    def __init__(self, most: int = 400_000) -> None:
        self.most, self.places = most, {}
        self.table = np.empty((2, most + 1024), np.uint64)
        self.grow(1024)

    def hashes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of each word's 128-bit hash, kept in a table that starts anew when it is full."""
        places = self.places
        if len(places) > self.most:
            places.clear()
        new = set(words).difference(places)
        if new:
            start = len(places)
            if start + len(new) > self.table.shape[1]:
                self.table = np.concatenate([self.table, np.empty((2, len(new) + self.most), np.uint64)], axis=1)
            found = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, new)), ">u8").reshape(-1, 2)
            self.table[:, start : start + len(new)] = found.T
            places.update(zip(new, range(start, start + len(new))))
        at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
        return self.table[0][at], self.table[1][at]

    def grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            powers = np.full((2, n + 1), BASE_B, np.uint64)
            powers[1] = pow(BASE_B, -1, 1 << 64)
            powers[:, 0] = 1
            self.up, self.down = np.cumprod(powers, axis=1, dtype=np.uint64)

    def spans(self, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(h) >= len(self.up):
            self.grow(2 * len(h))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.down[: len(h)], dtype=np.uint64)])
            return (total[end] - total[start]) * self.up[start]


def sites(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, position, and first and last window of each anchor of a text of word hashes h."""
    grams = rolling(h, GRAM, BASE_A)
    # the leftmost least of 13 grams by the hash's upper half, by minima of 2, 4 and 8 neighbours
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    for step in (1, 2, 4, WINDOW - GRAM + 1 - 8):
        least = np.minimum(least[:-step], least[step:])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    hi = np.concatenate([lo[1:] - 1, [len(at) - 1]])
    return grams[at[lo]], at[lo], lo, hi


def anchors(docs: DataFrame) -> DataFrame:
    """fp, zone, doc_id, pos, lo, hi: the anchors of all windows of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Words()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), bytes_column(batch.column(1))):
                words = text.split()
                if len(words) < WINDOW:
                    continue
                one, two = table.hashes(words)
                fp, pos, lo, hi = sites(one)
                zone = table.spans(two, lo, hi + WINDOW)
                with np.errstate(over="ignore"):
                    zone = mix(zone ^ mix(((hi - lo) * 64 + pos - lo).astype(np.uint64)))
                out.append((fp, zone, np.full(len(fp), doc, np.int64), pos, lo, hi))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(c) if k < 2 else c.astype(np.int64 if k == 2 else np.int32)) for k, c in enumerate(cols)],
                    names=["fp", "zone", *SITE],
                )

    schema = "fp long, zone long, doc_id long, pos int, lo int, hi int"
    return docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wa, wb, doc_id, start: hashes of the windows at ``wanted`` (doc_id, spans: lists of lo and hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Words()
        for batch in batches:
            out: list[tuple] = []
            for doc, text, spans in zip(batch.column(0).to_pylist(), bytes_column(batch.column(1)), batch.column(2).to_pylist()):
                words = text.split()
                if len(words) < WINDOW:
                    continue
                keep = np.zeros(len(words) - WINDOW + 1, bool)
                for s in spans:
                    keep[s["lo"] : s["hi"] + 1] = True
                at = np.flatnonzero(keep)
                one, two = table.hashes(words)
                a, b = rolling(one, WINDOW, BASE_A)[at], rolling(two, WINDOW, BASE_B)[at]
                out.append((as_long(a), as_long(b), np.full(len(at), doc, np.int64), at.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["wa", "wb", "doc_id", "start"])

    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.join(wanted, "doc_id").select("doc_id", "text", "spans").mapInArrow(run, "wa long, wb long, doc_id long, start int")


class FingerprintIndex:
    """Sorted runs of (fp, zone, first place); batches must come by ascending doc_id."""

    def __init__(self, spark: SparkSession, scratch: Scratch, most_runs: int = 2):
        self.spark, self.scratch, self.most_runs = spark, scratch, most_runs
        self.runs: list[str] = []
        self.made = 0

    def _store(self, keys: DataFrame) -> str:
        """Writes one immutable run: bucketed by fp, sorted in each bucket."""
        name = f"fingerprints_{self.scratch.root.rsplit('-', 1)[1]}_{self.made}"
        self.made += 1
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        (
            keys.repartition(n, "fp")
            .write.bucketBy(n, "fp")
            .sortBy("fp", "zone")
            .option("path", f"{self.scratch.root}/{name}")
            .option("compression", "zstd")
            .format("parquet")
            .saveAsTable(name)
        )
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def close(self) -> None:
        for name in self.runs:
            self._drop(name)
        self.runs = []

    def compact(self) -> None:
        """Merges all runs into one; of a zone that several runs know, the first place stays."""
        merged = self.spark.table(self.runs[0])
        for name in self.runs[1:]:
            merged = merged.unionByName(self.spark.table(name))
        merged = merged.groupBy("fp", "zone").agg(F.min(F.struct(*SITE)).alias("first")).select("fp", "zone", "first.*")
        new = self._store(merged)
        for name in self.runs:
            self._drop(name)
        self.runs = [new]

    def add(self, batch: DataFrame, so_far: DataFrame, after: int | None = None, last: bool = False) -> DataFrame:
        """doc_id, lo, hi: ranges of windows of the batch that start earlier too, in it or in what was added before.

        ``so_far``: the texts added so far and the batch's, for verification. ``after``: the batch has larger ids only.
        ``last``: no batch follows.
        """
        k, save = self.made, self.scratch.save
        found = save(anchors(batch), f"anchors{k}")
        keys = save(
            found.groupBy("fp", "zone").agg(F.min(F.struct(*SITE)).alias("first"), F.count(F.lit(1)).alias("n")),
            f"keys{k}",
        )
        tidy(self.spark)  # here and below: what a step wrote or moved goes before the next one writes
        old = None
        for name in self.runs:  # merge joins: the run's side is bucketed and sorted
            hit = self.spark.table(name).join(keys.select("fp").distinct(), "fp", "left_semi")
            old = hit if old is None else old.unionByName(hit)
        new = keys.select("fp", "zone", "first", "n", F.lit(False).alias("known"))
        if old is not None:
            old = save(old, f"old{k}")
            if last:
                self.close()
            seen = old.select("fp", "zone", F.lit(True).alias("seen")).distinct()
            new = new.drop("known").join(seen, ["fp", "zone"], "left").withColumn("known", F.col("seen").isNotNull()).drop("seen")
            new = save(new, f"new{k}")
            self.scratch.drop(f"keys{k}")
        tidy(self.spark)
        # an anchor with several zones: its windows need verification, at the zones' first places
        zones = new.select("fp", "zone", F.when(F.col("known"), 0).otherwise(1).alias("fresh"))
        if old is not None:
            zones = zones.unionByName(old.select("fp", "zone", F.lit(0).alias("fresh")))
        several = save(
            zones.groupBy("fp").agg(F.min("zone").alias("a"), F.max("zone").alias("b"), F.max("fresh").alias("fresh"))
            .where("a <> b and fresh = 1").select("fp"),
            f"several{k}",
        )
        tidy(self.spark)
        places = new.where("not known").join(several, "fp", "left_semi").select("first.*")
        if old is not None:
            places = places.unionByName(old.join(several, "fp", "left_semi").select(*SITE))
        wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
        hashes = save(windows(so_far, wanted), f"windows{k}")
        self.scratch.drop(f"old{k}", f"several{k}")
        tidy(self.spark)
        least = hashes.groupBy("wa", "wb").agg(F.min(F.struct("doc_id", "start")).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1")
        single = (
            hashes.join(least, ["wa", "wb"])
            .where("doc_id <> at.doc_id or start <> at.start")
            .where(F.lit(True) if after is None else F.col("doc_id") > after)
            .select("doc_id", F.col("start").alias("lo"), F.col("start").alias("hi"))
        )
        single = save(single, f"single{k}")
        self.scratch.drop(f"windows{k}")
        tidy(self.spark)
        whole = (
            found.join(new.where("known or n > 1").select("fp", "zone", "first", "known"), ["fp", "zone"])
            .where("known or doc_id <> first.doc_id or pos <> first.pos")
            .select("doc_id", "lo", "hi")
        )
        out = save(
            whole.unionByName(single).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), f"spans{k}"
        )
        if not last:
            self.runs.append(self._store(new.where("not known").select("fp", "zone", "first.*")))
            if len(self.runs) > self.most_runs:
                self.compact()
        self.scratch.drop(*(f"{x}{k}" for x in ("anchors", "keys", "new", "single")))
        tidy(self.spark)
        return out


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept: what is left of each text without the words that the spans cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(bytes_column(batch.column(1)), batch.column(2).to_pylist()):
                words = text.split()
                n = len(words)
                if spans:
                    change = np.zeros(n + 1, np.int64)
                    for s in spans:
                        change[min(s["lo"], n)] += 1
                        change[min(s["hi"] + WINDOW, n)] -= 1
                    gone = np.cumsum(change[:-1]) > 0
                    words = [w for w, x in zip(words, gone.tolist()) if not x]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    joined = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def substring_dedup(docs: DataFrame, batches: int = 3, most_runs: int = 1) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept for every row of docs(doc_id, text).

    Words covered by a 20-word window that also starts earlier (smaller doc_id, or earlier in the text) go. A null or
    empty text, or one of fewer than 20 words, loses nothing; a row with a null doc_id is compared with nothing and
    stays whole; rows that repeat an id and its text are one document listed twice and get the same result. Other
    columns are not read. ``batches``: the corpus is indexed in so many steps of growing size, by ascending
    doc_id; runs are compacted on the way.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    scratch = Scratch(spark, "substrings")
    index = FingerprintIndex(spark, scratch, most_runs)
    edges = [None, *ranges(docs, batches), None]
    spans = None
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        upto = docs if high is None else docs.where(F.col("doc_id") <= high)
        batch = upto if low is None else upto.where(F.col("doc_id") > low)
        got = index.add(batch, upto, low, last=k == len(edges) - 2)
        spans = got if spans is None else spans.unionByName(got)
    index.close()
    return cut(docs, spans)
