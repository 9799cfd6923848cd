"""N-gram Jaccard join: a size-aware heavy-light set similarity join with connected groups.

A document's set holds the hashes of its distinct word n-grams. Equal sets are one class from the start, so copies
never meet as pairs. Small (light) sets: all subsets of the size that a link needs are enumerated, and equal subsets
meet. Large (heavy) sets: the inverted lists of the sets' first elements are scanned; with the elements in one order,
linked sets share one of their first ``size - needed + 1``. The boundary is the size at which enumeration costs more
than scanning. Frequent n-grams, found over all documents, come last in the order, so the lists stay short.

Only groups are returned, so a list of m sets isn't expanded into m*m pairs: each set is first verified against the
list's centre; pairs between sets that this has joined need no test, and all remaining pairs of different components
are tested, unless their sizes, places or parities rule a link out. No list or group is cut off, and no link between
components is missed. Sides that grow with the corpus are merge-joined at every size, never broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalgrid.llm.common import BASE_A, LOWER, Scratch, WordHashes, as_long, bytes_column, components, mix, rolling, tidy

#: So many of the most frequent n-grams go to the end of the order. This bounds what is broadcast; any order is right.
FREQUENT = 50_000
#: Enumeration is considered up to this size of a set.
MOST_LIGHT = 20
PARITIES = ["p0", "p1", "p2", "p3"]
#: Up to this size of a set its parities rule out about all that its histogram would, so it has none.
PARITY_ENOUGH = 200


def needed(s: int, t: int, percent: int) -> int:
    """The least intersection of linked sets of sizes s and t."""
    return -(-percent * (s + t) // (100 + percent))


def prefix(s: int, percent: int) -> int:
    return s - -(-percent * s // 100) + 1 if s else 0


def partners(s: int, percent: int, most: int) -> list[int]:
    return [t for t in range(1, most + 1) if 100 * min(s, t) >= percent * max(s, t) and needed(s, t, percent) <= min(s, t)]


def boundary(percent: int, list_length: float) -> int:
    """The largest size up to which enumerating subsets is no dearer than scanning lists of the given mean length."""
    best = 0
    for s in range(1, MOST_LIGHT + 1):
        enumerate_cost = sum(comb(s, needed(s, t, percent)) for t in partners(s, percent, s))
        if enumerate_cost > prefix(s, percent) * (1 + list_length):
            break
        best = s
    return best


def parities(grams: np.ndarray) -> np.ndarray:
    """256 bits: whether an odd number of elements falls into each bucket. Where two sets' bits differ, so do the sets."""
    counts = np.bincount((grams >> np.uint64(56)).astype(np.int64), minlength=256)
    return np.packbits(counts.astype(np.uint8) & 1).view(np.int64)


def histogram(grams: np.ndarray) -> bytes:
    """How many elements fall into each of 256 buckets, 255 at most. Two sets differ in as many elements as these do."""
    return np.minimum(np.bincount((grams >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def text_set(text: bytes, n: int, table: WordHashes) -> np.ndarray:
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 7)], np.uint64)
    return np.unique(rolling(np.fromiter(map(table.__getitem__, words), np.uint64, len(words)), n, BASE_A))


def frequent(docs: DataFrame, n: int) -> DataFrame:
    """gram, n: document counts of n-grams that are frequent in a task; each gram's total comes from these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, waiting, total = WordHashes(), None, [], 0
        kept, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        def fold() -> None:
            nonlocal kept, counts, waiting, held
            keys, add = np.unique(np.concatenate(waiting), return_counts=True)
            both, at = np.unique(np.concatenate([kept, keys]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([counts, add]), len(both)).astype(np.int64)
            if len(both) > 2_000_000:  # bounded memory: a gram seen once so far may be counted anew later
                both, sums = both[sums > 1], sums[sums > 1]
            kept, counts, waiting, held = both, sums, [], 0

        held = 0
        for batch in batches:
            for text in bytes_column(batch.column(0)):
                grams = text_set(text, n, table)
                total += len(grams)
                waiting.append(grams)
                held += len(grams)
                if held > 1_000_000:
                    fold()
        if waiting:
            fold()
        often = counts > 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(as_long(kept[often]), 0)), pa.array(np.append(counts[often], total)), pa.array(np.append(np.zeros(int(often.sum()), bool), True))],
            names=["gram", "n", "total"],
        )

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "gram long, n long, total boolean")


def keys(docs: DataFrame, n: int, percent: int, last: np.ndarray, light: int) -> DataFrame:
    """doc_id, size, digest, keys, p0 to p3, counts: what each document's set is looked up by, its parities and histogram. ``last``: grams by rising frequency."""
    order = np.argsort(last, kind="stable")
    by_value, rank = last[order], order

    def light_keys(grams: np.ndarray) -> list[int]:
        s, out = len(grams), []
        parts = [int(x) for x in mix(grams)]
        for t in partners(s, percent, light):
            tag = int(mix(np.array([min(s, t) * 1000 + max(s, t)], np.uint64))[0])
            if s != t or percent < 100:
                for chosen in combinations(parts, needed(s, t, percent)):
                    out.append((sum(chosen) + tag) & (2**64 - 1))
        return out

    def heavy_keys(grams: np.ndarray) -> np.ndarray:
        length = prefix(len(grams), percent)
        if not len(by_value):
            return grams[:length]
        at = np.minimum(np.searchsorted(by_value, grams), len(by_value) - 1)
        often = by_value[at] == grams
        rare = grams[~often][:length]
        if len(rare) < length:
            common, ranks = grams[often], rank[at[often]]
            rare = np.concatenate([rare, common[np.argsort(ranks, kind="stable")][: length - len(rare)]])
        return rare

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            sizes, digests, found, bits, counts = [], [], [], [], []
            for text in bytes_column(batch.column(1)):
                grams = text_set(text, n, table)
                s = len(grams)
                sizes.append(s)
                bits.append(parities(grams))
                counts.append(histogram(grams) if s > PARITY_ENOUGH else None)
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()) if s else None)
                mine = []
                if s and 100 * s > percent * light:  # a partner may be heavy
                    mine.append(heavy_keys(grams))
                if 0 < s <= light:
                    mine.append(np.array(light_keys(grams), np.uint64))
                found.append(as_long(np.concatenate(mine)) if mine else np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists, *(pa.array(c) for c in np.array(bits, np.int64).reshape(-1, 4).T), pa.array(counts, pa.binary())],
                names=["doc_id", "size", "digest", "keys", *PARITIES, "counts"],
            )

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, size long, digest binary, keys array<long>, p0 long, p1 long, p2 long, p3 long, counts binary")


def plausible(base: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose histograms differ in no more elements than linked sets may; rules out most pairs of large sets."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t, x, y in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                differ = 0 if x is None or y is None else int(np.abs(np.frombuffer(x, np.uint8).astype(np.int16) - np.frombuffer(y, np.uint8)).sum())
                keep.append(differ <= s + t - 2 * needed(s, t, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (base.where("size > 0 and doc_id is not null").select(F.col("doc_id").alias(x), F.col("size").alias(f"s{x}"), F.col("counts").alias(f"h{x}")) for x in "ab")
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "sa", "sb", "ha", "hb")
    return both.mapInArrow(test, "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; sets are made again from the texts of the documents in pairs."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            made = [text_set(text, n, table).tobytes() for text in bytes_column(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(made, pa.binary())], names=["id", "grams"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                z = np.concatenate([x, y])
                z.sort(kind="stable")
                same = int((z[1:] == z[:-1]).sum())
                keep.append(same > 0 and 100 * same >= percent * (len(z) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = docs.where("doc_id is not null").join(ids.hint("merge"), "doc_id", "left_semi").select("doc_id", F.col("text").cast("binary").alias("text"))
    held = texts.mapInArrow(sets, "id long, grams binary")
    left = pairs.join(held.withColumnsRenamed({"id": "a", "grams": "x"}), "a")
    both = left.join(held.withColumnsRenamed({"id": "b", "grams": "y"}), "b").select("a", "b", "x", "y")
    return both.mapInArrow(test, "a long, b long")


def ngram_jaccard_join(docs: DataFrame, n: int = 4, percent: int = 85, light: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text).

    Two documents link when 100 * intersection >= percent * union of their sets of distinct n-word shingles (fewer
    words: all of them as one shingle). ``component_id`` is the smallest doc_id that links lead to. A null or empty
    text has an empty set and links with nothing; equal rows are one class; a row with a null doc_id gets its
    n_shingles and a null component; other columns are not read. ``light`` overrides the boundary chosen by cost.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    docs = docs.select("doc_id", "text")
    counts = scratch.save(frequent(docs, n).groupBy("gram", "total").agg(F.sum("n").alias("n")), "frequent")
    grams = counts.where("not total")
    top = grams.where("n > 7").orderBy(F.desc("n"), "gram").limit(FREQUENT).toPandas()
    last = top["gram"].to_numpy(np.int64)[::-1].copy().view(np.uint64)
    if light is None:
        x = grams.agg(F.sum(F.col("n") * F.col("n")).cast("double")).first()[0] or 0.0
        light = boundary(percent, x / max(1, counts.where("total").agg(F.sum("n")).first()[0] or 1))
    base = scratch.save(keys(docs, n, percent, last, light), "keys")
    classes = base.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = scratch.save(classes, "classes")
    reps = base.join(classes.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    postings = reps.select(F.col("doc_id").alias("id"), "size", F.posexplode("keys").alias("at", "key"))
    postings = postings.withColumn("at", F.when(F.col("size") > light, F.col("at")).otherwise(0))
    # if this element is the first that two sets share, the other set has at most ``reach`` elements
    reach = F.floor((F.col("size") - F.col("at")) * (100.0 + percent) / percent + 1e-6).cast("long") - F.col("size")
    postings = postings.withColumn("reach", reach)
    bounds = [F.min("size").alias("least"), F.max("reach").alias("far")]
    useful = (F.col("reach") >= F.col("least")) & (F.col("size") <= F.col("far"))
    # the centre is the set with the fewest elements before the shared one, so the closest to what is common
    centres = postings.groupBy("key").agg(F.min(F.struct("at", "id", "size")).alias("c"), F.count(F.lit(1)).alias("n"), *bounds).where("n > 1")
    lists = postings.join(centres.select("key", "c", "least", "far").hint("merge"), "key").where(useful).drop("least", "far")
    lists = scratch.save(lists, "lists")
    tidy(docs.sparkSession)

    def possible(sa: str, ia: str, sb: str, ib: str) -> F.Column:
        """Length bound, and positional bound for a shared element that is the first of both."""
        enough = F.ceil((F.col(sa) + F.col(sb)) * percent / (100.0 + percent) - 1e-6)
        return (100 * F.least(sa, sb) >= percent * F.greatest(sa, sb)) & (F.least(F.col(sa) - F.col(ia), F.col(sb) - F.col(ib)) >= enough)

    def alike(a: str, b: str, sa: str, sb: str) -> F.Column:
        """The sets' parities differ in no more places than linked sets may differ in elements."""
        enough = F.ceil((F.col(sa) + F.col(sb)) * percent / (100.0 + percent) - 1e-6)
        return sum(F.bit_count(F.col(f"{a}{p}").bitwiseXOR(F.col(f"{b}{p}"))) for p in PARITIES) <= F.col(sa) + F.col(sb) - 2 * enough

    def marked(side: str) -> DataFrame:
        return base.where("size > 0").select(F.col("doc_id").alias(side), *[F.col(p).alias(f"{side}{p}") for p in PARITIES])

    stars = lists.where("id <> c.id").select(F.col("c.id").alias("a"), F.col("id").alias("b"), F.col("c.size").alias("sa"), F.col("c.at").alias("ia"), F.col("size").alias("sb"), F.col("at").alias("ib"))
    stars = stars.where(possible("sa", "ia", "sb", "ib")).select("a", "b", "sa", "sb").distinct()
    stars = stars.join(marked("a"), "a").join(marked("b"), "b").where(alike("a", "b", "sa", "sb"))
    tried = scratch.save(stars.select("a", "b").distinct(), "stars")
    likely = scratch.save(plausible(base, tried, percent).distinct(), "star-likely")
    tidy(docs.sparkSession)
    links = scratch.save(verified(docs, likely, n, percent), "star-links")
    groups = components(scratch, links, "star")
    tidy(docs.sparkSession)

    labels = groups.withColumnRenamed("component", "comp")
    open_ = lists.select("key", "id", "size", "at", "reach").join(labels.hint("merge"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = open_.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), *bounds).where("x <> y")
    open_ = scratch.save(open_.join(mixed.select("key", "least", "far").hint("merge"), "key").where(useful).drop("least", "far"), "open")
    marks = base.where("size > 0").select(F.col("doc_id").alias("id"), *PARITIES)
    open_ = scratch.save(open_.join(marks.hint("merge"), "id"), "open-marked")
    # pairs of components in a list: their sizes and reaches must allow a link, and single sets be alike
    sides = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("s"), *bounds, *[F.first(p).alias(p) for p in PARITIES])
    left, right = (sides.select("key", F.col("comp").alias(f"c{x}"), *[F.col(c).alias(f"{x}{c}") for c in ("n", "s", "least", "far", *PARITIES)]) for x in "ab")
    feasible = (F.col("ca") < F.col("cb")) & (F.col("afar") >= F.col("bleast")) & (F.col("bfar") >= F.col("aleast"))
    feasible &= (F.col("an") > 1) | (F.col("bn") > 1) | alike("a", "b", "as", "bs")
    across = left.join(right, "key").where(feasible).drop("an", "as", "aleast", "afar", *[f"a{p}" for p in PARITIES])
    # members of one side meet the other side's bounds first, and its parities if that is a single set
    one = open_.select("key", F.col("comp").alias("ca"), F.col("id").alias("a"), F.col("size").alias("sa"), F.col("at").alias("ia"), F.col("reach").alias("ra"), *[F.col(p).alias(f"a{p}") for p in PARITIES])
    two = open_.select("key", F.col("comp").alias("cb"), F.col("id").alias("b"), F.col("size").alias("sb"), F.col("at").alias("ib"), *[F.col(p).alias(f"c{p}") for p in PARITIES])
    half = across.join(one, ["key", "ca"]).where((F.col("ra") >= F.col("bleast")) & (F.col("sa") <= F.col("bfar")) & ((F.col("bn") > 1) | alike("a", "b", "sa", "bs")))
    half = half.select("key", "cb", "a", "sa", "ia", *[f"a{p}" for p in PARITIES])
    rest = half.join(two, ["key", "cb"]).where(possible("sa", "ia", "sb", "ib") & alike("a", "c", "sa", "sb"))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    rest = scratch.save(plausible(base, rest, percent).distinct(), "rest")
    scratch.drop("lists", "open", "open-marked")
    tidy(docs.sparkSession)
    if rest.limit(1).count():
        more = scratch.save(verified(docs, rest, n, percent), "rest-links")
        groups = components(scratch, links.unionByName(more), "all")
    scratch.drop("frequent", "stars", "star-likely", "rest", "star-edges")
    tidy(docs.sparkSession)
    return (
        base.select("doc_id", F.col("size").alias("n_shingles"), "digest")
        .join(classes, "digest", "left")
        .join(groups.withColumnRenamed("id", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    )
