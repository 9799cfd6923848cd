"""What several of these operators share: scratch tables, byte-level words, hashing and components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as bytes.split() knows it: 0x20 and 0x09-0x0D.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Lower-cases A-Z and turns all ASCII that is neither digit nor letter into spaces.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


class Scratch:
    """Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``).

    A written table cuts lineage and survives a lost executor. Only where the setting is absent
    and all runs on one machine, as in tests, a temporary folder takes its place.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = root or tempfile.mkdtemp(prefix="tidalgrid-")
        self.root = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "snappy").mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


class WordHashes(dict):
    """word -> 64-bit hash; stops growing at ``most`` entries, so its memory is bounded."""

    def __init__(self, most: int = 400_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) < self.most:
            self[word] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Mixed polynomial hashes of all runs of n consecutive word hashes; built by doubling, log2(n) passes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, have, block, size, b = None, 0, h, 1, np.uint64(base)
    power, left = b, n
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if out is None:
                    out, have = block, size
                else:
                    out = out[: len(h) - have - size + 1] * power + block[have : have + len(h) - have - size + 1]
                    have += size
            left >>= 1
            if left:
                block = block[: len(h) - 2 * size + 1] * power + block[size : len(h) - size + 1]
                size, power = 2 * size, power * power
        return mix(out[: len(h) - n + 1])


BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def bytes_column(array) -> list[bytes]:
    """The values of an Arrow binary or string column as bytes; null is empty."""
    import pyarrow as pa

    if pa.types.is_string(array.type) or pa.types.is_large_string(array.type):
        array = array.cast(pa.binary() if pa.types.is_string(array.type) else pa.large_binary())
    return [x or b"" for x in array.to_pylist()]


def components(scratch: Scratch, links: DataFrame, tag: str) -> DataFrame:
    """(id, component) for every id of ``links(a, b)``; the component is its smallest id.

    Contraction: every vertex points to its smallest neighbour or itself, and then to where that one points; links
    between what they point to are left, once each. A star or a chain shrinks to a third at least, so rounds grow with the
    logarithm of the diameter and the links left shrink from round to round. All of it is joins and partial
    aggregates; nothing is gathered on the driver but one count a round.
    """
    pair = links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct()
    edges, maps = scratch.save(pair, f"{tag}-edges-0"), []
    while True:
        k = len(maps)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), f"{tag}-near-{k}")
        up = first.select(F.col("u").alias("p"), F.col("p").alias("top"))
        maps.append(scratch.save(first.join(up.hint("merge"), "p").select(F.col("u").alias("id"), F.col("top").alias("component")), f"{tag}-map-{k}"))
        for side in "uv":
            edges = edges.join(maps[-1].withColumnRenamed("id", side).hint("merge"), side).withColumn(side, F.col("component")).drop("component")
        edges = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        edges = scratch.save(edges, f"{tag}-edges-{k + 1}")
        scratch.drop(f"{tag}-edges-{k}", f"{tag}-near-{k}")
        if not edges.limit(1).count():
            break
    while len(maps) > 1:  # the last maps are the smallest
        last, before = maps.pop(), maps.pop()
        further = last.select(F.col("id").alias("component"), F.col("component").alias("top"))
        whole = before.join(further.hint("merge"), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
        maps.append(scratch.save(whole, f"{tag}-whole-{len(maps)}"))
        scratch.drop(f"{tag}-map-{len(maps)}")
    scratch.drop(f"{tag}-edges-{k + 1}")
    return maps[0]


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of frames that are no longer referred to."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ranges(docs: DataFrame, n: int) -> list[int]:
    """Up to n - 1 ids that cut the documents into batches by ascending doc_id; the last cut has 35 % of all below it, and each
    cut before it three tenths of the one that follows."""
    if n < 2:
        return []
    cuts = docs.where("doc_id is not null").approxQuantile("doc_id", [0.35 * 0.3**i for i in range(n - 2, -1, -1)], 0.01)
    return sorted({int(c) for c in cuts})
