"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One first-order model describes random strings, the other ordinary identifiers; both are counted from labelled samples.
A long enough run of key characters whose transitions the first explains better is reported as well. Everything is
DataFrame functions: matches and the text between them give the positions, as both come from the same left-to-right
search; the ratio is a sum of table entries over a candidate's transitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Patterns of the base kinds (fixed values): kind, pattern, group whose length counts, its least length.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]+)", 1, 24),
]
#: The same matches are kept when runs too short to count aren't looked at; only for kinds that take whole runs.
SHORTCUT = {"access": r"(AKIA[A-Z0-9]{16,})", "hex": r"([0-9a-f]{24,})"}
CANDIDATE = r"([A-Za-z0-9+/_=-]{16,})"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

#: Parts of ordinary identifiers, for the labelled samples.
PARTS = (
    "account address array async batch block buffer cache callback channel class client cluster column config connection "
    "container context count current customer data database date default delete device directory document element email "
    "engine entity error event export factory field file filter format frame function global group handler header image "
    "import index input insert instance integer invoice item iterator key label language layer length level list loader "
    "local location logger manager mapper memory message method metric model module monitor name network node number "
    "object offset option order output package page parameter parent parser partition password path pattern payment "
    "permission pointer policy position prefix price process product profile project property provider query queue range "
    "reader record reference region register remote report request resource response result row schedule schema scope "
    "score search section segment server service session shared signal size source stack stage state static status store "
    "stream string struct suffix summary system table target task template temporary test text thread time timeout token "
    "total tracker transaction transform type unique update user validate value variable vector version view width window "
    "worker writer"
).split()


def labelled_samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """token, random: strings of hash output in several alphabets, and identifiers joined from ordinary words."""
    ids = spark.range(n).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    plain = F.base64(F.unhex("h"))
    random = F.when(F.col("id") % 3 == 0, F.regexp_replace(plain, "[+/=]", "x")).when(F.col("id") % 3 == 1, plain).otherwise(F.substring("h", 1, 40))
    words = F.array(*[F.lit(p) for p in PARTS])
    part = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    style = F.col("id") % 5
    ordinary = (
        F.when(style == 0, F.concat_ws("_", part(1), part(2), part(3)))
        .when(style == 1, F.concat(part(1), F.initcap(part(2)), F.initcap(part(3))))
        .when(style == 2, F.concat_ws("-", part(1), part(2), part(3)))
        .when(style == 3, F.upper(F.concat_ws("_", part(1), part(2))))
        .otherwise(F.concat_ws("/", part(1), part(2), F.concat(part(3), (F.col("id") % 100).cast("string"))))
    )
    return ids.select(random.alias("token"), F.lit(True).alias("random")).unionByName(ids.select(ordinary.alias("token"), F.lit(False).alias("random")))


def train(samples: DataFrame, prior: float = 0.5) -> list[float]:
    """Log-likelihood ratios of all transitions, row by row of the alphabet; at most 67 * 67 counts are gathered."""
    steps = F.transform(F.sequence(F.lit(2), F.length("token")), lambda i: F.col("token").substr(i - 1, F.lit(2)))
    pairs = samples.where("length(token) > 1").select("random", F.explode(steps).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.where(F.col("pair").rlike(f"^[{ALPHABET[:-1]}-]{{2}}$")).groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    table, n = [], len(ALPHABET)
    for a in ALPHABET:
        rows = {k: [counts.get((k, a + b), 0) + prior for b in ALPHABET] for k in (True, False)}
        sums = {k: math.log(sum(v)) for k, v in rows.items()}
        table += [(math.log(x) - sums[True]) - (math.log(y) - sums[False]) for x, y in zip(rows[True], rows[False])]
    assert len(table) == n * n
    return table


def spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind, end, token>> of the pattern's matches whose group is long enough, in code points."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,token:string>>")
    between = F.transform(F.split(text, pattern, -1), F.length)
    found = F.arrays_zip(between.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("token"))
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["whole"]), F.lit(0))
        one = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["token"].alias("token"))
        keep = x["whole"].isNotNull() & (F.length(x["token"]) >= least)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(found, start, step, lambda acc: acc["out"])).otherwise(empty)


def ratio(token: Column, table: Column) -> Column:
    code = lambda i: F.instr(F.lit(ALPHABET), token.substr(i, F.lit(1)))
    return F.aggregate(F.sequence(F.lit(2), F.length(token)), F.lit(0.0), lambda acc, i: acc + F.element_at(table, (code(i - 1) - 1) * len(ALPHABET) + code(i)))


def joined(column: Column) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in BASE], F.lit("random"))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, samples: DataFrame | None = None, threshold: float = 12.0) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end, token by start, then kind) for every row of docs(doc_id, text).

    Kinds: 0 assign, 1 access, 2 hex, 3 random. A random span's ratio exceeds ``threshold``, and no base span overlaps
    it. A null or empty text has no spans; a null doc_id is returned as null; rows that repeat are scanned each; other
    columns are not read. ``samples``: token and whether it is random; built-in ones otherwise.
    """
    table = train(labelled_samples(docs.sparkSession) if samples is None else samples)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = [spans(F.col("text"), k, SHORTCUT.get(kind, pattern), group, least) for k, (kind, pattern, group, least) in enumerate(BASE)]
    out = out.select("doc_id", F.array_sort(F.concat(*found)).alias("base"), spans(F.col("text"), 3, CANDIDATE, 1, 16).alias("long"))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    more = F.filter("long", lambda s: free(s) & (ratio(s["token"], table) > threshold))
    return out.select("doc_id", "base", more.alias("more")).select("doc_id", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of ``secret_scan``'s rows."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
