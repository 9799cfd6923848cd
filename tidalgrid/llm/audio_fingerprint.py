"""Chroma audio fingerprints.

A recording is cut into overlapping frames whose spectrum is folded onto the twelve pitch classes. Over the integral image of that
chroma picture, sixteen rectangle filters are each quantised to two bits, so each frame gives a 32-bit integer. All
equal integers of two recordings vote for the difference of their places; the differences of this offset histogram are
verified by the share of bits that differ along the alignment.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalgrid.llm.common import Scratch

#: Seconds of a frame, frames that begin in that time, and samples of a frame of the synthetic tones.
SECONDS, OVERLAP, FRAME = 0.128, 4, 256
PITCHES = 12
#: Frames under the widest filter: as much time as eight frames that don't overlap.
WIDTH = 7 * OVERLAP + 1
#: Kind, first pitch class, height, width of the filters; kinds as in ``fingerprint``, widths given in frames that don't overlap.
FILTERS = [(k, p, h, (w - 1) * OVERLAP + 1) for k, p, h, w in zip([0, 1, 2, 3] * 4, [0, 2, 4, 6, 1, 3, 5, 7, 0, 4, 2, 0, 6, 3, 0, 2], [6, 4, 6, 4, 4, 6, 4, 4, 12, 8, 10, 12, 6, 8, 10, 6], [8, 8, 6, 8, 4, 6, 8, 4, 8, 4, 8, 6, 4, 8, 8, 6])]
#: Fingerprints of so many bytes of queries are sent to all tasks at a time.
BLOCK_BYTES = 4 << 20
#: Two-bit codes of the four levels; neighbours differ in one bit.
GRAY = np.array([0, 1, 3, 2], np.uint32)


def samples(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples, in 16-bit units, of a WAV of 8 to 32-bit integers or floats, its channels averaged.

    Other or broken data have no samples; what a cut off file still holds counts.
    """
    none, form, at = (1, np.empty(0)), None, 12
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return none
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body, at = data[at + 8 : at + 8 + size], at + 8 + size + size % 2
        if name == b"fmt " and len(body) >= 16:
            form = struct.unpack_from("<HHIIHH", body)
            kind = struct.unpack_from("<H", body, 24)[0] if form[0] == 0xFFFE and len(body) >= 26 else form[0]
        elif name == b"data" and form:
            break
    else:
        return none
    channels, rate, width = form[1], form[2], (form[5] + 7) // 8
    if not channels or not rate or (kind, width) not in {(1, 1), (1, 2), (1, 3), (1, 4), (3, 4), (3, 8)}:
        return none
    body = body[: len(body) // (width * channels) * width * channels]
    if kind == 3:
        pcm = np.nan_to_num(np.frombuffer(body, f"<f{width}").astype(float), posinf=0, neginf=0) * 2.0**15
    elif width == 1:
        pcm = (np.frombuffer(body, np.uint8).astype(float) - 128) * 2.0**8
    elif width == 3:
        wide = np.zeros((len(body) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(body, np.uint8).reshape(-1, 3)
        pcm = wide.view("<i4").ravel() / 2.0**16
    else:
        pcm = np.frombuffer(body, f"<i{width}") / 2.0 ** (8 * width - 16)
    return rate, pcm.reshape(-1, channels).mean(axis=1)


@lru_cache(maxsize=64)
def folding(size: int, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of a frame, and which frequencies above 60 Hz belong to which pitch class."""
    freq = np.fft.rfftfreq(size, 1 / rate)
    pitch = np.rint(12 * np.log2(np.maximum(freq, 1e-9) / 440.0)).astype(int) % PITCHES
    return np.hanning(size), ((pitch[:, None] == np.arange(PITCHES)) & (freq > 60)[:, None]).astype(float)


def chroma(data: bytes, block: int = 4096) -> np.ndarray:
    """Frames by pitch classes from a WAV; a frame and the step to the next last equally long at any rate."""
    rate, pcm = samples(data)
    size = max(2, round(SECONDS * rate))
    if len(pcm) < size:
        return np.zeros((0, PITCHES))
    most = int((len(pcm) - size) * OVERLAP / (SECONDS * rate)) + 2
    starts = np.rint(np.arange(most) * (SECONDS * rate / OVERLAP)).astype(np.int64)
    starts = starts[starts + size <= len(pcm)]
    window, fold = folding(size, rate)
    views, out = np.lib.stride_tricks.sliding_window_view(pcm, size), []
    for k in range(0, len(starts), block):
        waves = np.fft.rfft(views[starts[k : k + block]] * window, axis=1)
        out.append((waves.real**2 + waves.imag**2) @ fold)
    out = np.concatenate(out)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-9)


def fingerprint(picture: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each place at which the widest filter fits; pictures of one length may be stacked."""
    n = picture.shape[-2] - WIDTH + 1
    if n <= 0:
        return np.empty((*picture.shape[:-2], 0), np.uint32)
    total = np.zeros((*picture.shape[:-2], picture.shape[-2] + 1, PITCHES + 1))
    picture.cumsum(axis=-2).cumsum(axis=-1, out=total[..., 1:, 1:])

    def box(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        band = total[..., p1] - total[..., p0]
        return band[..., t1 : t1 + n] - band[..., t0 : t0 + n]

    out = np.zeros((*picture.shape[:-2], n), np.uint32)
    low, high = np.exp(-0.5), np.exp(0.5)
    for kind, p, h, w in FILTERS:
        h = min(h, PITCHES - p)
        if kind == 0:  # all against the rest of the picture
            a, b = box(0, w, p, p + h), box(0, w, 0, PITCHES) * (h / PITCHES)
        elif kind == 1:  # lower against upper half
            a, b = box(0, w, p, p + h // 2), box(0, w, p + h // 2, p + 2 * (h // 2))
        elif kind == 2:  # earlier against later half
            a, b = box(0, w // 2, p, p + h), box(w // 2, w // 2 * 2, p, p + h)
        else:  # two opposite quarters against the others
            x, y = w // 2, h // 2
            a = box(0, x, p, p + y) + box(x, 2 * x, p + y, p + 2 * y)
            b = box(x, 2 * x, p, p + y) + box(0, x, p + y, p + 2 * y)
        a, b = a + 0.05, b + 0.05
        level = (a >= low * b).astype(np.uint32) + (a >= b) + (a >= high * b)
        out = (out << np.uint32(2)) | GRAY[level]
    return out


def parts(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, as a recording is far larger than its fingerprint or vector."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def fingerprints(media: DataFrame) -> DataFrame:
    """id, n_frames, code (the integers, little-endian) of media(id, data), data being WAV files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            pictures, codes = [chroma(d or b"") for d in batch.column(1).to_pylist()], {}
            for n in {len(p) for p in pictures}:  # those of one length at once, a few if they are long
                places = [k for k, p in enumerate(pictures) if len(p) == n]
                each = max(1, 50_000 // (n + 1))
                for k in range(0, len(places), each):
                    made = fingerprint(np.stack([pictures[i] for i in places[k : k + each]])).astype("<u4")
                    codes |= {i: code.tobytes() for i, code in zip(places[k : k + each], made)}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(p) for p in pictures], pa.int64()), pa.array([codes[k] for k in range(len(pictures))], pa.binary())],
                names=["id", "n_frames", "code"],
            )

    return media.select("id", "data").mapInArrow(run, "id long, n_frames long, code binary")


def runs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, start and length of the runs of equal integers."""
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[start], start, np.diff(np.r_[start, len(code)])


def offset_votes(x: np.ndarray, y: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """How many places i of x have x[i] == y[i + shift], for shift from -len(x) on.

    Two runs of one value vote for a trapezoid of shifts, which four second differences hold; ``most`` pairs of runs are
    held at a time.
    """
    (value, start, length), (values, starts, lengths) = runs(x), runs(y)
    order = np.argsort(values, kind="stable")
    values, starts, lengths = values[order], starts[order], lengths[order]
    low = np.searchsorted(values, value)
    each = np.searchsorted(values, value, "right") - low
    ends = np.cumsum(each)
    bends = np.zeros(len(x) + len(y) + 2, np.int64)
    for k in range(0, int(ends[-1]), most):
        pair = np.arange(k, min(k + most, int(ends[-1])))
        a = np.searchsorted(ends, pair, "right")
        b = low[a] + pair - (ends[a] - each[a])
        at, m, n = starts[b] - start[a] - length[a] + 1 + len(x), length[a], lengths[b]
        for place, sign in ((at, 1), (at + m, -1), (at + n, -1), (at + m + n, 1)):
            bends += sign * np.bincount(place, minlength=len(bends))
    return bends.cumsum().cumsum()


def best_shift(x: np.ndarray, y: np.ndarray, least_votes: int, most_errors: float) -> tuple[int, float] | None:
    """The shift of most votes (then least bit errors, least distance) among those that pass both bounds, and its errors."""
    votes = offset_votes(x, y)
    for n_votes in np.unique(votes[votes >= max(1, least_votes)])[::-1]:
        passed = []
        for shift in (np.flatnonzero(votes == n_votes) - len(x)).tolist():
            a, b = x[max(0, -shift) :], y[max(0, shift) :]
            n = min(len(a), len(b))
            error = float(np.bitwise_count(a[:n] ^ b[:n]).sum()) / (32 * n)
            if error <= most_errors:
                passed.append((error, abs(shift), -shift))
        if passed:
            return -min(passed)[2], min(passed)[0]
    return None


class Asked:
    """A block of queries and an inverted list of their values: which query has a value, and in how many places."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.ids, self.codes = [r[0] for r in rows], [np.frombuffer(r[1], "<u4") for r in rows]
        found = [np.unique(c, return_counts=True) for c in self.codes]
        values = np.concatenate([v for v, _ in found] or [np.empty(0, np.uint32)])
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        self.owner = np.repeat(np.arange(len(rows)), [len(v) for v, _ in found])[order]
        self.places = np.concatenate([n for _, n in found] or [np.empty(0, np.int64)])[order]

    def bounds(self, code: np.ndarray) -> np.ndarray:
        """For each query, the most votes that any shift can have: at one shift a place meets one place at most."""
        values, places = np.unique(code, return_counts=True)
        low, high = np.searchsorted(self.values, values), np.searchsorted(self.values, values, "right")
        each = high - low
        at = np.arange(int(each.sum())) + np.repeat(low - (np.cumsum(each) - each), each)
        return np.bincount(self.owner[at], np.minimum(self.places[at], np.repeat(places, each)), len(self.ids))


def searched(groups: DataFrame, block: Broadcast, least_votes: int, most_errors: float) -> DataFrame:
    """q, class_id, shift, bit_errors of the queries of a block and the recordings that match them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = block.value
        for batch in batches:
            found = []
            for c, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code = np.frombuffer(data, "<u4")
                for k in np.flatnonzero(asked.bounds(code) >= least_votes).tolist():
                    if asked.ids[k] != c and (made := best_shift(asked.codes[k], code, least_votes, most_errors)) is not None:
                        found.append((asked.ids[k], c, *made))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in enumerate(kinds)], names=["q", "class_id", "shift", "bit_errors"])

    return groups.select("class_id", "code").mapInArrow(run, "q long, class_id long, shift int, bit_errors double")


def align(media: DataFrame, every: int = 50, least_votes: int = 4, most_errors: float = 0.35, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_frames, code_crc32, class_id, best_id, best_offset, bit_errors for every row of media(id, data).

    Recordings of equal fingerprints are a class, named by its smallest id. Queries are the classes that hold an id
    divisible by ``every``; they are searched among all classes, and their best other match (least bit errors, then
    smallest id) is given, if its bit errors are at most ``most_errors`` and ``least_votes`` places agree. All places
    vote, and the offset of a match is the one of most votes among all that pass both bounds. Broken, null
    or short recordings have no fingerprint, a class of their own and no match; a null id is returned with nulls;
    repeated rows are in one class; other columns are not read. ``best_offset`` is in frame lengths, a quarter the least.
    """
    scratch = Scratch(media.sparkSession, "audio")
    made = scratch.save(fingerprints(media), "codes")
    named = made.where("id is not null and octet_length(code) > 0")
    groups = scratch.save(named.groupBy("code").agg(F.min("id").alias("class_id"), F.max((F.col("id") % every == 0).cast("int")).alias("query")), "classes")

    asked = groups.where("query = 1").select("class_id", "code")
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("code"))).first()[0] or 0) // block_bytes))
    tested = None
    for k in range(blocks):  # the stated queries meet all recordings, a bounded block of them at a time
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("class_id"), F.lit(blocks)) == k)
        block = media.sparkSession.sparkContext.broadcast(Asked([(r["class_id"], bytes(r["code"])) for r in part.collect()]))
        found = searched(groups, block, least_votes, most_errors).groupBy("q").agg(F.min(F.struct("bit_errors", "class_id", "shift")).alias("best"))
        found = scratch.save(found, f"best{k}")
        tested = found if tested is None else tested.unionByName(found)
    return (
        made.join(groups.select("code", "class_id"), "code", "left")
        .select("id", "n_frames", F.crc32("code").alias("code_crc32"), F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"))
        .join(tested.withColumnRenamed("q", "class_id"), "class_id", "left")
        .select("id", "n_frames", "code_crc32", "class_id", F.col("best.class_id").alias("best_id"), (F.col("best.shift") / OVERLAP).alias("best_offset"), F.col("best.bit_errors").alias("bit_errors"))
    )


def synthetic_media(vectors: DataFrame, rate: int = 2000) -> DataFrame:
    """id, data: a WAV for each row of vectors(vec_id, embedding): each component is a frame of two tones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(FRAME) / rate
        tones = np.stack([np.sin(2 * np.pi * 220.0 * 2 ** (k / 12) * t) for k in range(24)])
        both = (tones * 12000 + tones[(np.arange(24) * 7 + 3) % 24] * 6000).astype("<i2")
        for batch in parts(batches):
            out = []
            for vector in batch.column(1).to_pylist():
                x = np.nan_to_num(np.array([v or 0.0 for v in vector or []], float))
                first = np.clip((np.clip(x, -1, 1) * 20).round().astype(int) % 24, 0, 23)
                pcm = both[first] if len(x) else np.empty(0)
                file = io.BytesIO()
                with wave.open(file, "wb") as f:
                    f.setparams((1, 2, rate, 0, "NONE", ""))
                    f.writeframes(pcm.astype("<i2").tobytes())
                out.append(file.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.binary())], names=["id", "data"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "id long, data binary")
