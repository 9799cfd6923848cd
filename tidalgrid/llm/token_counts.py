"""Token counts: a prefix dynamic programme keeps the exact token count of every prefix of a text.

For byte-pair encoding, the tokens of a prefix are those of a shorter prefix and one more token. The last token is
the only one that ends there and that does not merge otherwise with the token before it, so one pass over a word
gives the count at each of its prefixes. Words repeat, so their results are kept in a bounded table. A text's
table is one signed byte a code point (the change of the count), compressed; its running sum answers how many tokens
any prefix has, and where to cut for a budget, without encoding again.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Contractions that the byte-level pattern takes whole; their two-letter prefixes are two pieces (fixed values).
THREE = ("'re", "'ve", "'ll")

SCHEMA = "doc_id long, n_bytes long, n_chars long, n_tokens long, prefix_counts binary"

UNIT = re.compile(r"\s*\S+|\s+")
#: White space that regex engines may class differently; a text with one of these is taken as a whole.
ODD = re.compile(r"[^\S\t\n\x0b\x0c\r ]")

#: Two or more characters of Unicode's White_Space property (fixed values).
RUN = re.compile(r"[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")

#: A word of Latin letters, perhaps with a stop behind it: one piece, or two.
SIMPLE = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?]?)")


def changes(counts: list[int]) -> bytes:
    """Differences as signed bytes: one more character adds four tokens at most, and takes away fewer than a token has bytes."""
    return bytes([(b - a) & 255 for a, b in zip([0, *counts], counts)])


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """The dynamic programme for one byte-level BPE vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str, most: int = 500_000):
        import ahocorasick
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without a normaliser is needed")
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.vocab = {raw(k): v for k, v in spec["model"]["vocab"].items() if all(c in alphabet for c in k)}
        self.text_of = {v: k for k, v in self.vocab.items()}
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((raw(a), raw(b)), rank)
        self.longest = max(map(len, self.vocab))
        if self.longest > 128:
            raise ValueError("tokens of over 128 bytes")
        finder = ahocorasick.Automaton()
        for token, t in self.vocab.items():
            finder.add_word(token.decode("latin-1"), (t, len(token)))
        finder.make_automaton()
        self.ending = finder.iter
        self.specials = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.alone: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.units: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.most = most
        self.alphabet = alphabet

    def merge(self, data: bytes) -> list[bytes]:
        """Plain byte-pair merging of a short string; only asked about single tokens and pairs of tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def joins(self, a: int, b: int) -> bool:
        """Whether token b may follow token a inside a word."""
        x, y = self.text_of[a], self.text_of[b]
        got = self.merge(x + y) == [x, y]
        if len(self.pairs) < 2 * self.most:
            self.pairs[a, b] = got
        return got

    def whole(self, t: int) -> bool:
        got = self.alone[t] = len(self.merge(self.text_of[t])) == 1
        return got

    def word(self, data: bytes) -> list[int]:
        """Token counts of data[:1], data[:2], ... for one piece that the pattern doesn't split."""
        pairs, alone, n = self.pairs, self.alone, len(data)
        last, counts = [-1] * (n + 1), [0] * (n + 1)
        for end, (t, size) in self.ending(data.decode("latin-1")):  # tokens that end at each place, longest first
            i = end + 1
            if counts[i]:
                continue
            j = i - size
            if j:
                ok = pairs.get((last[j], t))
                ok = self.joins(last[j], t) if ok is None else ok
            else:
                ok = alone.get(t)
                ok = self.whole(t) if ok is None else ok
            if ok:
                last[i] = t
                counts[i] = counts[j] + 1
        if 0 in counts[1:]:
            raise ValueError("the vocabulary lacks a byte")
        return counts[1:]

    def chars(self, piece: str) -> list[int]:
        counts = self.word(piece.encode())
        if len(counts) == len(piece):
            return counts
        ends = np.cumsum([len(c.encode()) for c in piece]) - 1
        return [counts[e] for e in ends]

    def plain(self, text: str) -> list[int]:
        """Counts at every code point of a text without special strings."""
        out: list[int] = []
        done = at = 0
        for _, (start, end) in self.split(text):
            piece = text[start:end]
            if start < at:  # bytes of one character in several pieces
                raise ValueError("the pattern split a character")
            if piece in THREE:
                one = [1, 2, self.chars(piece)[-1]]
            else:
                one = self.chars(piece)
            out.extend(done + c for c in one)
            done, at = out[-1], end
        # a prefix that ends inside a white-space run has that run so far as one last piece
        for m in RUN.finditer(text):
            before = out[m.start() - 1] if m.start() else 0
            out[m.start() : m.end()] = [before + c for c in self.chars(m[0])]
        return out

    def counts(self, text: str) -> list[int]:
        """Counts at every code point; special strings are single tokens, as the library takes them by default."""
        if not self.special or not (found := list(self.special.finditer(text))):
            return self.plain(text)
        out: list[int] = []
        start = done = 0
        for m in found:
            partly = self.plain(text[start : m.end() - 1])
            before = partly[m.start() - start - 1] if m.start() > start else 0
            out.extend(done + c for c in partly)
            done += before + 1
            out.append(done)
            start = m.end()
        out.extend(done + c for c in self.plain(text[start:]))
        return out

    def piece(self, piece: str) -> bytes:
        """Changes of the count inside one piece that the pattern doesn't split."""
        got = self.pieces.get(piece)
        if got is None:
            got = changes(self.chars(piece))
            if len(self.pieces) < self.most:
                self.pieces[piece] = got
        return got

    def deltas(self, unit: str) -> bytes:
        got = self.units.get(unit)
        if got is None:
            simple = SIMPLE.fullmatch(unit)
            if simple:
                got = self.piece(simple[1]) + (self.piece(simple[2]) if simple[2] else b"")
            else:
                got = changes(self.counts(unit))
            if len(self.units) < self.most and len(unit) < 64:
                self.units[unit] = got
        return got

    def table(self, text: str) -> bytes:
        """One signed byte a code point: by how much the token count changes there."""
        if ODD.search(text):
            return self.deltas(text)
        return b"".join(map(self.deltas, UNIT.findall(text)))


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_table(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens and the table of prefix counts of every whole text.

    ``tokenizer``: path of a byte-level BPE file, the same on every machine. A null text counts as empty and has
    an empty table; a null doc_id is returned as null; repeated rows are counted each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = counter(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tables = [made.table(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([int(np.frombuffer(t, np.int8).sum(dtype=np.int64)) for t in tables], pa.int64()),
                    pa.array([zlib.compress(t, 1) for t in tables], pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_chars", "n_tokens", "prefix_counts"],
            )

    return docs.select(F.col("doc_id"), F.col(text)).mapInArrow(run, SCHEMA)


def prefix_counts(table: bytes) -> np.ndarray:
    """The token count of each prefix of 1, 2, ... code points, from a stored table."""
    return np.cumsum(np.frombuffer(zlib.decompress(table), np.int8), dtype=np.int64)


def tokens_at(table: bytes, chars: int) -> int:
    """Tokens of the prefix of so many code points."""
    return int(prefix_counts(table)[chars - 1]) if chars > 0 else 0


def longest_prefix(table: bytes, budget: int) -> int:
    """The most code points that fit into a budget of tokens; counts can fall as a prefix grows, so all are looked at."""
    fit = np.flatnonzero(prefix_counts(table) <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0
