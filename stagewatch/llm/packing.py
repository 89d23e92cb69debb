"""Best-fit packing of tokenised documents into fixed-length sequences by exact complements.

Only a histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus)
reaches the driver. There, the longest lengths come first: sums of one, two and three
available lengths are indexed, and a combination that fills the gap exactly is used as
often as the counts allow; where none does, the fullest combination goes in and what gap
is left takes the best-fitting lengths still there. The plan is a short list of patterns
with multiplicities, of a size bounded by the capacity. Pieces are numbered within their
length by partition counts and offsets, and a piece's number gives its place in the plan,
so no group of pieces is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of, id_and_text, stored

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a byte-level BPE tokenizer file. The same vocabulary as ranks (``.tiktoken``, beside
    it) gives the same ids several times faster; texts that hold the string of a special
    token go through the tokenizer itself."""

    def __init__(self, path: str):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        self.path, self.exact = path, None
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            if self.exact is None:  # most tasks never need it
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.path)
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: only what is longer than a sequence is
    cut, into full sequences after a first piece that may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode, part = Encoder(path), TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    for b in batches:
        doc_ids, texts = b.column(0).to_pylist(), b.column(1)
        for i in range(0, len(doc_ids), 256):
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, text in zip(doc_ids[i:i + 256], texts[i:i + 256]):
                ids = np.array([*encode(text.as_py()), END_ID], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start:start + length]
                    for c, v in zip(cols, (doc_id, k, start, length, crc32_of(own), part, int(seen[length]),
                                           own.astype(np.int32) if keep_ids else None)):
                        c.append(v)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.list_(pa.int32())))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"])


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents, each with its partition and its number there among pieces of its length."""
    return id_and_text(docs).mapInArrow(
        lambda it: _pieces(it, path, capacity, keep_ids),
        "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long, ids array<int>")


class _Sums:
    """The sums that one, two and three available lengths reach, as bit sets (bit s: sum s is reached)."""

    def __init__(self, counts: np.ndarray):
        self.left = [int(c) for c in counts]
        self.of_state: tuple = ()

    def _index(self) -> None:
        """Rebuilt when a length's availability (none, one, two, more) has changed."""
        self.lengths = [x for x, c in enumerate(self.left) if c]
        self.one = self.two = self.three = 0
        self.two_below = {}  # pairs of lengths shorter than this one
        for x in self.lengths:
            self.two_below[x] = self.two
            self.three |= self.two << x
            if self.left[x] > 1:
                self.three |= self.one << 2 * x
                if self.left[x] > 2:
                    self.three |= 1 << 3 * x
            self.two |= self.one << x
            if self.left[x] > 1:
                self.two |= 1 << 2 * x
            self.one |= 1 << x
        self.stale = False

    def take(self, length: int, times: int = 1) -> None:
        before = min(self.left[length], 3)
        self.left[length] -= times
        if min(self.left[length], 3) != before:
            self.stale = True

    stale = True

    def _pair(self, total: int, below: int) -> list[int]:
        """The largest-first pair of lengths shorter than ``below``; there is one."""
        for x in reversed(self.lengths):
            if x < below and total - x <= x and total > x and self.left[total - x] and (total != 2 * x or self.left[x] > 1):
                return [x, total - x]
        raise AssertionError("the index holds a sum that no pair has")

    def best(self, gap: int) -> list[int]:
        """The fullest combination of at most three lengths in ``gap``, of as few lengths as that takes; none: empty."""
        if self.stale:
            self._index()
        within = (1 << gap + 1) - 1
        total = ((self.one | self.two | self.three) & within).bit_length() - 1
        if total <= 0:
            return []
        if self.one >> total & 1:
            return [total]
        if self.two >> total & 1:
            return self._pair(total, len(self.left))
        for x in reversed(self.lengths):
            rest = total - x
            if rest <= 0:
                continue
            if self.two_below[x] >> rest & 1:
                return [x, *self._pair(rest, x)]
            if self.left[x] > 1 and 0 < rest - x <= x and self.left[rest - x] and (rest != 2 * x or self.left[x] > 2):
                return [x, x, rest - x]
        raise AssertionError("the index holds a sum that no triple has")


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """``counts[length]`` -> patterns ``(times, lengths)`` that use every piece once.

    Longest first. A combination that fills the gap exactly is preferred, the fullest one
    taken otherwise, and again for what is left of the gap. Each pattern is used until one of its lengths
    has run out, so there are at most about as many patterns as lengths."""
    sums, out = _Sums(counts), []
    for longest in range(capacity, 0, -1):
        while sums.left[longest]:
            sums.take(longest)
            pattern, gap = [longest], capacity - longest
            while gap and (more := sums.best(gap)):
                for x in more:
                    sums.take(x)
                pattern += more
                gap -= sum(more)
            need = {x: pattern.count(x) for x in pattern}
            again = min(sums.left[x] // k for x, k in need.items())
            for x, k in need.items():
                if again:
                    sums.take(x, again * k)
            out.append((1 + again, pattern))
    return out


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, from, to, first sequence, offset)``: pieces of a length numbered from..to-1
    stand at ``offset`` of the sequences that follow ``first sequence``."""
    out, used, sequence = [], {}, 0
    for times, lengths in patterns:
        offset = 0
        for x in lengths:
            at = used.get(x, 0)
            out.append((x, at, at + times, sequence, offset))
            used[x] = at + times
            offset += x
        sequence += times
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and the ``ids``).

    A null text is an empty one: its document is the end id alone. Null and repeated doc_ids
    are documents like any other. No rows give no rows; other columns are ignored."""
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, path or tokenizer_path(), capacity, keep_ids), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[r["length"]] = r["n"]
    table = slots(plan(counts, capacity))
    if len(table) > 64 * capacity:  # what is broadcast does not grow with the corpus
        raise ValueError("the plan is larger than its bound")
    # As an Arrow table: rows of Python objects would start further Python workers in the executors.
    names = ["length", "lo", "hi", "sequence", "offset"]
    places = spark.createDataFrame(pa.table([pa.array([r[k] for r in table], pa.int64()) for k in range(len(names))], names=names))
    before = by_part.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = (pieces.join(before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before")), ["length", "part"])
                .withColumn("rank", F.col("before") + F.col("nth")))
    placed = numbered.join(F.broadcast(places), "length").where("rank >= lo and rank < hi")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"),
                         "offset", *(["ids"] if keep_ids else []))
