"""Token counts that follow edits.

A text is cut into pre-tokens, which are encoded apart, so a text's count is the sum over
its pre-tokens. A segment tree holds these in blocks, with characters and tokens summed
up to the root. An edit is located by descending the tree; cutting starts ``CONTEXT`` pre-tokens
before it and goes on until, behind the edit, it meets an old boundary, after which the
old pre-tokens stand. Only what lies between is encoded again, and only the sums above the
touched blocks change.

A document's edits come in order through a sorted stream, one text held at a time.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
CONTEXT = 2   # the pattern looks at most two characters past a pre-token, so two pre-tokens back are enough
BLOCK = 64    # pre-tokens in a leaf, when the tree is built
_KEPT = 400_000


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Cuts texts into pre-tokens and counts the tokens of each."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = public_tokenizers.PATTERN
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut, self.known = regex.compile(pattern), {}

    def tokens(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= _KEPT:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n


class CountedText:
    """A text, its pre-tokens in the leaves of a segment tree, and what edits cost."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.encoded = text, counter, 0
        self._build([(len(p), counter.tokens(p)) for p in counter.cut.findall(text)])

    def _build(self, pieces: list[tuple[int, int]]) -> None:
        leaves = [pieces[i:i + BLOCK] for i in range(0, len(pieces), BLOCK)] or [[]]
        self.size = 1 << (len(leaves) - 1).bit_length()
        self.leaves = leaves + [[] for _ in range(self.size - len(leaves))]
        self.chars, self.sums = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(self.leaves):
            self._fill(i)
        for i in range(self.size - 1, 0, -1):
            self._add_up(i)

    def _fill(self, leaf: int) -> None:
        self.chars[self.size + leaf] = sum(c for c, _ in self.leaves[leaf])
        self.sums[self.size + leaf] = sum(t for _, t in self.leaves[leaf])

    def _add_up(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    @property
    def tokens(self) -> int:
        return self.sums[1]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` (the last one with any, behind the end), and its first character's place."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if place >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def _beside(self, leaf: int, step: int) -> int | None:
        """The next leaf with pre-tokens on that side."""
        leaf += step
        while 0 <= leaf < self.size and not self.leaves[leaf]:
            leaf += step
        return leaf if 0 <= leaf < self.size else None

    def edit(self, start: int, length: int, insert: str) -> None:
        """Replace ``length`` characters from ``start`` by ``insert``; places beyond the text's ends are moved to these."""
        start = min(max(start, 0), len(self.text))
        stop = min(start + max(length, 0), len(self.text))
        if start == stop and not insert:
            return
        self.text = self.text[:start] + insert + self.text[stop:]
        grown = len(insert) - (stop - start)

        first, base = self._leaf_at(start)
        pieces = list(self.leaves[first])  # from the first touched leaf on
        touched = [first]
        starts = list(accumulate((c for c, _ in pieces), initial=base))
        k = max(bisect_left(starts, start + 1, hi=max(len(starts) - 1, 0)) - 1, 0) if pieces else 0
        while k < CONTEXT and (before := self._beside(touched[0], -1)) is not None:
            own = self.leaves[before]
            base -= sum(c for c, _ in own)
            pieces, k = own + pieces, k + len(own)
            touched.insert(0, before)
        k = max(k - CONTEXT, 0)
        keep = pieces[:k]
        place = base + sum(c for c, _ in keep)

        # Old boundaries behind the edit, in the new text's places, fetched leaf by leaf.
        old, new, j = place, [], k
        at, found = place, False
        while at < len(self.text):
            m = self.counter.cut.match(self.text, at)
            new.append((m.end() - at, self.counter.tokens(m.group())))
            self.encoded += m.end() - at
            at = m.end()
            if at < start + len(insert):
                continue
            while old < at - grown or old < stop:  # the old boundary at or behind this one
                if j == len(pieces):
                    after = self._beside(touched[-1], 1)
                    if after is None:
                        break
                    touched.append(after)
                    pieces = pieces + self.leaves[after]
                old += pieces[j][0]
                j += 1
            if old == at - grown and old >= stop:
                found = True
                break
        if not found:  # to the text's end: nothing behind stands
            after = touched[-1]
            while (after := self._beside(after, 1)) is not None:
                touched.append(after)
            j = len(pieces)
        block = keep + new + pieces[j:]
        if len(block) > 4 * BLOCK * len(touched):
            self._build([p for i, leaf in enumerate(self.leaves) if i < touched[0] for p in leaf] + block
                        + [p for leaf in self.leaves[touched[-1] + 1:] for p in leaf])
            return
        share = -(-len(block) // len(touched)) or 1
        for i, leaf in enumerate(touched):
            self.leaves[leaf] = block[i * share:(i + 1) * share]
            self._fill(leaf)
        for node in sorted({(self.size + leaf) >> d for leaf in touched for d in range(1, self.size.bit_length())}, reverse=True):
            if node:
                self._add_up(node)


_OUT = ["doc_id", "n_chars", "n_tokens", "n_edits", "chars_after", "tokens_after", "chars_encoded"]


def _follow(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counter, key, state, copies, before = Counter(path), None, None, 0, ()
    edits = 0

    def rows():
        return [(*before, edits, len(state.text), state.tokens, state.encoded)] * copies

    def table(out):
        cols = list(zip(*out)) or [()] * len(_OUT)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], _OUT)

    for b in batches:
        out = []
        doc_ids, h1, h2, seq, start, length = (b.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5))
        for i, own in enumerate(zip(doc_ids, h1, h2)):
            text = b.column(6)[i].as_py()
            if own != key:
                out += rows() if state else []
                key, state, copies, edits = own, None, 0, 0
            if seq[i] is None:  # the document itself; it comes first
                if state is None:
                    state = CountedText(text, counter)
                    before = (own[0], len(text), state.tokens)
                copies += 1
            elif state is not None:
                state.edit(start[i] or 0, length[i] or 0, text)
                edits += 1
        yield table(out)
    if state:
        yield table(rows())


def count_tokens(docs: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """Counts before and after a table of edits: one row per row of ``docs``, ``doc_id, n_chars,
    n_tokens, n_edits, chars_after, tokens_after, chars_encoded`` (characters encoded for the edits).

    ``edits(doc_id, seq, start, length, insert)`` are applied in the order of ``seq`` (ties by start,
    length, insert), each to the text that the one before has left: ``length`` characters from ``start``
    are replaced by ``insert``. Null start, length and insert are 0, 0 and empty; edits with a null
    doc_id or seq, or of no document, are ignored. A null text is an empty one. Rows that repeat an
    id and text share one tree; every text under a repeated id gets the id's edits. Rows with a null doc_id are counted
    and never edited. No rows give no rows; other columns are ignored."""
    text = F.coalesce(docs["text"], F.lit(""))
    doc_id = docs["doc_id"].cast("long")
    h1, h2 = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    state = docs.select(doc_id.alias("doc_id"), h1.alias("h1"), h2.alias("h2"), F.lit(None).cast("long").alias("seq"),
                        F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), text.alias("text"))
    given = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"),
                         F.coalesce(F.col("start").cast("long"), F.lit(0)).alias("start"),
                         F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("length"),
                         F.coalesce("insert", F.lit("")).alias("text")).where("doc_id is not null and seq is not null")
    texts = docs.select(doc_id.alias("doc_id"), h1.alias("h1"), h2.alias("h2")).distinct()
    given = given.join(texts, "doc_id").select("doc_id", "h1", "h2", "seq", "start", "length", "text")
    own = path or ranks_path()
    ordered = state.unionByName(given).repartition("doc_id", "h1", "h2").sortWithinPartitions(
        "doc_id", "h1", "h2", F.col("seq").asc_nulls_first(), "start", "length", "text")
    return ordered.mapInArrow(lambda it: _follow(it, own), ", ".join(f"{c} long" for c in _OUT))


def edits_from(docs: DataFrame) -> DataFrame:
    """Three edits for each document, drawn from its own text and id: a passage is repeated elsewhere,
    one is cut out, and one is replaced by another. Lengths are 1 to 64 characters."""
    text = F.coalesce(docs["text"], F.lit(""))
    n = F.length(text)

    def draw(seed: int, below):
        return F.pmod(F.xxhash64(docs["doc_id"], F.lit(seed)), below.cast("long") + 1)

    def passage(seed: int):
        return F.substring(text, (draw(seed, n) + 1).cast("int"), (draw(seed + 1, F.lit(63)) + 1).cast("int"))

    rows = [(1, draw(10, n), F.lit(0).cast("long"), passage(11)), (2, draw(20, n), draw(21, F.lit(63)) + 1, F.lit("")),
            (3, draw(30, n), draw(31, F.lit(63)) + 1, passage(32))]
    return docs.select(docs["doc_id"].alias("doc_id"), F.explode(F.array(*[
        F.struct(F.lit(s).cast("long").alias("seq"), a.alias("start"), c.alias("length"), i.alias("insert")) for s, a, c, i in rows])).alias("e")
    ).select("doc_id", "e.*")
