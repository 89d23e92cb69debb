"""SentencePiece encoding and decoding by a batched Viterbi over words.

Words of one length are rows of one matrix and advance together, a character a step. All
substrings' rolling hashes are probed in the sorted hashes of the pieces of that length (a
hit is confirmed on the characters). For every end, the best last piece over all lengths is
kept as the backpointer.

What is maximised follows the model's type. *Unigram*: the sum of the pieces' scores. *BPE*: a
sequence of pieces is what merging yields exactly if merging each adjacent pair on its own
yields that pair; so a piece may follow another if it passes this test, and exactly one
sequence remains. Alone, each piece is built by its own merges; what matters for a pair is the
last symbol of the left and the first of the right one after each of them. The test walks both
lists from the characters on, for many pairs at once, the higher score first: the pair fails
where joining the two symbols that face each other has a higher score than what comes next.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_and_text

MODEL = "piece_bpe_32k.model"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = "▁"
_CELLS = 1 << 21      # substrings probed at once
_KEPT = 400_000       # words remembered; emptied when full, which changes no result
_SIEVE_BITS = 21
_TESTED_BITS = 20     # pairs of pieces whose test is remembered
_BEYOND = np.uint32(0xFFFFFFFF)  # no character: what stands after a shorter word's end
_TEXTS, _CHARS = 2048, 1 << 22  # of texts encoded together; a longer text goes alone
_WORKER = "_stagewatch_sentencepieces"
_START, _UNKNOWN = -1, -2


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys.view(np.uint64) * _BASE) >> np.uint64(64 - _SIEVE_BITS)).astype(np.intp)


def _sieve(keys: np.ndarray) -> np.ndarray:
    """A small table that says of most keys at once that they are none of these."""
    out = np.zeros(1 << _SIEVE_BITS, bool)
    out[_slots(keys)] = True
    return out


def _sifted(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return sieve[_slots(keys)]


class Pieces:
    """A SentencePiece model: identity normalisation, of type unigram or BPE."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto.FromString(model)
        norm = m.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        if m.trainer_spec.model_type not in (1, 2) or any(p.type in (4, 5) for p in m.pieces):
            raise ValueError("only unigram and BPE models without user-defined or unused pieces are supported")
        self.bpe, self.prefix = m.trainer_spec.model_type == 2, norm.add_dummy_prefix
        self.text = [p.piece for p in m.pieces]
        self.normal = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        self.score = np.array([p.score for p in m.pieces], np.float32)
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6} if m.trainer_spec.byte_fallback else {}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.silent = {i for i, p in enumerate(m.pieces) if p.type == 3}
        # what a piece that is no byte decodes to
        self.surface = ["" if i in self.silent else m.trainer_spec.unk_surface if i == self.unknown else t for i, t in enumerate(self.text)]
        self.unknown_score = np.float32(self.score[list(self.normal.values())].min() - 10)
        # a piece never goes on past the end of a word, unless the model has such pieces
        self.whole = any(re.search(f"[^{_SPACE}]{_SPACE}", t) for t in self.normal)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        groups: dict[int, list[str]] = {}
        for t in self.normal:
            groups.setdefault(len(t), []).append(t)
        for n, texts in groups.items():
            chars = np.stack([_codes(t) for t in texts])
            keys = self._hash(chars)[:, -1]
            o = np.argsort(keys)
            if len(np.unique(keys)) != len(keys):
                raise ValueError("two pieces share a hash")
            self.by_length[n] = keys[o], np.array([self.normal[t] for t in texts])[o], chars[o]
        self.longest = max(self.by_length)
        self.sieve = _sieve(np.concatenate([keys for keys, _, _ in self.by_length.values()]))
        self.bytes = pa.array([bytes([self.of_byte[i]]) if i in self.of_byte else t.encode("utf-8", "replace")
                               for i, t in enumerate(self.surface)], pa.binary())
        self._forget()
        if self.bpe:
            self._spines()

    def _forget(self) -> None:
        """Known words: the ids of all of them in a row, and where each word's start, the end last."""
        self.words: dict[str, int] = {}
        self.flat, self.begin = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _spines(self) -> None:
        """Tables for the pair test: per piece its last (first) symbols, one for each merge that
        changes it, with the score of the next one, and the score of every merge of two symbols."""
        self.tested, self.passed = np.full(1 << _TESTED_BITS, -1), np.zeros(1 << _TESTED_BITS, bool)
        symbols = {t: i for i, t in enumerate(self.text) if t in self.normal}
        for t in self.normal:
            for c in t:
                symbols.setdefault(c, len(self.text) + len(symbols))
        names = list(symbols)
        numbers = np.array([symbols[t] for t in names])
        place = {t: i for i, t in enumerate(names)}
        score = self.score.tolist()
        n = len(self.text)
        self.width = int(numbers.max()) + 1
        pairs = [(symbols[t[:k]] * self.width + symbols[t[k:]], score[i]) for t, i in self.normal.items()
                 for k in range(1, len(t)) if t[:k] in place and t[k:] in place]
        keys = np.array([k for k, _ in pairs], np.int64)
        o = np.argsort(keys)
        self.pair_keys = np.append(keys[o], np.iinfo(np.int64).max)
        self.pair_scores = np.append(np.array([v for _, v in pairs], np.float64)[o], -np.inf)
        self.pair_sieve = _sieve(keys)
        self.reachable, self.ordered = np.zeros(n, bool), np.ones(n, bool)
        sides: list[list[list[int]]] = [[[0]] * n, [[0]] * n]
        for t, i in self.normal.items():
            own, scores, first, last = list(t), [], [symbols[t[0]]], [symbols[t[-1]]]
            while len(own) > 1:
                best, at = -np.inf, -1
                for k in range(len(own) - 1):
                    j = self.normal.get(own[k] + own[k + 1])
                    if j is not None and score[j] > best:
                        best, at = score[j], k
                if at < 0:
                    break
                own[at:at + 2] = [own[at] + own[at + 1]]
                scores.append(best)
                if at == 0:
                    first.append(symbols[own[0]])
                if at == len(own) - 1:
                    last.append(symbols[own[-1]])
            self.reachable[i] = len(own) == 1
            self.ordered[i] = all(x >= y for x, y in zip(scores, scores[1:]))
            sides[0][i], sides[1][i] = first, last
        of_symbol = np.full(self.width, -np.inf)
        of_symbol[:n] = self.score
        self.sides = []
        for lists in sides:
            deep = max(map(len, lists))
            table = np.array([x + [-1] * (deep + 1 - len(x)) for x in lists])
            following = np.where(table[:, 1:] >= 0, of_symbol[table[:, 1:]], -np.inf)
            self.sides.append((table, following))

    @staticmethod
    def _hash(chars: np.ndarray) -> np.ndarray:
        """Rolling hashes of all prefixes; the empty one first."""
        out = np.zeros((chars.shape[0], chars.shape[1] + 1), np.uint64)
        mixed = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(27)
        for i in range(chars.shape[1]):
            out[:, i + 1] = out[:, i] * _BASE + mixed[:, i]
        return out

    def _found(self, chars: np.ndarray) -> np.ndarray:
        """``[word, end, length - 1]``: the piece that ends there with that length, or _UNKNOWN."""
        n, size = chars.shape
        prefix, power = self._hash(chars), 1
        out = np.full((n, size + 1, min(self.longest, size)), _UNKNOWN, np.int32)
        for length in range(1, out.shape[2] + 1):
            power = power * int(_BASE) % 2**64
            if length not in self.by_length:
                continue
            keys, ids, texts = self.by_length[length]
            hashes = prefix[:, length:] - prefix[:, :-length] * np.uint64(power)
            row, start = np.nonzero(_sifted(self.sieve, hashes))
            hashes = hashes[row, start]
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = keys[at] == hashes
            row, start, at = row[hit], start[hit], at[hit]
            same = (texts[at] == chars[row[:, None], start[:, None] + np.arange(length)]).all(axis=1)
            out[row[same], start[same] + length, length - 1] = ids[at[same]]
        return out

    def _merged(self, left: int, right: int) -> bool:
        """Does merging leave this pair as it is? By doing it; for pieces whose merges do not go by falling scores."""
        symbols = list(self.text[left] + self.text[right])
        while len(symbols) > 1:
            best = max(((self.score[i], -k) for k in range(len(symbols) - 1)
                        if (i := self.normal.get(symbols[k] + symbols[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols == [self.text[left], self.text[right]]

    def _pair_score(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.full(len(left), -np.inf)
        key = left * self.width + right
        some = np.flatnonzero(_sifted(self.pair_sieve, key))
        at = np.searchsorted(self.pair_keys, key[some])
        same = self.pair_keys[at] == key[some]
        out[some[same]] = self.pair_scores[at[same]]
        return out

    def _may_follow(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        out = (piece == _UNKNOWN) | self.reachable[np.maximum(piece, 0)]
        todo = np.flatnonzero(out & (last >= 0) & (piece >= 0))  # nothing merges with an unknown character
        a, b = last[todo], piece[todo].astype(np.int64)
        key = a * self.width + b
        slot = ((key.view(np.uint64) * _BASE) >> np.uint64(64 - _TESTED_BITS)).astype(np.intp)
        known = self.tested[slot] == key
        out[todo[known]] = self.passed[slot[known]]
        if not known.all():
            todo, key, slot = todo[~known], key[~known], slot[~known]
            ok = out[todo] = self._stays(a[~known], b[~known])
            self.tested[slot] = key
            held = self.tested[slot] == key
            self.passed[slot[held]] = ok[held]
        return out

    def _stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Does merging leave the pairs as they are?"""
        out, todo = np.ones(len(a), bool), np.arange(len(a))
        plain = self.ordered[a] & self.ordered[b]
        for k in np.flatnonzero(~plain).tolist():
            out[k] = self._merged(int(a[k]), int(b[k]))
        todo, a, b = todo[plain], a[plain], b[plain]
        free = np.isneginf(self._pair_score(a, b))  # most pairs fail here
        out[todo[~free]] = False
        todo, a, b = todo[free], a[free], b[free]
        (firsts, first_next), (lasts, last_next) = self.sides
        i, j = np.zeros(len(todo), np.intp), np.zeros(len(todo), np.intp)
        while len(todo):
            left, right = last_next[a, i], first_next[b, j]
            join = self._pair_score(lasts[a, i], firsts[b, j])
            fails = (join > left) & (join >= right)  # of equal scores the leftmost merge comes first
            out[todo[fails]] = False
            on = ~fails & ~(np.isneginf(left) & np.isneginf(right))
            step = (left >= right)[on]
            todo, a, b, i, j = todo[on], a[on], b[on], i[on] + step, j[on] + ~step
        return out

    def _viterbi(self, chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's pieces and where they start, first to last; _START fills up in front. A word has ``sizes`` characters, then _BEYOND."""
        n, size = chars.shape
        found = self._found(chars)
        best = np.full((n, size + 1), -np.inf, np.float32)
        best[:, 0] = 0
        last = np.full((n, size + 1), _START, np.int64)
        back = np.zeros((n, size + 1), np.int32)
        rows = np.arange(n)
        for end in range(1, size + 1):
            lengths = np.arange(min(end, found.shape[2]), 0, -1)  # the longest first: it wins ties
            piece = found[:, end, :][:, lengths - 1]
            before = best[:, end - lengths]
            if self.bpe:
                may = (piece >= 0) & (before == 0)
                may[:, -1] |= (piece[:, -1] == _UNKNOWN) & (before[:, -1] == 0) & (sizes >= end)
                r, c = np.nonzero(may)
                ok = self._may_follow(last[r, end - lengths[c]], piece[r, c])
                r, c = r[ok], c[ok]
                if len(r):
                    longest = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                    r, c = r[longest], c[longest]
                best[r, end], back[r, end], last[r, end] = 0, lengths[c], piece[r, c]
                continue
            value = np.where(piece >= 0, before + self.score[piece], -np.inf)
            value[:, -1] = np.where(piece[:, -1] >= 0, value[:, -1], before[:, -1] + self.unknown_score)
            top = value.argmax(axis=1)
            best[:, end], back[:, end], last[:, end] = value[rows, top], lengths[top], piece[rows, top]
        # all words go back together, a piece a step
        at, pieces, starts = sizes, [], []
        while at.any():
            pieces.append(np.where(at > 0, last[rows, at], _START))
            at = at - back[rows, at]
            starts.append(at)
        return np.stack(pieces[::-1], axis=1), np.stack(starts[::-1], axis=1)

    def _ids(self, chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in a row, and how many each has; unknown characters as bytes, or as one unknown a run."""
        pieces, starts = self._viterbi(chars, sizes)
        row, col = np.nonzero(pieces != _START)
        ids = pieces[row, col]
        unknown = ids == _UNKNOWN
        if not self.byte:
            ids[unknown] = self.unknown
            keep = ~(unknown & np.r_[False, unknown[:-1] & (row[1:] == row[:-1])])
            return ids[keep].astype(np.int32), np.bincount(row[keep], minlength=len(chars))
        points, which = np.unique(chars[row[unknown], starts[row, col][unknown]], return_inverse=True)
        coded = [[self.byte[b] for b in chr(p).encode("utf-8", "replace")] for p in points.tolist()]
        size = np.array([len(x) for x in coded], np.int64)[which]
        table = np.array([x + [0] * (4 - len(x)) for x in coded], np.int32).reshape(-1, 4)[which]
        count = np.ones(len(ids), np.int64)
        count[unknown] = size
        out, first = np.repeat(ids, count).astype(np.int32), (np.cumsum(count) - count)[unknown]
        for k in range(4):
            out[first[size > k] + k] = table[size > k, k]
        return out, np.bincount(row, count, len(chars)).astype(np.int64)

    def _learn(self, words: list[str]) -> None:
        """New words, each once. Those of like length go together."""
        flat, counts = [self.flat], []
        words = sorted(words, key=len)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        i = 0
        while i < len(words):
            most = int(sizes[i]) * 5 // 4 + 1
            j = int(np.searchsorted(sizes, most, "right"))
            size = int(sizes[j - 1])
            j = min(j, i + max(1, _CELLS // (size * min(size, self.longest))))
            size = int(sizes[j - 1])
            chars = np.full((j - i, size), _BEYOND)
            chars[np.arange(size) < sizes[i:j, None]] = _codes("".join(words[i:j]))
            ids, count = self._ids(chars, sizes[i:j])
            flat.append(ids)
            counts.append(count)
            i = j
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        if counts:
            self.flat = np.concatenate(flat)
            self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(np.concatenate(counts)))

    def _split(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct words of all texts, which of them each word is, and how many words each text has."""
        raw = [(" " * self.prefix + t.replace(_SPACE, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        joined, size = b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(size)
        if self.whole:
            begins = np.zeros(len(joined), bool)
        else:  # a word is a run of spaces and what follows
            begins = np.frombuffer(joined, np.uint8) == 32
            begins[1:] &= ~begins[:-1]
        begins[(ends - size)[size > 0]] = True
        at = np.flatnonzero(begins)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(joined)).astype(np.int64)),
                                                                             pa.py_buffer(joined)]).dictionary_encode()
        return ([w.decode("utf-8", "surrogatepass").replace(" ", _SPACE) for w in words.dictionary.to_pylist()],
                words.indices.to_numpy(), np.diff(np.searchsorted(at, np.r_[0, ends])))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's start, the end last."""
        distinct, which, n_words = self._split(texts)
        if len(self.words) >= _KEPT:
            self._forget()
        self._learn([w for w in distinct if w not in self.words])
        place = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))[which]
        first = self.begin[place]
        count = self.begin[place + 1] - first
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(first - (ends - count), count) + np.arange(count.sum())]
        starts = np.r_[0, ends][np.r_[0, np.cumsum(n_words)]]
        if not self.byte:  # neighbouring unknown characters are one, over words too
            again = (ids == self.unknown) & (np.r_[-1, ids[:-1]] == self.unknown)
            again[starts[:-1][starts[:-1] < len(ids)]] = False
            starts = starts - np.r_[0, np.cumsum(again)][starts]
            ids = ids[~again]
        return ids, starts

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, starts = self.encode_all(texts)
        return [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]

    def decode_all(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The texts of ids in a row: their bytes joined; where these are no UTF-8, run by run."""
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), self.bytes.take(pa.array(ids))), b"")
        out = []
        for k, raw in enumerate(joined.to_pylist()):
            try:
                text = raw.decode("utf-8").replace(_SPACE, " ")
                out.append(text[1:] if self.prefix and text[:1] == " " else text)
            except UnicodeDecodeError:
                out.append(self.decode(ids[starts[k]:starts[k + 1]].tolist()))
        return out

    def decode(self, ids: list[int]) -> str:
        if self.of_byte.keys().isdisjoint(ids):
            parts = list(map(self.surface.__getitem__, ids))
        else:
            parts, raw = [], bytearray()
            for i in [*ids, None]:
                if i in self.of_byte:
                    raw.append(self.of_byte[i])
                    continue
                if raw:
                    parts.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                if i is not None:
                    parts.append(self.surface[i])
        text = "".join(parts).replace(_SPACE, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


def _pieces(model: bytes) -> Pieces:
    """The model's tables and known words: kept by a worker process for all its tasks."""
    kept = sys.modules.setdefault(_WORKER, types.ModuleType(_WORKER)).__dict__
    key = hashlib.sha256(model).hexdigest()
    if key not in kept:
        kept.clear()
        kept[key] = Pieces(model)
    return kept[key]


def _encoded(batches: Iterator[pa.RecordBatch], model: bytes, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    pieces = _pieces(model)
    for b in batches:
        chars = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < b.num_rows:
            full = int(np.searchsorted(chars, (chars[i - 1] if i else 0) + _CHARS))
            j = max(i + 1, min(i + _TEXTS, full))
            texts = b.column(1)[i:j].to_pylist()
            ids, starts = pieces.encode_all(texts)
            same = [x == t.replace(_SPACE, " ") for x, t in zip(pieces.decode_all(ids, starts), texts)]
            raw, at = memoryview(ids.astype("<u4").tobytes()), (4 * starts).tolist()
            kept = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids)) if keep_ids else pa.nulls(j - i, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0)[i:j], pa.array(np.diff(starts), pa.int64()),
                 pa.array([zlib.crc32(raw[x:y]) for x, y in zip(at, at[1:])], pa.int64()), pa.array(same, pa.bool_()), kept],
                ["doc_id", "n_ids", "ids_crc32", "round_trip", "ids"])
            i = j


def encode(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_ids, ids_crc32, round_trip`` (does decoding give the text
    back?) and, if kept, ``ids``.

    Texts of some MB are encoded together; a longer one goes alone, in memory in proportion to its length.
    The model file is read once, on the driver, and goes to the tasks (some hundred KB). A null text
    is an empty one, without ids. Null and repeated doc_ids are rows like any other. The sign
    for a space (U+2581) in a text stands for a space. No rows give no rows; other columns are ignored."""
    with open(path or model_path(), "rb") as f:
        model = f.read()
    out = id_and_text(docs).mapInArrow(lambda it: _encoded(it, model, keep_ids),
                                       "doc_id long, n_ids long, ids_crc32 long, round_trip boolean, ids array<int>")
    return out if keep_ids else out.drop("ids")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` -> ``doc_id, text``. Null ids give an empty text; bytes that are no UTF-8 the replacement character."""
    with open(path or model_path(), "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for b in batches:
            texts = [pieces.decode([x for x in ids or [] if x is not None]) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
