"""Byte-level BPE: encoding with a pair occurrence index, and decoding.

The distinct pieces (words with their leading space, numbers, ...) of a slice of
texts are laid out in one linked list of symbols.  An index maps each pair that
has a merge rule to all its positions; active ranks are applied in ascending
order to all positions at once, and each merge updates the lists of the pairs
it creates.  So a frequent pair is looked up once for a whole slice, and a piece
of n symbols takes O(n log n) however long it is.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import SPACE, slices, vocabulary_path

#: Encoded pieces that a Python worker remembers, and their characters; it forgets all of them when there are more.
REMEMBERED, REMEMBERED_CHARS = 300_000, 8 << 20
#: Characters of text encoded at once, and positions from which on a pair's merges are done as arrays.
SLICE_CHARS = 4 << 20
_MANY = 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes
    stand for themselves, the others for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (c for c in range(256) if c not in own)
    return [chr(c) for _, c in sorted([(b, b) for b in own] + [(b, 256 + k) for k, b in enumerate(rest)])]


class _Pieces(dict):
    """piece -> number; an unknown piece gets the next number and waits in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


def _gather(flat: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries of the lists ``at`` of a ragged table, one after the other; their sizes)."""
    sizes = offsets[at + 1] - offsets[at]
    ends = np.cumsum(sizes)
    return flat[np.repeat(offsets[at] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], sizes


class Tokenizer:
    """Encoder and decoder of a byte-level BPE vocabulary file (tokenizers' JSON format)."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.byte_ids = np.array([vocab[c] for c in symbols], np.int32)
        self.merges = []  # by rank: left, right, merged
        for m in spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
        self.rank = {(a, b): r for r, (a, b, _) in reversed(list(enumerate(self.merges)))}
        pairs = np.array(sorted((a << 32 | b, r) for (a, b), r in self.rank.items()), np.int64).reshape(-1, 2)
        self.pair_keys, self.pair_ranks = pairs[:, 0].copy(), pairs[:, 1].copy()
        back = {c: k for k, c in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in (*vocab.items(), *self.special.items())}
        raw = [bytes(back[c] for c in tokens[i]) if i in tokens and all(c in back for c in tokens[i]) else tokens.get(i, "").encode()
               for i in range(max(tokens) + 1)]
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.token_starts = np.cumsum([0, *map(len, raw)])
        pattern = public_tokenizers.PATTERN.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]")
        self.pieces_of = regex.compile(pattern).findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if self.special else lambda t: [t]
        self._forget()

    def _forget(self) -> None:
        self.known, self.characters = _Pieces(), 0
        self.known.update((t, k) for k, t in enumerate(self.special))
        self.flat = np.array(list(self.special.values()), np.int32)  # ids of the known pieces, one after the other
        self.offsets = np.arange(len(self.special) + 1)

    def pieces(self, text: str) -> list[str]:
        """Pieces in order; a special token is a piece of its own."""
        parts = self.split_special(text)
        if len(parts) == 1:
            return self.pieces_of(text)
        return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else self.pieces_of(part))]

    def _ranks(self, left, right) -> np.ndarray:
        """Rank of each pair, -1 without a merge rule."""
        key = np.asarray(left, np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, ids of each piece), by the pair occurrence index over all of them."""
        encoded = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ends = np.cumsum(sizes)
        symbol = self.byte_ids[np.frombuffer(b"".join(encoded), np.uint8)]
        next_ = np.arange(1, len(symbol) + 1, dtype=np.int32)
        next_[ends - 1] = -1
        prev = np.arange(-1, len(symbol) - 1, dtype=np.int32)
        prev[ends - sizes] = -1

        index: dict[int, list[int]] = {}  # rank of a pair -> its positions
        active: list[int] = []  # heap of the ranks in the index

        def note(ranks: np.ndarray, positions: np.ndarray) -> None:
            found = ranks >= 0
            ranks, positions = ranks[found], positions[found]
            if len(ranks) > 1:
                order = np.argsort(ranks, kind="stable")
                ranks, positions = ranks[order], positions[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                starts = [0, *cuts.tolist()]
            else:
                starts = [0] * len(ranks)
            positions = positions.tolist()
            for r, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(positions)]):
                if r in index:
                    index[r] += positions[a:b]
                else:
                    index[r] = positions[a:b]
                    heapq.heappush(active, r)

        inner = np.flatnonzero(next_ >= 0)
        note(self._ranks(symbol[inner], symbol[inner + 1]), inner)
        symbol_, next_one, prev_one = memoryview(symbol), memoryview(next_), memoryview(prev)  # fast single entries
        rank = self.rank.get
        while active:
            r = heapq.heappop(active)
            left, right, merged = self.merges[r]
            positions = index.pop(r)
            if len(positions) >= _MANY and left != right:  # no two of these overlap: all at once
                i = np.sort(np.array(positions, np.int32))
                i = i[np.concatenate([[True], i[1:] != i[:-1]])]
                j = next_[i]
                good = (j >= 0) & (symbol[i] == left) & (symbol[j] == right)  # else an earlier merge took one of the two
                i, j = i[good], j[good]
                after = next_[j]
                symbol[i], symbol[j], next_[i] = merged, -1, after
                inside = after >= 0
                prev[after[inside]] = i[inside]
                before = prev[i]
                from_left = before >= 0
                own, to = before[from_left], after[inside]
                note(np.concatenate([self._ranks(symbol[own], merged), self._ranks(merged, symbol[to])]), np.concatenate([own, i[inside]]))
                continue
            for i in sorted(positions):
                j = next_one[i]
                if j < 0 or symbol_[i] != left or symbol_[j] != right:
                    continue
                symbol_[i], symbol_[j] = merged, -1
                next_one[i] = after = next_one[j]
                if after >= 0:
                    prev_one[after] = i
                    if (new := rank((merged, symbol_[after]))) is not None:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heapq.heappush(active, new)
                before = prev_one[i]
                if before >= 0 and (new := rank((symbol_[before], merged))) is not None:
                    if new in index:
                        index[new].append(before)
                    else:
                        index[new] = [before]
                        heapq.heappush(active, new)
        alive = symbol >= 0
        return symbol[alive], np.add.reduceat(alive, ends - sizes, dtype=np.int64) if len(sizes) else sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids of each whole text)."""
        if len(self.known) > REMEMBERED or self.characters > REMEMBERED_CHARS:
            self._forget()
        split = list(map(self.pieces, texts))
        numbers = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(split)), np.int64)
        new, self.known.new = self.known.new, []
        self.characters += sum(map(len, new))
        for i, j in slices([len(p) for p in new]):
            ids, sizes = self.merge(new[i:j])
            self.flat = np.concatenate([self.flat, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        ids, sizes = _gather(self.flat, self.offsets, numbers)
        ends = np.cumsum([0, *map(len, split)])
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(total[ends])

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Text of each run of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        raw, lengths = _gather(self.token_bytes, self.token_starts, np.asarray(ids, np.int64))
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        raw = raw.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


@functools.lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    """One tokenizer per Python worker and file."""
    return Tokenizer(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): ids of the whole text of every row, null or empty: none.

    Repeated rows are encoded as often as they occur.  Other columns are not read.
    """
    path = path or vocabulary_path("byte_bpe_50k.json")
    src = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in slices([len(t) for t in texts], SLICE_CHARS):
                ids, sizes = load(path).encode(texts[i:j])
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))],
                                                 names=["doc_id", "ids"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): adds the text of the ids (null ids: the empty text)."""
    path = path or vocabulary_path("byte_bpe_50k.json")
    src = encoded.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            for i, j in slices(sizes.tolist()):
                part = batch.slice(i, j - i)
                texts = load(path).decode(part.column(1).flatten().to_numpy(zero_copy_only=False), sizes[i:j])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())],
                                                 names=["doc_id", "ids", "decoded"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
