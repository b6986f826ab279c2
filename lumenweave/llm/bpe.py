"""Byte-level BPE over length-bucketed padded matrices.

Texts are cut by the tokenizer's pattern. Pieces that are tokens already need no merging. The others are grouped by length and laid as rows of
padded matrices of token ids; each round every row merges its leftmost pair of least rank, the columns to its right move up
one place, and rows without a pair are done. Ranks of pairs come from an open-addressing hash table held in arrays. A piece longer than the
last bucket is a matrix of one row; all places of its least pair merge in one round, so that very long pieces take rounds by ranks, not by letters.

Defined cases: null is an empty text; an empty text has no ids, and an empty table no rows; of pairs of equal rank the leftmost merges first; lone
surrogates cannot occur in a Spark string; repeated rows and null ids are encoded each for itself; very long texts are held one at a time; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.llm.common import by_bytes

NONE = np.int32(2**31 - 1)
BUCKETS = (4, 8, 12, 16, 24, 32, 64, 128, 512)
CACHE_PIECES = 100_000


def load_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line)}


class PairTable:
    """rank of (left id, right id), for every pair of tokens whose bytes joined are a token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        todo, vals, probe = np.array(keys, np.int64), np.array(values, np.int32), 0
        while len(todo):
            slot = self._slot(todo, probe)
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]], self.ranks[slot[placed]] = todo[placed], vals[placed]
            rest = np.ones(len(todo), bool)
            rest[placed] = False
            todo, vals, probe = todo[rest], vals[rest], probe + 1
        self.probes = probe

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (((mixed >> np.uint64(64 - self.bits)).astype(np.int64)) + probe) & ((1 << self.bits) - 1)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        found = np.full(len(keys), NONE, np.int32)
        todo = np.arange(len(keys))
        for probe in range(self.probes):
            slot = self._slot(keys[todo], probe)
            there = self.keys[slot]
            same = there == keys[todo]
            found[todo[same]] = self.ranks[slot[same]]
            todo = todo[~same & (there != -1)]
            if not len(todo):
                break
        return found


def together(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive texts of about ``chars`` characters: however long texts are, the pieces held at once are those of so many characters, or of one text."""
    first, count = 0, 0
    for i, text in enumerate(texts):
        count += len(text)
        if count >= chars:
            yield texts[first : i + 1]
            first, count = i + 1, 0
    if first < len(texts):
        yield texts[first:]


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(ranks)
        self.token = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: str(rank) for rank in ranks.values()}
        self.cache: dict[str, list[int]] = {}

    def _merge_rows(self, rows: list[bytes], width: int) -> list[list[int]]:
        lengths = np.array([len(r) for r in rows])
        data = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        ids = self.single[data]
        ids[np.arange(width)[None, :] >= lengths[:, None]] = -1
        rank = self.pairs.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        out, own = [[] for _ in rows], np.arange(len(rows))
        while len(own):
            at = rank.argmin(axis=1)
            line = np.arange(len(own))
            best = rank[line, at]
            done = best == NONE
            if done.any():
                for i, row in zip(own[done].tolist(), ids[done], strict=True):
                    out[i] = row[row >= 0].tolist()
                keep = ~done
                own, ids, rank, at, best = own[keep], ids[keep], rank[keep], at[keep], best[keep]
                line = np.arange(len(own))
                if not len(own):
                    break
            ids[line, at] = best
            width = ids.shape[1]
            if width == 2:
                for i, row in zip(own.tolist(), ids, strict=True):
                    out[i] = [int(row[0])]
                break
            column = np.arange(width - 1)
            ids = np.take_along_axis(ids, column[None, :] + (column[None, :] > at[:, None]), axis=1)
            column = column[:-1]
            rank = np.take_along_axis(rank, column[None, :] + (column[None, :] >= at[:, None]), axis=1)
            left = at > 0
            rank[line[left], at[left] - 1] = self.pairs.look_up(ids[line[left], at[left] - 1], ids[line[left], at[left]])
            right = at < width - 2
            rank[line[right], at[right]] = self.pairs.look_up(ids[line[right], at[right]], ids[line[right], at[right] + 1])
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        """A row of its own, which merges all places of its least pair in one round, from the left. That is what merging the leftmost again and again does, as
        long as no merge on the way makes a pair of a lower rank: the round ends with the first merge that does."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        rank = self.pairs.look_up(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            # of places that overlap, every second one of a run merges
            run = np.cumsum(np.r_[True, np.diff(at) > 1]) - 1
            at = at[(at - at[np.searchsorted(run, run)]) % 2 == 0]
            left, right = at > 0, at + 2 < len(ids)
            before, after = ids[at - 1], ids[np.minimum(at + 2, len(ids) - 1)]
            joined = np.full(len(at), best, np.int32)
            merged_before = np.r_[False, np.diff(at) == 2]  # what stands at the left is the pair merged just before
            lower = left & (self.pairs.look_up(np.where(merged_before, joined, before), joined) < best)
            lower |= right & (self.pairs.look_up(joined, after) < best)
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids[at] = best
            ids = ids[keep]
            place = at - np.arange(len(at))
            rank = rank[keep[1:]] if len(ids) > 1 else rank[:0]
            touched = np.unique(np.r_[place[place > 0] - 1, place[place < len(ids) - 1]])
            rank[touched] = self.pairs.look_up(ids[touched], ids[touched + 1])
        return ids.tolist()

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of new pieces into the cache."""
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            if piece in self.cache:
                continue
            raw = piece.encode("utf-8")
            if (rank := self.ranks.get(raw)) is not None:
                self.cache[piece] = [rank]
            elif len(raw) > BUCKETS[-1]:
                self.cache[piece] = self._merge_long(raw)
            else:
                buckets.setdefault(next(b for b in BUCKETS if len(raw) <= b), []).append((piece, raw))
        for width, rows in buckets.items():
            step = max(1, (1 << 18) // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for (piece, _), ids in zip(part, self._merge_rows([r for _, r in part], width), strict=True):
                    self.cache[piece] = ids

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text."""
        for part in together(texts):
            cut = [self.pattern.findall(t) for t in part]
            self.learn(set().union(*cut))
            get = self.cache.__getitem__
            for pieces in cut:
                ids: list[int] = []
                for own in map(get, pieces):
                    ids += own
                yield ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(lines: bytes, pattern: str) -> ByteBpe:
    """The worker's own copy, made once."""
    key = (hashlib.sha256(lines).hexdigest(), pattern)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(load_ranks(lines), pattern)
    return _LOADED[key]


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, ids. The vocabulary, about a megabyte and of fixed size, is read where the driver runs and broadcast."""
    lines = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(lines.value, pattern)
        for batch in by_bytes(batches, 2 << 20):
            texts = [t or "" for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "ids": pa.array(list(bpe.encode(texts)), pa.list_(pa.int32()))})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; the last is of the bytes that the ids decode to."""
    lines = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(lines.value, pattern)
        decimal = bpe.decimal.__getitem__
        for batch in by_bytes(batches, 2 << 20):
            counts, ids_sha, text_sha = [], [], []
            for ids in bpe.encode([t or "" for t in batch["text"].to_pylist()]):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
