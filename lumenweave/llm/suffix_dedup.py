"""Exact removal of long repeated byte strings, with run-length compressed Burrows-Wheeler indexes.

Every window of ``length`` bytes is told by its least 32-byte gram. Consecutive windows with the same least gram form one string of at most
``length`` + ``length`` - 32 bytes, and equal windows always lie in strings with the same gram hash, which therefore deals strings out to tasks:

1. strings equal as a whole are told by two 64-bit hashes: the first stays, the rest are marked; grams with one distinct string are done. Strings of the grams that a sample
   of the texts shows to be the most frequent (a passage in a third of all texts, say, with other words around it) are dealt by gram and content, so that no task has them all;
2. the strings of a gram that differ are fetched from the texts and indexed in blocks: a suffix order gives a Burrows-Wheeler transform, which is kept as runs with
   the text's places at their ends, and the first string of every interval of suffixes that share ``length`` bytes. The block's strings and all later ones of their gram
   are streamed through the runs backwards, one step of all strings at a time; a window whose matching statistic reaches ``length``, in an earlier string, is marked;
3. the marks of a document are joined to its text.

Streaming every block through all before it takes work by the square of a gram's blocks. Grams with more than ``group_rows`` differing strings (say, of a passage in a third
of all documents, with other words around it) are resolved window by window instead, in linear work: each task tells equal windows of its own texts first, and only the
first of them is compared with other tasks', by 128-bit hashes.

Defined cases: null is an empty text; texts shorter than ``length`` keep all bytes, and an empty table stays empty; every row is a document of its own. Rows are
ordered by id, null first, and rows with equal ids by the xxhash64 of their texts, so that of repeated rows and of texts with no id all but the first
lose what they share. Very long texts are cut into overlapping pieces of ``PIECE`` bytes. Other columns pass through under their names, whatever they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenweave.llm.common import by_bytes, by_groups, written

GRAM, PIECE = 32, 1 << 19
#: Strings that are indexed together; some 15 numbers a byte are held. A larger group is indexed in blocks, and later blocks are streamed through earlier ones.
INDEX_ROWS = 3_000
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=11) | 1 for b in range(256)], dtype=np.uint64)
_ODD = 0x9E3779B97F4A7C15
_MIX = [np.uint64(xxhash.xxh64_intdigest(bytes([b]), seed=13) | 1) for b in range(5)]
# a string's place in a long: its start, and in 8 bits its length beyond the window's
_START = 8


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def strings_of(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: gram hash, content hash, number of the text, start in it, and length of every string."""
    n = len(data)
    empty = tuple(np.zeros(0, np.int64) for _ in range(5))
    if n < max(length, 64):
        return empty
    h, factor, grams = _BYTE[data], _ODD, None
    for size in (1, 2, 4, 8, 16, 32):
        h = h[: len(h) - size] * np.uint64(factor) + h[size:]
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF
        if size * 2 == GRAM:
            grams = _mixed(h)
    span = length - GRAM + 1
    least = (grams & ~np.uint64(0xFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    at = (least & np.uint64(0xFFFFF)).astype(np.int64)
    inside = np.zeros(len(at) + 1, np.int64)
    has = lengths >= length
    np.add.at(inside, begins[has], 1)
    np.add.at(inside, np.minimum(begins[has] + lengths[has] - length + 1, len(at)), -1)
    valid = np.cumsum(inside)[:-1] > 0
    new, last = valid.copy(), valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    last[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
    first, final = np.flatnonzero(new), np.flatnonzero(last)
    if not len(first):
        return empty
    size, gram = final - first + length, at[first]
    # three overlapping blocks of 64 bytes cover any string of up to 192 bytes
    content = _mixed(h[first] * _MIX[0] + h[first + (size - 64) // 2] * _MIX[1] + h[first + size - 64] * _MIX[2] + size.astype(np.uint64) * _MIX[3] + (gram - first).astype(np.uint64) * _MIX[4])
    text = np.searchsorted(begins, first, side="right") - 1
    return grams[gram].view(np.int64), content.view(np.int64), text, first - begins[text], size


class RunLengthIndex:
    """A Burrows-Wheeler transform, kept as runs with the text's places at their ends, of distinct strings, which come in the order of their first occurrence.

    Strings are streamed through it backwards, all together a letter at a time, whether the index has them or not. Each keeps its matching statistic, capped at
    ``length``: a row whose suffix begins with the longest match, and the match's size. Where the row's run has the next letter, the match grows by it. Else the row moves to
    the end of the nearest run of that letter above or below, whose places are sampled, and the match shrinks to what the text there has of it, the longer of both."""

    def __init__(self, strings: list[bytes], length: int) -> None:
        self.length = length
        sizes = np.array([len(s) for s in strings])
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        ends = np.cumsum(sizes + 1) - 1
        text[ends] = 0
        n = len(text)
        padded = np.concatenate([text, np.zeros(8, np.int64)])
        key = np.zeros(n, np.int64)
        for i in range(7):
            key = key << 9 | padded[i : i + n]
        rank, reach, half, at_half = self._ranks(key), 7, None, 7
        while True:
            if reach <= length < 2 * reach:
                half, at_half = rank, reach
            if rank.max() == n - 1 and half is not None:
                break
            shifted = np.zeros(n, np.int64)
            shifted[: max(0, n - reach)] = rank[reach:] + 1
            rank, reach = self._ranks(rank << 32 | shifted), 2 * reach
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        # runs of the transform: letter, first and last row, where the first row leads, and the text's places at both
        letters = text[order - 1]
        self.first_row = np.flatnonzero(np.r_[True, letters[1:] != letters[:-1]])
        self.last_row = np.r_[self.first_row[1:], n] - 1
        self.letter = letters[self.first_row]
        by_letter = np.argsort(self.letter, kind="stable")
        run_sizes = self.last_row - self.first_row + 1
        self.leads = np.empty(len(run_sizes), np.int64)
        self.leads[by_letter] = np.cumsum(run_sizes[by_letter]) - run_sizes[by_letter]
        self.first_place, self.last_place = order[self.first_row], order[self.last_row]
        self.by_letter, self.keys = by_letter, self.letter[by_letter] * len(by_letter) + by_letter
        self.text = np.concatenate([text, np.zeros(length + 1, np.int64)]).astype(np.int16)
        # intervals of suffixes that share `length` bytes of their strings, and the first string of each
        owner = np.repeat(np.arange(len(strings)), sizes + 1)
        whole = (ends[owner] - np.arange(n) >= length)[order]
        far = np.minimum(np.arange(n) + length - at_half, n - 1)
        a, b = half[order], half[far][order]
        joined = np.r_[False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])]
        self.interval_start = np.flatnonzero(whole & ~joined)
        rows = np.flatnonzero(whole)
        number = np.searchsorted(self.interval_start, rows, side="right") - 1
        self.first = np.full(len(self.interval_start), len(strings), np.int64)
        np.minimum.at(self.first, number, owner[order][rows])

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        return rank

    def _moved(self, run: np.ndarray, letter: np.ndarray, match: np.ndarray, query: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows in runs of other letters: the run of this letter to move to, the row in it, and what is left of the match of ``query[at:]``."""
        place = np.searchsorted(self.keys, letter * len(self.keys) + run)
        best_run, best_row, best = np.full(len(run), -1), np.zeros(len(run), np.int64), np.full(len(run), -1)
        offsets = np.arange(self.length)
        for beside, rows, places in ((place - 1, self.last_row, self.last_place), (place, self.first_row, self.first_place)):
            inside = (beside >= 0) & (beside < len(self.keys))
            other = self.by_letter[np.where(inside, beside, 0)]
            inside &= self.letter[other] == letter
            some = np.flatnonzero(inside)
            if not len(some):
                continue
            # the places are those of the suffixes themselves: how much of the match do they begin with?
            same = self.text[places[other[some]][:, None] + offsets] == query[at[some][:, None] + offsets]
            kept = np.minimum(np.where(same.all(axis=1), self.length, same.argmin(axis=1)), match[some])
            longer = kept > best[some]
            better = some[longer]
            best_run[better], best_row[better], best[better] = other[better], rows[other[better]], kept[longer]
        return best_run, best_row, best

    def matches(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every window of the strings that a string of the index has: the string's number, its start, and the first string of the index that has it."""
        sizes = np.array([len(s) for s in strings])
        query = np.concatenate([np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1, np.full(self.length, -1, np.int16)])
        last = np.cumsum(sizes) - 1
        own, rows, match = np.arange(len(strings)), np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64)
        found = []
        for done in range(int(sizes.max(initial=0))):
            going = sizes[own] > done
            own, rows, match = own[going], rows[going], match[going]
            at = last[own] - done
            letter = query[at].astype(np.int64)
            run = np.searchsorted(self.first_row, rows, side="right") - 1
            away = np.flatnonzero(self.letter[run] != letter)
            none = np.zeros(0, np.int64)
            if len(away):
                to, row, left = self._moved(run[away], letter[away], match[away], query, at[away] + 1)
                none = away[to < 0]
                run[away], rows[away], match[away] = np.where(to < 0, run[away], to), np.where(to < 0, rows[away], row), np.maximum(left, 0)
            here = rows
            rows = self.leads[run] + rows - self.first_row[run]
            match = np.minimum(match + 1, self.length)
            rows[none], match[none] = here[none], 0  # a letter that the index doesn't have
            hit = np.flatnonzero(match >= self.length)
            if len(hit):
                first = self.first[np.searchsorted(self.interval_start, rows[hit], side="right") - 1]
                found.append((own[hit], sizes[own[hit]] - done - 1, first))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return _in_order(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def repeats(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """String and start of every window of the index's own strings that an earlier one has too."""
        string, start, first = self.matches(strings)
        return string[first < string], start[first < string]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end up to PIECE bytes; longer ones in pieces that overlap by a window less one byte."""
    held: list[bytes] = []
    meta: list[tuple[int, int]] = []
    count = 0

    def laid():
        lengths = np.array([len(x) for x in held], np.int64)
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum(lengths) - lengths, lengths, np.array([m[0] for m in meta]), np.array([m[1] for m in meta])

    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        step = PIECE - length
        for a in range(0, len(text) - length + 1, step):
            part = text[a : a + step + length - 1]
            if count + len(part) > PIECE and held:
                yield laid()
                held, meta, count = [], [], 0
            held.append(part)
            meta.append((i, a))
            count += len(part)
    if held:
        yield laid()


def _spans(string: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows as string, from, to."""
    if not len(string):
        return string, start, start
    new = np.r_[True, (string[1:] != string[:-1]) | (start[1:] != start[:-1] + 1)]
    last = np.r_[new[1:], True]
    return string[new], start[new], start[last] + length


def keyed(docs: DataFrame) -> DataFrame:
    """rid: a number for each row, ascending by id (null first), hash of the text, place in the input; row: the columns of ``docs`` but the text; text.

    A written table: the number is a row's identity in all that follows, so that it must not be computed twice."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    order = ["d", "th", "at"]
    rows = docs.select(F.struct(*rest).alias("row"), "text", F.col("doc_id").alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.monotonically_increasing_id().alias("at"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.select(F.monotonically_increasing_id().alias("rid"), "row", "text"), "texts").where("rid IS NOT NULL")  # as inner joins add


def _emitted(texts: DataFrame, length: int, hot: np.ndarray) -> DataFrame:
    """deal, anchor, content, rid, packed, kind of every string: 1, it repeats an earlier one of the same slice of texts; 3, its gram is a hot one; else 0. Strings are told
    by task after ``deal``: of a gram all together, of a hot gram only those of one content, and those that are told already anywhere."""
    shared = texts.sparkSession.sparkContext.broadcast(np.sort(hot))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = shared.value
        for batch in by_bytes(batches):
            ids = batch["rid"].to_numpy()
            parts = []
            for data, begins, lengths, doc, offset in _pieces([t.encode() for t in batch["text"].to_pylist()], length):
                gram, content, text, start, size = strings_of(data, begins, lengths, length)
                parts.append((gram, content, ids[doc[text]], (start + offset[text]) << _START | (size - length)))
            if not parts:
                continue
            gram, content, rid, packed = (np.concatenate(x) for x in zip(*parts, strict=True))
            both = gram * 3 + content
            order = np.argsort(both, kind="stable")
            same = both[order][1:] == both[order][:-1]
            alike = order[np.r_[same, False] | np.r_[False, same]]
            alike = alike[np.lexsort((packed[alike], rid[alike], content[alike], gram[alike]))]
            again = ~_first(gram[alike], content[alike])
            kind = np.zeros(len(gram), np.int8)
            kind[np.isin(gram, heavy)] = 3
            kind[alike[again]] = 1
            deal = np.where(kind == 1, _spread(rid, packed), np.where(kind == 3, _mixed(both.view(np.uint64)).view(np.int64), gram))
            columns = {"deal": deal, "anchor": gram, "content": content, "rid": rid, "packed": packed, "kind": kind}
            for k in range(0, len(gram), 50_000):
                yield pa.RecordBatch.from_pydict({name: x[k : k + 50_000] for name, x in columns.items()})

    strings = texts.where(F.octet_length("text") >= length).select("rid", "text")
    return strings.mapInArrow(emit, "deal long, anchor long, content long, rid long, packed long, kind byte")


def hot_grams(texts: DataFrame, length: int, one_in: int = 16, least: int = 32, most: int = 20_000) -> np.ndarray:
    """The grams, ``most`` at most, with the most differing strings in one text of ``one_in``. This decides only how strings are dealt to tasks, not what is
    told of them: a gram that it misses has too few strings to hold a task up."""
    some = texts.where(F.pmod(F.xxhash64("rid"), F.lit(one_in)) == 0)
    counts = _emitted(some, length, np.zeros(0, np.int64)).where("kind = 0").groupBy("anchor").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least).orderBy(F.desc("n"), "anchor").limit(most).select("anchor").toArrow()["anchor"].to_numpy()


def _dealt(texts: DataFrame, length: int) -> DataFrame:
    return _emitted(texts, length, hot_grams(texts, length)).repartition("deal").sortWithinPartitions("anchor", "content", "rid", "packed")


def _found(texts: DataFrame, length: int) -> DataFrame:
    """rid, packed, anchor, kind: 1, a string that repeats an earlier one as a whole; 2, a string to index."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, last = Told(), None
        for rows in batches:
            anchor, content, rid, packed, kind = (rows[c].to_numpy() for c in ("anchor", "content", "rid", "packed", "kind"))
            done, hot = kind == 1, kind == 3
            out = [(rid[done], packed[done], anchor[done], kind[done]), *told.next(*(x[kind == 0] for x in (anchor, content, rid, packed)))]
            if hot.any():  # all first ones are indexed: others of their gram are in other tasks
                first = _first(anchor[hot], content[hot])
                first[0] = last != (anchor[hot][0], content[hot][0])
                last = anchor[hot][-1], content[hot][-1]
                out.append((rid[hot], packed[hot], anchor[hot], np.where(first, 2, 1).astype(np.int8)))
            rid, packed, anchor, kind = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_pydict({"rid": rid, "packed": packed, "anchor": anchor, "kind": kind})

    return _dealt(texts, length).drop("deal").mapInArrow(compare, "rid long, packed long, anchor long, kind byte")


def _first(*equal: np.ndarray) -> np.ndarray:
    """Of sorted rows: whether each is the first with its values."""
    if not len(equal[0]):
        return np.zeros(0, bool)
    return np.r_[True, np.any([x[1:] != x[:-1] for x in equal], axis=0)]


class Told:
    """Tells repeats in rows that come sorted by gram, content, rid and place, batch by batch. Of the rows before a batch only the last gram, the last content
    and a first string that still waits for a second one of its gram are kept, whatever the size of a gram's group."""

    def __init__(self) -> None:
        self.last: tuple[int, int] | None = None
        self.waits: tuple[int, int] | None = None

    def next(self, anchor: np.ndarray, content: np.ndarray, rid: np.ndarray, packed: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """rid, packed, anchor, kind of what is decided by now."""
        if not len(anchor):
            return []
        first, new = _first(anchor, content), _first(anchor)
        if self.last is not None:
            new[0] = anchor[0] != self.last[0]
            first[0] = new[0] or content[0] != self.last[1]
        run = np.cumsum(new)  # 0: the gram of the batch before
        several = np.bincount(run, weights=first, minlength=run[-1] + 1) > 1
        out = []
        if not new[0] and (first & (run == 0)).any():
            several[0] = True
            if self.waits is not None:
                out.append((np.array([self.waits[0]]), np.array([self.waits[1]]), anchor[:1], np.array([2], np.int8)))
                self.waits = None
        ask, again = first & several[run], ~first
        out += [(rid[x], packed[x], anchor[x], np.full(int(x.sum()), kind, np.int8)) for x, kind in ((again, 1), (ask, 2))]
        if run[-1]:
            alone = np.flatnonzero(first)[-1] if not several[-1] else None
            self.waits = None if alone is None else (int(rid[alone]), int(packed[alone]))
        self.last = int(anchor[-1]), int(content[-1])
        return out


def _spread(rid: np.ndarray, packed: np.ndarray) -> np.ndarray:
    return _mixed((rid * 31 + packed).view(np.uint64)).view(np.int64)


def repeated_spans(texts: DataFrame, length: int = 100, group_rows: int = 60_000) -> DataFrame:
    """rid and spans (array of from, to; in bytes; unmerged) of the ``keyed`` texts that have any to remove."""
    if not 64 <= length <= 112:
        raise ValueError("windows of 64 to 112 bytes")
    found = written(_found(texts, length), "found")
    start, more = F.shiftrightunsigned("packed", _START), F.col("packed").bitwiseAND((1 << _START) - 1)
    whole = found.where("kind = 1").select("rid", start.alias("a"), (start + more + length).alias("b"))
    asked = found.where("kind = 2").select("rid", "packed", "anchor")
    large = written(asked.groupBy("anchor").count().where(F.col("count") > group_rows).select("anchor", F.lit(True).alias("large")), "large")
    n_large = large.count()
    asked = asked.join(F.broadcast(large) if n_large <= 100_000 else large, "anchor", "left").select("rid", F.struct("packed", "anchor", F.coalesce("large", F.lit(False)).alias("large")).alias("ask"))
    wanted = texts.join(asked.groupBy("rid").agg(F.collect_list("ask").alias("asks")), "rid")  # all columns, so that the caller's join reads the same shuffle

    def places(batches: Iterator[pa.RecordBatch], large: bool) -> Iterator[tuple[int, int, int, int, bytes]]:
        """rid, anchor, start, windows and bytes of the strings asked for."""
        for batch in by_bytes(batches):
            asks, ends = batch["asks"].flatten(), batch["asks"].offsets.to_numpy()
            chosen = asks.field("large").to_numpy(zero_copy_only=False) == large
            packed, anchor = asks.field("packed").to_numpy(), asks.field("anchor").to_numpy()
            first = int(ends[0])
            for i, rid in enumerate(batch["rid"].to_pylist()):
                own = np.arange(int(ends[i]) - first, int(ends[i + 1]) - first)
                own = own[chosen[own]]
                if len(own):
                    raw = batch["text"][i].as_py().encode()
                    for at, a, m in zip(anchor[own].tolist(), (packed[own] >> _START).tolist(), (packed[own] & ((1 << _START) - 1)).tolist(), strict=True):
                        yield rid, at, a, m + 1, raw[a : a + length + m]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batched(((at, rid, a, string) for rid, at, a, _, string in places(batches, False)), 20_000):
            anchor, rid, a, string = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchor, pa.int64()), "rid": pa.array(rid, pa.int64()), "a": pa.array(a, pa.int64()), "string": pa.array(string, pa.binary())})

    def fetch_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batched(places(batches, True), 2_000):
            halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s[i : i + length]) for _, _, _, n, s in rows for i in range(n)), "<i8").reshape(-1, 2)
            n = np.array([x[3] for x in rows])
            rid, a = np.repeat(np.array([x[0] for x in rows]), n), np.repeat(np.array([x[2] for x in rows]), n)
            a += np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            order = np.lexsort((a, rid, halves[:, 1], halves[:, 0]))
            high, low, rid, a = halves[order, 0], halves[order, 1], rid[order], a[order]
            first = _first(high, low)
            # windows that repeat one of this task go on as spans, dealt out evenly
            span, begin, end = _spans(*_in_order(rid[~first], a[~first]), length)
            yield pa.RecordBatch.from_pydict({"window": np.r_[high[first], _spread(span, begin)], "low": np.r_[low[first], end], "rid": np.r_[rid[first], span], "a": np.r_[a[first], begin], "kind": np.r_[np.zeros(int(first.sum()), np.int8), np.ones(len(span), np.int8)]})

    def later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for rows in batches:
            if not rows.num_rows:
                continue
            window, low, rid, a, kind = (rows[c].to_numpy() for c in ("window", "low", "rid", "a", "kind"))
            done, new = kind == 1, kind == 0
            again = ~_first(window[new], low[new])
            if len(again):
                again[0] = last == (window[new][0], low[new][0])
                last = window[new][-1], low[new][-1]
            begin = np.r_[a[done], a[new][again]]
            yield pa.RecordBatch.from_pydict({"rid": np.r_[rid[done], rid[new][again]], "a": begin, "b": np.r_[low[done], a[new][again] + length]})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_groups(["anchor"], INDEX_ROWS)(batches):
            strings, rid, base = rows["string"].to_pylist(), rows["rid"].to_numpy(), rows["a"].to_numpy()
            for i in range(0, len(strings), INDEX_ROWS):
                indexed = RunLengthIndex(strings[i : i + INDEX_ROWS], length)
                for j in range(i, len(strings), INDEX_ROWS):  # its own strings, and all later ones of a large group
                    part = strings[j : j + INDEX_ROWS]
                    string, start = indexed.repeats(part) if i == j else indexed.matches(part)[:2]
                    if len(string):
                        string, a, b = _spans(string + j, start, length)
                        yield pa.RecordBatch.from_pydict({"rid": rid[string], "a": base[string] + a, "b": base[string] + b})

    strings = wanted.mapInArrow(fetch, "anchor long, rid long, a long, string binary")
    indexed = strings.repartition("anchor").sortWithinPartitions("anchor", "rid", "a").mapInArrow(index, "rid long, a long, b long")
    spans = whole.unionByName(indexed)
    if n_large:
        windows = wanted.mapInArrow(fetch_windows, "window long, low long, rid long, a long, kind byte")
        later = windows.repartition("window").sortWithinPartitions("window", "low", "rid", "a").mapInArrow(later_windows, "rid long, a long, b long")
        spans = spans.unionByName(later)
    return spans.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _in_order(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort(columns[::-1])
    return tuple(x[order] for x in columns)


def merged(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Spans as they cover the text together; those that touch are one."""
    if not len(a):
        return []
    a, b = _in_order(a, b)
    reach = np.maximum.accumulate(b)
    new = np.r_[True, a[1:] > reach[:-1]]
    return list(zip(a[new].tolist(), reach[np.r_[new[1:], True]].tolist(), strict=True))


def _with_cuts(batch: pa.RecordBatch) -> Iterator[tuple[str | None, list[tuple[int, int]]]]:
    """Text and merged spans of each row."""
    spans = batch["spans"]
    a, b = (spans.flatten().field(i).to_numpy() for i in range(2))
    sizes = np.array([0 if x is None else x for x in spans.value_lengths().to_pylist()], np.int64)
    ends = np.cumsum(sizes)
    for i, text in enumerate(batch["text"].to_pylist()):
        yield text, merged(a[ends[i] - sizes[i] : ends[i]], b[ends[i] - sizes[i] : ends[i]])


def _kept_text(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """What is left, with every letter that a span cuts kept whole."""
    parts, at = [], 0
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
            b -= 1
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]]).decode("utf-8")


def deduplicated(docs: DataFrame, length: int = 100, group_rows: int = 60_000) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts, kind = keyed(docs.select("doc_id", "text")), dict(docs.dtypes)["doc_id"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            out: list[list] = [[], [], [], []]
            for text, cut in _with_cuts(batch):
                raw, at, digest = (text or "").encode(), 0, hashlib.sha256()
                for a, b in cut:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                for column, value in zip(out, (len(raw), sum(b - a for a, b in cut), len(cut), digest.hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"]} | {name: pa.array(x, pa.string() if name == "kept_sha256" else pa.int64()) for name, x in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), out, strict=True)})

    joined = texts.join(repeated_spans(texts, length, group_rows), "rid", "left")
    return joined.select(F.col("row.doc_id").alias("doc_id"), "text", "spans").mapInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def with_kept_text(docs: DataFrame, length: int = 100, group_rows: int = 60_000) -> DataFrame:
    """The rows of ``docs`` with ``text`` cut down to what is kept; null stays null."""
    texts = keyed(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            kept = [_kept_text(text.encode(), own) if own else text for text, own in _with_cuts(batch)]
            yield pa.RecordBatch.from_pydict({"row": batch["row"], "text": pa.array(kept, pa.string())})

    joined = texts.join(repeated_spans(texts, length, group_rows), "rid", "left").select("row", "text", "spans")
    cuts = joined.mapInArrow(cut, T.StructType([texts.schema["row"], T.StructField("text", T.StringType())]))
    return cuts.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
