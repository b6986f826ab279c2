"""Scoring by a Brown class bigram model.

Words are counted over all training texts. Every text is cut into words once, as a table of word numbers that all later passes read. The most frequent words
of the vocabulary, the seeds, are elements of their own, and all others belong to one of a fixed number of groups by shape (script, marks, length, last
letters). Exchange clustering moves elements between classes as long as the likelihood of the class bigrams, counted over all training texts, grows. Then every
other word of the vocabulary goes to its best class by the same gain, from the counts of the classes before and after it in all training texts, in tasks that
hold some words' counts each; and the transitions are counted again with all words in their classes. From then on all words, seeds too, are taken out of their class and
moved to the best one, round by round, until the moves of a round are of less than ``SETTLED`` of the tokens, or ``ROUNDS`` are done. As words move at the same time, the likelihood of
the recounted transitions decides: where it falls, only the quarter of the moves that gains most is tried, and at the second fall the classes stay. ``Model.likelihoods`` has every round's.

A word's probability is that of its class after the previous word's class, smoothed towards the class's own, times the share that the word has in its class.
Words beyond the vocabulary have the class of their group and their own share. A group also keeps a share for all words never seen, as large as its words seen
once: such a word stands for the one unknown word of its group, so that probabilities sum to one over known words and the groups' unknown ones.

Words above ``LONG`` bytes, such as addresses and dividers, are words as all others, under a digest of theirs that stands for them.

What reaches the driver is bounded: ``VOCABULARY`` words of ``LONG`` bytes at most and their classes, and the bigram counts of ``SEEDS`` + ``GROUPS`` elements. The counts of words beyond
the vocabulary stay in a table that the words of texts are joined to.

Defined cases: null and empty texts still have their end; a null id counts with id "" where the caller parts texts by id; repeated rows are trained on and
scored each for itself, under ids of any type; an empty table gives no rows; without training texts every score is that of unseen words; of words equally
frequent a hash decides which are in the vocabulary; very long texts are held one at a time; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.llm.common import SPACE_RUN, by_bytes, lowered, written
from lumenweave.llm.language_id import most_frequent

VOCABULARY, SEEDS, GROUPS, CLASSES, LONG = 200_000, 1_000, 192, 64, 64
#: Rounds over all words, tries of one, and the share of tokens below which a round's moves are no longer made.
ROUNDS, TRIES, SETTLED = 2, 2, 0.001
#: The end of a text; no word has white space.
END = b"\n"


def key_of(word: bytes) -> bytes:
    """What stands for a word: itself, or where it is long a digest that no word equals."""
    return word if len(word) <= LONG else END + hashlib.sha1(word).hexdigest().encode()


def group_of(word: str) -> int:
    """0 to GROUPS - 1: script, marks and length, and a hash of the last two letters."""
    raw = word.encode("utf-8")
    letters = re.sub(r"\W+", "", word)
    marks = 0 if len(letters) == len(word) else 1 if word[-1:] in ".,;:!?" and len(letters) >= len(word) - 1 else 2
    shape = (len(raw) > len(word)) * 12 + marks * 4 + min(3, len(word) // 4)
    return shape * 8 + zlib.crc32(letters[-2:].encode("utf-8")) % 8


def exchanged(counts: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """A class for each element, from the bigram counts of elements, by moving one element at a time to its best class."""
    n = len(counts)
    own = np.arange(n) % classes
    of = np.zeros((n, classes))
    of[np.arange(n), own] = 1
    table = of.T @ counts @ of

    weight = counts.sum(axis=1)
    left, right = counts.sum(axis=0), weight
    for _ in range(rounds):
        moved = 0
        for w in np.argsort(-weight, kind="stable"):
            if not weight[w] and not left[w]:
                continue
            a, self_count = own[w], counts[w, w]
            after, before = np.bincount(own, weights=counts[w], minlength=classes), np.bincount(own, weights=counts[:, w], minlength=classes)
            table[a] -= after
            table[:, a] -= before
            table[a, a] += self_count
            after[a] -= self_count
            before[a] -= self_count
            rows, columns, corner = table.sum(axis=1), table.sum(axis=0), np.diag(table)
            gain = (phi(table + after[None, :]) - phi(table)).sum(axis=1) + (phi(table + before[:, None]) - phi(table)).sum(axis=0)
            gain += phi(corner + after + before + self_count) - phi(corner + after) - phi(corner + before) + phi(corner)
            # what stands beside it has its place in these sums whatever its class
            gain -= phi(rows + before + right[w]) - phi(rows + before) + phi(columns + after + left[w]) - phi(columns + after)
            best = int(gain.argmax())
            if gain[best] <= gain[a] + 1e-9:
                best = int(a)
            moved += best != a
            own[w] = best
            table[best] += after
            table[:, best] += before
            table[best, best] += self_count
        if not moved:
            break
    return own


class Numbers(dict):
    """Numbers of the vocabulary's words; others are numbered -1 less their group, and kept up to ``more`` of them."""

    def __init__(self, words: list[bytes], more: int = 200_000) -> None:
        super().__init__(zip(words, range(len(words)), strict=True))
        self.extra: list[bytes] = []
        self.more = more

    def __missing__(self, word: bytes) -> int:
        if len(self.extra) >= self.more:
            for w in self.extra:
                del self[w]
            self.extra.clear()
        number = self[word] = -1 - group_of(word.decode("utf-8"))
        self.extra.append(word)
        return number


@dataclass
class Corpus:
    texts: DataFrame  # uid, doc_id, learn, numbers of the words and the end, rest (words beyond the vocabulary: word, n, g)
    counts: DataFrame  # word, n over the training texts, ends included
    words: list[bytes]  # the vocabulary, the most frequent first, the end among the seeds
    frequency: np.ndarray
    tokens: int
    types: int


@dataclass
class Model:
    classes: np.ndarray  # of the vocabulary's words, then of the groups
    share: np.ndarray  # log10 of a word's part of its class
    step: np.ndarray  # log10 probability of a class after a class
    whole: np.ndarray  # log10 of the size of a group's class
    unseen: np.ndarray  # log10 of a group's unknown word's part of its class
    likelihoods: list[float]  # log10 probability of a training token by its class bigram and share, after the first assignment and each round


def phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def prepared(docs: DataFrame, learn: Column) -> Corpus:
    """The words of all texts as numbers, and what the texts where ``learn`` holds say of the words. Both are written tables."""
    key = lambda w: F.when(F.octet_length(w) > LONG, F.concat(F.lit(END.decode()), F.sha1(F.encode(w, "utf-8")))).otherwise(w)
    words = F.transform(F.filter(F.split(lowered(F.col("text")), SPACE_RUN), lambda w: w != ""), key)
    counts = docs.where(learn).select(F.explode(F.concat(words, F.array(F.lit(END.decode())))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = written(counts, "word-counts")
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    short = counts.withColumn("all", F.lit(1))
    top = sorted(((w.encode(), n) for w, n in zip(*most_frequent(short, ["all"], "word", VOCABULARY, few=True).select("word", "n").toArrow().to_pydict().values(), strict=True)), key=lambda x: (-x[1], x[0]))
    end = [x for x in top if x[0] == END] or [(END, 0)]
    top = [x for x in top if x[0] != END]
    top[min(len(top), SEEDS - 1) : min(len(top), SEEDS - 1)] = end
    vocabulary = [w for w, _ in top]
    shared, kind = docs.sparkSession.sparkContext.broadcast(vocabulary), dict(docs.dtypes)["doc_id"]
    item = pa.struct([("word", pa.string()), ("n", pa.int64()), ("g", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbers(shared.value)
        get, last = number.__getitem__, number[END]
        for batch in by_bytes(batches):
            values, ends, rest, rest_ends = [], [0], [], [0]
            for text in batch["text"].to_pylist():
                own = (text or "").encode("utf-8").lower().split()
                if own and len(max(own, key=len)) > LONG:
                    own = [key_of(w) for w in own]
                ids = np.fromiter(map(get, own), np.int32, len(own))
                unknown = np.flatnonzero(ids < 0)
                if len(unknown):
                    found = Counter(own[i] for i in unknown.tolist())
                    rest += [(w, n, -1 - get(w)) for w, n in found.items()]
                values += [ids, np.array([last], np.int32)]
                ends.append(ends[-1] + len(ids) + 1)
                rest_ends.append(len(rest))
            parts = list(zip(*rest, strict=True)) if rest else [(), (), ()]
            flat = pa.StructArray.from_arrays([pa.array(parts[0], pa.binary()).cast(pa.string()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.int32())], fields=list(item))
            numbers = np.concatenate(values) if values else np.zeros(0, np.int32)
            columns = {"uid": batch["uid"], "doc_id": batch["doc_id"], "learn": batch["learn"], "numbers": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers))}
            yield pa.RecordBatch.from_pydict(columns | {"rest": pa.ListArray.from_arrays(pa.array(rest_ends, pa.int32()), flat)})

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce(learn, F.lit(False)).alias("learn"), "text")
    texts = rows.mapInArrow(run, f"uid long, doc_id {kind}, learn boolean, numbers array<int>, rest array<struct<word string, n long, g int>>")
    return Corpus(written(texts, "word-numbers"), counts, vocabulary, np.array([n for _, n in top], np.int64), int(size["n"]), int(size["v"]))


def _laid(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all rows, end to end, and where each row ends."""
    lists = batch["numbers"]
    return lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` numbers, or of one row."""
    for batch in batches:
        ends, first = np.cumsum(batch["numbers"].value_lengths().to_numpy(zero_copy_only=False)), 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, size + (int(ends[first - 1]) if first else 0), side="right")))
            yield batch.slice(first, last - first)
            first = last


def _after(values: np.ndarray, ends: np.ndarray, first: int) -> np.ndarray:
    """What stands before each value; ``first`` before the first of a row."""
    before = np.empty_like(values)
    before[1:] = values[:-1]
    before[_begins(ends)] = first
    return before


def _begins(ends: np.ndarray) -> np.ndarray:
    return np.r_[0, ends[:-1]] if len(ends) else ends.astype(np.int64)


def _pair_counts(corpus: Corpus, of: np.ndarray, end: int, n: int) -> np.ndarray:
    """How often each of ``n`` kinds follows each, over the training texts; ``of``: the kind of the vocabulary's words, then of groups. A task adds up its own."""
    shared, v = corpus.texts.sparkSession.sparkContext.broadcast(of), len(corpus.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, total = shared.value, np.zeros(n * n, np.int64)
        for batch in _slices(batches, 1 << 19):
            numbers, ends = _laid(batch)
            if len(numbers):
                own = kinds[np.where(numbers >= 0, numbers, v - 1 - numbers)].astype(np.int64)
                total += np.bincount(_after(own, ends, end) * n + own, minlength=n * n)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": code, "n": total[code]})

    cells = corpus.texts.where("learn").select("numbers").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(n * n)
    table[cells["code"].to_numpy()] = cells["n"].to_numpy()
    return table.reshape(n, n)


def _gains(table: np.ndarray, seen: np.ndarray, other: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """What each word adds to the likelihood's bigrams (k, c) in every class c, if it has ``seen`` these counts of classes k on one side and the ``other`` ones on its other side."""
    word, k = np.nonzero(seen)
    out = np.zeros(seen.shape)
    if not len(word):
        return out
    n, base = seen[word, k][:, None], table[k]
    if own is not None:  # the word is in a class, whose bigrams are fewer without it
        base[np.arange(len(word)), own[word]] -= n[:, 0]
        same = k == own[word]
        base[same] -= other[word[same]]
        np.maximum(base, 0, out=base)  # a word beside itself is taken out twice
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out[word[first]] = np.add.reduceat(phi(base + n) - phi(base), first)
    return out


def best_classes(table: np.ndarray, before: np.ndarray, after: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For words with these counts of classes before and after them, the class that they add most likelihood to, and how much more than in their own. ``own``: the class they are in
    and are first taken out of; without it they are in none."""
    gain, at = _gains(table, before, after, own) + _gains(table.T, after, before, own), np.arange(len(before))
    for line, size in ((table.sum(axis=1), after.sum(axis=1)[:, None]), (table.sum(axis=0), before.sum(axis=1)[:, None])):
        without = np.broadcast_to(line, gain.shape).copy()
        if own is not None:
            without[at, own] -= size[:, 0]
        gain -= phi(without + size) - phi(without)
    corner = np.broadcast_to(np.diag(table), gain.shape).copy()  # a class beside itself gains from both sides at once
    if own is not None:
        corner[at, own] = np.maximum(corner[at, own] - before[at, own] - after[at, own], 0)
    gain += phi(corner + after + before) - phi(corner + after) - phi(corner + before) + phi(corner)
    best = gain.argmax(axis=1)
    return best, gain[at, best] - (gain[at, own] if own is not None else 0)


def _moves(corpus: Corpus, classes: np.ndarray, table: np.ndarray, first: int, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the vocabulary's words from ``first`` on, their best classes and gains, given the classes of all and their transitions. ``inside``: the words are in their classes and are
    taken out first. Tasks count what stands beside each word as bytes, which one shuffle brings together by word."""
    spark, v, end = corpus.texts.sparkSession, len(corpus.words), int(classes[corpus.words.index(END)])
    shared, side = spark.sparkContext.broadcast((classes, table)), 2 * CLASSES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = shared.value[0].astype(np.uint8)
        for batch in batches:
            numbers, ends = _laid(batch)
            own = kinds[np.where(numbers >= 0, numbers, v - 1 - numbers)]
            later = np.full(len(own), end, np.uint8)
            later[:-1] = own[1:]  # what follows the end of a text is the next one's first word, which no likelihood counts
            before = _after(own, ends, end)
            for i in range(0, len(numbers), 1 << 21):  # what is sorted at once; a code is below 2^31
                at = np.flatnonzero(numbers[i : i + (1 << 21)] >= first) + i
                inner = at[numbers[at] != corpus_end]
                code, n = np.unique(np.r_[numbers[at] * side + before[at], numbers[inner] * side + (CLASSES + later[inner])], return_counts=True)
                word, begins = np.unique(code // side, return_index=True)
                kept, times = (code % side).astype(np.uint8).tobytes(), n.astype("<u4").tobytes()
                cut = list(zip(begins.tolist(), [*begins[1:].tolist(), len(code)], strict=True)) if len(word) else []
                yield pa.RecordBatch.from_pydict({"word": word.astype(np.int64), "k": pa.array([kept[a:b] for a, b in cut], pa.binary()), "n": pa.array([times[4 * a : 4 * b] for a, b in cut], pa.binary())})

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, table = shared.value
        place: dict[int, int] = {}
        seen = np.zeros((0, side))
        for batch in batches:
            words = batch["word"].to_pylist()
            for w in words:
                place.setdefault(w, len(place))
            if len(place) > len(seen):
                seen = np.concatenate([seen, np.zeros((max(len(place) - len(seen), len(seen)), side))])
            sizes = pa.compute.binary_length(batch["k"]).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.array([place[w] for w in words], np.int64), sizes)
            k, n = (np.frombuffer(b"".join(batch[c].to_pylist()), kind) for c, kind in (("k", np.uint8), ("n", "<u4")))
            np.add.at(seen, (rows, k), n)
        words = np.fromiter(place, np.int64, len(place))
        for i in range(0, len(words), 128):
            part, own = words[i : i + 128], seen[i : i + 128][: len(words) - i]
            best, gain = best_classes(table, own[:, :CLASSES], own[:, CLASSES:], kinds[part] if inside else None)
            yield pa.RecordBatch.from_pydict({"word": part, "class": best, "gain": gain})

    corpus_end = corpus.words.index(END)
    seen = corpus.texts.where("learn").select("numbers").mapInArrow(count, "word long, k binary, n binary")
    found = seen.repartition("word").mapInArrow(choose, "word long, class long, gain double").toArrow()
    return tuple(found[c].to_numpy() for c in ("word", "class", "gain"))


def likelihood(steps: np.ndarray) -> float:
    """Of the class bigrams, without the words' own part, which does not depend on the classes."""
    return float(phi(steps).sum() - phi(steps.sum(axis=0)).sum() - phi(steps.sum(axis=1)).sum())


def settled(corpus: Corpus, classes: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes after rounds of exchange over all words, their transitions, and the likelihood before and after each round."""
    end = corpus.words.index(END)
    steps = _pair_counts(corpus, classes, int(classes[end]), CLASSES)
    history = [likelihood(steps)]
    for _ in range(rounds):
        words, chosen, gain = _moves(corpus, classes, steps, 0, True)
        better = np.flatnonzero((chosen != classes[words]) & (gain > 1e-9) & (words != end))
        better = better[np.lexsort((words[better], -gain[better]))]
        for _ in range(TRIES):
            if corpus.frequency[words[better]].sum() < SETTLED * corpus.tokens:
                return classes, steps, history
            moved = classes.copy()
            moved[words[better]] = chosen[better]
            after = _pair_counts(corpus, moved, int(moved[end]), CLASSES)
            if likelihood(after) > history[-1]:
                classes, steps = moved, after
                history.append(likelihood(after))
                break
            better = better[: len(better) // 4]
        else:
            break
    return classes, steps, history


def fit(corpus: Corpus, smoothing: float = 10.0) -> Model:
    v, elements = len(corpus.words), SEEDS + GROUPS
    shape = np.array([group_of(w.decode()) for w in corpus.words], np.int64)
    of = np.r_[np.where(np.arange(v) < SEEDS, np.arange(v), SEEDS + shape), SEEDS + np.arange(GROUPS)]
    end = corpus.words.index(END)
    table = _pair_counts(corpus, of, end, elements)
    by_element = exchanged(table, CLASSES)
    one = np.zeros((elements, CLASSES))
    one[np.arange(elements), by_element] = 1
    classes = by_element[of]
    words, chosen, _ = _moves(corpus, classes, one.T @ table @ one, SEEDS, False)
    classes[words] = chosen
    classes, steps, history = settled(corpus, classes)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GROUPS, np.int64)
        for batch in batches:
            total += np.bincount([group_of(w) for w in batch["word"].to_pylist()], minlength=GROUPS)
        yield pa.RecordBatch.from_pydict({"g": np.arange(GROUPS, dtype=np.int32), "once": total})

    once = np.ones(GROUPS)
    for r in corpus.counts.where("n = 1").select("word").mapInArrow(grouped, "g int, once long").groupBy("g").agg(F.sum("once").alias("once")).collect():
        once[r["g"]] += r["once"]
    of_groups, sizes = classes[v:], steps.sum(axis=0)
    own = float(phi(corpus.frequency.astype(np.float64)).sum())
    whole = np.maximum(sizes + np.bincount(of_groups, weights=once, minlength=CLASSES), 1e-9)
    alone = (sizes + 0.5) / (sizes.sum() + 0.5 * CLASSES)
    step = np.log10((steps + smoothing * alone[None, :]) / (steps.sum(axis=1, keepdims=True) + smoothing))
    share = np.log10(np.maximum(corpus.frequency, 1)) - np.log10(whole[classes[:v]])
    return Model(classes, share, step, np.log10(whole[of_groups]), np.log10(once) - np.log10(whole[of_groups]), [(x + own) / max(1, corpus.tokens) / np.log(10) for x in history])


def scored(corpus: Corpus, model: Model) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    shared, v, end = corpus.texts.sparkSession.sparkContext.broadcast((model, np.log10(corpus.frequency + 1.0), corpus.frequency > 0)), len(corpus.words), corpus.words.index(END)
    kind = dict(corpus.texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, base, seen = shared.value
        for batch in _slices(batches, 1 << 19):
            numbers, ends = _laid(batch)
            own = m.classes[np.where(numbers >= 0, numbers, v - 1 - numbers)]
            known, place = numbers >= 0, np.maximum(numbers, 0)
            # an end that was never seen is an unknown word as any other
            sums = [known & seen[place], np.where(known, base[place], 0.0), m.step[_after(own, ends, int(m.classes[end])), own] + np.where(known, m.share[place], 0.0)]
            added = [np.add.reduceat(x, _begins(ends)) if len(x) else x for x in (sums[0].astype(np.int64), *sums[1:])]
            sizes = np.diff(np.r_[0, ends])
            yield pa.RecordBatch.from_pydict({"uid": batch["uid"], "doc_id": batch["doc_id"], "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(added[0], pa.int64()), "base": added[1], "score": added[2]})

    own = corpus.texts.select("uid", "doc_id", "numbers").mapInArrow(run, f"uid long, doc_id {kind}, n_tokens long, n_known long, base double, score double")
    rest = corpus.texts.select("uid", F.explode("rest").alias("r")).select("uid", "r.*").join(corpus.counts.select("word", F.col("n").alias("c")), "word", "left")
    of_group: Callable[[np.ndarray], Column] = lambda values: F.element_at(F.array(*(F.lit(float(x)) for x in values)), F.col("g") + 1)
    found, c = F.col("c").isNotNull(), F.col("c").cast("double")
    rest = rest.select(
        "uid",
        F.lit(None).cast(kind).alias("doc_id"),
        F.lit(0).cast("long").alias("n_tokens"),
        F.when(found, F.col("n")).otherwise(0).alias("n_known"),
        F.when(found, F.col("n") * F.log10(c + 1)).otherwise(0.0).alias("base"),
        (F.col("n") * F.when(found, F.log10(c) - of_group(model.whole)).otherwise(of_group(model.unseen))).alias("score"),
    )
    sums = own.unionByName(rest).groupBy("uid").agg(F.max("doc_id").alias("doc_id"), *(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")))
    unit = float(np.log10(corpus.tokens + corpus.types + 1))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(corpus.tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * unit).alias("base_score"), "score")
