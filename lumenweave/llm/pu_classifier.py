"""A quality classifier from positive and unlabelled texts.

Each text becomes a few statistics, cut into bins at quantiles over all texts; the model adds a weight for each statistic's bin. Trusted positives are
texts labelled good; all other training texts are unlabelled. Training lowers the non-negative unbiased risk
``prior * risk of positives as positive + max(0, risk of unlabelled as negative - prior * risk of positives as negative)`` with logistic loss, by
full gradients: every round each task sums its rows' gradients, and the sums, a fixed number of values, come to the driver. The class prior is the least
ratio, over score thresholds, of the unlabelled to the positive share above it, for a first model that tells positives from unlabelled.

Defined cases: null is an empty text, whose statistics are zero; null labels and labels without a text count for nothing; a text with several labels
has the least; without positives all weights stay zero and every score is one half; rows with null ids are unlabelled; repeated rows count and are scored each for itself; an
empty table gives no rows; equal statistics give equal scores; very long texts are measured whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.llm.common import written

STATISTICS = ("words", "mean_word", "symbols", "capitals", "digits", "marks", "exclaims", "distinct", "top_word", "dup_lines", "repeats", "foreign", "line_length", "short_words", "long_word", "entropy", "ended")
BINS = 10
_KINDS = np.zeros((256, 6))
for _i, _set in enumerate((b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:?", b"!", bytes(range(128, 256)))):
    _KINDS[list(_set), _i] = 1


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    letters = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = letters[letters > 0] / len(raw)
    symbols, capitals, digits, marks, exclaims, foreign = (letters @ _KINDS) / len(raw)
    width = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(n), width.mean(), symbols, capitals, digits, marks, exclaims, len(counts) / n, max(counts.values()) / n,
        1 - len(set(lines)) / len(lines), sum(c for c in windows.values() if c > 1) / n, foreign, np.log1p(len(raw) / len(lines)),
        float((width <= 3).mean()), np.log1p(width.max()), float(-(share * np.log(share)).sum()), sum(w[-1] in b".,;:!?" for w in words) / n,
    ]


def prepared(docs: DataFrame, labels: DataFrame, train: "F.Column") -> DataFrame:
    """doc_id, part (0: held out, 1: unlabelled, 2: trusted positive) and bins, a byte for each statistic; a written table."""

    @F.pandas_udf("array<float>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(statistics(t), np.float32) for t in texts])

    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id", F.lit(True).alias("good"))
    rows = docs.select("doc_id", train.alias("train"), stats(F.coalesce("text", F.lit(""))).alias("s"))
    rows = written(rows.select("doc_id", "train", *(F.col("s")[i].alias(f"s{i}") for i in range(len(STATISTICS)))), "statistics")
    levels = F.array(*(F.lit(i / BINS) for i in range(1, BINS)))
    cuts = rows.agg(*(F.percentile_approx(f"s{i}", levels, 2_000).alias(f"s{i}") for i in range(len(STATISTICS)))).first()
    edges = [np.unique(np.array(cuts[i] or [], np.float32)) for i in range(len(STATISTICS))]

    @F.pandas_udf("binary")
    def binned(*columns: pd.Series) -> pd.Series:
        table = np.stack([np.searchsorted(e, c.to_numpy(), side="left") for e, c in zip(edges, columns, strict=True)], axis=1).astype(np.uint8)
        return pd.Series([r.tobytes() for r in table])

    part = F.when(~F.col("train"), 0).when(F.col("good"), 2).otherwise(1)
    return written(rows.join(good, "doc_id", "left").select("doc_id", part.alias("part"), binned(*(f"s{i}" for i in range(len(STATISTICS)))).alias("bins")), "bins")


def _places(bins: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(bins.to_pylist()), np.uint8).reshape(-1, len(STATISTICS)).astype(np.int64) + BINS * np.arange(len(STATISTICS))


class Trainer:
    """Weights, and the sums over the table that move them."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table.where("part > 0")
        self.weights = np.zeros(BINS * len(STATISTICS) + 1)
        self.count = np.array([0, 0])

    def _sums(self, of) -> dict[int, float]:
        """``of(places, part, logits)`` gives keys and values, which are summed over the table."""
        weights = self.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, float] = {}
            for batch in batches:
                if batch.num_rows:
                    places = _places(batch["bins"])
                    for k, v in zip(*of(places, batch["part"].to_numpy(), weights[places].sum(axis=1) + weights[-1]), strict=True):
                        total[int(k)] = total.get(int(k), 0.0) + float(v)
            yield pa.RecordBatch.from_pydict({"k": pa.array(total.keys(), pa.int64()), "v": pa.array(total.values(), pa.float64())})

        rows = self.table.select("part", "bins").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        return {r["k"]: r["v"] for r in rows}

    def gradients(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean losses and mean gradients of: positives as positive, positives as negative, unlabelled as negative."""
        n = len(self.weights)

        def of(places: np.ndarray, part: np.ndarray, logits: np.ndarray):
            keys, values = [], []
            for i, (own, sign) in enumerate(((2, 1), (2, -1), (1, -1))):
                chosen = part == own
                pull = -sign / (1 + np.exp(sign * logits[chosen]))
                sums = np.bincount(places[chosen].ravel(), weights=np.repeat(pull, places.shape[1]), minlength=n)
                sums[-1] = pull.sum()
                keys.append(np.arange(n + 2) + i * (n + 2))
                values.append(np.r_[sums, np.logaddexp(0, -sign * logits[chosen]).sum(), chosen.sum()])
            return np.concatenate(keys), np.concatenate(values)

        found = self._sums(of)
        table = np.array([[found.get(i * (n + 2) + k, 0.0) for k in range(n + 2)] for i in range(3)])
        self.count = table[:, n + 1]
        mean = table[:, : n + 1] / np.maximum(table[:, n + 1 :], 1)
        return mean[:, n], mean[:, :n]

    def train(self, rounds: int, direction, rate: float = 0.3) -> None:
        first, second = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for t in range(1, rounds + 1):
            losses, slopes = self.gradients()
            if not self.count[0]:
                return
            slope = direction(losses, slopes) + 1e-3 * np.r_[self.weights[:-1], 0]
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            self.weights = self.weights - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)

    def prior(self, least: float = 0.3, error: float = 0.05, cells: int = 200) -> float:
        """The least ratio of the shares of unlabelled and positive rows above a threshold that ``least`` of the positives exceed, each
        share moved by what a sample of its size may err by (Dvoretzky, Kiefer and Wolfowitz)."""

        def of(places: np.ndarray, part: np.ndarray, logits: np.ndarray):
            cell = np.clip(((np.tanh(logits / 4) + 1) / 2 * cells).astype(np.int64), 0, cells - 1) + cells * (part == 2)
            n = np.bincount(cell, minlength=2 * cells)
            return np.flatnonzero(n), n[n > 0]

        found = self._sums(of)
        table = np.array([[found.get(i * cells + k, 0.0) for k in range(cells)] for i in range(2)])
        total = np.maximum(table.sum(axis=1, keepdims=True), 1)
        above, slack = np.cumsum(table[:, ::-1], axis=1) / total, np.sqrt(np.log(2 / error) / (2 * total[:, 0]))
        wide = above[1] >= least + slack[1]
        return float(np.clip(((above[0] + slack[0])[wide] / (above[1] - slack[1])[wide]).min(), 0.01, 0.99)) if wide.any() else 0.5


def fit(table: DataFrame, first_rounds: int = 12, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and the class prior."""
    trainer = Trainer(table)
    trainer.train(first_rounds, lambda losses, slopes: slopes[0] + slopes[2])
    prior = trainer.prior()
    trainer.weights = np.zeros_like(trainer.weights)

    def direction(losses: np.ndarray, slopes: np.ndarray) -> np.ndarray:
        negative = slopes[2] - prior * slopes[1]
        return prior * slopes[0] + negative if losses[2] - prior * losses[1] >= 0 else -negative

    trainer.train(rounds, direction)
    return trainer.weights, prior


def scored(table: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score of every row of a prepared table."""

    @F.pandas_udf("double")
    def score(bins: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-(weights[_places(pa.array(bins, pa.binary()))].sum(axis=1) + weights[-1]))))

    return table.select("doc_id", (F.col("part") == 0).alias("held_out"), score("bins").alias("score"))
