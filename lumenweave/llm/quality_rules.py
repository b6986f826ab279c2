"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Every text gets counts. Labelled texts are halved by id. On the design half, each stratum (``lang``) gets cutoffs for each rule at
several quantiles of its good texts, kept where they reject more bad than good texts; all rules at one quantile are one candidate.
On the holdout half, a candidate is certified if an exact binomial test, at a level divided by the number of candidates tested
(Bonferroni over strata and quantiles), shows that it rejects at most ``risk`` of the stratum's good texts. Of the certified
candidates the most useful one is used; a stratum without any rejects by the base rule alone.

Defined cases: null, empty or wordless text has zero counts and fails the base rule; null ``lang`` is a stratum of its own, apart from that of an empty one; a document with
several labels has the least of them; null labels and labels without a document count for nothing; without labels nothing is certified, and without documents there are no
rows; repeated rows are judged each for itself, and where labelled count each; of equally useful candidates the one with the higher quantile is used; very long texts are
counted whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce
from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.llm.common import SPACE_RUN, SPACES, UPPER, id_crc, let, written

#: Each rule rejects texts above its cutoff.
RULES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
}
QUANTILES = (0.9, 0.95, 0.98, 0.99, 0.995, 0.998, 0.999, 1.0)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in windows of three found twice or more. Equal windows have equal hashes, so only texts with equal hashes compare the windows themselves."""

    def window(i: Column) -> list[Column]:
        return [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]

    places = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(*window(i)))
    ordered = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        def equal(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))

        found = F.filter(s, lambda x, k: equal(x, k - 1) | equal(x, k + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.when(n < 4, 0).when(F.size(F.array_distinct(hashes)) == n - 2, 0).otherwise(let(ordered, repeated))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts of every text."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE_RUN), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, SPACES) != "")
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w, F.size(w)).alias("r")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    bare = _without(text, SPACES)
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("stratum"), F.char_length(bare).alias("word_chars"), F.char_length(_without(bare, "#*$%&|<>")).alias("plain"), F.char_length(_without(bare, UPPER)).alias("small"), of_words.alias("w"), of_lines.alias("x"))
    return rows.select("doc_id", "stratum", *(c.cast("long").alias(name) for name, c in {"n_words": F.col("w.n"), "word_chars": F.col("word_chars"), "n_symbols": F.col("word_chars") - F.col("plain"), "n_dup_lines": F.col("x.d"), "n_repeat_words": F.col("w.r"), "n_lines": F.col("x.n"), "n_capitals": F.col("word_chars") - F.col("small")}.items()))


def _stirling_rest(m: Column) -> Column:
    """ln m! less Stirling's formula."""
    x = m.cast("double")
    series = 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    return F.when(m < 16, F.log(F.factorial(m)) - (x + 0.5) * F.log(x) + x - 0.5 * log(2 * pi)).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial. Terms are added from k away from the mean, where each is less than the one before: past twelve standard deviations they are below the last bit of
    the sum, so that the work grows with the root of n."""
    q = 1 - p
    x, y, size = k.cast("double"), (n - k).cast("double"), n.cast("double")
    apart = x * F.log(x / (size * p)) + y * F.log(y / (size * q))
    first = F.exp(_stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - apart + 0.5 * F.log(size / (2 * pi * x * y)))
    above = x > size * p
    terms = F.least(F.when(above, n - k).otherwise(k), F.ceil(12 * F.sqrt(size * p * q)) + 50)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        ratio = F.when(above, (y - i + 1) * p / ((x + i) * q)).otherwise((x - i + 1) * q / ((y + i) * p))
        return F.struct((acc["term"] * ratio).alias("term"), (acc["total"] + acc["term"] * ratio).alias("total"))

    others = F.aggregate(F.sequence(F.lit(1).cast("long"), terms.cast("long")), start, step, lambda acc: acc["total"])
    return F.when(k >= n, 1.0).when(k < 1, F.exp(size * log(q))).otherwise(F.when(above, 1 - first * others).otherwise(first * (1 + others)))


def certified(counts: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05, good_weight: float = 5.0) -> DataFrame:
    """stratum, certified quantile and the cutoff of each rule (null: the rule is off). One row a certified stratum."""
    quality = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    marked = counts.where("NOT base_failed").join(quality, "doc_id").select("doc_id", "stratum", "good", *RULES)
    marked = written(marked.withColumn("holdout", id_crc(F.col("doc_id")) % 2 == 1), "marked")
    levels = F.array(*map(F.lit, QUANTILES))
    design = marked.where("NOT holdout")
    cuts = design.where("good").groupBy("stratum").agg(*(F.percentile_approx(r, levels, 100_000).alias(r) for r in RULES))
    cuts = cuts.select("stratum", F.posexplode(F.arrays_zip(*RULES)).alias("level", "cut")).select("stratum", "level", *(F.col("cut")[r].alias(f"cut_{r}") for r in RULES))
    totals = [F.sum(F.col("good").cast("long")).alias("n_good"), F.sum((~F.col("good")).cast("long")).alias("n_bad")]

    def hits(fired: Column, name: str) -> list[Column]:
        return [F.sum((fired & F.col("good")).cast("long")).alias(f"good_{name}"), F.sum((fired & ~F.col("good")).cast("long")).alias(f"bad_{name}")]

    tried = design.join(cuts, "stratum").groupBy("stratum", "level").agg(*totals, *(h for r in RULES for h in hits(F.col(r) > F.col(f"cut_{r}"), r)))

    def useful(name: str) -> Column:
        return F.col(f"bad_{name}") / F.greatest("n_bad", F.lit(1)) - good_weight * F.col(f"good_{name}") / F.greatest("n_good", F.lit(1))

    candidates = cuts.join(tried, ["stratum", "level"]).select("stratum", "level", *(F.when(useful(r) > 0, F.col(f"cut_{r}")).alias(f"cut_{r}") for r in RULES))
    fired = reduce(lambda a, b: a | b, (F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False)) for r in RULES))
    tested = marked.where("holdout").join(candidates, "stratum").groupBy("stratum", "level", *(f"cut_{r}" for r in RULES)).agg(*totals, *hits(fired, "any"))
    tested = written(tested, "tested")
    level = error / max(1, tested.count())
    passed = tested.where(F.col("n_good") > 0).where(binomial_tail(F.col("good_any"), F.col("n_good"), risk) <= level).where(useful("any") > 0)
    best = passed.groupBy("stratum").agg(F.max_by(F.struct(F.col("level"), *(F.col(f"cut_{r}") for r in RULES)), F.struct(useful("any"), F.col("level"))).alias("best"))
    return best.select("stratum", "best.*")


def judged(docs: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept, and the certified quantile that judged it (null: none)."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = counted(docs).withColumn("base_failed", failed)
    for rule, share in RULES.items():
        counts = counts.withColumn(rule, F.expr(share).cast("double"))
    counts = written(counts, "counts")
    rules = certified(counts, labels, risk, error)
    if rules.limit(10_001).count() <= 10_000:  # a row a stratum: languages are few, but nothing bounds them
        rules = F.broadcast(rules)
    rejected = reduce(lambda a, b: a | b, (F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False)) for r in RULES))
    return counts.join(rules, "stratum", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), "stratum", F.col("level").alias("certified_level"))
