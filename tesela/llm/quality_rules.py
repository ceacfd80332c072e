"""Operator 9, quality rules with a log-likelihood ratio (DataFrame functions only).

Words and word pairs are hashed into a fixed number of buckets. Two multinomials over the buckets,
of a trusted target and of the raw corpus, give each bucket a log ratio; a text's score is the mean
ratio of its n-grams. The threshold is a stated quantile of the trusted texts' own scores, so it means
the same on any corpus. Plain counting rules come before it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, saved, small, text_of

BUCKETS = 1 << 14
#: Share of the trusted texts that may score below the threshold, and steps of a score in its histogram.
LOSS, STEPS = 0.001, 10_000

_SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """The words of a text, as an array."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def _after(array: Column, n: int) -> Column:
    """The array without its first ``n`` elements."""
    return F.slice(array, n + 1, F.greatest(F.size(array) - n, F.lit(0)))


def _chain(a: Column, b: Column) -> Column:
    """Hashes of a[i] with b[i], as far as both go."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.xxhash64(x, y))


def with_hashes(rows: DataFrame) -> DataFrame:
    """Adds h (a hash of each word) and h2 (of each word pair) to rows with words."""
    hashed = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    return hashed.withColumn("h2", _chain(F.col("h"), _after(F.col("h"), 1)))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _window_repeats() -> Column:
    """Words in windows of five words that occur twice or more in the text.

    Hashes of their first and last word pairs tell which texts have none; the windows themselves are
    compared after.
    """
    width = 5
    n = F.size("words") - (width - 1)
    starts = F.sequence(F.lit(1), n)
    hashes = _chain(F.col("h2"), _after(F.col("h2"), width - 2))
    texts = F.transform(starts, lambda i: F.struct(F.array_join(F.slice("words", i, width), " ").alias("w"), i.alias("i")))

    def repeated(sorted_: Column) -> Column:
        last = F.size(sorted_) - 1
        same = F.filter(sorted_, lambda x, k: ((k > 0) & (x["w"] == F.get(sorted_, F.greatest(k - 1, F.lit(0)))["w"])) | ((k < last) & (x["w"] == F.get(sorted_, F.least(k + 1, last))["w"])))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    # One-element arrays bind a value to a name, so that it is computed once.
    bound = F.transform(F.array(F.array_sort(texts)), lambda s: F.transform(F.array(repeated(s)), covered)[0])[0]
    some = (n > 1) & (F.size(F.array_distinct(hashes)) < n)
    return F.when(some, bound).otherwise(F.lit(0)).cast("long")


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """A log ratio for each bucket, from all n-grams of the corpus and of its trusted part."""
    ids = trusted.select(F.col(id_col).alias("id")).filter("id IS NOT NULL").distinct().withColumn("target", F.lit(1))
    # Texts meet the ids before they are split, so that a join by sort moves texts and no arrays.
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(small(ids, ids.count()), "id", "left")
    grams = with_hashes(rows.select("target", words_of(F.col("text")).alias("words"))).select("target", F.explode(F.concat("h", "h2")).alias("g")).select("target", _bucket(F.col("g")).alias("b"))
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("target").alias("target")).collect():  # BUCKETS rows at most
        raw[r.b] += r.raw
        target[r.b] += r.target
    if target.sum() == BUCKETS:  # no target, no preference
        return [0.0] * BUCKETS
    return (np.log(target / target.sum()) - np.log(raw / raw.sum())).tolist()


def threshold_of(scored: DataFrame, trusted: DataFrame, id_col: str, loss: float = LOSS) -> float:
    """The largest score, in steps of 1 / STEPS, that at most a share ``loss`` of the trusted rows that
    pass the base rules are below; without such rows nothing is.

    A histogram over the steps comes to the driver, not the scores.
    """
    ids = trusted.select(F.col(id_col).alias("id")).filter("id IS NOT NULL").distinct()
    own = scored.filter("NOT base_failed").select("id", F.floor(F.col("llr") * STEPS).alias("step")).join(small(ids, ids.count()), "id", "left_semi")
    steps = sorted((r.step, r["count"]) for r in own.groupBy("step").count().collect())
    left = loss * sum(n for _, n in steps)
    for step, n in steps:
        left -= n
        if left < 0:
            return step / STEPS
    return float("-inf")


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", loss: float = LOSS) -> DataFrame:
    """One row per row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, llr (mean log ratio of the n-grams), kept.

    base_failed: fewer than 10 words, or over a fifth of them in repeated 5-word windows. kept: not
    base_failed and llr not below the threshold, which a share ``loss`` of the trusted rows may be.
    ``trusted`` names the ids of the target; with none, every ratio is 0 and kept follows the base
    rules. A null text has no words and fails. Repeated
    rows count as often as they occur. An empty table gives no rows.
    """
    ratios = log_ratios(docs, trusted, id_col, text_col)
    table = F.lit(",".join(f"{x:.6g}" for x in ratios))
    table = F.split(table, ",").cast("array<double>")  # folded into one constant
    rows = with_hashes(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("words", words_of(F.col("text"))))
    letters = F.length(F.array_join("words", ""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    add = lambda acc, h: acc + F.get(table, _bucket(h))
    ratio = F.aggregate("h", F.lit(0.0), add) + F.aggregate("h2", F.lit(0.0), add)
    n = F.size("words")
    out = rows.select(
        "id", n.cast("long").alias("n_words"), letters.cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        _window_repeats().alias("n_repeat_words"), F.when(n > 0, ratio / F.greatest(2 * n - 1, F.lit(1))).otherwise(0.0).alias("llr"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = saved(out.withColumn("base_failed", failed))
    threshold = threshold_of(out, trusted, id_col, loss)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), F.round("llr", 6).alias("llr"))
