"""Fusion, recommendation, media windows, chunking, spelling and evaluation, over DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import running


def rrf(lists: list[tuple[DataFrame, float]], key: str, score: str = "score", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of short ranked lists: key, score, best rank."""
    parts = None
    for df, weight in lists:
        rank = F.row_number().over(Window.orderBy(F.desc(score), key))  # lists are cut to a top k before
        part = df.select(key, rank.alias("rank")).select(key, "rank", (F.lit(float(weight)) / (k + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.union(part)
    return parts.groupBy(key).agg(F.sum("part").alias("score"), F.min("rank").alias("best_rank"))


def minmax_fusion(signals: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of signals (signal, key, value), each scaled to 0..1; a constant signal is 1."""
    bounds = signals.groupBy("signal").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    scaled = F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")))
    weight = F.element_at(F.create_map(*[F.lit(x) for p in weights.items() for x in p]), F.col("signal"))
    return signals.join(bounds, "signal").groupBy(key).agg(F.sum(weight * scaled).alias("score"))


def fused_signals(signals: DataFrame, key: str, weights: dict[str, float], boosts: dict[str, float] | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """(key, score, signals) of a shop's fusion, best first, more signals before fewer, then by key.

    Signals of ``weights`` are scaled to 0..1 (a constant one is 1); the weight of those without any
    row (a cold start) is shared among the others by weight. Signals of ``boosts`` are absolute values
    of 0..1: they add to a key that has a scaled signal and bring none in. Keys of ``exclude`` go.
    """
    if exclude is not None:
        signals = signals.join(exclude.select(key), key, "left_anti")
    own = signals.filter(F.col("signal").isin(list(weights)))
    bounds = own.groupBy("signal").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()  # one row a signal
    there = sum(weights[r.signal] for r in bounds)
    score = F.lit(0.0)
    for r in bounds:
        scaled = F.lit(1.0) if r.high == r.low else (F.col("value") - F.lit(float(r.low))) / float(r.high - r.low)
        score = score + F.when(F.col("signal") == r.signal, scaled * (weights[r.signal] * sum(weights.values()) / there if there else 0.0)).otherwise(0.0)
    for name, weight in (boosts or {}).items():
        score = score + F.when(F.col("signal") == name, F.col("value") * weight).otherwise(0.0)
    scaled = F.count_if(F.col("signal").isin(list(weights)))
    out = signals.filter(F.col("signal").isin([*weights, *(boosts or {})])).groupBy(key).agg(F.sum(score).alias("score"), scaled.alias("signals"))
    return out.filter("signals > 0").orderBy(F.desc(F.round("score", 12)), F.desc("signals"), key)


def copurchase_for(pairs: DataFrame, owned: DataFrame, user: str, item: str) -> DataFrame:
    """(user, other, times, items): how often other items go with those that a user has, and with how
    many of these; items that the user has are left out."""
    own = owned.select(user, item).distinct()
    met = own.join(pairs.select(item, "other", "times"), item).groupBy(user, "other").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("items"))
    return met.join(own.select(user, F.col(item).alias("other")), [user, "other"], "left_anti")


def coverage(windows_: Column, one: Column, other: Column) -> Column:
    """Windows of a run as a share of the shorter of two recordings' windows, at most 1."""
    return F.least(F.lit(1.0), windows_ / F.greatest(F.least(one, other), F.lit(1)))


def copurchase(baskets: DataFrame, basket: str, item: str, support: int = 1, top: int | None = None) -> DataFrame:
    """(item, other, times): items of the same basket, both ways; at least ``support`` times."""
    pairs = baskets.select(basket, item).distinct()
    other = pairs.select(basket, F.col(item).alias("other"))
    counts = pairs.join(other, basket).filter(F.col(item) != F.col("other")).groupBy(item, "other").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") >= support)
    if top is None:
        return counts
    order = Window.partitionBy(item).orderBy(F.desc("times"), "other")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def add_copurchases(pairs: DataFrame, new: DataFrame, item: str) -> DataFrame:
    """Pair counts with those of new purchases added: a new snapshot."""
    return pairs.select(item, "other", "times").union(new.select(item, "other", "times")).groupBy(item, "other").agg(F.sum("times").alias("times"))


def leave_last_out(events: DataFrame, user: str, order: list[str]) -> DataFrame:
    """split: the last event of a user is test, the one before it valid, the others train."""
    n = F.row_number().over(Window.partitionBy(user).orderBy(*[F.desc(c) for c in order]))
    return events.withColumn("split", F.when(n == 1, "test").when(n == 2, "valid").otherwise("train"))


def history(events: DataFrame, user: str, item: str, ts: str) -> DataFrame:
    """Items of each user, newest first, each once: user, item, last, place."""
    last = events.groupBy(user, item).agg(F.max(ts).alias("last"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy(user).orderBy(F.desc("last"), item)))


def windows(df: DataFrame, duration: str, size: float, hop: float) -> DataFrame:
    """Start and end of the windows over a duration; a short one has one window."""
    n = F.greatest(F.floor((F.col(duration) - size) / hop) + 1, F.lit(1))
    starts = df.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return starts.withColumn("start", F.col("window") * hop).withColumn("end", F.least(F.col("window") * hop + size, F.col(duration).cast("double")))


def offset_votes(matches: DataFrame, by: list[str], there: str, here: str, hop: float) -> DataFrame:
    """Votes of matched windows for a song's time offset, in hops, neighbours counted in."""
    votes = matches.select(*by, F.round((F.col(there) - F.col(here)) / hop).cast("long").alias("offset"))
    near = votes.withColumn("offset", F.explode(F.array(F.col("offset") - 1, F.col("offset"), F.col("offset") + 1)))
    sums = near.groupBy(*by, "offset").agg(F.count(F.lit(1)).alias("votes"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("votes"), "offset"))).filter("place = 1").drop("place")


def run_score(windows_: Column, similarity: Column) -> Column:
    """min(1, w / 7) times the similarity above 0.85, clamped to 0..1."""
    return F.least(F.lit(1.0), windows_ / 7) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity - 0.85) / 0.15))


def weighted_sample(df: DataFrame, by: str, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """n rows of each group without replacement, by log(u) / w with u hashed from the key; a row
    needs a weight above 0."""
    df = df.filter(F.col(weight) > 0)
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)).cast("double") + 1) / float((1 << 40) + 1)
    order = Window.partitionBy(by).orderBy(F.desc(F.log(u) / F.col(weight)), key)
    return df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def citations(text: Column) -> Column:
    """Numbers of [n] and [1, 3] marks, in order."""
    inner = F.regexp_extract_all(text, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    return F.transform(F.flatten(F.transform(inner, lambda x: F.split(x, r"\s*,\s*"))), lambda x: x.cast("int"))


_SENTENCE = re.compile(r"[^.!?]+[.!?]*\s*")


def chunk_text(text: str, target: int = 120, overlap: int = 1) -> list[str]:
    """Whole sentences up to ``target`` words, the last ``overlap`` sentences repeated; a sentence
    that is longer is cut, and a short tail joins the chunk before it."""
    pieces = []
    for sentence in _SENTENCE.findall(text):
        words = sentence.split()
        pieces += [words[i : i + target] for i in range(0, len(words), target)]
    chunks, now = [], []
    for words in pieces:
        if now and sum(map(len, now)) + len(words) > target:
            chunks.append(now)
            back = now[-overlap:] if overlap and sum(map(len, now[-overlap:])) + len(words) <= target else []
            now = list(back)
        now.append(words)
    if now:
        if chunks and sum(map(len, now)) < target // 4:
            new = now[overlap:] if now[:overlap] == chunks[-1][-overlap:] else now
            chunks[-1] = chunks[-1] + new
        else:
            chunks.append(now)
    return [" ".join(w for part in c for w in part) for c in chunks]


def chunks(df: DataFrame, key: str, column: str, target: int = 120, overlap: int = 1) -> DataFrame:
    """(key, ordinal, words, content) of each text's chunks."""

    @F.pandas_udf("array<string>")
    def cut(texts):
        return texts.map(lambda t: chunk_text(t or "", target, overlap))

    each = df.select(key, F.posexplode(cut(F.col(column))).alias("ordinal", "content"))
    return each.select(key, "ordinal", F.size(F.split("content", " ")).alias("words"), "content")


def deletions(word: Column) -> Column:
    """The word and all forms with one character less."""
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), less))


def two_deletions(word: Column) -> Column:
    """The word and all forms with one or two characters less."""
    return F.array_distinct(F.flatten(F.transform(deletions(word), deletions)))


def osa(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1]


def spell(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, fix): of vocabulary (term, freq) words within distance 2 that share a deletion, the
    nearest, then the most frequent, then the first; a known word stays unless a neighbour is over
    50 times as frequent. A word of 6 letters or more that finds none takes the best within
    distance 2 of the same initial; two deletions of each side meet for all of these."""

    @F.pandas_udf("int")
    def far(a, b):
        return a.combine(b, osa)

    keys = vocabulary.select("term", "freq", F.explode(deletions(F.col("term"))).alias("form"))
    asked = words.select("word", F.explode(deletions(F.col("word"))).alias("form"))
    found = asked.join(keys, "form").select("word", "term", "freq").distinct().withColumn("d", far("word", "term")).filter("d <= 2")
    own = F.max(F.when(F.col("d") == 0, F.col("freq"))).over(Window.partitionBy("word"))
    found = found.withColumn("own", own).filter((F.col("own").isNull()) | (F.col("d") == 0) | (F.col("freq") > 50 * F.col("own")))
    first = F.row_number().over(Window.partitionBy("word").orderBy(F.when((F.col("d") == 0), 1).otherwise(0), "d", F.desc("freq"), "term"))
    best = found.withColumn("r", first).filter("r = 1").select("word", "term")
    distinct = words.select("word").distinct()
    left = distinct.filter(F.length("word") >= 6).join(best, "word", "left_anti")
    initial = lambda c: F.substring(c, 1, 1).alias("initial")
    asked = left.select("word", initial("word"), F.explode(two_deletions(F.col("word"))).alias("form"))
    keys = vocabulary.filter(F.length("term") >= 4).select("term", "freq", initial("term"), F.explode(two_deletions(F.col("term"))).alias("form"))
    further = asked.join(keys, ["initial", "form"]).select("word", "term", "freq").distinct().withColumn("d", far("word", "term")).filter("d <= 2")
    nearest = F.row_number().over(Window.partitionBy("word").orderBy("d", F.desc("freq"), "term"))
    best = best.union(further.withColumn("r", nearest).filter("r = 1").select("word", "term"))
    return distinct.join(best.withColumnRenamed("term", "fix"), "word", "left")


def ranking_metrics(ranked: DataFrame, user: str, hit: str, rank: str, k: int = 10) -> DataFrame:
    """hit_at_k, ndcg_at_k and mrr_at_k over users with one relevant item each."""
    inside = F.col(hit) & (F.col(rank) <= k)
    per = ranked.groupBy(user).agg(F.max(F.when(inside, 1.0).otherwise(0.0)).alias("h"), F.max(F.when(inside, 1 / F.log2(F.col(rank) + 1)).otherwise(0.0)).alias("g"), F.max(F.when(inside, F.lit(1.0) / F.col(rank)).otherwise(0.0)).alias("m"))
    return per.agg(F.avg("h").alias("hit_at_k"), F.avg("g").alias("ndcg_at_k"), F.avg("m").alias("mrr_at_k"))


def best_threshold(scores: DataFrame, score: str, truth: str) -> DataFrame:
    """Accuracy at each distinct score as a threshold, the best first, from running sums."""
    at = scores.groupBy(score).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    total = at.agg(F.sum("p"), F.sum("n")).first()
    sums = running(at, [F.desc(score)], {"tp": F.col("p"), "taken": F.col("n")}).select(score, "tp", "taken")
    right = F.col("tp") + (F.lit(total[1] - total[0]) - (F.col("taken") - F.col("tp")))
    return sums.withColumn("accuracy", right / total[1]).orderBy(F.desc("accuracy"), F.desc(score))
