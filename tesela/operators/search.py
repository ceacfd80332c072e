"""Ranked full-text search: postings, BM25, TF-IDF cosine, and Boolean queries."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

# Apostrophes that join what is around them, the pattern of a term, its longest length.
_APOSTROPHES = dict.fromkeys(map(ord, "'’ʼ"))
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
_LONGEST = 40

#: Buckets of terms that the postings of a stored index are dealt to.
_BUCKETS = 64


@lru_cache(1 << 16)
def _bare(ch: str) -> str:
    """A character without its marks (category Mn); one that has none, or n with tilde, as it is."""
    parts = unicodedata.normalize("NFD", ch)
    kept = [c for c in parts if unicodedata.category(c) != "Mn"]
    return ch if ch == "ñ" or len(kept) == len(parts) else unicodedata.normalize("NFC", "".join(kept))


def fold(text: str) -> str:
    """Compatibility form, case folded, without apostrophes and diacritics (the one of n stays)."""
    text = text.casefold() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()
    text = text.translate(_APOSTROPHES)
    return text if text.isascii() else "".join(map(_bare, unicodedata.normalize("NFC", text)))


def analyse(text: str, stopwords: frozenset[str] = frozenset(), stem: Callable[[str], str] | None = None) -> list[str]:
    """Terms of a text: 1 to 40 characters; numbers skip stopwords and the stemmer."""
    terms = []
    for token in _TOKEN.findall(fold(text)):
        if len(token) > _LONGEST:
            continue
        if token[0].isdigit():
            terms.append(token.replace(",", "."))
        elif token not in stopwords:
            terms.append(stem(token) if stem else token)
    return terms


def analysed(column: Column, stopwords: frozenset[str] = frozenset(), stem=None) -> Column:
    """The terms of a text column, by an Arrow-batched function."""

    @F.pandas_udf("array<string>")
    def terms(texts):
        return texts.map(lambda t: None if t is None else analyse(t, stopwords, stem))

    return terms(column)


def ascii_terms(column: Column) -> Column:
    """A-Z words in lower case, all in the JVM; for texts and tests where that is enough."""
    return F.regexp_extract_all(F.lower(column), F.lit("[a-z]+"), F.lit(0))


@dataclass
class TextIndex:
    """Ranked search over the analysed terms of a text column.

    Rows with a null text are not indexed; a text without terms counts. A query makes one slim table
    (key, length, how often each of its terms occurs) by a map over the texts; corpus figures are one
    aggregation of it and scores are expressions over it, so nothing but the answer is shuffled.
    """

    rows: DataFrame  # key, terms
    key: str
    split: Callable[[str], list[str]]

    @classmethod
    def build(cls, df: DataFrame, key: str, column: str, terms: Callable[[Column], Column] = analysed, split=analyse) -> TextIndex:
        return cls(df.filter(F.col(column).isNotNull()).select(F.col(key).alias("key"), terms(F.col(column)).alias("terms")), key, split)

    @property
    def postings(self) -> DataFrame:
        """(key, term, tf) of every term."""
        return self.rows.select("key", F.explode("terms").alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))

    def _slim(self, terms: list[str], norms: bool = False, everything: bool = False) -> tuple[DataFrame, int, float, list[int]]:
        """The slim table, the number of texts, their mean length, and df of each term."""
        hits = self.rows.select("key", F.size("terms").alias("length"), F.filter("terms", lambda x: x.isin(terms)).alias("hits"), *([_norm().alias("norm")] if norms else []))
        times = lambda t: F.size(F.filter("hits", lambda x: x == t))
        tf = F.array(*[times(t) for t in terms]) if terms else F.array().cast("array<int>")
        slim = hits.withColumn("tf", tf).drop("hits")
        n, mean, *df = slim.agg(F.count(F.lit(1)), F.avg("length"), *[F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(terms))]).first()
        return slim, n, mean or 0.0, df

    def _bm25(self, slim, n, mean, df, terms, scored, k1: float = 1.2, b: float = 0.75) -> Column:
        length = F.col("length") / mean if mean else F.lit(1.0)
        total = F.lit(0.0)
        for i, t in enumerate(terms):
            if t in scored:
                idf, tf = math.log(1 + (n - df[i] + 0.5) / (df[i] + 0.5)), F.get("tf", F.lit(i))
                total = total + idf * (k1 + 1) * tf / (tf + k1 * (1 - b + b * length) + F.when(tf == 0, 1.0).otherwise(0.0))
        return total

    def _tf_idf(self, slim, n, mean, df, terms, scored) -> Column:
        weights = {t: (1 + math.log10(scored.count(t))) * math.log10(n / df[i]) for i, t in enumerate(terms) if t in scored and df[i]}
        size = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        total = F.lit(0.0)
        for i, t in enumerate(terms):
            if t in weights:
                tf = F.get("tf", F.lit(i))
                total = total + F.when(tf > 0, weights[t] / size * (1 + F.log10(F.greatest(tf, F.lit(1)).cast("double")))).otherwise(0.0)
        return F.when(F.col("norm") > 0, total / F.col("norm")).otherwise(0.0)

    def stored(self) -> StoredIndex:
        """The index written to the shared folder: texts are analysed once, for all queries."""
        rows = written(self.rows)
        tf = rows.select("key", F.explode("terms").alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
        norms = tf.groupBy("key").agg(F.sqrt(F.sum(F.pow(1 + F.log10(F.col("tf").cast("double")), 2))).alias("norm"))
        docs = written(rows.select("key", F.size("terms").alias("length")).join(norms, "key", "left").withColumn("norm", F.coalesce("norm", F.lit(0.0))))
        bucket = F.pmod(F.xxhash64("term"), F.lit(_BUCKETS)).cast("int")
        terms = written(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("bucket", bucket).repartitionByRange("term").sortWithinPartitions("term"))
        n, mean = docs.agg(F.count(F.lit(1)), F.avg("length")).first()
        listed = tf.join(docs, "key").withColumn("bucket", bucket)
        # By range, so that a very common term is dealt over many tasks and files.
        postings = written(listed.repartitionByRange("bucket", "term", "key").sortWithinPartitions("bucket", "term", "key"), "bucket")
        return StoredIndex(self.rows, self.key, self.split, docs, terms, postings, n, mean or 0.0)

    def bm25(self, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(key, score) of the texts with some term of a free query; repeated words count once."""
        return self._ranked(self.split(query), None, "BM25", {"k1": k1, "b": b})

    def tf_idf(self, query: str) -> DataFrame:
        """(key, score): cosine of (1 + log10 tf) document weights and tf-idf query weights."""
        return self._ranked(self.split(query), None, "TF_IDF", {})

    def match(self, query: str, method: str = "BM25", **options) -> DataFrame:
        """(key, score) of the texts that satisfy a free or Boolean query; its positive terms score."""
        if not re.search(r"\b(AND|OR|NOT)\b|[()]", query):
            return self._ranked(self.split(query), None, method.upper(), options)
        tree = parse_boolean(query, self.split)
        positive = positive_terms(tree)
        if not positive:
            raise ValueError("a query needs a term that is not negated")
        return self._ranked(positive, tree, method.upper(), options)

    def _ranked(self, scored: list[str], tree, method: str, options: dict) -> DataFrame:
        terms = list(dict.fromkeys([*scored, *all_terms(tree)]))
        everything = tree is not None and _true_of_none(tree)
        slim, n, mean, df = self._slim(terms, method == "TF_IDF", everything)
        score = (self._bm25 if method == "BM25" else self._tf_idf)(slim, n, mean, df, terms, scored, **options)
        has = {t: F.get("tf", F.lit(i)) > 0 for i, t in enumerate(terms)}
        holds = reduce(Column.__or__, [has[t] for t in terms], F.lit(False)) if tree is None else _holds(tree, has)
        return slim.filter(holds).select(F.col("key").alias(self.key), score.alias("score"))


@dataclass
class StoredIndex(TextIndex):
    """An index whose postings (term, key, tf, length, norm), by bucket of terms, are a table. A query
    reads the buckets of its terms, and all texts only if texts with none of them satisfy it."""

    docs: DataFrame
    terms: DataFrame
    listed: DataFrame
    n: int
    mean: float

    def _slim(self, terms: list[str], norms: bool = False, everything: bool = False) -> tuple[DataFrame, int, float, list[int]]:
        found = self.terms.filter(F.col("term").isin(terms)).collect() if terms else []
        known, buckets = {r.term: r.df for r in found}, sorted({r.bucket for r in found})
        times = [F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).cast("int") for t in terms]
        tf = F.array(*times) if terms else F.array().cast("array<int>")
        slim = self.listed.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).groupBy("key").agg(F.first("length").alias("length"), F.first("norm").alias("norm"), tf.alias("tf"))
        if everything:
            none = F.array(*[F.lit(0)] * len(terms)).cast("array<int>")
            slim = self.docs.join(slim.select("key", "tf"), "key", "left").withColumn("tf", F.coalesce("tf", none))
        return slim, self.n, self.mean, [known.get(t, 0) for t in terms]


def _norm() -> Column:
    """Length of the vector of (1 + log10 tf) of a text, over the runs of its sorted terms."""
    weight = lambda k: F.pow(1 + F.log10(k.cast("double")), 2)
    start = F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("k"), F.lit(0.0).alias("sum"))

    def step(acc, x):
        same = acc["term"].eqNullSafe(x)
        return F.struct(x.alias("term"), F.when(same, acc["k"] + 1).otherwise(1).alias("k"), F.when(same | (acc["k"] == 0), acc["sum"]).otherwise(acc["sum"] + weight(acc["k"])).alias("sum"))

    return F.aggregate(F.array_sort("terms"), start, step, lambda acc: F.sqrt(acc["sum"] + F.when(acc["k"] > 0, weight(F.greatest(acc["k"], F.lit(1)))).otherwise(0.0)))


# Boolean queries: ("term", t), ("and", a, b), ("or", a, b), ("not", a), or None for a word that the
# analyser drops.


def parse_boolean(query: str, split: Callable[[str], list[str]] = analyse):
    """NOT binds before AND before OR; operands side by side are OR; a word of several terms is AND."""
    tokens = re.findall(r"[()]|[^\s()]+", query)
    at = 0

    def join(op, a, b):
        return b if a is None else a if b is None else (op, a, b)

    def either():
        nonlocal at
        left = both()
        while at < len(tokens) and tokens[at] != ")":
            if tokens[at] == "OR":
                at += 1
            left = join("or", left, both())
        return left

    def both():
        nonlocal at
        left = unary()
        while at < len(tokens) and tokens[at] == "AND":
            at += 1
            left = join("and", left, unary())
        return left

    def unary():
        nonlocal at
        if at >= len(tokens) or tokens[at] in ("AND", "OR", ")"):
            raise ValueError("an operand is missing in the query")
        token = tokens[at]
        at += 1
        if token == "NOT":
            inner = unary()
            return None if inner is None else ("not", inner)
        if token == "(":
            inner = either()
            if at >= len(tokens):
                raise ValueError("a parenthesis is not closed in the query")
            at += 1
            return inner
        tree = None
        for term in split(token):
            tree = join("and", tree, ("term", term))
        return tree

    tree = either()
    if at < len(tokens):
        raise ValueError("unbalanced parenthesis in the query")
    return tree


def all_terms(tree) -> list[str]:
    return [] if tree is None else [tree[1]] if tree[0] == "term" else [t for part in tree[1:] for t in all_terms(part)]


def positive_terms(tree, sign: bool = True) -> list[str]:
    if tree is None:
        return []
    if tree[0] == "term":
        return [tree[1]] if sign else []
    return [t for part in tree[1:] for t in positive_terms(part, sign != (tree[0] == "not"))]


def _true_of_none(tree) -> bool:
    """Does a text with none of the terms satisfy the query?"""
    if tree[0] in ("term", "not"):
        return tree[0] == "not" and not _true_of_none(tree[1])
    return (all if tree[0] == "and" else any)(map(_true_of_none, tree[1:]))


def _holds(tree, has: dict[str, Column]) -> Column:
    if tree[0] == "term":
        return has[tree[1]]
    if tree[0] == "not":
        return ~_holds(tree[1], has)
    a, b = _holds(tree[1], has), _holds(tree[2], has)
    return a & b if tree[0] == "and" else a | b
