"""Operator 2, language-model scores.

A log-bilinear model over word types (the most frequent words, and hash classes of the rest) is
trained in numpy with noise-contrastive estimation on the pair counts of the whole training corpus:
the loss takes each observed pair with its count, and the noise samples with their expectation. Types
and classes grow with the cube root of the training tokens, and the pairs that are gathered with its
square; nothing that the corpus yields (word counts, pair counts, the counts that rare words look up) is
capped. Training takes contexts in blocks of a fixed size, so that memory does not grow with the
square of the types. Batched matrix products give each type after each type its normalised
log-probability; a word of a class has its smoothed share of the class.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, remainder, saved

#: Frequent words whose counts are broadcast (a fixed bound; counts of other words are joined; types
#: beyond it come along), dimensions of a vector, training steps on one block of contexts, contexts of
#: a block times types, cells of a dense table of pairs in a task, or of pairs held on the driver.
FREQUENT, DIM, STEPS, BLOCK_CELLS, DENSE_CELLS = 65_536, 32, 240, 1 << 20, 1 << 22
END = b""


@dataclass(frozen=True)
class Sizes:
    """Word types with a vector of their own, and hash classes for other words."""

    types: int
    classes: int

    @property
    def all(self) -> int:
        return self.types + self.classes

    @classmethod
    def of(cls, n_train: int) -> Sizes:
        """Twice the cube root of the training tokens, as a power of two from 512, and an eighth of it."""
        types = 1 << max(9, int(np.log2(max(1, n_train)) / 3 + 1))
        return cls(types, types // 8)


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def _count_words(batches):
    def rows(c: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "c"])

    c: Counter = Counter()
    for batch in batches:
        texts = byte_texts(batch.column(0))
        for t in texts:
            c.update(tokens(t))
            if len(c) > 300_000:
                yield rows(c)
                c = Counter()
        c[END] += len(texts)
    if c:
        yield rows(c)


class _Types(dict):
    """Type of each word; frequent ones are stored, others fall to a hash class."""

    def __init__(self, frequent: list[tuple[bytes, int]], sizes: Sizes):
        self.sizes = sizes
        super().__init__((w, i) for i, (w, _) in enumerate(frequent[: sizes.types]))
        self.update((w, self[w]) for w, _ in frequent[sizes.types :])

    def __missing__(self, word: bytes) -> int:
        return self.sizes.types + zlib.crc32(word) % self.sizes.classes


def _count_pairs(frequent: list[tuple[bytes, int]], sizes: Sizes):
    """Counts of pairs of types: in a dense table while that is small, else sorted in turns."""

    def rows(pairs, n):
        for i in range(0, len(pairs), 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + (1 << 20)]), pa.array(n[i : i + (1 << 20)])], names=["pair", "n"])

    def run(batches):
        size, kinds = sizes.all, _Types(frequent, sizes)
        end = kinds[END]
        total, held, waiting = np.zeros(size * size if size * size <= DENSE_CELLS else 0, np.int64), [], 0
        for batch in batches:
            for t in byte_texts(batch.column(0)):
                seq = np.fromiter(map(kinds.__getitem__, [END, *tokens(t), END]), np.int64)
                seq[0] = seq[-1] = end
                pairs = seq[:-1] * size + seq[1:]
                if not len(total):
                    held.append(pairs)
                    waiting += len(pairs)
                    if waiting > DENSE_CELLS:
                        yield from rows(*np.unique(np.concatenate(held), return_counts=True))
                        held, waiting = [], 0
                elif len(pairs) > 4096:
                    total += np.bincount(pairs, minlength=size * size)
                else:
                    np.add.at(total, pairs, 1)
        at = np.flatnonzero(total)
        yield from rows(at, total[at])
        if held:
            yield from rows(*np.unique(np.concatenate(held), return_counts=True))

    return run


@dataclass
class Model:
    """Vectors of the types: log10 P(b after a) is left[a] . right[b] + bias[b] - norm[a]."""

    left: np.ndarray
    right: np.ndarray
    bias: np.ndarray
    norm: np.ndarray

    def log10(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a))
        for i in range(0, len(a), 1 << 16):
            x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
            out[i : i + (1 << 16)] = np.einsum("ij,ij->i", self.left[x], self.right[y]) + self.bias[y] - self.norm[x]
        return out


def block_rows(size: int) -> int:
    """Contexts of a block."""
    return max(1, min(size, BLOCK_CELLS // size))


def train(marginals: tuple[np.ndarray, np.ndarray], block: Callable[[int], np.ndarray], dim: int = DIM, noise: int = 8, rate: float = 0.05, seed: int = 5) -> Model:
    """A model from pair counts. ``marginals``: how often each type is a context, and follows one;
    ``block(k)``: the counts of the k-th block of contexts, by all types.

    Score of b after a: (R[a] C) . R[b] + bias[b]. NCE with ``noise`` unigram samples a token, in
    expectation over the samples; Adam, a block a step, in the order of a seeded shuffle.
    """
    as_context, follows = marginals
    size, n = len(follows), max(1.0, follows.sum())
    high = block_rows(size)
    blocks = -(-size // high)
    rng = np.random.default_rng(seed)
    q = ((follows + 1.0) / (n + size)).astype(np.float32)
    params = [rng.normal(0, 0.1, (size, dim)).astype(np.float32), np.eye(dim, dtype=np.float32) * 0.1 + rng.normal(0, 0.02, (dim, dim)).astype(np.float32), np.log(q)]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    shift, steps = np.log(noise * q), STEPS * max(1, round(blocks**0.5))
    order: list[int] = []
    for step in range(1, steps + 1):
        order = order or rng.permutation(blocks).tolist()
        k = order.pop()
        own = slice(k * high, min(size, (k + 1) * high))
        # Of all pairs, as if the block were the corpus in their stead.
        data = (block(k) * (blocks / n)).astype(np.float32)
        noisy = (noise * blocks / n) * as_context[own, None].astype(np.float32) * q
        r, c, bias = params
        rc = r[own] @ c
        delta = np.clip(rc @ r.T + bias - shift, -30, 30)
        s = 1 / (1 + np.exp(-delta))
        g = noisy * s - data * (1 - s)
        gr = g @ r
        to_r = g.T @ rc
        to_r[own] += gr @ c.T
        grads = [to_r, r[own].T @ gr, g.sum(axis=0)]
        now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for p, d, (m, v) in zip(params, grads, state):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    r, c, bias = (p.astype(np.float64) for p in params)
    left, norm = r @ c, np.zeros(size)
    for k in range(blocks):
        own = slice(k * high, min(size, (k + 1) * high))
        s = left[own] @ r.T + bias
        top = s.max(axis=1)
        norm[own] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
    ten = np.log(10)
    return Model(left / ten, r, bias / ten, norm / ten)


def fitted(pairs: DataFrame, sizes: Sizes) -> Model:
    """A model from a saved table (block, pair, n). Blocks of a small table come to the driver once,
    those of a larger one a block at a time, whenever a step takes it."""
    size, high = sizes.all, block_rows(sizes.all)
    as_context, follows = np.zeros(size), np.zeros(size)
    for column, into in ((F.floor(F.col("pair") / size), as_context), (F.pmod("pair", F.lit(size)), follows)):
        for r in pairs.groupBy(column.cast("int").alias("t")).agg(F.sum("n").alias("n")).collect():
            into[r.t] = r.n

    def dense(at: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros((min(size, (k + 1) * high) - k * high, size), np.float32)
        out.ravel()[at - k * high * size] = n
        return out

    if size * size <= DENSE_CELLS:
        rows = pairs.toPandas().sort_values("pair")
        at, n = rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(float)
        cuts = np.searchsorted(at, np.arange(0, size * size + high * size, high * size))
        return train((as_context, follows), lambda k: dense(at[cuts[k] : cuts[k + 1]], n[cuts[k] : cuts[k + 1]], k))

    def read(k: int) -> np.ndarray:
        rows = pairs.filter(F.col("block") == k).toPandas()
        return dense(rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(float), k)

    return train((as_context, follows), read)


def _score(frequent: list[tuple[bytes, int]], sizes: Sizes, model: Model, class_log: np.ndarray, n_train: int, v_train: int):
    """Sums over what is broadcast; words beyond it are listed with their counts in the text."""

    def run(batches):
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 40
        kinds = _Types(frequent, sizes)
        end = kinds[END]
        gain = {w: np.log10(c + 1) for w, c in frequent}
        known = {w for w, c in frequent if c}
        denominator = np.log10(n_train + v_train + 1)
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            words, rares, seqs = [], [], []
            for t in byte_texts(batch.column(2)):
                ws = tokens(t)
                ws.append(END)
                seq = np.fromiter(map(kinds.__getitem__, ws), np.int64, len(ws))
                seq[-1] = end
                seqs.append(seq)
                c = Counter(ws)
                rare = [(w, k) for w, k in c.items() if w not in known]
                base = sum(gain[w] * k for w, k in c.items() if w in known)
                shares = sum(gain[w] * k for w, k in c.items() if w in known and kinds[w] >= sizes.types)
                for column, x in zip(out, (rid, len(ws) - sum(k for _, k in rare), base - denominator * len(ws), shares)):
                    column.append(x)
                words += rare
                rares.append(len(rare))
                rid += 1
            each = np.array([len(s) for s in seqs], np.int64)
            all_ = np.concatenate([*seqs, np.zeros(0, np.int64)])
            before = np.roll(all_, 1)
            before[np.cumsum(each) - each] = end
            logs = model.log10(before, all_)
            is_class = all_ >= sizes.types
            logs[is_class] -= class_log[all_[is_class] - sizes.types]
            sums = np.add.reduceat(logs, np.cumsum(each) - each) if len(each) else np.zeros(0)  # a text has its end token
            struct = pa.StructArray.from_arrays([pa.array([w for w, _ in words], pa.binary()), pa.array([k for _, k in words], pa.int64())], names=["word", "k"])
            rare_list = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rares)]), pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(each), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(sums + np.array(out[3])), rare_list], names=["id", "held_out", "rid", "n_tokens", "n_known", "base", "model", "rare"])

    return run


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The end token and the most frequent words, at most ``most``, by falling count.

    A histogram of rounded logarithms of counts finds how far down they fit, so that what comes to
    the driver has the same bound however many words and partitions there are.
    """
    level = F.floor(F.log2("c") * 8)
    words = counts.filter(F.length("word") > 0)
    room, lowest = most, None
    for r in sorted(words.groupBy(level.alias("l")).count().collect(), key=lambda r: -r.l):
        room -= r["count"]
        if room < 0:
            break
        lowest = r.l
    found = [] if lowest is None else [(bytes(r.word), r.c) for r in words.filter(level >= lowest).collect()]
    ends = counts.filter(F.length("word") == 0).agg(F.sum("c")).first()[0] or 0
    return [(END, ends), *sorted(found, key=lambda x: (-x[1], x[0]))]


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 2, folds: int = 7) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(id as text) mod ``folds`` is ``fold`` are held out. A null text is empty, and an
    empty text is one end token; a null id counts as the empty text in the fold. Scores are log10
    probabilities of the text. If every row is held out, no word is known and the model is uniform
    over types. Repeated rows are scored as often as they occur. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), (remainder(id_col, folds) == fold).alias("held_out"), F.col(text_col).alias("text"))
    training = rows.filter(~F.col("held_out")).select("text")
    counts = saved(training.mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    n_train, v_train = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    sizes = Sizes.of(n_train)
    frequent = frequent_words(counts, max(FREQUENT, sizes.types))
    size = np.zeros(sizes.classes)
    for r in counts.groupBy((F.crc32("word") % sizes.classes).cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        size[r.k] = r.c + r.v
    for w, c in frequent[: sizes.types]:
        size[zlib.crc32(w) % sizes.classes] -= (c + 1) * (c > 0)
    found = training.mapInArrow(_count_pairs(frequent, sizes), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = saved(found.withColumn("block", F.floor(F.col("pair") / (sizes.all * block_rows(sizes.all))).cast("int")).select("block", "pair", "n"))
    model = fitted(pairs, sizes)
    scored = saved(rows.mapInArrow(_score(frequent, sizes, model, np.log10(size + 1), n_train, v_train), "id " + docs.schema[id_col].dataType.simpleString() + ", held_out boolean, rid long, n_tokens long, n_known long, base double, model double, rare array<struct<word:binary,k:bigint>>"))
    rare = scored.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.k").join(counts, "word")  # unknown words add log10(0 + 1)
    sums = rare.groupBy("rid").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more"), F.sum("k").alias("more_known"))
    zero = F.coalesce("more", F.lit(0.0))
    return scored.drop("rare").join(sums, "rid", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + zero).alias("base_score"), (F.col("model") + zero).alias("score"),
    )
