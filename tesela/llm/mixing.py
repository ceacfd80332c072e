"""Operator 10, mixing sources to target weights.

Within a source, words are packed into blocks of a fixed length. Each output shard draws how many
of its slots each source gets from a multinomial; a slot's number within its source goes through a
pseudorandom permutation of the source's block numbers, and slots meet blocks by that number. A
source whose target is beyond its size is gone through again under another permutation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import local_table, saved, small, tidy, with_row_ids, word_count
from .sentencepiece_codec import mix64

#: Words of a block; documents of a packing chunk, about; output shards at least; slots of a shard at
#: most; chunks of a source whose blocks are added up in one task.
BLOCK, CHUNK, SHARDS, SHARD_SLOTS, SPAN = 256, 1024, 64, 1 << 18, 4096


def targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess shared again."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if unit * weights[i] >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
            open_.remove(i)
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0 .. size-1 at ``index``: a four-round Feistel network, walked."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2)) / 2))).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (mix64(right ^ mix64(k + np.uint64(r))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def draw(slots: np.ndarray, most: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard (shards x sources).

    A shard's counts are the whole part of its expectation and a multinomial draw for the rest, so
    that a source's total stays near ``slots``; no total is above ``most``.
    """
    rng, total = np.random.default_rng(seed), int(slots.sum())
    out = np.zeros((shards, len(slots)), np.int64)
    if not total:
        return out
    used = np.zeros(len(slots), np.int64)
    for s in range(shards):
        size = total * (s + 1) // shards - total * s // shards
        rest = np.maximum(slots - used, 0)
        expected = size * rest / max(1, rest.sum())
        whole = np.floor(expected).astype(np.int64)
        part = expected - whole
        more = size - int(whole.sum())
        if more > 0 and part.sum() > 0:
            whole = whole + rng.multinomial(more, part / part.sum())
        out[s] = np.minimum(whole, most - used)
        used += out[s]
    return out


def _slot_rows(cumulative: np.ndarray, blocks: np.ndarray, by_shard: np.ndarray, seed: int):
    """Slot numbers to (slot, shard, source, block)."""

    def run(batches):
        for batch in batches:
            slot = batch.column(0).to_numpy()
            source = np.searchsorted(cumulative, slot, side="right") - 1
            j = slot - cumulative[source]
            n = blocks[source]
            key = mix64(source.astype(np.uint64) * np.uint64(2) + (j // n).astype(np.uint64)) ^ np.uint64(seed)
            shard = np.zeros(len(slot), np.int32)
            for s in np.unique(source):
                shard[source == s] = np.searchsorted(by_shard[:, s], j[source == s], side="right")
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(shard), pa.array(source.astype(np.int32)), pa.array(permuted(j % n, n, key))], names=["slot", "shard", "sid", "block"])

    return run


class Mix:
    """The plan of a mixture. ``docs``: rid, id, size, sid and source facts of each row;
    ``pieces``: rid, sid, block, and the words [start, stop) of the row in it; ``slots``: slot,
    shard, sid, block. The recipe has one entry a source and lives on the driver, as weights do.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3, 1, 2), share: float = 1.5, seed: int = 10, carry: bool = False):
        spark = docs.sparkSession
        rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), *([F.struct(*docs.columns).alias("row")] if carry else []))
        self.rows = with_row_ids(rows)
        facts = self.rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        facts.sort(key=lambda r: (r.source is None, r.source or ""))
        sizes = [int(r["size"]) for r in facts]
        self.targets = targets(sizes, [weights[i % len(weights)] for i in range(len(facts))], share * sum(sizes))
        table = local_table(spark, {"sid": pa.array(range(len(facts)), pa.int32()), "name": pa.array([r.source for r in facts], pa.string()), "source_size": pa.array(sizes, pa.int64()), "target": pa.array(self.targets, pa.float64())})
        known = self.rows.join(small(table, len(facts)), F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
        self.docs = known
        slim = known.filter("size > 0").select("rid", "id", "sid", "size")
        chunks = max(1, sum(r.n for r in facts) // CHUNK)
        dealt = slim.withColumn("h", F.xxhash64("id", F.lit(seed))).withColumn("chunk", F.pmod("h", F.lit(chunks)).cast("int"))
        along = Window.partitionBy("sid", "chunk").orderBy("h", "id", "rid").rowsBetween(Window.unboundedPreceding, -1)
        packed = dealt.withColumn("at", F.coalesce(F.sum("size").over(along), F.lit(0)))
        totals = packed.groupBy("sid", "chunk").agg(F.ceil(F.max(F.col("at") + F.col("size")) / BLOCK).alias("blocks"))
        # Running sums over chunks, and over spans of chunks, so that a source's chunks are many tasks.
        ahead = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumn("span", F.floor(F.col("chunk") / SPAN).cast("int"))
        spans = totals.groupBy("sid", "span").agg(F.sum("blocks").alias("all"))
        spans = spans.withColumn("first", F.coalesce(F.sum("all").over(ahead("sid", "span")), F.lit(0))).drop("all")
        bases = totals.withColumn("base", F.coalesce(F.sum("blocks").over(ahead("sid", "span", "chunk")), F.lit(0))).join(spans, ["sid", "span"])
        bases = bases.withColumn("base", F.col("base") + F.col("first")).drop("first", "span")
        spread = packed.join(bases.drop("blocks"), ["sid", "chunk"]).withColumn("k", F.explode(F.sequence(F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("size") - 1) / BLOCK))))
        self.pieces = saved(spread.select("rid", "sid", (F.col("base") + F.col("k")).alias("block"), F.greatest(F.col("k") * BLOCK - F.col("at"), F.lit(0)).alias("start"), F.least((F.col("k") + 1) * BLOCK - F.col("at"), F.col("size")).alias("stop")))
        blocks = np.zeros(len(facts), np.int64)
        for r in totals.groupBy("sid").agg(F.sum("blocks").alias("n")).collect():
            blocks[r.sid] = r.n
        mean = np.array(sizes) / np.maximum(blocks, 1)
        slots = np.minimum(np.rint(np.array(self.targets) / np.maximum(mean, 1e-9)).astype(np.int64), 2 * blocks) if len(facts) else np.zeros(0, np.int64)
        by_shard = draw(slots, 2 * blocks, max(SHARDS, -(-int(slots.sum()) // SHARD_SLOTS)), seed)
        cumulative = np.concatenate([[0], np.cumsum(by_shard.sum(axis=0))])
        self.slots = spark.range(0, int(cumulative[-1])).mapInArrow(_slot_rows(cumulative, np.maximum(blocks, 1), np.cumsum(by_shard, axis=0), seed), "slot long, shard int, sid int, block long")

    def uses(self) -> DataFrame:
        """(sid, block, uses) of blocks that some slot takes; 2 at most."""
        return self.slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("uses"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken.

    Sources are in code-point order, null last; their weights repeat. A null or empty text has size
    0 and nothing is taken from it. taken counts repeats, and is at most twice the size. Repeated
    rows are packed as often as they occur. The same table gives the same mix. An empty table gives
    no rows.
    """
    mix = Mix(docs, id_col, text_col, source_col, **how)
    taken = mix.pieces.join(mix.uses(), ["sid", "block"]).groupBy("rid").agg(F.sum((F.col("stop") - F.col("start")) * F.col("uses")).alias("taken"))
    return mix.docs.join(taken, "rid", "left").select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixture as rows with the columns of ``docs``: of each text the words that the mix takes.

    A text's words in blocks that two slots take come in a second row. Where all words of a text are
    taken, the row has its exact text, else the taken words with one space between them; n_chars is
    that text's length. Null and empty texts have no words and are not in the mixture; a null source
    is a source, the last; repeated rows are packed as often as they occur; other columns may have any
    name. An empty table gives no rows.
    """
    mix = Mix(docs, carry=True, **how)
    parts = mix.pieces.join(mix.uses(), ["sid", "block"]).withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))))
    spans = parts.groupBy("rid", "turn").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))  # of one text
    spans = spans.groupBy("rid").agg(F.collect_list("spans").alias("turns"))
    joined = mix.rows.join(spans, "rid").select("row.*", F.col("size").alias("_size"), F.col("turns").alias("_turns"))
    schema, columns = docs.schema, docs.columns
    text_at, chars_at = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def cut(batches):
        for batch in batches:
            whose, texts = [], []
            for i, (text, size, turns) in enumerate(zip(batch.column(text_at).to_pylist(), batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist())):
                words = None
                for spans in turns:
                    if sum(s["stop"] - s["start"] for s in spans) < size:
                        words = text.encode().split() if words is None else words
                        taken = b" ".join([w for s in spans for w in words[s["start"] : s["stop"]]]).decode()
                    else:
                        taken = text
                    whose.append(i)
                    texts.append(taken)
            at = pa.array(whose, pa.int64())
            out = [batch.column(k).take(at) for k in range(len(columns))]
            out[text_at] = pa.array(texts, pa.string())
            if chars_at is not None:
                out[chars_at] = pa.array([len(t) for t in texts]).cast(out[chars_at].type)
            yield pa.RecordBatch.from_arrays(out, names=columns)

    return joined.mapInArrow(tidy(cut), schema)
