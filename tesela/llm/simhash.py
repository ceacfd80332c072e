"""Operator 7, SimHash near-dedup over vantage-point trees.

Bounded samples fit a vantage-point tree, level by level, until its leaves, the shards, are small. Each distinct fingerprint
has one home shard; it also visits the shards on the other side of a split that it is within the
radius of (triangle bound). Inside a shard, a dual-tree join splits both sides by distance to a
vantage point, prunes what the bound excludes, and compares the rest exactly, so no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, plain_names, saved, small, with_row_ids
from .components import connected_components, merge_labels

#: Fingerprints of a shard, as planned; of a sample that splits shards, about; of
#: each shard that it splits, at least.
SHARD, SAMPLE, EACH = 32_768, 65_536, 128
#: Neighbours that lead a crowded fingerprint; pairs that a task holds before it thins crowds.
LEADERS, HELD = 8, 1 << 22
_LEAF = 1 << 20


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the lower-cased word shingles; 0 if there is no word."""
    from functools import partial

    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return majority(np.fromiter(map(partial(xxh64_intdigest, seed=seed), shingles), np.uint64, n))


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes ``h``."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        counts += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int):
    def run(batches):
        for batch in batches:
            texts = byte_texts(batch.column(batch.schema.get_field_index("_text")))
            fp = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            rest = [i for i, c in enumerate(batch.schema.names) if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(fp)], names=[*(batch.schema.names[i] for i in rest), "fp"])

    return run


def distances(x: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ v).astype(np.int16)


def _split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int]:
    """A vantage point and a bound near the median, with the fewest points close to the bound."""
    look = points if len(points) <= 512 else points[rng.integers(0, len(points), 512)]
    best = (2.0, look[0], 32)
    for v in look[rng.integers(0, len(look), 12)]:
        d = np.sort(distances(look, v))
        for mu in {int(d[len(d) * q // 100]) for q in (35, 42, 50, 58, 65)}:
            inside = (d <= mu).mean()
            near = ((d > mu - radius) & (d <= mu + radius)).mean() + abs(inside - 0.5)
            if 0.05 < inside < 0.95 and near < best[0]:
                best = (near, v, mu)
    return best[1], best[2]


def fit_tree(sample: np.ndarray, leaves: int, radius: int, numbers: Iterator[int], seed: int = 7):
    """A nested (vantage, bound, inside, outside) with shard ``numbers`` at its leaves."""
    rng = np.random.default_rng(seed)

    def grow(points: np.ndarray, want: int):
        if want <= 1 or len(points) < 32:
            return next(numbers)
        v, mu = _split(points, radius, rng)
        d = distances(points, v)
        low = points[d <= mu]
        if not 0 < len(low) < len(points):
            return next(numbers)
        share = max(1, min(want - 1, round(want * len(low) / len(points))))
        return (v, mu, grow(low, share), grow(points[d > mu], want - share))

    return grow(sample, leaves)


def _route(tree, radius: int):
    """Rows (shard, fp, home), then what else a row has. Of two linked points that a split parts, the
    outer one visits."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            shards, whose, homes = [], [], []

            def walk(node, at, home):
                if not len(at):
                    return
                if not isinstance(node, tuple):
                    shards.append(np.full(len(at), node, np.int32))
                    whose.append(at)
                    homes.append(home)
                    return
                v, mu, low, high = node
                d = distances(fp[at], v)
                inside = d <= mu
                to_low = inside | (d <= mu + radius)
                to_high = ~inside | (~home & (d > mu - radius))
                walk(low, at[to_low], (home & inside)[to_low])
                walk(high, at[to_high], home[to_high])

            walk(tree, np.arange(len(fp)), np.ones(len(fp), bool))
            if shards:
                at = np.concatenate(whose)
                more = [c.take(pa.array(at)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shards)), pa.array(fp[at].view(np.int64)), pa.array(np.concatenate(homes)), *more], names=["shard", "fp", "home", *batch.schema.names[1:]])

    return run


def _blocks(x: np.ndarray, home: np.ndarray, radius: int, leaves: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (a, b) whose products hold all links among homes (a is b, or parts of them) and from
    visitors to homes, each link once; products of up to ``leaves`` leaves are not split."""
    rng = np.random.default_rng(11)
    todo = [(h := np.flatnonzero(home), h), (np.flatnonzero(~home), h)]
    while todo:
        a, b = todo.pop()
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) <= leaves * _LEAF or min(len(a), len(b)) < 64:
            yield a, b
            continue
        v, mu = _split(x[a if len(a) >= len(b) else b], radius, rng)
        if a is b:
            d = distances(x[a], v)
            low, high = a[d <= mu], a[d > mu]
            if not len(low) or not len(high):
                yield a, b
                continue
            todo += [(low, low), (high, high), (a[(d > mu) & (d <= mu + radius)], a[(d <= mu) & (d > mu - radius)])]
            continue
        if len(a) < len(b):  # the larger side is halved
            a, b = b, a
        da, db = distances(x[a], v), distances(x[b], v)
        low, high = da <= mu, da > mu
        if low.all() or high.all():
            yield a[low | high], b
            continue
        todo += [(a[low], b[db <= mu + radius]), (a[high], b[db > mu - radius])]


def _near(x: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the pairs of a block within the radius, some rows of it at a time."""
    step = max(1, _LEAF // max(1, len(b)))
    for i in range(0, len(a), step):
        r, c = np.nonzero(np.bitwise_count(x[a[i : i + step], None] ^ x[None, b]) <= radius)
        yield a[i + r], b[c]


def join_within(x: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """Labels (smallest index) of the sets that links among homes and from visitors to homes make."""
    label, kept, held = np.arange(len(x)), [], 0

    def flush():
        nonlocal held
        if kept:
            merge_labels(label, np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept]))
        kept.clear()
        held = 0

    for block in _blocks(x, home, radius):
        for r, c in _near(x, *block, radius):
            apart = label[r] != label[c]
            kept.append((r[apart], c[apart]))
            held += int(apart.sum())
            if held > 1 << 20:
                flush()
    flush()
    return label


def _leading(r: np.ndarray, c: np.ndarray, degree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leader, led): of each index in the pairs (r, c) its LEADERS neighbours of the highest degree."""
    u, v = np.concatenate([r, c]), np.concatenate([c, r])
    order = np.lexsort((v, -degree[v], u))
    u, v = u[order], v[order]
    first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]][: len(u)])
    place = np.arange(len(u)) - np.repeat(first, np.diff(np.r_[first, len(u)]))
    return v[place < LEADERS], u[place < LEADERS]


def pairs_within(x: np.ndarray, texts: np.ndarray, home: np.ndarray, radius: int, hot: int) -> tuple[np.ndarray, ...]:
    """(a, b, leader, led, crowded): the pairs (a, b) of distinct fingerprints within the radius, among
    homes and of visitors with homes, but for those of which both are ``crowded``, within the radius of
    over ``hot`` other ``texts``: of these each one's pairs with its leaders."""
    degree, hits, held, most = texts.astype(np.int64) - 1, [], 0, HELD

    def thinned():
        r, c = (np.concatenate([np.empty(0, np.int64), *(h[i] for h in hits)]) for i in (0, 1))
        both = (degree[r] > hot) & (degree[c] > hot)
        return r[~both], c[~both], *_leading(r[both], c[both], degree)

    for a, b in _blocks(x, home, radius, 16):  # at a wide radius splits exclude little
        for r, c in _near(x, a, b, radius):
            if a is b:
                once = r < c
                r, c = r[once], c[once]
            np.add.at(degree, r, texts[c])
            np.add.at(degree, c, texts[r])
            hits.append((r, c))
            held += len(r)
            if held > most:
                r, c, lead, led = thinned()
                ends = np.unique(np.stack([np.minimum(lead, led), np.maximum(lead, led)]), axis=1)
                hits[:] = [(r, c), (ends[0], ends[1])]
                held = len(r) + ends.shape[1]
                most = max(HELD, 2 * held)
    return *thinned(), np.flatnonzero(degree > hot)


def _links(radius: int):
    def run(table: pa.Table) -> pa.Table:
        x = table.column("fp").to_numpy().view(np.uint64)
        label = join_within(x, table.column("home").to_numpy(), radius)
        linked = np.flatnonzero(label != np.arange(len(x)))
        return pa.table({"a": x[linked].view(np.int64), "b": x[label[linked]].view(np.int64)})

    return run


def _pairs(radius: int, hot: int):
    def run(table: pa.Table) -> pa.Table:
        x = table.column("fp").to_numpy()
        a, b, lead, led, crowded = pairs_within(x.view(np.uint64), table.column("texts").to_numpy(), table.column("home").to_numpy(), radius, hot)
        whose = np.repeat([False, True], [len(a), len(lead) + len(crowded)])
        return pa.table({"a": x[np.concatenate([a, lead, crowded])], "b": x[np.concatenate([b, led, crowded])], "led": whose})

    return run


def _sampled(rows: DataFrame, n: int, most: int, by: str = "fp") -> DataFrame:
    """About ``most`` of ``n`` rows by a hash of ``by``, the same ones in each run."""
    return rows.filter(F.pmod(F.xxhash64(by), F.lit(1 << 30)) < max(1, min(1 << 30, (most << 30) // max(1, n))))


def _with_leaves(node, new: dict):
    """The tree with some leaves (shard numbers) replaced by trees."""
    if not isinstance(node, tuple):
        return new.get(node, node)
    v, mu, low, high = node
    return v, mu, _with_leaves(low, new), _with_leaves(high, new)


def grown_tree(distinct: DataFrame, n: int, radius: int):
    """A tree whose shards are homes of about SHARD of the ``n`` fingerprints.

    Level by level, each shard that holds over twice as many is split by a sample of its own, until
    all fit or no vantage point parts them. What comes to the driver at a time is a sample of SAMPLE
    fingerprints, shared by the shards that are split, and one count a shard.
    """
    if n <= SHARD:
        return 0
    numbers = count()
    sample = _sampled(distinct, n, SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    tree, whole = fit_tree(np.sort(sample).view(np.uint64), -(-n // SHARD), radius, numbers), set()
    while True:
        homes = distinct.select("fp").mapInArrow(_route(tree, radius), "shard int, fp long, home boolean").filter("home")
        sizes = {r.shard: r.n for r in homes.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        large = [k for k, size in sorted(sizes.items()) if size > 2 * SHARD and k not in whole]
        if not large:
            return tree
        large = large[: max(1, SAMPLE // EACH)]  # the others in the next turns
        over = homes.join(small(distinct.sparkSession.createDataFrame([(k,) for k in large], "shard int"), len(large)), "shard")
        rows, new = _sampled(over, sum(sizes[k] for k in large), SAMPLE).toPandas(), {}
        for k in large:
            points = np.sort(rows.loc[rows["shard"] == k, "fp"].to_numpy(np.int64)).view(np.uint64)
            new[k] = fit_tree(points, -(-sizes[k] // SHARD), radius, numbers)
            if not isinstance(new[k], tuple):  # too few or too close to be parted
                whole.add(new[k])
        tree = _with_leaves(tree, new)


def link_fingerprints(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints (one column, fp) that span each linked set."""
    tree = grown_tree(distinct, distinct.count(), radius)
    routed = distinct.select("fp").mapInArrow(_route(tree, radius), "shard int, fp long, home boolean")
    return routed.groupBy("shard").applyInArrow(_links(radius), "a long, b long")


def close_fingerprints(distinct: DataFrame, radius: int, hot: int) -> DataFrame:
    """Pairs (a, b, led) of distinct fingerprints (fp, texts: how many texts have it) within the radius.

    A fingerprint that is so close to over ``hot`` other texts, its own among them, is crowded: it has
    a row with itself. Pairs of two crowded ones are given only where a leads b. All other pairs are
    there: a wide radius visits most shards, so that comparisons grow with the square of the rows.
    """
    tree = grown_tree(distinct, distinct.count(), radius)
    routed = distinct.select("fp", F.col("texts").cast("long")).mapInArrow(_route(tree, radius), "shard int, fp long, home boolean, texts long")
    return routed.groupBy("shard").applyInArrow(_pairs(radius, hot), "a long, b long, led boolean")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: rid, id, fp (the 64 bits as a long), component_id, and, with
    ``carry``, the text and those columns.

    Words are lower-cased (A-Z); a text with fewer words than ``width`` is one shingle, one without
    words has fingerprint 0 and links like any other; null is empty. Rows with ``radius`` or fewer
    differing bits link; component_id is the smallest id that links lead to (null if all ids are).
    Repeated rows and ties stay as rows. An empty table gives an empty result.
    """
    with_text, carry = carry is not None, [c for c in carry or [] if c not in (id_col, text_col)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    if with_text:  # texts stay with their rows for the caller
        rows = rows.withColumn("_raw", F.col("_text"))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"]
    prints = with_row_ids(rows.mapInArrow(_fingerprints(width), ", ".join([*types, "fp long"])))
    distinct = saved(prints.groupBy("fp").agg(F.min("id").alias("low")))
    labels = connected_components(link_fingerprints(distinct, radius))
    linked = labels.join(distinct.withColumnRenamed("fp", "node"), "node")
    lowest = linked.groupBy("label").agg(F.min("low").alias("least"))
    moved = linked.join(lowest, "label").select(F.col("node").alias("fp"), "least")
    reps = saved(distinct.join(moved, "fp", "left").select("fp", F.when(F.col("least").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id")))
    out = prints.join(reps, "fp")
    return out.select("rid", F.col("id").alias(id_col), "fp", "component_id", *([F.col("_raw").alias(text_col)] if with_text else []), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without those that link, directly or through others, to a kept row.

    Of each group the row with the smallest id stays, of several with that id one of them.
    """
    columns, docs = docs.columns, plain_names(docs)
    groups = simhash_groups(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text")], **how)
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid"))
    # By fingerprint first: a component may hold a third of all rows.
    keep = groups.groupBy("component_id", "fp").agg(lead.alias("r")).groupBy("component_id").agg(F.min("r").alias("r")).select(F.col("r.rid").alias("rid"))
    return groups.join(keep, "rid", "left_semi").select(*docs.columns).toDF(*columns)
