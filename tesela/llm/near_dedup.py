"""Near dedup of the pipeline: SimHash over a vantage-point tree, decided on whole sets of shingles.

Operator 7's tree, asked for a wide radius, pairs texts whose fingerprints (of the set of 5-word
shingles) are within RADIUS bits; the Jaccard similarity of their whole sets decides. Texts at a
similarity of 0.8 differ in 9.7 of 64 bits on average, and in more than RADIUS with a chance of some
hundredths. No radius holds all of them, so an exact way follows for the rest: pairs farther apart, and
those inside crowds, where the tree compares each text with leaders only. It asks for no pair that the
tree has decided.

The way for the rest: the smallest hashes of a text's shingles are its sketch. Two similar texts share at least so many
hashes of their sketches, so they meet in one of the rarest hashes of each (a prefix by rarity);
texts that meet are candidates if their sketches share enough, and the full shingle sets of each
candidate pair are compared. Sketches only propose: a pair at the stated similarity is not proposed
with a chance of under MISS, and short texts, whose sketch is their whole set, are always proposed.
A hash in which very many texts meet does not pair them all. A few of them, its leaders, are compared
with each: in a group of near copies most link to the text that has most of what is common. The texts
of such crowds then meet once more, by the rarest of all their shingles, where a text that no leader
links is told by shingles of its own; only those apart from a hash's largest linked set ask, and
places in the sets bound what two texts can share.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, own_tables, plain_names, saved, small, tidy, with_row_ids
from .components import connected_components
from .simhash import close_fingerprints, majority

#: Differing bits up to which the tree pairs texts.
RADIUS = 14

#: Hashes of a sketch; chance to miss a pair; texts that a hash may pair one by one; leaders of others.
SKETCH, MISS, HOT, LEADERS = 64, 1e-7, 200, 8


def least_shared(similarity: float) -> int:
    """Hashes that full sketches of texts with that similarity share, but for a chance of MISS."""
    tail, c = 0.0, 0
    while True:
        tail += math.comb(SKETCH, c) * similarity**c * (1 - similarity) ** (SKETCH - c)
        if tail >= MISS:
            return max(1, c)
        c += 1


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased (A-Z) shingles; a shorter text is one."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(partial(xxh64_intdigest, seed=42), shingles), np.uint64))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    values = np.concatenate([*sets, np.empty(0, np.uint64)]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _sketches(width: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, width) for t in byte_texts(batch.column(1))]
            whole = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            fp = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(fp), _lists([s[:SKETCH] for s in sets])], names=["rid", "whole", "n", "fp", "sketch"])

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_set(t, width) for t in byte_texts(batch.column(1))])], names=["rid", "hashes"])

    return run


def _alike(similarity: float):
    def run(batches):
        for batch in batches:
            x, y = (batch.column(i) for i in (2, 3))
            keep = []
            for i in range(len(x)):
                a, b = (np.asarray(side[i].values) for side in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, each: DataFrame, rows: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs (a, b) that share enough of their sketches, and whose whole sets are that similar."""
    sides = [each.select(F.col("rid").alias(s), F.col("c").alias(f"c{s}"), F.col("sketch").alias(f"s{s}")) for s in ("a", "b")]
    asked = saved(pairs.join(sides[0], "a").join(sides[1], "b").filter(F.size(F.array_intersect("sa", "sb")) >= F.greatest("ca", "cb")).select("a", "b"))
    whose = asked.select(F.col("a").alias("rid")).union(asked.select("b")).distinct()
    sets = saved(rows.select("rid", "text").join(small(whose, 2 * asked.count()), "rid", "left_semi").mapInArrow(tidy(_sets(width)), "rid long, hashes array<long>"))
    whole = asked.join(sets.select(F.col("rid").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("rid").alias("b"), F.col("hashes").alias("y")), "b")
    return saved(whole.select("a", "b", "x", "y").mapInArrow(tidy(_alike(similarity)), "a long, b long"))


def tree_pairs(each: DataFrame, similarity: float, hot: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of the texts ``each`` (rid, n, fp) whose fingerprints the tree finds within RADIUS
    and whose sizes allow the similarity, and the crowded fingerprints (fp); both saved. Every such pair
    is there but for those of two crowded ones, which meet their leaders."""
    each = each.select("rid", "n", "fp")
    first = F.min(F.struct("rid", "n")).alias("first")
    classes = saved(each.groupBy("fp").agg(F.count(F.lit(1)).alias("texts"), first).select("fp", "texts", "first.rid", "first.n"))
    close = saved(close_fingerprints(classes.select("fp", "texts"), RADIUS, hot).distinct())
    crowded = saved(close.filter("a = b").select(F.col("a").alias("fp")))
    own = classes.filter("texts > 1").join(small(crowded, crowded.count()), "fp", "left_anti").select(F.col("fp").alias("a"), F.col("fp").alias("b"))

    def texts(of: DataFrame, side: str, fp: str) -> DataFrame:
        return of.select(F.col("fp").alias(fp), F.col("rid").alias(f"rid{side}"), F.col("n").alias(f"n{side}"))

    plain = close.filter("NOT led").select("a", "b").union(own).join(texts(each, "x", "a"), "a").join(texts(each, "y", "b"), "b")
    plain = plain.filter((F.col("a") != F.col("b")) | (F.col("ridx") < F.col("ridy")))
    led = close.filter("led").select("a", "b").join(texts(classes, "x", "a"), "a").join(texts(each, "y", "b"), "b").filter("ridx <> ridy")
    met = plain.union(led.select(plain.columns)).filter(F.least("nx", "ny") >= similarity * F.greatest("nx", "ny"))
    return saved(met.select(F.least("ridx", "ridy").alias("a"), F.greatest("ridx", "ridy").alias("b")).distinct()), crowded


def similar_pairs(rows: DataFrame, similarity: float = 0.8, width: int = 5, hot: int = HOT) -> DataFrame:
    """Links (a, b) of ``rows`` (rid, text, saved) whose shingle sets have that Jaccard similarity or
    more: enough of them to span every linked set. Of rows with equal sets one stands for all."""
    sketches = saved(rows.select("rid", "text").mapInArrow(tidy(_sketches(width)), "rid long, whole binary, n int, fp long, sketch array<long>"))
    lead = sketches.groupBy("whole").agg(F.min("rid").alias("a"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    equal = saved(sketches.join(lead, "whole").filter("rid <> a").select("a", F.col("rid").alias("b")))
    copies = small(equal.select(F.col("b").alias("rid")), equal.count())
    # A text shares c hashes of its sketch with any similar one: of short texts both sketches are whole sets.
    c = F.when(F.col("n") <= math.floor(SKETCH * similarity), F.ceil(F.col("n") * F.lit(similarity) - 1e-9)).otherwise(least_shared(similarity)).cast("int")
    each = saved(sketches.join(copies, "rid", "left_anti").select("rid", "n", "fp", c.alias("c"), "sketch"))
    near, crowded = tree_pairs(each, similarity, hot)
    whose = near.select(F.col("a").alias("rid")).union(near.select("b")).distinct()
    found = _verified(near, each.join(small(whose, 2 * near.count()), "rid", "left_semi"), rows, similarity, width)
    labels = connected_components(found).withColumnRenamed("node", "rid")
    crowds = small(crowded.withColumn("crowded", F.lit(True)), crowded.count())
    known = each.drop("sketch").join(crowds, "fp", "left").join(small(labels, labels.count()), "rid", "left")
    known = saved(known.select("rid", "n", "c", "fp", F.coalesce("crowded", F.lit(False)).alias("crowded"), F.coalesce("label", "rid").alias("label")))
    # The rest: pairs that the tree has not decided, as they are farther apart or in a crowd.
    entries = each.select("rid", F.explode("sketch").alias("h"))
    often = saved(entries.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    # Hashes of one text only are a sketch's rarest: they are counted and need not be moved.
    rarest = entries.join(often, "h").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("hs"), F.count_if(F.col("df") > hot).cast("long").alias("common"))  # SKETCH at most
    p = F.greatest(F.size("hs") - F.col("c") + 1, F.lit(0))
    text = ["rid", "n", "fp", "crowded", "label"]
    rarest = rarest.join(known, "rid").select(*text, "common", F.explode(F.slice("hs", F.lit(1), p)).alias("x"))
    prefix = saved(rarest.select(*text, "common", F.col("x.h").alias("h")))
    # Leaders have most of what is common, the first one most of all; among equals a hash draws.
    drawn = [F.max(F.struct(F.col("common") if i == 0 else F.floor(F.col("common") / 8).cast("long"), F.xxhash64("rid", F.lit(i)), *[F.col(v).alias(v) for v in text])).alias(f"l{i}") for i in range(LEADERS)]
    sizes = saved(prefix.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), *drawn).filter("texts > 1"))
    prefix = prefix.drop("common")
    large = sizes.filter(F.col("texts") > hot)
    many = large.count()

    def pairs(x: DataFrame, y: DataFrame, extra=True) -> DataFrame:
        x, y = (d.select("h", *[F.col(v).alias(f"{v}{s}") for v in d.columns if v != "h"]) for d, s in ((x, "x"), (y, "y")))
        open_ = (F.bit_count(F.col("fpx").bitwiseXOR(F.col("fpy"))) > RADIUS) | (F.col("crowdedx") & F.col("crowdedy"))
        close = (F.col("labelx") != F.col("labely")) & open_ & (F.least("nx", "ny") >= similarity * F.greatest("nx", "ny"))
        met = x.join(y, "h").filter(close if extra is True else close & extra)
        return met.select(F.least("ridx", "ridy").alias("a"), F.greatest("ridx", "ridy").alias("b")).distinct()

    cold = prefix.join(sizes.filter(F.col("texts") <= hot).select("h"), "h", "left_semi")
    found = saved(found.union(_verified(pairs(cold, cold, F.col("ridx") < F.col("ridy")), each, rows, similarity, width)))
    if not many:
        return found.union(equal)
    crowd = saved(prefix.join(small(large.select("h"), many), "h", "left_semi"))
    leaders = large.select("h", F.explode(F.array(*[F.struct(*[f"l{i}.{v}" for v in text]) for i in range(LEADERS)])).alias("l")).select("h", "l.*").distinct()
    found = saved(found.union(_verified(pairs(crowd, small(leaders, LEADERS * many)), each, rows, similarity, width)))
    labels = connected_components(found)
    whose = saved(crowd.select("rid").distinct())
    sets = rows.select("rid", "text").join(small(whose, whose.count()), "rid", "left_semi").mapInArrow(tidy(_sets(width)), "rid long, hashes array<long>")
    all_ = saved(sets.select("rid", F.size("hashes").alias("n"), F.explode("hashes").alias("h")))
    place = F.row_number().over(Window.partitionBy("rid").orderBy("df", "h"))
    all_ = all_.join(all_.groupBy("h").agg(F.count(F.lit(1)).alias("df")), "h").withColumn("place", place)
    all_ = all_.filter((F.col("df") > 1) & (F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - 1e-9) + 1))

    def labelled(entries: DataFrame, labels: DataFrame) -> DataFrame:
        """Labels meet texts first, which are far fewer than entries."""
        texts = whose.join(labels.withColumnRenamed("node", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
        return entries.join(texts, "rid")

    all_ = saved(labelled(all_.select("h", "rid", "n", "place"), labels).join(known.select("rid", "fp", "crowded"), "rid"))
    # Sets only grow: a hash whose texts are linked already has nothing more to ask.
    parted = all_.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    all_ = saved(all_.join(parted.select("h"), "h", "left_semi"))
    bound = 1 + F.least(F.col("nx") - F.col("placex"), F.col("ny") - F.col("placey")) >= F.ceil((F.col("nx") + F.col("ny")) * F.lit(similarity / (1 + similarity)) - 1e-9)

    def asked(by: str, all_now: DataFrame) -> DataFrame:
        """Entries of a hash that are apart from its largest linked set; of each such set one text, or all."""
        main = all_now.groupBy("h", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.max(F.struct("k", "label")).alias("m")).select("h", F.col("m.label").alias("main"))
        apart = all_now.join(main, "h").filter("label <> main").drop("main")
        if by == "label":
            first = F.min(F.struct(F.xxhash64("rid").alias("x"), "rid", "n", "place", "fp", "crowded")).alias("f")
            apart = apart.groupBy("h", "label").agg(first, F.count(F.lit(1)).alias("k")).filter("k > 1").select("h", "f.rid", "f.n", "f.place", "f.fp", "f.crowded", "label")
        return pairs(apart, all_now, bound)

    found = saved(found.union(_verified(asked("label", all_), each, rows, similarity, width)))
    rest = _verified(asked("rid", labelled(all_.drop("label"), connected_components(found))), each, rows, similarity, width)
    return found.union(rest).union(equal)


def keep_dissimilar(docs: DataFrame, similarity: float = 0.8, width: int = 5, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` without those that link, directly or through others, to a kept row.

    Of each group the row with the smallest id stays (a null id is larger than any other), of
    several with that id one of them. A null text is empty, and texts of fewer words than ``width``
    are one shingle. Repeated rows go but for one; other columns may have any name. An empty table
    gives no rows.
    """
    columns, rows = docs.columns, with_row_ids(plain_names(docs))
    with own_tables(docs.sparkSession, lambda paths: paths[-1:]):  # the ids that go
        gone = _gone(rows, similarity, width, hot)
    return rows.join(small(gone, gone.count()), "rid", "left_anti").drop("rid").toDF(*columns)


def _gone(rows: DataFrame, similarity: float, width: int, hot: int) -> DataFrame:
    """rid of each row that links to one that stays; saved."""
    labels = connected_components(saved(similar_pairs(rows, similarity, width, hot)))
    members = labels.join(rows.select(F.col("rid").alias("node"), "doc_id"), "node").withColumn("r", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", F.col("node").alias("rid")))
    lead = members.groupBy("label").agg(F.min("r").alias("lead"))
    return saved(members.join(lead, "label").filter("node <> lead.rid").select(F.col("node").alias("rid")))
