"""Operator 1, exact dedup by a content sort.

Spark samples splitters and range-partitions the rows by their normalised bytes; the external
sorter then places equal texts next to each other, and one pass over each sorted partition compares
neighbours in full. A splitter is (first bytes, SHA-256, id), so it has a bounded size, and a text
that fills a third of the table is dealt over many partitions. Runs that touch the end of a partition
are stitched by the digests of at most two rows a partition, and by their texts where digests agree.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, local_table, plain_names, saved, small, text_of, tidy

_GAPS = re.compile(rb"[\x20\x09-\x0D]+")
#: First bytes of a text in the sort key; its digest follows them.
HEAD = 16


def normalised(text: bytes) -> bytes:
    return _GAPS.sub(b" ", text)


def _norm(column: str) -> Column:
    return F.regexp_replace(text_of(column), f"[{SPACE}]+", " ")


def _sorted(rows: DataFrame) -> DataFrame:
    """``rows`` (id, _text and others) with ``_sha``, range-partitioned and sorted by content."""
    key = rows.withColumn("_sha", F.unhex(F.sha2(_norm("_text"), 256))).withColumn("_head", F.substring(_norm("_text").cast("binary"), 1, HEAD))
    order = [F.col("_head"), F.col("_sha"), F.col("id").asc_nulls_last()]
    return key.repartitionByRange(*order).sortWithinPartitions(*order).drop("_head")


def _repeats(batches):
    """Each batch of a sorted partition with flags: is a row's text that of the row before it?

    Yields (batch, flags, texts), texts giving the normalised text of a row.
    """
    last_sha = last_text = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sha, text = batch.column(batch.schema.get_field_index("_sha")), batch.column(batch.schema.get_field_index("_text")).cast(pa.binary())
        read = lambda i, text=text: normalised(text[i].as_py() or b"")
        same = np.zeros(n, bool)
        same[1:] = pc.equal(sha.slice(1), sha.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        same[0] = last_sha is not None and sha[0].as_py() == last_sha
        for i in np.flatnonzero(same).tolist():  # equal digests: compare the texts themselves
            same[i] = (read(i - 1) if i else last_text) == read(i)
        yield batch, same, read
        last_sha, last_text = sha[n - 1].as_py(), read(n - 1)


def _runs(columns: list[str]):
    """A mapInArrow function that finds the runs of equal texts in a sorted partition.

    ``columns``: those that are carried, the first one is the id. Edge 1: the run touches the
    partition's start; 2: its end; 3: both.
    """

    def scan(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []  # slices of the open run, without texts
        open_text, first = None, True
        kept = [*columns, "_sha"]

        def emit(rows: pa.Table, starts: np.ndarray, edges: np.ndarray, lead: bytes | None):
            sizes = np.diff(np.append(starts, rows.num_rows))
            at = np.repeat(starts, sizes)
            is_first = np.zeros(rows.num_rows, bool)
            is_first[starts] = True
            edge_text = [None] * rows.num_rows
            edge_text[0] = lead
            ids = rows.column(columns[0]).combine_chunks()
            out = {"keep_id": ids.take(pa.array(at)), "run_rows": pa.array(np.repeat(sizes, sizes)), "is_first": pa.array(is_first), "pid": pa.array(np.full(rows.num_rows, pid, np.int32)), "edge": pa.array(np.repeat(edges, sizes).astype(np.int32)), "edge_text": pa.array(edge_text, pa.binary()), "sha": rows.column("_sha")}
            yield from pa.table([rows.column(c) for c in columns] + list(out.values()), names=[*columns, *out]).to_batches(max_chunksize=10_000)

        for batch, same, read in _repeats(batches):
            rows, cuts = batch.select(kept), np.flatnonzero(~same)
            if not len(cuts):
                held.append(rows)
                continue
            table = pa.Table.from_batches([*held, rows.slice(0, cuts[-1])], schema=rows.schema)
            if table.num_rows:
                ahead = sum(x.num_rows for x in held)
                starts = np.array([*([0] if held else []), *(ahead + cuts[:-1])], np.int64)
                edges = np.zeros(len(starts), np.int32)
                edges[0] = 1 if first else 0
                yield from emit(table, starts, edges, (open_text if held else read(0)) if first else None)
                first = False
            held, open_text = [rows.slice(cuts[-1])], read(int(cuts[-1]))
        if held:
            yield from emit(pa.Table.from_batches(held), np.array([0]), np.array([3 if first else 2], np.int32), open_text)

    return scan


def _goes_on(edges: list, texts: DataFrame) -> list[bool]:
    """For each of the edge rows (pid, edge, sha), in order: is its text that of the one before?

    ``texts`` has pid, edge and edge_text; it is read only for neighbours whose digests agree.
    """
    same = [i for i in range(1, len(edges)) if edges[i]["sha"] == edges[i - 1]["sha"]]
    if not same:
        return [False] * len(edges)
    near = [(i, edges[i - 1].pid, edges[i - 1].edge, edges[i].pid, edges[i].edge) for i in same]
    pairs = local_table(texts.sparkSession, {k: pa.array(v, pa.int32()) for k, v in zip("ipeqf", zip(*near))})
    side = lambda p, e, t: texts.select(F.col("pid").alias(p), F.col("edge").alias(e), F.col("edge_text").alias(t))
    met = pairs.join(side("p", "e", "x"), ["p", "e"]).join(side("q", "f", "y"), ["q", "f"])
    found = {r.i for r in met.filter(F.col("x") == F.col("y")).select("i").collect()}
    return [i in found for i in range(len(edges))]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, and ``carry``.

    Texts are equal when identical after each run of separators is replaced by one space; a null
    text is an empty one. Of equal texts the row with the smallest id stays; a null id is larger
    than any other, and of rows with the same id and text exactly one stays. An empty table gives
    an empty result. Only the named columns are read, so other columns may have any name.
    """
    carry = [c for c in carry or [] if c != id_col]
    names = {c: f"c{i}" for i, c in enumerate(carry)}
    ranged = _sorted(docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(names[c]) for c in carry], text_of(text_col).alias("_text")))
    columns = ["id", *names.values()]
    schema = T.StructType([ranged.schema[c] for c in columns]).add("keep_id", ranged.schema["id"].dataType)
    for name, of in (("run_rows", T.LongType()), ("is_first", T.BooleanType()), ("pid", T.IntegerType()), ("edge", T.IntegerType()), ("edge_text", T.BinaryType()), ("sha", T.BinaryType())):
        schema = schema.add(name, of)
    runs = saved(ranged.mapInArrow(_runs(columns), schema))

    texts = runs.filter("edge_text IS NOT NULL")
    edges = sorted(texts.select("pid", "edge", "keep_id", "run_rows", "sha").collect(), key=lambda r: (r.pid, r.edge))  # two slim rows a partition at most
    chains: list[list[int]] = []
    for i, on in enumerate(_goes_on(edges, texts)):
        if on:
            chains[-1].append(i)
        else:
            chains.append([i])
    fixes = []
    for chain in (c for c in chains if len(c) > 1):
        ids = [edges[i].keep_id for i in chain if edges[i].keep_id is not None]
        fixes += [(edges[i].pid, edges[i].edge, i != chain[0], min(ids, default=None), sum(edges[j].run_rows for j in chain)) for i in chain]
    kind = T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("edge", T.IntegerType()), T.StructField("goes_on", T.BooleanType()), T.StructField("all_keep", schema["id"].dataType), T.StructField("all_rows", T.LongType())])
    fixed = runs.drop("edge_text").join(small(docs.sparkSession.createDataFrame(fixes, kind), len(fixes)), ["pid", "edge"], "left")
    there = F.col("goes_on").isNotNull()
    return fixed.select(
        F.col("id").alias(id_col), F.when(there, F.col("all_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(there, F.col("all_rows")).otherwise(F.col("run_rows")).alias("group_size"),
        (F.col("is_first") & ~F.coalesce("goes_on", F.lit(False))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
        *[F.col(v).alias(k) for k, v in names.items()],
    )


def _firsts(columns: list[str]):
    """The first row of each run of a sorted partition, with its partition and its edge as in _runs."""

    def scan(batches):
        from pyspark import TaskContext

        pid, last, first = TaskContext.get().partitionId(), None, True

        def marked(rows: pa.RecordBatch, edges: list[int]):
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array([pid] * rows.num_rows, pa.int32()), pa.array(edges, pa.int32())], names=[*columns, "_pid", "_edge"])

        for batch, same, _ in _repeats(batches):
            rows = batch.filter(pa.array(~same))
            if not rows.num_rows:
                continue
            if last is not None:
                yield marked(last, [1 if first else 0])
                first = False
            head = rows.slice(0, rows.num_rows - 1)
            if head.num_rows:
                yield marked(head, [1 if first else 0] + [0] * (head.num_rows - 1))
                first = False
            last = rows.slice(rows.num_rows - 1)
        if last is not None:
            yield marked(last, [3 if first else 2])

    return scan


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that exact dedup keeps.

    A null text is an empty one and stays null; of equal texts the row with the smallest id stays, a
    null id being larger than any other, and of repeated rows exactly one; other columns may have any
    name. An empty table gives no rows. Rows that do not stay are dropped while their partition is
    scanned, so a run of any size takes no memory.
    """
    columns = docs.columns
    rows = plain_names(docs).withColumnsRenamed({"doc_id": "id", "text": "_text"})
    ranged = _sorted(rows)
    found = saved(ranged.mapInArrow(tidy(_firsts(ranged.columns)), T.StructType([*ranged.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_edge", T.IntegerType())])))
    texts = found.filter("_edge > 0").select(F.col("_pid").alias("pid"), F.col("_edge").alias("edge"), F.col("_sha").alias("sha"), _norm("_text").alias("edge_text"))
    edges = sorted(texts.select("pid", "edge", "sha").collect(), key=lambda r: (r.pid, r.edge))  # two slim rows a partition at most
    gone = [(e.pid, e.edge) for e, on in zip(edges, _goes_on(edges, texts)) if on]
    drop = local_table(docs.sparkSession, {"_pid": pa.array([p for p, _ in gone], pa.int32()), "_edge": pa.array([e for _, e in gone], pa.int32())})
    return found.join(small(drop, len(gone)), ["_pid", "_edge"], "left_anti").select(*rows.columns).toDF(*columns)

