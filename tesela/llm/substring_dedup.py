"""Operator 8, substring dedup by line or paragraph hashing.

Each unit (a line, or a paragraph between blank lines, and each of its sentences) is normalised and
hashed; digests meet globally, the earliest ranked occurrence stays, and all others are removed from
their texts. Removed spans refer to the original text. Sentences find passages that stand inside a
line, where the line as a whole is not repeated.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, with_row_ids

_BREAK = {"line": re.compile("\n"), "paragraph": re.compile(r"\n[\x20\x09\x0B-\x0D]*\n")}
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_SENTENCE = re.compile(r"[^.!?]+[.!?]*|[.!?]+")


def units(text: str, unit: str, min_words: int):
    """(start, end, 16-byte digest) of each unit of ``min_words`` words or more, in code points.

    A line or paragraph comes before its sentences, and is not given twice if it is just one.
    """
    at = 0
    for m in [*_BREAK[unit].finditer(text), None]:
        end = m.start() if m else len(text)
        words = text[at:end].encode().lower().split()
        if len(words) >= min_words:
            yield at, end, hashlib.blake2b(b" ".join(words), digest_size=16).digest()
            for part in _SENTENCE.finditer(text, at, end):
                own = part[0].encode().lower().split()
                if len(own) >= min_words and part.span() != (at, end):
                    yield *part.span(), hashlib.blake2b(b" ".join(own), digest_size=16).digest()
        at = m.end() if m else end


def _hash(unit: str, min_words: int):
    def run(batches):
        for batch in batches:
            rows = [(i, s, e, d) for i, t in enumerate(batch.column(2).to_pylist()) for s, e, d in units(t or "", unit, min_words)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.binary())))], names=["rid", "id", "start", "stop", "digest"])

    return run


def _cut(batches):
    for batch in batches:
        out, removed = [], []
        for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            text, at, kept, outer = text or "", 0, [], []
            for s in sorted(spans or [], key=lambda s: (s["start"], -s["stop"])):
                a, b = s["start"], s["stop"]
                if outer and a < outer[-1]["stop"]:
                    continue  # a sentence of a unit that goes as a whole
                outer.append(s)
                kept.append(text[at:a])
                at = b + (text[b : b + 1] == "\n" and text[a - 1 : a] in ("", "\n"))  # a whole line takes its break along
            out.append("".join([*kept, text[at:]]))
            removed.append(outer)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(removed, _SPANS), pa.array(out, pa.string())], names=["id", "spans", "text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 8) -> DataFrame:
    """One row per row of ``docs``: id, text without the removed units, spans (start, stop) of these.

    Units are equal when their lower-cased (A-Z) words are; a sentence ends after a run of ``.!?``.
    Units of fewer than ``min_words`` words are never removed, so that short phrases of clean texts
    stay. Of equal units the one with the smallest (id, start) stays, and so what a removed unit
    holds stays too; a null id is larger than any other, and of rows with one id the first counts as
    smaller. Repeats within a text go too. A null text is empty. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = with_row_ids(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    found = saved(rows.select("rid", "id", "text").mapInArrow(_hash(unit, min_words), f"rid long, id {kind}, start int, stop int, digest binary"))
    rank = F.struct(F.col("id").isNull().alias("n"), "id", "rid", "start")
    # Saved, so that the join below deals both sides anew and a very common unit can be split.
    first = saved(found.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first"))
    repeated = found.join(first, "digest").filter((F.col("rid") != F.col("first.rid")) | (F.col("start") != F.col("first.start")))
    spans = repeated.groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # of one text
    cut = rows.join(spans, "rid", "left").select("rid", "id", "text", "spans").mapInArrow(_cut, f"id {kind}, spans array<struct<start:int,stop:int>>, text string")
    return cut.select(F.col("id").alias(id_col), "text", "spans")
