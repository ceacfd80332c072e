"""The queries of the ten operators over the synthetic tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches
from .exact_dedup import exact_dedup
from .lm_score import lm_scores
from .mixing import mix_report
from .quality_classifier import quality_scores
from .quality_rules import quality_rules
from .secret_scan import secret_digest
from .sentencepiece_codec import encode
from .simhash import simhash_groups
from .substring_dedup import substring_dedup
from .token_counts import token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_lm_score(spark, sf_dir):
    return lm_scores(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark, sf_dir):
    return token_counts(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark, sf_dir):
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_sentencepiece(spark, sf_dir):
    return encode(_table(spark, sf_dir, "documents"), digest=True)


def op6_secret_scan(spark, sf_dir):
    return secret_digest(_table(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    out = simhash_groups(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_substring_dedup(spark, sf_dir):
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return out.select("doc_id", F.size("spans").cast("long").alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"), spans.alias("removed_spans"))


def op9_quality_rules(spark, sf_dir):
    trusted = _table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_rules(_table(spark, sf_dir, "documents"), trusted)


def op10_mixing(spark, sf_dir):
    return mix_report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_exact_dedup, op2_lm_score, op3_token_counts, op4_quality_classifier, op5_sentencepiece, op6_secret_scan, op7_simhash, op8_substring_dedup, op9_quality_rules, op10_mixing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": r"""
            WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
            g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.norm) AS text_sha256
            FROM t JOIN g ON t.norm = g.norm""",
        "op8_substring_dedup": r"""
            WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
            l AS (SELECT doc_id, ls[i] AS line, CAST(coalesce(list_sum(list_transform(ls[1:i - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS s
                  FROM d, range(1, len(ls) + 1) AS r(i)),
            p AS (SELECT *, regexp_extract_all(line, '[^.!?]+[.!?]*|[.!?]+') AS ps FROM l),
            q AS (SELECT doc_id, s AS line_at, i, ps[i] AS part, s + CAST(coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
                  FROM p, range(1, len(ps) + 1) AS r(i)),
            u AS (SELECT doc_id, s AS line_at, 0 AS i, line AS part, s FROM l
                  UNION ALL SELECT q.* FROM q JOIN p ON q.doc_id = p.doc_id AND q.line_at = p.s WHERE len(ps) > 1),
            n AS (SELECT doc_id, line_at, i, s, s + length(part) AS e, list_filter(regexp_split_to_array(
                    translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM u),
            k AS (SELECT *, row_number() OVER (PARTITION BY array_to_string(ws, ' ') ORDER BY doc_id, s) AS r FROM n WHERE len(ws) >= 8),
            whole AS (SELECT doc_id, line_at, s, e FROM k WHERE r > 1 AND i = 0),
            inner_ AS (SELECT k.* FROM k ANTI JOIN whole w ON k.doc_id = w.doc_id AND k.line_at = w.line_at WHERE r > 1 AND i > 0),
            gone AS (SELECT doc_id, s, e FROM whole UNION ALL SELECT doc_id, s, e FROM inner_),
            rests AS (SELECT q.doc_id, q.line_at, coalesce(string_agg(q.part, '' ORDER BY q.i) FILTER (WHERE g.i IS NULL), '') AS line
                  FROM q LEFT JOIN inner_ g ON q.doc_id = g.doc_id AND q.line_at = g.line_at AND q.i = g.i GROUP BY ALL),
            kept AS (SELECT l.doc_id, coalesce(c.line, l.line) AS line, l.s, w.s IS NOT NULL AS cut
                  FROM l LEFT JOIN rests c ON l.doc_id = c.doc_id AND l.s = c.line_at LEFT JOIN whole w ON l.doc_id = w.doc_id AND l.s = w.s),
            texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY s) FILTER (WHERE NOT cut) AS rest, arg_max(cut, s) AS last_cut,
                      count(*) FILTER (WHERE NOT cut) AS lines FROM kept GROUP BY doc_id),
            spans AS (SELECT doc_id, count(*) AS n, string_agg(s || ':' || e, ',' ORDER BY s) AS removed FROM gone GROUP BY doc_id),
            final AS (SELECT doc_id, CASE WHEN lines = 0 THEN '' WHEN last_cut THEN rest || chr(10) ELSE rest END AS rest FROM texts)
            SELECT f.doc_id, coalesce(n, 0) AS n_removed, length(rest) AS kept_chars, sha256(rest) AS kept_sha256, coalesce(removed, '') AS removed_spans
            FROM final f LEFT JOIN spans USING (doc_id)""",
    }
