"""Operator 6, secret scans over a trigram inverted index (DataFrame functions only).

From each rule's regex a Boolean query over trigrams is derived on the driver. The index holds, for
each trigram that some query names and each shard of a few thousand documents, the sorted keys of
the documents with it. Queries intersect and unite these postings; only candidates are verified with
the rule's regex. A rule whose regex has no mandatory trigram scans every document.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small, text_of


@dataclass(frozen=True)
class Rule:
    """``group`` of a match has ``least`` characters or more; ``base`` rules count in the digest."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    base: bool = False


#: Fixed patterns. A maximal run of the last class is what each of them matches, so the least
#: lengths of access and hex can stand in the regex without a change to any span.
RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"://[A-Za-z0-9._-]+:[^\x20\x09-\x0D:/@]+@[A-Za-z0-9.-]+"),
]

#: Documents of a shard, about.
SHARD = 4096

# Queries: True (all documents), a trigram, ("and", ...) or ("or", ...).


def _all(parts):
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts):
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]):
    """Trigrams that cover each string: every third one, and the last."""
    return _any([_all([s[i : i + 3] for i in sorted({*range(0, len(s) - 2, 3), len(s) - 3}) if i >= 0]) for s in sorted(strings)])


def _exact(node, most: int = 24) -> set[str] | None:
    """All strings that a node of a parsed regex matches, if they are few."""
    op, arg = node
    if op is rc.LITERAL:
        return {chr(arg).lower()}
    if op is rc.IN:
        out = {chr(a).lower() for o, a in arg if o is rc.LITERAL}
        return out if all(o is rc.LITERAL for o, _ in arg) and len(out) <= most else None
    if op is rc.SUBPATTERN:
        return _exact_sequence(arg[-1], most)
    if op is rc.BRANCH:
        found = [_exact_sequence(x, most) for x in arg[1]]
        out = None if None in found else set().union(*found)
        return out if out is not None and len(out) <= most else None
    if op is rc.MAX_REPEAT and arg[:2] == (0, 1):
        inner = _exact_sequence(arg[2], most)
        return None if inner is None else inner | {""}
    if op is rc.MAX_REPEAT and arg[0] == arg[1] and arg[0] <= 8:
        return _exact_sequence(list(arg[2]) * arg[0], most)
    return None


def _exact_sequence(nodes, most: int) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _exact(node, most)
        if more is None or len(out) * len(more) > most:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(nodes):
    parts, now = [], {""}
    for node in nodes:
        more = _exact(node)
        if more is not None and len(more) * len(now) <= 24:
            now = {a + b for a in now for b in more}
            continue
        parts.append(_of_strings(now))
        now = {""} if more is None else more
        if more is None:
            op, arg = node
            if op is rc.SUBPATTERN:
                parts.append(_query(arg[-1]))
            elif op is rc.BRANCH:
                parts.append(_any([_query(x) for x in arg[1]]))
            elif op is rc.MAX_REPEAT and arg[0] > 0:
                parts.append(_query(arg[2]))
    return _all([*parts, _of_strings(now)])


def trigram_query(regex: str):
    """The Boolean query over lower-case trigrams that each match of ``regex`` satisfies."""
    return _query(parser.parse(regex))


def trigrams(query) -> list[str]:
    if query is True:
        return []
    return [query] if isinstance(query, str) else list(dict.fromkeys(t for part in query[1:] for t in trigrams(part)))


def postings_of(query, number: dict[str, int]) -> Column:
    """The sorted keys of a shard that satisfy a query, from its map of postings."""
    if isinstance(query, str):
        return F.coalesce(F.element_at("postings", F.lit(number[query])), F.array().cast("array<bigint>"))
    meet = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(meet, [postings_of(part, number) for part in query[1:]])


def trigram_index(docs: DataFrame, grams: list[str], rows: int) -> DataFrame:
    """(shard, postings): for each shard a map from a trigram's number to its sorted keys; saved.

    ``docs`` has key and text. Rules whose trigrams are among ``grams`` can be asked of it again.
    """
    low = docs.select("key", F.lower("text").alias("low"))
    hits = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    entries = low.select("key", F.explode(hits).alias("gram"))
    lists = entries.groupBy(F.pmod("key", F.lit(max(1, rows // SHARD))).alias("shard"), "gram").agg(F.sort_array(F.collect_set("key")).alias("ids"))
    return saved(lists.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("postings")))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, mask): bit i is set if rule i has a trigram query and the document satisfies it."""
    queries = [trigram_query(r.regex) for r in rules]
    grams = list(dict.fromkeys(t for q in queries for t in trigrams(q)))
    number = {g: i for i, g in enumerate(grams)}
    index = trigram_index(docs, grams, docs.count())
    met = F.array(*[F.struct(F.lit(1 << i).cast("long").alias("bit"), postings_of(q, number).alias("ids")) for i, q in enumerate(queries) if q is not True])
    each = index.select(F.explode(met).alias("m")).select("m.bit", F.explode("m.ids").alias("key"))
    return each.groupBy("key").agg(F.bit_or("bit").alias("mask"))


def _spans(rule: Rule, order: int) -> Column:
    """Structs (start, order, kind, end) of a rule's matches, in code points."""
    rx = F.lit(rule.regex)
    whole = F.regexp_extract_all("text", rx, F.lit(0))
    group = F.regexp_extract_all("text", rx, F.lit(rule.group)) if rule.group else whole
    steps = F.arrays_zip(F.slice(F.split("text", rule.regex, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("match"), group.alias("part"))
    empty = F.array().cast("array<struct<start:int,kind_order:int,kind:string,stop:int>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(order).alias("kind_order"), F.lit(rule.kind).alias("kind"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(F.length(x["part"]) >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    return F.aggregate(steps, zero, step, lambda acc: acc["spans"])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs``: id and spans (start, kind_order, kind, stop), in order.

    Matches of a rule are leftmost and do not overlap; those of different rules may. Offsets are code
    points, the end exclusive. A null text is empty and has no spans; repeated rows and null ids are
    rows like any other (equal ids only share candidates). An empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("key"), text_of(text_col).alias("text"))
    found = saved(candidates(rows, rules))
    # Few candidates are sent to the texts; beyond the bound both sides meet by key.
    joined = rows.join(small(found, found.count()), "key", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    none = F.array().cast("array<struct<start:int,kind_order:int,kind:string,stop:int>>")
    parts = []
    for i, rule in enumerate(rules):
        if trigram_query(rule.regex) is True:
            hit = F.col("text").rlike(rule.regex)
        else:
            hit = F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
        parts.append(F.when(hit, _spans(rule, i)).otherwise(none))
    return joined.select(F.col("id").alias(id_col), F.array_sort(F.concat(*parts)).alias("spans"))


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, base_sha256 of the base spans, and all spans."""
    found = secret_spans(docs, id_col, text_col)
    last = sum(r.base for r in RULES)

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["kind_order"] < last)
    of = lambda i: F.filter("spans", lambda x: x["kind_order"] == i)
    counts = [F.size(of(i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(RULES[:last])]
    return found.select(id_col, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
