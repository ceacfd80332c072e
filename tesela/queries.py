"""Queries over the synthetic tables, and DuckDB SQL that returns the same rows.

Most relational ones are statements of the dialect, run by the engine; the SQL is the same statement
or its plain form. Points are derived from keys, and a purchase is a line item.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, vectors
from .functions.ordered import every_nth
from .operators import evaluation, language, media, service
from .operators.search import TextIndex, ascii_terms
from .plans.engine import Engine

_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "labels": "doc_id", "benchmark": "item_id", "pages": "page_id", "lineitem": None}


def _split(text: str) -> list[str]:
    return re.findall("[a-z]+", text.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lat(key):
    return f"(({key} * 37) % 1000) / 1000e0 - 125e-1"


def _lon(key):
    return f"(({key} * 91) % 1000) / 1000e0 - 775e-1"


def places(spark, sf_dir, name="customer", key="c_custkey") -> DataFrame:
    """A table with a point p derived from its key."""
    return table(spark, sf_dir, name).withColumn("p", F.struct(F.expr(_lat(key)).alias("lat"), F.expr(_lon(key)).alias("lon")))


def engine(spark: SparkSession, sf_dir: str, sql: str) -> Engine:
    """An engine with the tables that ``sql`` names."""
    e = Engine(spark, ascii_terms, _split)
    for name, key in _KEYS.items():
        if re.search(rf"\b{name}\b", sql):
            e.register(name, table(spark, sf_dir, name), key)
    if "MATCH(" in sql:
        e.tables["documents"].indexes["documents_text"] = text_index(spark, sf_dir, e)
    if re.search(r"\bcustomer_places\b", sql):
        e.register("customer_places", places(spark, sf_dir), "c_custkey")
    return e


_INDEXES: dict[tuple[str, str], dict] = {}


def text_index(spark: SparkSession, sf_dir: str, e: Engine | None = None) -> dict:
    """The inverted index of documents, written once by CREATE INDEX in an application."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _INDEXES:
        e = e or engine(spark, sf_dir, "documents")
        e.sql("CREATE INDEX documents_text ON documents USING INVERTED (text)")
        _INDEXES[at] = e.tables["documents"].indexes["documents_text"]
    return _INDEXES[at]


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()}) if digits else df


def _dialect(sql: str, digits: dict[str, int] | None = None):
    return lambda spark, sf_dir: rounded(engine(spark, sf_dir, sql).sql(sql), digits or {})


def _oracle(sql: str, digits: dict[str, int] | None = None) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {n}) AS {c}' for c, n in digits.items())}) FROM ({sql})" if digits else sql


#: Statements that both engines read: name, statement, digits to round to.
_SAME: list[tuple[str, str, dict[str, int]]] = [
    ("scan_project", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders", {}),
    ("filter_3vl", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 100000) AND o_orderkey IS NOT NULL", {}),
    ("between_not", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice NOT BETWEEN 50000 AND 200000", {}),
    ("in_list", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_linenumber NOT IN (1, 2)", {}),
    ("like_pattern", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%' AND p_type NOT LIKE 'ECONOMY%'", {}),
    ("is_null_outer", "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 WHERE o.o_orderkey IS NULL", {}),
    ("pk_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 7, 32, 100)", {}),
    ("pk_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND 300 > o_orderkey", {}),
    ("modulo_sign", "SELECT o_orderkey, -o_orderkey % 7 AS m, (3 - o_orderkey) % 5 AS k FROM orders", {}),
    ("real_division", "SELECT l_orderkey, l_linenumber, l_linenumber / 4 AS q, -l_linenumber + 2 * 3 AS s FROM lineitem WHERE l_linenumber > 1", {"q": 6}),
    ("order_multi", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50", {}),
    ("order_alias", "SELECT o_orderkey AS k, o_totalprice * 2 AS t FROM orders ORDER BY t DESC, k LIMIT 20", {"t": 2}),
    ("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 40", {}),
    ("topk_price", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10", {}),
    ("distinct_multi", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", {}),
    ("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", {}),
    ("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000", {}),
    ("join_right", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT OUTER JOIN customer c ON o.o_custkey = c.c_custkey", {}),
    ("join_full", "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey AND s.s_nationkey = c.c_nationkey", {}),
    ("join_composite", "SELECT a.l_orderkey, a.l_linenumber, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber", {}),
    ("join_residual", "SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_extendedprice > o.o_totalprice", {}),
    ("join_theta", "SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_nationkey < r.r_regionkey", {}),
    ("join_chain", "SELECT r.r_name, COUNT(*) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY r.r_name", {}),
    ("self_join", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", {}),
    ("group_col", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q, AVG(l_discount) AS d, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus", {"q": 2, "d": 6}),
    ("group_expr", "SELECT o_orderkey % 7 AS b, COUNT(*) AS n FROM orders GROUP BY o_orderkey % 7", {}),
    ("group_position", "SELECT o_orderstatus, o_orderpriority, COUNT(o_custkey) AS n FROM orders GROUP BY 1, 2", {}),
    ("having_expr", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10 AND SUM(o_totalprice) > 1000", {}),
    ("agg_global", "SELECT COUNT(*) AS n, COUNT(o_orderstatus) AS s, SUM(o_totalprice) AS t, AVG(o_totalprice) AS a FROM orders WHERE o_orderkey > 10", {"t": 2, "a": 4}),
    ("agg_empty", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS t, MIN(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0", {}),
    ("agg_in_expr", "SELECT l_returnflag, SUM(l_extendedprice * (1 - l_discount)) / COUNT(*) AS mean FROM lineitem GROUP BY l_returnflag", {"mean": 4}),
    ("agg_order", "SELECT o_custkey, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey ORDER BY SUM(o_totalprice) DESC, o_custkey LIMIT 10", {"t": 2}),
    ("facet_counts", "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand HAVING COUNT(*) > 1 ORDER BY n DESC, p_brand", {}),
    ("catalogue_page", "SELECT p_partkey, p_name FROM part WHERE p_size = 10 ORDER BY p_partkey LIMIT 20 OFFSET 5", {}),
    ("copurchase_of_one", "SELECT b.l_partkey AS other, COUNT(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey WHERE a.l_partkey = 1 GROUP BY b.l_partkey", {}),
    ("star_expand", "SELECT * FROM nation WHERE n_regionkey = 2", {}),
    ("distinct_order", "SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderpriority", {}),
    ("join_theta_left", "SELECT r.r_regionkey, n.n_nationkey FROM region r LEFT JOIN nation n ON n.n_nationkey < r.r_regionkey", {}),
    ("join_theta_full", "SELECT r.r_regionkey, n.n_nationkey FROM region r FULL JOIN nation n ON n.n_nationkey < r.r_regionkey", {}),
    ("interval_contains", "SELECT o_orderkey FROM orders WHERE o_orderkey - 5 <= 60 AND o_orderkey + 5 >= 60", {}),
]


def _hav(lat, lon, key="c_custkey"):
    a, o = _lat(key), _lon(key)
    return f"2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({lat} - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({lat})) * pow(sin(radians({lon} - ({o})) / 2), 2))))"


_SQUARE = [(-12.3, -77.4), (-12.3, -76.9), (-11.8, -76.9), (-11.8, -77.4)]
_CORNER = [(-12.3, -77.4), (-12.3, -76.9), (-12.1, -76.9), (-12.1, -77.2), (-11.8, -77.2), (-11.8, -77.4)]
_DERIVED: list[tuple[str, str, str, dict[str, int]]] = [
    ("radius", "SELECT c_custkey, distancia(p, POINT(-12.05, -77.04)) AS d FROM customer_places WHERE distancia(p, POINT(-12.05, -77.04)) < 20000", f"SELECT c_custkey, {_hav(-12.05, -77.04)} AS d FROM customer WHERE {_hav(-12.05, -77.04)} < 20000", {"d": 3}),
    ("radius_filtered", "SELECT c_custkey FROM customer_places WHERE distancia(p, POINT(-12.1, -77.1)) <= 40000 AND c_acctbal > 0 AND c_mktsegment = 'BUILDING'", f"SELECT c_custkey FROM customer WHERE {_hav(-12.1, -77.1)} <= 40000 AND c_acctbal > 0 AND c_mktsegment = 'BUILDING'", {}),
    ("knn_point", "SELECT c_custkey, distancia(p, POINT(-12.05, -77.04)) AS d FROM customer_places ORDER BY distancia(p, POINT(-12.05, -77.04)), c_custkey LIMIT 10", f"SELECT c_custkey, {_hav(-12.05, -77.04)} AS d FROM customer ORDER BY d, c_custkey LIMIT 10", {"d": 3}),
    ("knn_euclid", "SELECT c_custkey, distancia(p, POINT(-12, -77), metrica = 'euclidiana') AS d FROM customer_places ORDER BY d, c_custkey LIMIT 10", f"SELECT c_custkey, sqrt(pow({_lat('c_custkey')} + 12, 2) + pow({_lon('c_custkey')} + 77, 2)) AS d FROM customer ORDER BY d, c_custkey LIMIT 10", {"d": 6}),
    ("polygon_concave", "SELECT c_custkey FROM customer_places WHERE intersecta(p, POLYGON(" + ", ".join(map(str, _CORNER)) + "))", f"SELECT c_custkey FROM customer WHERE {_lat('c_custkey')} BETWEEN -12.3 AND -11.8 AND {_lon('c_custkey')} BETWEEN -77.4 AND -76.9 AND ({_lat('c_custkey')} <= -12.1 OR {_lon('c_custkey')} <= -77.2)", {}),
    ("polygon_in", "SELECT c_custkey FROM customer_places WHERE intersecta(p, POLYGON(" + ", ".join(map(str, _SQUARE)) + "))", f"SELECT c_custkey FROM customer WHERE {_lat('c_custkey')} BETWEEN -12.3 AND -11.8 AND {_lon('c_custkey')} BETWEEN -77.4 AND -76.9", {}),
]

# Text. The oracle writes the formulas out over the same A-Z words.

_TERMS = "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), dl AS (SELECT d.doc_id, count(t.term) AS len FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id), st AS (SELECT count(*) AS n, avg(len) AS mean FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"


def _bm25(words: str, k1: str = "12e-1", b: str = "75e-2") -> str:
    listed = ", ".join(f"'{w}'" for w in dict.fromkeys(_split(words)))
    return f"{_TERMS}, s AS (SELECT tf.doc_id, sum(ln(1 + (n - df + 5e-1) / (df + 5e-1)) * ({k1} + 1) * tf / (tf + {k1} * (1 - {b} + {b} * len / mean))) AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id), st WHERE term IN ({listed}) GROUP BY tf.doc_id)"


def _holds(expression: str) -> str:
    return _TERMS + f", f AS (SELECT doc_id, list(term) AS has FROM tf GROUP BY doc_id) SELECT doc_id FROM f WHERE {expression}"


_TEXT: list[tuple[str, str, str, dict[str, int]]] = [
    ("bm25_top", "SELECT doc_id, SCORE() AS score FROM documents WHERE MATCH(text, 'thing other reation') ORDER BY SCORE() DESC, doc_id LIMIT 10", _bm25("thing other reation") + " SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 10", {"score": 6}),
    ("bm25_all", "SELECT doc_id, SCORE() AS score FROM documents WHERE MATCH(text, 'which these ingly')", _bm25("which these ingly") + " SELECT doc_id, score FROM s", {"score": 6}),
    ("bm25_k1b", "SELECT doc_id, SCORE() AS score FROM documents WHERE MATCH(text, 'the tion') USING BM25 WITH (k1 = 2.0, b = 0.5)", _bm25("the tion", "20e-1", "5e-1") + " SELECT doc_id, score FROM s", {"score": 6}),
    ("tfidf_top", "SELECT doc_id, SCORE() AS score FROM documents WHERE MATCH(text, 'that tion for') USING TF_IDF", _TERMS + ", q AS (SELECT term, log10(n / df) AS w FROM df, st WHERE term IN ('that', 'tion', 'for')), z AS (SELECT sqrt(sum(w * w)) AS size FROM q), nrm AS (SELECT doc_id, sqrt(sum(pow(1 + log10(tf), 2))) AS norm FROM tf GROUP BY doc_id) SELECT tf.doc_id, sum((1 + log10(tf)) * w / CASE WHEN size = 0 THEN 1 ELSE size END) / any_value(norm) AS score FROM tf JOIN q USING (term) JOIN nrm USING (doc_id), z GROUP BY tf.doc_id", {"score": 6}),
    ("match_filter", "SELECT doc_id, SCORE() AS score FROM documents WHERE MATCH(text, 'thing') AND lang = 'en' AND n_chars > 500", _bm25("thing") + " SELECT s.doc_id, score FROM s JOIN documents d USING (doc_id) WHERE lang = 'en' AND n_chars > 500", {"score": 6}),
    ("match_group", "SELECT lang, COUNT(*) AS n FROM documents WHERE MATCH(text, 'de la') GROUP BY lang", _bm25("de la") + " SELECT lang, count(*) AS n FROM s JOIN documents d USING (doc_id) GROUP BY lang", {}),
    ("match_join", "SELECT d.doc_id, l.quality, SCORE() AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE MATCH(d.text, 'with from')", _bm25("with from") + " SELECT s.doc_id, l.quality, score FROM s JOIN labels l USING (doc_id)", {"score": 6}),
    ("bool_and_not", "SELECT doc_id FROM documents WHERE MATCH(text, 'the AND that AND NOT for')", _holds("list_contains(has, 'the') AND list_contains(has, 'that') AND NOT list_contains(has, 'for')"), {}),
    ("bool_or", "SELECT doc_id FROM documents WHERE MATCH(text, '(only OR which) AND NOT (these AND this)')", _holds("(list_contains(has, 'only') OR list_contains(has, 'which')) AND NOT (list_contains(has, 'these') AND list_contains(has, 'this'))"), {}),
]


# Operations of the DataFrame interface.


def term_df(spark, sf_dir):
    index = TextIndex.build(table(spark, sf_dir, "documents"), "doc_id", "text", ascii_terms, _split)
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


#: A fixed query vector of 64 parts.
_Q = [((i * 7) % 11 - 5) / 10 for i in range(64)]
_QL = "[" + ", ".join(f"{x}::DOUBLE" for x in _Q) + "]"
_E = "list_transform(embedding, lambda x: x::DOUBLE)"
_COS = f"list_cosine_similarity({_E}, {_QL})"


def _knn(metric, where=None):
    def run(spark, sf_dir):
        df = table(spark, sf_dir, "embeddings")
        return vectors.knn(df.filter(where) if where else df, "embedding", _Q, 10, "vec_id", metric).select("vec_id", F.round("score", 6).alias("score"))

    return run


def knn_sql(spark, sf_dir):
    sql = "SELECT vec_id, SIMILARITY_SCORE() AS score FROM embeddings WHERE SIMILAR_TO(embedding, $1, k = 5) AND label <> 2 USING HNSW WITH (metric = cosine, ef_search = 40)"
    return rounded(engine(spark, sf_dir, sql).sql(sql, [_Q]), {"score": 6})


def knn_join_after(spark, sf_dir):
    near = vectors.knn(table(spark, sf_dir, "embeddings"), "embedding", _Q, 50, "vec_id")
    return near.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), F.col("vec_id") == F.col("doc_id")).filter("lang = 'en'").select("vec_id", F.round("score", 6).alias("score"))


_QUERIES = [(n, [((i * n) % 13 - 6) / 10 for i in range(1, 65)]) for n in (3, 5, 7)]


def knn_batch(spark, sf_dir):
    return rounded(vectors.knn_batch(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", _QUERIES, 5), {"score": 6})


def class_centroid(spark, sf_dir):
    means = vectors.mean_vector(table(spark, sf_dir, "embeddings"), "embedding", ["label"])
    return means.select("label", F.posexplode("mean").alias("i", "v")).withColumn("v", F.round("v", 5))


def ivf_recall(spark, sf_dir):
    """Share of the exact ten neighbours of every row whose id 100 divides that a search finds, by the
    lists it looks into: their square root first, doubled until the recall is 0.9 or more."""
    df = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL").select("vec_id", vectors.unit(F.col("embedding")).alias("v"))
    lists = vectors.list_count(df.count())
    centres = vectors.kmeans(df, "v", lists)
    at = vectors.neighbour_ranks(df, "v", "vec_id", centres).groupBy("list_rank").agg(F.count(F.lit(1)).alias("n"), F.collect_set("query_id").alias("q")).collect()
    total, asked, probes, rows = sum(r.n for r in at), len({i for r in at for i in r.q}), vectors.probe_count(len(centres)), []
    while total:
        rows.append((len(centres), probes, asked, sum(r.n for r in at if r.list_rank < probes) / total))
        if rows[-1][3] >= 0.9:
            break
        probes = min(2 * probes, len(centres))
    return spark.createDataFrame(rows, "lists int, probes int, queries int, recall double")


def rrf_hybrid(spark, sf_dir):
    index = text_index(spark, sf_dir)["text"]
    words = index.bm25("thing other").orderBy(F.desc("score"), "doc_id").limit(50)
    near = vectors.knn(table(spark, sf_dir, "embeddings"), "embedding", _Q, 50, "vec_id").select(F.col("vec_id").alias("doc_id"), "score")
    return rounded(service.rrf([(words, 1.0), (near, 1.0)], "doc_id"), {"score": 8})


def minmax_fusion(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    sold = li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("value")).select(F.lit("sold").alias("signal"), F.col("l_partkey").alias("part"), "value")
    price = table(spark, sf_dir, "part").select(F.lit("price").alias("signal"), F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("value"))
    return rounded(service.minmax_fusion(sold.union(price), "part", {"sold": 0.7, "price": 0.3}), {"score": 6})


def copurchase_pairs(spark, sf_dir):
    return service.copurchase(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 2)


def copurchase_top_n(spark, sf_dir):
    return service.copurchase(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 1, 3)


_PAIRS = "WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), c AS (SELECT a.l_partkey, b.l_partkey AS other, count(*) AS times FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY ALL)"


def leave_last_out(spark, sf_dir):
    return service.leave_last_out(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"]).select("event_id", "split")


def user_history(spark, sf_dir):
    return service.history(table(spark, sf_dir, "events"), "user_id", "event_type", "ts").select("user_id", "event_type", "place")


def stock_nearby(spark, sf_dir):
    stores = places(spark, sf_dir, "supplier", "s_suppkey")
    here = F.struct(F.lit(-12.05).alias("lat"), F.lit(-77.04).alias("lon"))
    near = stores.withColumn("m", geo.distance(F.col("p"), here)).filter(geo.near_box(F.col("p"), -12.05, -77.04, 60000) & (F.col("m") < 60000))
    stock = table(spark, sf_dir, "lineitem").join(near.select("s_suppkey", "m"), F.col("l_suppkey") == F.col("s_suppkey"))
    best = stock.groupBy("l_partkey").agg(F.min(F.struct("m", "s_suppkey")).alias("b"))
    return best.select("l_partkey", F.col("b.s_suppkey").alias("s_suppkey"), F.round(1 - F.col("b.m") / 60000, 6).alias("score"))


def segment_windows(spark, sf_dir):
    songs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 20).alias("seconds"))
    return service.windows(songs, "seconds", 10.0, 5.0).select("doc_id", "window", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


def offset_votes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", (F.col("event_id") % 40).alias("there"), (F.col("event_id") % 7).alias("here"))
    return service.offset_votes(e, ["user_id", "event_type"], "there", "here", 1.0)


def length_histogram(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.floor(F.col("n_chars") / 500).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def length_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n_chars)").alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.99)])


def hit_ndcg(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    ranked = e.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))).withColumn("hit", F.col("rank") == F.col("user_id") % 15 + 1)
    return rounded(service.ranking_metrics(ranked, "user_id", "hit", "rank"), {"hit_at_k": 6, "ndcg_at_k": 6, "mrr_at_k": 6})


def best_threshold(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.floor("value").alias("score"), (F.col("event_type") == "click").alias("truth"))
    return service.best_threshold(e, "score", "truth").select("score", "tp", "taken", F.round("accuracy", 6).alias("accuracy"))


def chunk_docs(spark, sf_dir):
    return service.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


def spell_fix(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(ascii_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("freq")).filter("freq >= 2")
    asked = words.select(F.concat(F.col("term"), F.lit("x")).alias("word"))
    return service.spell(asked, words)


def citation_counts(spark, sf_dir):
    text = F.concat(F.col("text"), F.lit(" [1, 3] and ["), (F.col("doc_id") % 9).cast("string"), F.lit("]"))
    return table(spark, sf_dir, "documents").select(F.explode(service.citations(text)).alias("cited")).groupBy("cited").agg(F.count(F.lit(1)).alias("n"))


def systematic_sample(spark, sf_dir):
    return every_nth(places(spark, sf_dir), "c_custkey", 300).select("c_custkey", F.round("p.lat", 6).alias("lat"))


def weighted_sample(spark, sf_dir):
    return service.weighted_sample(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_custkey", 3, 11).select("c_nationkey", "c_custkey", "place")


def resemblance(spark, sf_dir):
    near = table(spark, sf_dir, "events").select((F.col("event_id") % 9).alias("shot"), F.col("user_id").alias("person"), (F.col("value") / 100).alias("score"))
    return rounded(media.resemblance(near, "shot", "person", "score"), {"score": 6})


def class_medoid(spark, sf_dir):
    return media.medoids(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def bag_of_words(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("obj"), (F.col("l_partkey") % 64).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(media.bag_tf_idf(counts, "obj", "word", "n"), {"weight": 6})


def media_fragments(spark, sf_dir):
    part = F.concat(F.lit("song"), F.col("doc_id").cast("string"), F.lit(".mp3#t="), (F.col("doc_id") % 50).cast("string"), F.lit(","), F.lit("1:"), F.lpad((F.col("doc_id") % 60).cast("string"), 2, "0"))
    return table(spark, sf_dir, "documents").select("doc_id", media.fragment(part).alias("f")).select("doc_id", "f.path", "f.begin", F.col("f.end").alias("stop"))


def window_loudness(spark, sf_dir):
    blocks = table(spark, sf_dir, "events").select("user_id", (F.pmod(F.col("event_id"), F.lit(97)) * 0.1).alias("start"), (F.abs("value") / 1000).alias("power"))
    return rounded(media.loudness(blocks, "user_id", "start", "power", 2.0, 1.0), {"dbfs": 4})


def box_tracks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    boxes = e.select((F.col("user_id") % 20).alias("session"), F.floor(F.col("event_id") / 20).cast("double").alias("ts"), (F.col("event_id") % 5 * 8.0).alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"))
    return media.track(boxes, "session", "ts", lost_seconds=30.0)


def lang_guess(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(language.guess_language(F.col("text")).alias("guess"), "lang").groupBy("guess", "lang").agg(F.count(F.lit(1)).alias("n"))


def roc_auc(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.floor("value").alias("score"), (F.col("event_type") == "click").alias("truth"))
    return rounded(evaluation.auc(e, "score", "truth").select("auc"), {"auc": 6})


def tar_at_far(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.floor("value").alias("score"), (F.col("event_type") == "click").alias("truth"))
    return rounded(evaluation.tar_at_far(e, "score", "truth", 0.1), {"tar": 6})


def rater_kappa(spark, sf_dir):
    return rounded(evaluation.kappa(table(spark, sf_dir, "labels"), "quality", "toxic"), {"kappa": 6})


def weight_search(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    c = e.groupBy("user_id", "event_type").agg(F.avg("value").alias("a"), F.count(F.lit(1)).cast("double").alias("b")).withColumn("hit", F.col("event_type") == "click")
    return rounded(evaluation.best_weights(c, "user_id", "event_type", "hit", ["a", "b"], 4, 2), {"ndcg": 6, "hit_rate": 6})


def clean_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n\n"), lambda p: F.concat(F.lit("Header\n"), p)).alias("pages"))
    return language.cleaned(docs, "doc_id", "pages")


def filtered_hybrid(spark, sf_dir):
    """Texts are filtered before they are ranked, vectors after 500 candidates."""
    wanted = table(spark, sf_dir, "documents").filter("lang IN ('en', 'de')").select("doc_id")
    words = text_index(spark, sf_dir)["text"].bm25("thing other").join(wanted, "doc_id", "left_semi").orderBy(F.desc("score"), "doc_id").limit(50)
    near = vectors.knn(table(spark, sf_dir, "embeddings"), "embedding", _Q, 500, "vec_id").select(F.col("vec_id").alias("doc_id"), "score")
    near = near.join(wanted, "doc_id", "left_semi").orderBy(F.desc("score"), "doc_id").limit(50)
    return rounded(service.rrf([(words, 1.0), (near, 1.0)], "doc_id"), {"score": 8})


def over_fetch(spark, sf_dir):
    near = vectors.knn(table(spark, sf_dir, "embeddings"), "embedding", _Q, 40, "vec_id")
    kept = near.join(table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id"), F.col("vec_id") == F.col("doc_id"))
    return kept.orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", F.round("score", 6).alias("score"))


def _owned(spark, sf_dir):
    bought = table(spark, sf_dir, "orders").filter("o_custkey % 100 = 0").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return bought.select("o_custkey", "l_partkey").distinct()


def copurchase_for_user(spark, sf_dir):
    """For each customer whose key 100 divides."""
    pairs = service.copurchase(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    return service.copurchase_for(pairs, _owned(spark, sf_dir), "o_custkey", "l_partkey")


def fused_signals(spark, sf_dir):
    """Sales and prices, a third signal without rows, nearness as a boost, one brand left out."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    sold = li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("value")).select(F.lit("sold").alias("signal"), F.col("l_partkey").alias("part"), "value")
    price = part.filter("p_partkey % 2 = 0").select(F.lit("price").alias("signal"), F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("value"))
    near = part.filter("p_partkey % 3 = 0").select(F.lit("near").alias("signal"), F.col("p_partkey").alias("part"), (F.col("p_partkey") % 10 / 10).alias("value"))
    gone = part.filter("p_partkey % 7 = 0").select(F.col("p_partkey").alias("part"))
    return rounded(service.fused_signals(sold.union(price).union(near), "part", {"sold": 0.5, "price": 0.2, "history": 0.3}, {"near": 0.1}, gone), {"score": 6})


def run_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 12).alias("w"), (F.pmod(F.col("event_id"), F.lit(31)) / 30.0).alias("s"), (F.col("user_id") % 9 + 1).alias("u"), (F.col("event_id") % 5 + 2).alias("o"))
    return e.select("event_id", F.round(service.run_score(F.col("w"), F.col("s")), 6).alias("score"), F.round(service.coverage(F.col("w"), F.col("u"), F.col("o")), 6).alias("coverage"))


def recommender_use(spark, sf_dir):
    top = service.copurchase(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 1, 3).select(F.col("other").alias("l_partkey"))
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("times"))
    catalogue = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
    return rounded(evaluation.catalogue_use(top, catalogue, sold, "l_partkey", "times"), {"coverage": 6, "popularity": 6})


def bootstrap(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg((F.col("event_type") == "click").cast("double")).alias("hit"))
    return rounded(evaluation.bootstrap_means(per, "user_id", "hit", 50), {"mean": 6})


def identification(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("value", (F.col("event_id") % 3 > 0).alias("mated"), (F.col("event_type") == "click").alias("right"))
    return rounded(evaluation.identification(e, "value", "mated", "right", 50.0), {"rank_1": 6, "fnir": 6, "fpir": 6})


def detection(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("value") > 40).alias("found"), (F.col("event_type") == "click").alias("truth"))
    return rounded(evaluation.detection(e, "found", "truth"), {"precision": 6, "recall": 6, "f1": 6})


def interval_overlap(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", *[(F.col("event_id") % m).cast("double").alias(c) for m, c in ((11, "a"), (7, "b"))])
    return e.select("event_id", F.round(evaluation.interval_iou((F.col("a"), F.col("a") + 4), (F.col("b"), F.col("b") + 3)), 6).alias("iou"))


def roc_continuous(spark, sf_dir):
    """Scores as they are, nearly all distinct."""
    e = table(spark, sf_dir, "events").select(F.col("value").alias("score"), (F.col("event_type") == "click").alias("truth"))
    return rounded(evaluation.auc(e, "score", "truth").select("auc"), {"auc": 6})


def null_keys(spark, sf_dir):
    """Null keys meet nothing, and outer joins keep them."""
    e = Engine(spark)
    e.register("a", table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("k")))
    e.register("b", table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("k")))
    return e.sql("SELECT a.o_orderkey, b.c_custkey FROM a FULL JOIN b ON a.k = b.k")


def date_text(spark, sf_dir):
    e = Engine(spark)
    e.register("o", table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")))
    return e.sql("SELECT o_orderkey FROM o WHERE d >= '1996-01-10' AND d < '1996-03-01' AND NOT d = '1996-02-03'")


def write_path(spark, sf_dir):
    """A table that is made, filled, changed, cut and rolled back, and read."""
    e = Engine(spark)
    e.sql("CREATE TABLE w (id INT PRIMARY KEY, n INT, x FLOAT, s VARCHAR(8))")
    e.sql("INSERT INTO w VALUES " + ", ".join(f"({i}, {i % 7}, {i * 0.5}, 's{i % 4}')" for i in range(1, 61)))
    e.sql("INSERT INTO w (id, s) VALUES (61, 'new'), (62, NULL)")
    e.sql("UPDATE w SET n = n + 10, x = NULL WHERE s = 's1'")
    e.sql("DELETE FROM w WHERE n = 3 OR id > 61")
    e.sql("BEGIN")
    e.sql("DELETE FROM w WHERE id > 0")
    e.sql("ROLLBACK")
    return e.sql("SELECT id, n, x, s FROM w")


_FRAME: dict[str, tuple[Callable, str | None]] = {
    "term_df": (term_df, _TERMS + " SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY term"),
    "knn_cosine": (_knn("cosine"), f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10"),
    "knn_dot": (_knn("dot"), f"SELECT vec_id, round(list_inner_product({_E}, {_QL}), 6) AS score FROM embeddings ORDER BY list_inner_product({_E}, {_QL}) DESC, vec_id LIMIT 10"),
    "knn_l2": (_knn("euclidean"), f"SELECT vec_id, round(1 / (1 + list_distance({_E}, {_QL})), 6) AS score FROM embeddings ORDER BY list_distance({_E}, {_QL}), vec_id LIMIT 10"),
    "knn_filtered": (_knn("cosine", "label < 4"), f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings WHERE label < 4 ORDER BY {_COS} DESC, vec_id LIMIT 10"),
    "knn_sql": (knn_sql, f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings WHERE label <> 2 ORDER BY {_COS} DESC, vec_id LIMIT 5"),
    "knn_join_after": (knn_join_after, f"WITH n AS (SELECT vec_id, {_COS} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 50) SELECT vec_id, round(s, 6) AS score FROM n JOIN documents ON vec_id = doc_id WHERE lang = 'en'"),
    "knn_batch": (knn_batch, "WITH q(query_id, v) AS (VALUES " + ", ".join(f"({n}, [{', '.join(f'{x}::DOUBLE' for x in v)}])" for n, v in _QUERIES) + f"), s AS (SELECT query_id, vec_id, list_cosine_similarity({_E}, v) AS score FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT CAST(query_id AS INTEGER) AS query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"),
    "class_centroid": (class_centroid, "WITH u AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS v FROM u GROUP BY ALL) SELECT label, CAST(i AS INTEGER) AS i, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 5) AS v FROM m"),
    "ivf_recall": (ivf_recall, None),
    "rrf_hybrid": (rrf_hybrid, _bm25("thing other") + f", w AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 50), n AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 50) SELECT doc_id, round(sum(1e0 / (60 + rank)), 8) AS score, CAST(min(rank) AS INTEGER) AS best_rank FROM (SELECT * FROM w UNION ALL SELECT * FROM n) GROUP BY doc_id"),
    "minmax_fusion": (minmax_fusion, "WITH s AS (SELECT 'sold' AS g, l_partkey AS part, sum(l_quantity) AS v FROM lineitem GROUP BY l_partkey UNION ALL SELECT 'price', p_partkey, p_retailprice FROM part), b AS (SELECT g, min(v) AS lo, max(v) AS hi FROM s GROUP BY g) SELECT part, round(sum(CASE WHEN g = 'sold' THEN 7e-1 ELSE 3e-1 END * CASE WHEN hi = lo THEN 1 ELSE (v - lo) / (hi - lo) END), 6) AS score FROM s JOIN b USING (g) GROUP BY part"),
    "copurchase_pairs": (copurchase_pairs, _PAIRS + " SELECT * FROM c WHERE times >= 2"),
    "copurchase_top_n": (copurchase_top_n, _PAIRS + " SELECT *, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY times DESC, other) AS INTEGER) AS rank FROM c QUALIFY rank <= 3"),
    "leave_last_out": (leave_last_out, "SELECT event_id, CASE row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) WHEN 1 THEN 'test' WHEN 2 THEN 'valid' ELSE 'train' END AS split FROM events"),
    "user_history": (user_history, "WITH l AS (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY ALL) SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last DESC, event_type) AS INTEGER) AS place FROM l"),
    "stock_nearby": (stock_nearby, f"WITH n AS (SELECT s_suppkey, {_hav(-12.05, -77.04, 's_suppkey')} AS m FROM supplier), b AS (SELECT l_partkey, min((m, s_suppkey)) AS b FROM lineitem JOIN n ON l_suppkey = s_suppkey WHERE m < 60000 GROUP BY l_partkey) SELECT l_partkey, b[2] AS s_suppkey, round(1 - b[1] / 60000, 6) AS score FROM b"),
    "segment_windows": (segment_windows, "WITH s AS (SELECT doc_id, n_chars / 20 AS d FROM documents), w AS (SELECT doc_id, d, unnest(range(0, greatest(CAST(floor((d - 10) / 5) AS BIGINT) + 1, 1))) AS w FROM s) SELECT doc_id, w AS \"window\", round(w * 5e0, 4) AS start, round(least(w * 5e0 + 10, d), 4) AS \"end\" FROM w"),
    "offset_votes": (offset_votes, "WITH v AS (SELECT user_id, event_type, (event_id % 40) - (event_id % 7) AS o FROM events), n AS (SELECT user_id, event_type, o + unnest([-1, 0, 1]) AS o FROM v), c AS (SELECT user_id, event_type, o, count(*) AS votes FROM n GROUP BY ALL) SELECT user_id, event_type, CAST(o AS BIGINT) AS \"offset\", votes FROM c QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY votes DESC, o) = 1"),
    "length_histogram": (length_histogram, "SELECT CAST(floor(n_chars / 500) AS BIGINT) AS bin, count(*) AS n FROM documents GROUP BY 1"),
    "length_percentiles": (length_percentiles, "SELECT " + ", ".join(f"quantile_disc(n_chars, {p}) AS p{int(p * 100)}" for p in (0.5, 0.9, 0.99)) + " FROM documents"),
    "hit_ndcg": (hit_ndcg, "WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events), h AS (SELECT user_id, max(CASE WHEN k = user_id % 15 + 1 AND k <= 10 THEN k END) AS k FROM r GROUP BY user_id) SELECT round(avg(CASE WHEN k IS NULL THEN 0e0 ELSE 1e0 END), 6) AS hit_at_k, round(avg(coalesce(1 / log2(k + 1), 0)), 6) AS ndcg_at_k, round(avg(coalesce(1e0 / k, 0)), 6) AS mrr_at_k FROM h"),
    "best_threshold": (best_threshold, "WITH a AS (SELECT CAST(floor(value) AS BIGINT) AS score, count(*) FILTER (WHERE event_type = 'click') AS p, count(*) AS n FROM events GROUP BY 1), t AS (SELECT sum(p) AS sp, sum(n) AS sn FROM a), r AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS taken FROM a) SELECT score, CAST(tp AS BIGINT) AS tp, CAST(taken AS BIGINT) AS taken, round((tp + (sn - sp - (taken - tp))) / sn, 6) AS accuracy FROM r, t"),
    "chunk_docs": (chunk_docs, None),
    "spell_fix": (spell_fix, None),
    "citation_counts": (citation_counts, "WITH c AS (SELECT unnest(regexp_extract_all(text || ' [1, 3] and [' || doc_id % 9 || ']', '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1)) AS g FROM documents), n AS (SELECT CAST(trim(unnest(string_split(g, ','))) AS INTEGER) AS cited FROM c) SELECT cited, count(*) AS n FROM n GROUP BY cited"),
    "systematic_sample": (systematic_sample, f"WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) SELECT c_custkey, round({_lat('c_custkey')}, 6) AS lat FROM r WHERE i % CAST(ceil(n / 300e0) AS BIGINT) = 0"),
    "weighted_sample": (weighted_sample, None),
    "resemblance": (resemblance, "WITH b AS (SELECT event_id % 9 AS shot, user_id AS person, max(value / 100) AS s FROM events GROUP BY ALL), f AS (SELECT shot, min(s) AS floor FROM b GROUP BY shot), p AS (SELECT DISTINCT person FROM b) SELECT p.person, round(avg(coalesce(b.s, f.floor)), 6) AS score FROM p CROSS JOIN f LEFT JOIN b ON b.shot = f.shot AND b.person = p.person GROUP BY p.person"),
    "class_medoid": (class_medoid, "WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS v FROM u GROUP BY ALL), l AS (SELECT label, list(v ORDER BY i) AS v FROM m GROUP BY label) SELECT label, arg_min(vec_id, (-round(list_cosine_similarity(" + _E + ", v), 9), vec_id)) AS vec_id FROM embeddings JOIN l USING (label) GROUP BY label"),
    "bag_of_words": (bag_of_words, "WITH c AS (SELECT l_orderkey AS obj, l_partkey % 64 AS word, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT count(DISTINCT obj) AS t FROM c) SELECT obj, word, round(n / sum(n) OVER (PARTITION BY obj) * ln(t / count(*) OVER (PARTITION BY word)), 6) AS weight FROM c, t"),
    "media_fragments": (media_fragments, "SELECT doc_id, 'song' || doc_id || '.mp3' AS path, CAST(doc_id % 50 AS DOUBLE) AS begin, CAST(60 + doc_id % 60 AS DOUBLE) AS stop FROM documents"),
    "window_loudness": (window_loudness, "WITH b AS (SELECT user_id, event_id % 97 AS k, abs(value) / 1000 AS p FROM events), w AS (SELECT user_id, unnest(range(greatest(0, k // 10 - 1), k // 10 + 1)) AS w, p FROM b), m AS (SELECT user_id, w, avg(p) AS p FROM w GROUP BY ALL), d AS (SELECT user_id, w, CASE WHEN p <= 1e-12 THEN -120e0 ELSE greatest(-120e0, 10 * log10(p)) END AS d FROM m) SELECT user_id, w AS \"window\", round(d, 4) AS dbfs, d < -50 AS silent FROM d"),
    "box_tracks": (box_tracks, None),
    "lang_guess": (lang_guess, "WITH w AS (SELECT lang, lower(text) AS t, regexp_extract_all(lower(text), '[\\p{L}]+') AS ws FROM documents), c AS (SELECT lang, len(list_filter(ws, lambda x: x IN (" + ", ".join(f"'{w}'" for w in language.ENGLISH) + "))) AS en, len(list_filter(ws, lambda x: x IN (" + ", ".join(f"'{w}'" for w in language.SPANISH) + "))) + len(regexp_extract_all(t, '[ñáéíóúü¿¡]')) AS es FROM w) SELECT CASE WHEN en > es THEN 'en' WHEN es > en THEN 'es' ELSE 'unknown' END AS guess, lang, count(*) AS n FROM c GROUP BY ALL"),
    "roc_auc": (roc_auc, "WITH a AS (SELECT CAST(floor(value) AS BIGINT) AS s, count(*) FILTER (WHERE event_type = 'click') AS p, count(*) FILTER (WHERE event_type <> 'click') AS q FROM events GROUP BY 1), c AS (SELECT p, q, sum(p) OVER (ORDER BY s DESC) AS up FROM a) SELECT round(sum(q * (up - p / 2)) / (sum(p) * sum(q)), 6) AS auc FROM c"),
    "tar_at_far": (tar_at_far, "WITH a AS (SELECT CAST(floor(value) AS BIGINT) AS s, count(*) FILTER (WHERE event_type = 'click') AS p, count(*) FILTER (WHERE event_type <> 'click') AS q FROM events GROUP BY 1), c AS (SELECT sum(p) OVER (ORDER BY s DESC) / sum(p) OVER () AS tpr, sum(q) OVER (ORDER BY s DESC) / sum(q) OVER () AS fpr FROM a) SELECT round(coalesce(max(tpr), 0), 6) AS tar FROM c WHERE fpr <= 1e-1"),
    "rater_kappa": (rater_kappa, "WITH t AS (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1e0 ELSE 0 END) AS o, avg(quality) AS a, avg(toxic) AS b FROM labels) SELECT round((o - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) AS kappa FROM t"),
    "filtered_hybrid": (filtered_hybrid, _bm25("thing other") + f", ok AS (SELECT doc_id FROM documents WHERE lang IN ('en', 'de')), w AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s SEMI JOIN ok USING (doc_id) QUALIFY rank <= 50), c AS (SELECT vec_id AS doc_id, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 500), n AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c SEMI JOIN ok USING (doc_id) QUALIFY rank <= 50) SELECT doc_id, round(sum(1e0 / (60 + rank)), 8) AS score, CAST(min(rank) AS INTEGER) AS best_rank FROM (SELECT * FROM w UNION ALL SELECT * FROM n) GROUP BY doc_id"),
    "over_fetch": (over_fetch, f"WITH n AS (SELECT vec_id, {_COS} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 40) SELECT vec_id, round(s, 6) AS score FROM n JOIN documents ON vec_id = doc_id WHERE lang = 'en' ORDER BY s DESC, vec_id LIMIT 10"),
    "copurchase_for_user": (copurchase_for_user, _PAIRS + ", o AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey % 100 = 0) SELECT o_custkey, other, CAST(sum(times) AS BIGINT) AS times, count(*) AS items FROM o JOIN c USING (l_partkey) WHERE NOT EXISTS (SELECT 1 FROM o AS x WHERE x.o_custkey = o.o_custkey AND x.l_partkey = c.other) GROUP BY ALL"),
    "fused_signals": (fused_signals, "WITH s AS (SELECT 'sold' AS g, l_partkey AS part, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY l_partkey UNION ALL SELECT 'price', p_partkey, p_retailprice FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'near', p_partkey, (p_partkey % 10) / 1e1 FROM part WHERE p_partkey % 3 = 0), k AS (SELECT * FROM s WHERE part % 7 <> 0), b AS (SELECT g, min(v) AS lo, max(v) AS hi FROM k WHERE g <> 'near' GROUP BY g) SELECT part, round(sum(CASE g WHEN 'near' THEN v * 1e-1 ELSE (CASE g WHEN 'sold' THEN 5e-1 ELSE 2e-1 END) / 7e-1 * CASE WHEN hi = lo THEN 1 ELSE (v - lo) / (hi - lo) END END), 6) AS score, count(*) FILTER (WHERE g <> 'near') AS signals FROM k LEFT JOIN b USING (g) GROUP BY part HAVING count(*) FILTER (WHERE g <> 'near') > 0"),
    "run_scores": (run_scores, "SELECT event_id, round(least(1e0, (event_id % 12) / 7e0) * greatest(0e0, least(1e0, ((event_id % 31) / 30e0 - 85e-2) / 15e-2)), 6) AS score, round(least(1e0, (event_id % 12) / CAST(greatest(least(user_id % 9 + 1, event_id % 5 + 2), 1) AS DOUBLE)), 6) AS coverage FROM events"),
    "recommender_use": (recommender_use, _PAIRS + ", r AS (SELECT other FROM c QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY times DESC, other) <= 3), n AS (SELECT l_partkey, count(*) AS k FROM lineitem GROUP BY 1) SELECT round((SELECT count(DISTINCT other) FROM r SEMI JOIN part ON p_partkey = other) / (SELECT count(*) FROM part), 6) AS coverage, round(avg(CAST(coalesce(k, 0) AS DOUBLE)), 6) AS popularity FROM r LEFT JOIN n ON n.l_partkey = r.other"),
    "bootstrap": (bootstrap, "WITH p AS (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN 1e0 ELSE 0 END) AS hit FROM events GROUP BY 1), u AS (SELECT hit, CAST(b AS INTEGER) AS round, CAST('0x' || substr(md5(user_id || ':' || b || ':7'), 1, 8) AS BIGINT) / 4294967296e0 AS u FROM p, range(50) AS r(b)), w AS (SELECT round, hit, " + " + ".join(f"CASE WHEN u >= {edge!r}::DOUBLE THEN 1 ELSE 0 END" for edge in evaluation.POISSON) + " AS w FROM u) SELECT round, round(sum(w * hit) / greatest(sum(w), 1), 6) AS mean FROM w GROUP BY round"),
    "identification": (identification, "WITH e AS (SELECT value AS v, event_id % 3 > 0 AS m, event_type = 'click' AS r FROM events) SELECT round(count(*) FILTER (WHERE m AND r) / count(*) FILTER (WHERE m), 6) AS rank_1, round(count(*) FILTER (WHERE m AND NOT (r AND v >= 50)) / count(*) FILTER (WHERE m), 6) AS fnir, round(count(*) FILTER (WHERE NOT m AND v >= 50) / count(*) FILTER (WHERE NOT m), 6) AS fpir FROM e"),
    "detection": (detection, "WITH e AS (SELECT value > 40 AS f, event_type = 'click' AS t FROM events), n AS (SELECT count(*) FILTER (WHERE f AND t) AS tp, count(*) FILTER (WHERE f) AS p, count(*) FILTER (WHERE t) AS t FROM e) SELECT round(CASE WHEN p = 0 THEN 0 ELSE tp / p END, 6) AS precision, round(CASE WHEN t = 0 THEN 0 ELSE tp / t END, 6) AS recall, round(CASE WHEN p + t = 0 THEN 0 ELSE 2 * tp / (p + t) END, 6) AS f1 FROM n"),
    "interval_overlap": (interval_overlap, "WITH e AS (SELECT event_id, event_id % 11 AS a, event_id % 7 AS b FROM events), i AS (SELECT event_id, greatest(0, least(a + 4, b + 3) - greatest(a, b)) AS i FROM e) SELECT event_id, round(i / CAST(7 - i AS DOUBLE), 6) AS iou FROM i"),
    "roc_continuous": (roc_continuous, "WITH a AS (SELECT value AS s, count(*) FILTER (WHERE event_type = 'click') AS p, count(*) FILTER (WHERE event_type <> 'click') AS q FROM events GROUP BY 1), c AS (SELECT p, q, sum(p) OVER (ORDER BY s DESC) AS up FROM a) SELECT round(sum(q * (up - p / 2)) / (sum(p) * sum(q)), 6) AS auc FROM c"),
    "null_keys": (null_keys, "WITH a AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS k FROM orders), b AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS k FROM customer) SELECT a.o_orderkey, b.c_custkey FROM a FULL JOIN b ON a.k = b.k"),
    "date_text": (date_text, "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-10' AND CAST(o_orderdate AS DATE) < DATE '1996-03-01' AND CAST(o_orderdate AS DATE) <> DATE '1996-02-03'"),
    "write_path": (write_path, "WITH t AS (SELECT i AS id, CASE WHEN i <= 60 THEN i % 7 END AS n, CASE WHEN i <= 60 THEN i * 5e-1 END AS x, CASE WHEN i <= 60 THEN 's' || (i % 4) WHEN i = 61 THEN 'new' END AS s FROM range(1, 63) AS r(i)), u AS (SELECT id, CASE WHEN s = 's1' THEN n + 10 ELSE n END AS n, CASE WHEN s = 's1' THEN NULL ELSE x END AS x, s FROM t) SELECT * FROM u WHERE NOT (coalesce(n = 3, false) OR id > 61)"),
    "weight_search": (weight_search, None),
    "clean_pages": (clean_pages, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _dialect(sql, digits) for name, sql, digits in _SAME}
    found |= {name: _dialect(sql, digits) for name, sql, _, digits in _DERIVED + _TEXT}
    return found | {name: f for name, (f, _) in _FRAME.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: _oracle(sql, digits) for name, sql, digits in _SAME}
    found |= {name: _oracle(sql, digits) for name, _, sql, digits in _DERIVED + _TEXT}
    return found | {name: sql for name, (_, sql) in _FRAME.items() if sql}
