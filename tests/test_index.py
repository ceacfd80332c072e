"""Stored inverted indexes, loads, writes and finite reals."""

import random

import pytest

from tesela.operators.search import TextIndex, analyse, fold
from tesela.plans.engine import Engine
from tesela.plans.syntax import SqlError


def test_marks_go_by_category_and_hangul_stays():
    assert fold("한국어 ÉTÉ ñandú ก็") == "한국어 ete ñandu ก"
    assert analyse("가나다라마바사아자차카타파하거") == ["가나다라마바사아자차카타파하거"]
    assert analyse("हिन्दी Straße") == [*analyse("हिन्दी"), "strasse"]


@pytest.mark.parametrize("query", ["casa perro", "casa AND NOT gato", "NOT casa OR perro", "(uno OR dos) AND tres", "nada", "casa OR NOT nada", "uno uno dos"])
@pytest.mark.parametrize("method", ["BM25", "TF_IDF"])
def test_stored_index_scores_like_the_texts(spark, query, method):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["uno", "dos", "tres", "casa", "perro", "gato", "Ñandú"], k=rng.randint(0, 12))) for _ in range(60)] + [None, ""]
    index = TextIndex.build(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")
    want = {r.id: r.score for r in index.match(query, method).collect()}
    assert {r.id: r.score for r in index.stored().match(query, method).collect()} == pytest.approx(want)


def test_a_write_makes_the_index_anew(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE d (id INT PRIMARY KEY, x TEXT)")
    e.sql("INSERT INTO d VALUES (1, 'uno dos'), (2, 'dos')")
    e.sql("CREATE INDEX i ON d USING INVERTED (x)")
    assert [r.id for r in e.sql("SELECT id FROM d WHERE MATCH(x, 'uno')").collect()] == [1]
    e.sql("INSERT INTO d VALUES (3, 'uno')")
    assert sorted(r.id for r in e.sql("SELECT id FROM d WHERE MATCH(x, 'uno')").collect()) == [1, 3]
    e.sql("BEGIN")
    e.sql("DELETE FROM d WHERE id = 1")
    assert [r.id for r in e.sql("SELECT id FROM d WHERE MATCH(x, 'uno')").collect()] == [3]
    e.sql("ROLLBACK")
    assert sorted(r.id for r in e.sql("SELECT id FROM d WHERE MATCH(x, 'uno')").collect()) == [1, 3]


def test_load_is_all_or_nothing(spark, tmp_path):
    e, good, twice, empty = Engine(spark), tmp_path / "g.csv", tmp_path / "t.csv", tmp_path / "e.csv"
    good.write_text("id,s\n1,a\n2,b\n")
    twice.write_text("id,s\n1,a\n1,b\n")
    empty.write_text("id,s\n1,a\n,b\n")
    e.sql(f"CREATE TABLE g FROM FILE '{good}' USING INDEX BTREE (id)")
    for path in (twice, empty):
        with pytest.raises(SqlError):
            e.sql(f"CREATE TABLE t FROM FILE '{path}' USING INDEX BTREE (id)")
        assert "t" not in e.tables
    e.sql(f"CREATE TABLE IF NOT EXISTS g FROM FILE '{twice}'")  # the table stays
    assert [tuple(r) for r in e.sql("SELECT id, s FROM g ORDER BY id").collect()] == [(1, "a"), (2, "b")]
    with pytest.raises(SqlError):
        e.sql(f"CREATE TABLE g FROM FILE '{good}'")
    with pytest.raises(SqlError):
        e.sql("INSERT INTO g VALUES (2, 'again')")


def test_many_rows_at_once_and_unique_nulls(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE t (id INT PRIMARY KEY, u INT UNIQUE)")
    assert e.sql("INSERT INTO t VALUES " + ", ".join(f"({i}, NULL)" for i in range(200))) == 200
    assert e.table("t").df.count() == 200 and e.table("t").df.rdd.getNumPartitions() <= 16
    e.sql("UPDATE t SET u = 7 WHERE id = 3")
    with pytest.raises(SqlError, match="twice"):
        e.sql("UPDATE t SET u = 7 WHERE id = 4")


def test_reals_are_finite(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE t (id INT PRIMARY KEY, d FLOAT)")
    e.sql("INSERT INTO t VALUES (1, 2.0), (2, NULL)")
    assert [r.x for r in e.sql("SELECT d * 3 AS x FROM t ORDER BY id").collect()] == [6.0, None]
    with pytest.raises(Exception, match="not finite"):
        e.sql("SELECT d * 1e308 * 10 AS x FROM t").collect()
