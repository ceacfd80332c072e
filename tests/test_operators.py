"""Sources, text analysis, and the service operators against small computations by hand."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesela.functions import geo, vectors
from tesela.operators import language, media, service
from tesela.operators.search import TextIndex, analyse, fold, parse_boolean
from tesela.sources.loader import read_csv, read_ndjson
from tesela.streaming.ingest import append_to, stream_ndjson


def test_fold_and_analyse():
    assert fold("Ñandú L’ÉTÉ ﬁn") == "ñandu lete fin"
    assert analyse("abc123 3,14 " + "x" * 41) == ["abc", "123", "3.14"]
    assert parse_boolean("a b AND NOT c") == ("or", ("term", "a"), ("and", ("term", "b"), ("not", ("term", "c"))))


@pytest.mark.parametrize("word, stem", [
    ("caresses", "caress"), ("ties", "tie"), ("consistency", "consist"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("generously", "generous"), ("happy", "happi"),
    ("running", "run"), ("agreed", "agre"), ("bled", "bled"), ("rationalize", "ration"), ("controlled", "control"), ("sky", "sky"), ("dying", "die"),
])
def test_english_stems(word, stem):
    assert language.stem_english(word) == stem


@pytest.mark.parametrize("word, stem", [
    ("chicos", "chic"), ("chica", "chic"), ("torneos", "torne"), ("toreado", "tor"), ("cheques", "chequ"), ("rápidamente", "rapid"), ("ciudades", "ciudad"),
    ("nacionalidad", "nacional"), ("tecnología", "tecnolog"), ("comiéndolos", "com"), ("pagues", "pag"), ("ñandú", "ñandu"),
])
def test_spanish_stems(word, stem):
    assert language.stem_spanish(word) == stem


def test_pages_are_cleaned():
    pages = ["Title\nself-at-\ntention works\n1", "Title\nwell-\nknown facts and well-known data self-attention\n2", "Title\nexam-\nple\n3"]
    assert language.clean_pages(pages) == ["self-attention works", "well-known facts and well-known data self-attention", "example"]


def test_tracks_follow_boxes(spark):
    boxes = [(1, 0.0, 0.0, 0.0, 10.0, 10.0), (1, 0.0, 50.0, 0.0, 10.0, 10.0), (1, 0.5, 2.0, 0.0, 10.0, 10.0), (1, 0.5, 90.0, 0.0, 10.0, 10.0), (1, 9.0, 2.0, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(boxes, "session int, ts double, x double, y double, w double, h double")
    assert [r.track_id for r in media.track(df, "session", "ts").orderBy("ts", "x").collect()] == [1, 2, 1, 3, 4]


def test_bm25_and_tf_idf_by_hand(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["uno", "dos", "tres", "casa", "perro", "gato"], k=rng.randint(0, 12))) for _ in range(40)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    index = TextIndex.build(df, "id", "text")
    docs = {i: t.split() for i, t in enumerate(texts) if t is not None}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    freq = lambda t: sum(t in d for d in docs.values())
    got = {r.id: r.score for r in index.match("casa perro").collect()}
    want = {}
    for i, d in docs.items():
        s = sum(math.log(1 + (n - freq(t) + 0.5) / (freq(t) + 0.5)) * 2.2 * d.count(t) / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in ("casa", "perro"))
        if "casa" in d or "perro" in d:
            want[i] = s
    assert got == pytest.approx(want)
    got = {r.id: r.score for r in index.match("casa casa gato", "TF_IDF").collect()}
    q = {"casa": (1 + math.log10(2)) * math.log10(n / freq("casa")), "gato": math.log10(n / freq("gato"))}
    size = math.sqrt(sum(w * w for w in q.values()))
    w = lambda d, t: 1 + math.log10(d.count(t)) if t in d else 0.0
    want = {i: sum(q[t] / size * w(d, t) for t in q) / math.sqrt(sum(w(d, t) ** 2 for t in set(d))) for i, d in docs.items() if set(q) & set(d)}
    assert got == pytest.approx(want)


def test_box_never_loses_a_point(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(400)]
    df = spark.createDataFrame(points, "id int, lat double, lon double").select("id", F.struct("lat", "lon").alias("p"))
    here = F.struct(F.lit(10.0).alias("lat"), F.lit(20.0).alias("lon"))
    near = df.filter(geo.distance(F.col("p"), here) < 3e6)
    assert near.count() == near.filter(geo.near_box(F.col("p"), 10.0, 20.0, 3e6)).count() > 0


def test_knn_batch_is_one_by_one(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)] + [(900, None), (901, [0.0] * 4)], "id long, v array<float>")
    queries = [(7, [1.0, 0, 0, 0]), (8, [0.3, -1, 0.5, 2])]
    got = {(r.query_id, r["rank"]): r.id for r in vectors.knn_batch(df, "v", "id", queries, 3).collect()}
    for q, v in queries:
        assert [got[q, i] for i in (1, 2, 3)] == [r.id for r in vectors.knn(df, "v", v, 3, "id").collect()]


def test_spelling(spark):
    assert service.osa("abcd", "abdc") == 1 and service.osa("ab", "xyab") == 2
    vocabulary = spark.createDataFrame([("casa", 100), ("cosa", 10), ("perro", 5)], "term string, freq long")
    words = spark.createDataFrame([("csaa",), ("cosa",), ("perrro",), ("zzzzzz",)], "word string")
    assert {r.word: r.fix for r in service.spell(words, vocabulary).collect()} == {"csaa": "casa", "cosa": "cosa", "perrro": "perro", "zzzzzz": None}


def test_chunks_keep_every_word():
    text = " ".join(f"w{i}" + ("." if i % 7 == 0 else "") for i in range(500))
    made = service.chunk_text(text, 50, 1)
    assert set(" ".join(made).split()) == set(text.split()) and all(len(c.split()) <= 50 + 50 // 4 for c in made)
    assert service.chunk_text("") == []


def test_copurchase(spark):
    baskets = {1: [1, 2, 3], 2: [1, 2], 3: [2]}
    df = spark.createDataFrame([(b, i) for b, items in baskets.items() for i in [*items, items[0]]], "b int, i int")
    got = {(r.i, r.other): r.times for r in service.copurchase(df, "b", "i").collect()}
    want = {}
    for items in baskets.values():
        for pair in itertools.permutations(items, 2):
            want[pair] = want.get(pair, 0) + 1
    assert got == want


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c,d,e,f,g\n1,1.5,true,2024-01-02,x,\"POINT(1, 2)\",\"[1,2]\"\n2,2,false,2024-01-03,,\"POINT(3, 4)\",\"[3,4]\"\n")
    df = read_csv(spark, str(tmp_path / "a.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "date", "string", "struct<lat:double,lon:double>", "array<float>"]
    assert df.filter("e IS NULL").count() == 1
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "r.json").write_text('{"a": 1}\n{"b": "x", "a": 2}\n')
    schema = spark.createDataFrame([], "a long, b string").schema
    assert sorted((r.a, r.b) for r in read_ndjson(spark, str(folder), schema).collect()) == [(1, None), (2, "x")]
    append_to(stream_ndjson(spark, str(folder), schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (folder / "s.json").write_text('{"c": 1}\n')
    with pytest.raises(Exception, match="unknown columns"):
        read_ndjson(spark, str(folder), schema).collect()


def test_mfcc_by_definition(spark):
    rng = np.random.default_rng(5)
    x = np.sin(np.arange(4000) * 2 * np.pi * 440 / 16000) + 0.01 * rng.normal(size=4000)
    got = media.mfcc(x)
    assert got.shape == (1 + 4000 // 160, 39) and media.mfcc([]).shape == (0, 39)
    # A window by hand: its spectrum by the sum, its bands by their corners.
    t = 10
    part = np.pad(x, 256)[t * 160 : t * 160 + 512] * np.pad(np.hanning(401)[:400], 56)
    power = np.array([abs(sum(part * np.exp(-2j * np.pi * k * np.arange(512) / 512))) ** 2 for k in range(257)])
    to_hz = lambda m: m * 200 / 3 if m < 15 else 1000 * 6.4 ** ((m - 15) / 27)
    corners = [to_hz(m) for m in np.linspace(0, 15 + 27 * math.log(8, 6.4), 130)]
    bands = []
    for a, b, c in zip(corners, corners[1:], corners[2:]):
        w = [max(0.0, min((31.25 * k - a) / (b - a), (c - 31.25 * k) / (c - b))) for k in range(257)]
        bands.append(10 * math.log10(max(1e-10, 2 / (c - a) * float(np.dot(w, power)))))
    want = [sum(v * math.cos(math.pi * q * (i + 0.5) / 128) for i, v in enumerate(bands)) * math.sqrt((2 if q else 1) / 128) for q in range(13)]
    assert got[t, 1:13] == pytest.approx(want[1:], abs=0.5) and got[t, 0] >= want[0] - 1e-3  # the loudest window bounds quiet bands
    line = np.arange(30.0)[:, None] ** 2
    assert media._slope(line, 9, 2)[10:20].ravel() == pytest.approx([2.0] * 10)
    assert media._slope(line, 9, 1)[10] == pytest.approx(20.0)
    df = spark.createDataFrame([(1, [float(v) for v in x]), (2, []), (3, None)], "id int, x array<double>")
    rows = media.mfcc_frames(df, "id", "x").orderBy("frame").collect()
    assert [r.id for r in rows] == [1] * len(got) and np.allclose([r.descriptor for r in rows], got)
