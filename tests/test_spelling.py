"""Spelling against brute force, and the words that the registered query asks."""

import random
from collections import Counter

from tesela import queries
from tesela.operators import service
from tesela.operators.search import ascii_terms

SF = "/root/testdata/sf0.001"


def test_distance_two_of_the_same_initial(spark):
    rng = random.Random(4)
    terms = {"".join(rng.choices("abcdefgh", k=rng.randint(4, 9))): rng.randint(1, 40) for _ in range(200)} | {"guitar": 30}
    asked = {"guitarra"}
    for t in sorted(terms) * 2:
        w = list(t)
        for _ in range(2):
            w[rng.randrange(1, len(w))] = rng.choice("abcdefghx")
        asked.add("".join(w))
    less = lambda w: {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}
    want, second = {}, 0
    for w in {w for w in asked if len(w) >= 6} - set(terms):
        near = [t for t in terms if less(w) & less(t) and service.osa(w, t) <= 2]
        further = [t for t in terms if t[0] == w[0] and service.osa(w, t) <= 2]
        second += not near and bool(further)
        want[w] = min(near or further, key=lambda t: (service.osa(w, t), -terms[t], t), default=None)
    vocabulary = spark.createDataFrame(list(terms.items()), "term string, freq long")
    words = spark.createDataFrame([(w,) for w in want], "word string")
    assert {r.word: r.fix for r in service.spell(words, vocabulary).collect()} == want
    assert want["guitarra"] == "guitar" and second > 20


def test_query_asks_all_words_seen_twice(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet")
    seen = Counter(w for r in texts.select(ascii_terms(texts["text"]).alias("w")).collect() for w in r.w)
    assert {r.word for r in queries.spell_fix(spark, SF).collect()} == {w + "x" for w, n in seen.items() if n >= 2}
