"""The pipeline's near dedup against all pairs of shingle sets."""

import itertools
import math
import random

import pytest

import corpus_pipeline
from tesela.llm import near_dedup, simhash
from tesela.llm.near_dedup import keep_dissimilar

SF = "/root/testdata/sf0.01"


def kept(texts):
    """Ids that stay when all pairs of sets are compared."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    home = {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        small, large = sorted((len(sets[a]), len(sets[b])))
        if small >= 0.8 * large and (both := len(sets[a] & sets[b])) >= 0.8 * (small + large - both):
            x, y = sorted((home[a], home[b]))
            home = {i: x if h == y else h for i, h in home.items()}
    return {i for i, h in home.items() if i == h}


@pytest.mark.parametrize("hot", [200, 3])
def test_all_pairs(spark, hot):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, common = {}, rng.choices(vocabulary, k=40)
    for g in range(40):
        base = rng.choices(vocabulary, k=rng.choice([1, 3, 6, 20, 40, 120, 300]))
        base = common + base if g % 3 == 0 else base
        for _ in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts[len(texts)] = " ".join(words).title()
    # Near copies of one text, in which every rare hash is common: leaders, and the texts they leave.
    base = rng.choices(vocabulary, k=150)
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts[len(texts)] = " ".join(words)
    texts |= {len(texts): None, len(texts) + 1: "", len(texts) + 2: " "}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = kept(texts)
    assert {r.doc_id for r in keep_dissimilar(docs, hot=hot).collect()} == want and len(want) < len(texts) - 20


def test_least_shared_hashes():
    tail = sum(math.comb(near_dedup.SKETCH, k) * 0.8**k * 0.2 ** (near_dedup.SKETCH - k) for k in range(near_dedup.least_shared(0.8)))
    assert tail < near_dedup.MISS and 28 <= near_dedup.least_shared(0.8) <= 40


def test_hard_rows(spark):
    schema = "doc_id long, text string, rid int, n int, h string, label string"
    rows = [(None, None, 1, 1, "x", "y"), (3, "", 1, 1, "x", None), (2, " ", 1, 1, None, "y"), (7, "A b", 0, 0, "p", "q"), (7, "a B", 0, 0, "p", "q"), (8, "w " * 50_000, 1, 2, "", "")]
    kept = keep_dissimilar(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "rid", "n", "h", "label"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 8]
    assert keep_dissimilar(spark.createDataFrame([], schema)).count() == 0


def test_stage_takes_five_words_and_four_fifths(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(set(got)) and set(got) == kept(texts)
    assert not {914, 770, 944, 875} & set(got)


def test_tree_proposes_every_pair_within_its_radius(spark, monkeypatch):
    """Whatever the crowds: a pair of the radius is there, or both of its fingerprints are crowded."""
    monkeypatch.setattr(simhash, "SHARD", 150)
    monkeypatch.setattr(simhash, "SAMPLE", 400)
    monkeypatch.setattr(simhash, "HELD", 50)
    rng = random.Random(5)
    centers = [rng.getrandbits(64) for _ in range(25)]
    fps = {c for c in centers}
    for c in [centers[0]] * 120 + centers * 12:
        for bit in rng.sample(range(64), rng.randint(0, 12)):
            c ^= 1 << bit
        fps.add(c)
    fps = sorted(fps)
    texts = {f: rng.choice([1, 1, 1, 2, 30]) for f in fps}
    signed = [(f - (1 << 64) if f >> 63 else f, n) for f, n in texts.items()]
    got = simhash.close_fingerprints(spark.createDataFrame(signed, "fp long, texts long"), 14, 20).collect()
    crowded = {r.a % 2**64 for r in got if r.a == r.b}
    plain = [tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in got if not r.led]
    led = {(r.a % 2**64, r.b % 2**64) for r in got if r.led and r.a != r.b}
    near = {(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 14}
    missing = near - set(plain)
    assert len(plain) == len(set(plain)) and set(plain) <= near
    assert missing and all(a in crowded and b in crowded for a, b in missing)
    degree = {f: texts[f] - 1 for f in fps}
    for a, b in near:
        degree[a] += texts[b]
        degree[b] += texts[a]
    assert crowded <= {f for f in fps if degree[f] > 20}
    assert {tuple(sorted(p)) for p in led} <= near and {b for _, b in led} <= crowded
    assert {a for a, b in missing} | {b for a, b in missing} <= {b for _, b in led}


def test_stage_gets_links_from_the_tree(spark, monkeypatch):
    """The stage's links within the radius come from operator 7's tree; the way for the rest adds others only."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees, proposed = [], []
    grown, tree_pairs = simhash.grown_tree, near_dedup.tree_pairs
    monkeypatch.setattr(simhash, "grown_tree", lambda distinct, n, radius: trees.append(radius) or grown(distinct, n, radius))
    monkeypatch.setattr(near_dedup, "tree_pairs", lambda *a: proposed.append(tree_pairs(*a)) or proposed[0])
    near_rows = near_dedup.with_row_ids(docs)
    links = {tuple(sorted((r.a, r.b))) for r in near_dedup.similar_pairs(near_rows).collect()}
    assert trees == [near_dedup.RADIUS] and near_dedup.RADIUS >= 10
    sets = {r.rid: near_dedup.shingle_set((r.text or "").encode()) for r in near_rows.collect()}
    first = {}
    sets = {i: s for i, s in sorted(sets.items()) if first.setdefault(s.tobytes(), i) == i}  # one of equal sets stands for all
    fp = {i: simhash.majority(s) for i, s in sets.items()}
    pairs = {(r.a, r.b) for r in proposed[0][0].collect()}
    alike = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = len(sets[a]), len(sets[b])
        if min(x, y) >= 0.8 * max(x, y) and (fp[a] ^ fp[b]).bit_count() <= near_dedup.RADIUS:
            both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            if both >= 0.8 * (x + y - both):
                alike.add((a, b))
    assert len(alike) >= 3 and alike <= pairs and alike <= links
    rest = {(a, b) for a, b in links - pairs if a in sets and b in sets}
    assert all((fp[a] ^ fp[b]).bit_count() > near_dedup.RADIUS for a, b in rest)


@pytest.mark.parametrize("hot", [200, 3])
def test_links_beyond_the_radius(spark, monkeypatch, hot):
    """What a narrower tree does not propose is found all the same."""
    monkeypatch.setattr(near_dedup, "RADIUS", 5)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(1000)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in keep_dissimilar(docs, hot=hot).collect()} == kept(texts)
