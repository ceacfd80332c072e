"""Sampled segmentations against sums over all paths of whole texts, in plain Python."""

import math
from collections import Counter

import numpy as np
import pytest

from tesela.llm import sentencepiece_codec as codec

SAMPLES = 4000


@pytest.fixture(scope="module")
def pieces():
    with open(codec.DEFAULT_MODEL, "rb") as f:
        return codec.Pieces(f.read())


def edges(pieces, text):
    """(start, end, log weight) of the whole text's lattice: no unit, no cut."""
    of = {b.decode(): pieces.weight[i] for i, b in enumerate(pieces.bytes_of) if b and pieces.weight[i] < 0}
    found = [(a, a + k, of[text[a : a + k]]) for a in range(len(text)) for k in range(1, pieces.longest + 1) if a + k <= len(text) and text[a : a + k] in of]
    ends = {b for _, b, _ in found}
    return sorted(found + [(a, a + 1, len(text[a].encode()) * pieces.byte_weight) for a in range(len(text)) if a + 1 not in ends])


def boundaries(pieces, text):
    """The chance of each position to be a boundary, over all paths."""
    found, add = edges(pieces, text), np.logaddexp
    alpha, beta = [-math.inf] * (len(text) + 1), [-math.inf] * (len(text) + 1)
    alpha[0] = beta[-1] = 0.0
    for a, b, w in found:
        alpha[b] = add(alpha[b], alpha[a] + w)
    for a, b, w in reversed(found):
        beta[a] = add(beta[a], beta[b] + w)
    return [math.exp(x + y - alpha[-1]) for x, y in zip(alpha, beta)]


def sampled(pieces, text, store=None, n=SAMPLES, seed=3):
    ids, cuts = codec.segment(pieces, [text] * n, np.arange(n, dtype=np.uint64), seed, store)
    return [ids[a:b].tolist() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


@pytest.mark.parametrize("text", [
    "internationalization" * 5, "  two  spaces   three    four words  ", "https://example.com/a_b-c?key=value&other=thing#fragment", "日本語のテキストには空白がありません。這是沒有空格的文字",
    "for(int i=0;i<10;i++){sum+=values[i];}return(sum);", "wörd\tx\n\nünï▁cödé \U0001f600 é", "a" * 70, " " * 60, "0123456789abcdef" * 5, "x",
])
def test_boundaries_have_the_chance_that_all_paths_give_them(pieces, text):
    want, seen = boundaries(pieces, text), Counter()
    for ids in sampled(pieces, text):
        data = pieces.decode(ids)
        assert data == text.encode()
        at, whole = 0, {len(text[:k].encode()): k for k in range(len(text) + 1)}
        seen[0] += 1
        for i in ids:
            at += len(pieces.bytes_of[i])
            if at in whole:
                seen[whole[at]] += 1
    for k, p in enumerate(want):
        assert abs(seen[k] - SAMPLES * p) <= 5.5 * math.sqrt(SAMPLES * p * (1 - p) + 1), (k, p, seen[k])


@pytest.mark.parametrize("text", ["  there", "there", "e  the", "…a b"])
def test_whole_paths_have_the_chance_of_their_weight(pieces, text):
    found = edges(pieces, text)

    def paths(at):
        if at == len(text):
            yield (), 0.0
        for a, b, w in found:
            if a == at:
                for tail, v in paths(b):
                    yield ((a, b), *tail), w + v

    weight = {p: math.exp(w) for p, w in paths(0)}
    total, seen = sum(weight.values()), Counter()
    for ids in sampled(pieces, text, n=20_000):
        at, path, data = 0, [], b""
        for i in ids:
            data += pieces.bytes_of[i]
            if len(data) and text.encode().startswith(data) and _whole(data):
                end = len(data.decode())
                path.append((at, end))
                at = end
        seen[tuple(path)] += 1
    assert set(seen) <= set(weight)
    for p, w in weight.items():
        want = 20_000 * w / total
        assert abs(seen[p] - want) < 6 * math.sqrt(want + 1)


def _whole(data):
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def test_a_unit_ends_only_where_no_piece_spans(pieces):
    texts = ["the cat's  mat, 12 ünï", "", "internationalization" * 9, "日本 語"]
    units, sizes = pieces.units(texts)
    assert "".join(units) == "".join(texts) and sizes.sum() == len(units) and sizes[1] == 0
    assert "internationalization" * 9 in units  # no cut in a long word
    known = [b.decode() for i, b in enumerate(pieces.bytes_of) if b and pieces.weight[i] < 0]
    pairs = {p[i : i + 2] for p in known for i in range(len(p) - 1)}
    at = 0
    for text, n in zip(texts, sizes):
        of, at = units[at : at + n], at + n
        assert "".join(of) == text
        assert all(a[-1] + b[0] not in pairs for a, b in zip(of, of[1:]))
        assert all(u[i : i + 2] in pairs for u in of for i in range(len(u) - 1))


def test_samples_do_not_depend_on_what_the_store_holds(pieces, monkeypatch):
    texts = ["the internationalization of cats", "x" * 40, "of  cats", "日本 the cats", ""] * 3
    keys = np.arange(len(texts), dtype=np.uint64)
    whole, cuts = codec.segment(pieces, texts, keys, 5)
    monkeypatch.setattr(codec, "STORE_EDGES", 50)
    store, one = codec.Store(pieces), []
    for k, t in reversed(list(enumerate(texts))):
        one.append(codec.segment(pieces, [t], keys[k : k + 1], 5, store)[0].tolist())
    assert [whole[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == one[::-1]


def test_decode_of_null_and_empty_ids(spark):
    rows = [(1, None, "old", 7), (1, [], "old", 7), (2, [], None, None)]
    encoded = spark.createDataFrame(rows, "doc_id long, ids array<int>, text string, pieces int")
    out = codec.decode(encoded)
    assert out.columns == encoded.columns
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [(1, None, None, 7), (1, [], "", 7), (2, [], "", None)]))
    assert codec.decode(encoded.limit(0)).count() == 0
