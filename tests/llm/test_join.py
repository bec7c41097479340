"""The n-gram join and components against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import ngram_join, shingles
from millrace.llm.components import components

from .conftest import WORDS, prose


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, percent):
    """doc_id: component; and the number of links of each row."""
    sets = [shingle_set(t, size) for _, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return Counter((d, len(s), None if d is None else find(d), links[k]) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near(seed, text, edits):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


@pytest.fixture
def rows():
    """Families of near copies, exact copies, a shared passage, small texts."""
    passage = prose(900, 60)
    out = []
    for f in range(6):
        base = prose(f, 120)
        out += [near(100 * f + k, base, k % 9) for k in range(25)] + [base] * 5
    out += [prose(300 + k, 30 + k) + " " + passage for k in range(40)]
    out += [prose(500 + k, k % 7) for k in range(40)]
    random.Random(3).shuffle(out)
    return list(enumerate(out, 1))


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_join_is_exact(docs, rows, size, percent):
    out = ngram_join.join(docs(rows), size, percent)
    assert Counter(map(tuple, out.collect())) == brute(rows, size, percent)


def test_join_blocks_and_stars(docs, rows, monkeypatch):
    """Small limits send all through families, blocks, bundles and salts."""
    monkeypatch.setattr(ngram_join, "FEW", 4)
    monkeypatch.setattr(ngram_join, "MANY", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    assert Counter(map(tuple, ngram_join.join(docs(rows), 4, 85).collect())) == brute(rows, 4, 85)


def test_join_edges(docs, edges):
    plain = [e for e in edges if e[0] != 5] + [(5, prose(5, 40))]
    assert Counter(map(tuple, ngram_join.join(docs(plain)).collect())) == brute(plain, 4, 85)
    got = ngram_join.join(docs(edges)).collect()
    assert len(got) == len(edges) and {r.component_id for r in got if r.doc_id in (5, 8)} == {5}
    assert ngram_join.join(docs([])).collect() == []


def test_keep_one(docs, rows, edges):
    kept = ngram_join.keep_one(docs(rows), 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c, _ in brute(rows, 5, 80)})
    got = Counter(r.doc_id for r in ngram_join.keep_one(docs(edges)).collect())
    assert got[None] == 2 and got[5] == 1 and got[8] == 0 and got[1] == 1


def test_keep_one_compares_rows_without_id(docs):
    rows = [(None, prose(1, 40)), (None, prose(1, 40)), (3, prose(2, 40)), (None, prose(2, 40)), (None, prose(3, 40)), (None, prose(3, 40) + " end"), (None, None)]
    got = Counter((r.doc_id, r.text) for r in ngram_join.keep_one(docs(rows), 5, 80).collect())
    assert got == Counter([(None, prose(1, 40)), (3, prose(2, 40)), (None, prose(3, 40)), (None, None)])


def test_candidate_batches(monkeypatch):
    """Runs that go over the ends of batches."""
    import pyarrow as pa

    r = np.random.default_rng(5)
    token = np.sort(r.integers(0, 30, 4000))
    frame = [token, np.zeros(4000, np.int32), np.concatenate([np.sort(r.choice(10**6, k, replace=False)) for k in np.unique(token, return_counts=True)[1]]), np.full(4000, 10, np.int32)]
    monkeypatch.setattr(ngram_join, "FEW", 100)
    found = []
    for step in (4000, 37, 1000):
        batches = (pa.RecordBatch.from_arrays([pa.array(x[k : k + step]) for x in frame], names=["token", "os", "node", "n"]) for k in range(0, 4000, step))
        rows = Counter()
        for b in ngram_join._candidates(batches, 85):
            rows |= Counter(zip(*(c.to_pylist() for c in b.columns), strict=True))
        found.append(set(rows))
    assert found[0] == found[1] == found[2] and len(found[0]) > 3000


def test_components(spark):
    r = random.Random(1)
    links = [(o, a, a + r.choice([1, 2, 500])) for o in (0, 1) for a in r.sample(range(2000), 900)] + [(0, 5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for o, a, b in links:
        if a != b:
            x, y = find((o, a)), find((o, b))
            parent[max(x, y)] = min(x, y)
    got = {((r.o, r.id), (r.o, r.component)) for r in components(spark.createDataFrame(links, "o int, u long, v long"), ["o"]).collect()}
    assert got == {(x, find(x)) for x in list(parent)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_hashes_follow_words():
    r = random.Random(2)
    texts = ["", " ", "a", "A b\x0bc\tD  e", "é é É", *(" ".join(r.choice(["Ab", "ab", "x", "yz", "é"]) for _ in range(r.randrange(12))) for _ in range(300))]
    seen: dict = {}
    for t in texts:
        w = shingles.words(t)
        one = shingles.word_hashes(t.encode())
        assert len(one) == len(w)
        for a, b in zip(w, one.tolist(), strict=True):
            assert seen.setdefault(a, b) == b
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [tuple(w)] if w else []
        for g, h in zip(grams, shingles.hashes(t, 3).tolist(), strict=True):
            assert seen.setdefault(g, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = prose(1, 4000).encode()
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "PIECE", 1000)
    assert (shingles.word_hashes(text) == whole).all() and len(shingles.word_hashes(b"x" * 5000)) == 1
