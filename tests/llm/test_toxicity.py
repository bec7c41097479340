"""The toxicity model: derivatives, array scoring, spellings, and the registered query by brute force."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import toxicity
from millrace.llm.queries import QUERIES

from .conftest import prose


def plain_score(model, text):
    """Word by word and n-gram by n-gram, with the same buckets."""
    means = []
    for w in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        at = toxicity.subwords([w])[0]
        assert len(at) == 1 + sum(max(0, len(w) + 3 - n) for n in toxicity.GRAMS)
        means.append(model.weights[at].astype(float).mean())
    return 1 / (1 + np.exp(-(np.mean(means or [0.0]) + model.bias)))


@pytest.fixture(scope="module")
def random_model():
    return toxicity.Model(np.random.default_rng(1).normal(0, 1, toxicity.BUCKETS).astype(np.float32), -0.5)


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab 1_-İŉßé漢\0\n"), st.characters()), max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_scores_of_many_texts(texts):
    model = toxicity.Model(np.random.default_rng(1).normal(0, 1, toxicity.BUCKETS).astype(np.float32), -0.5)
    assert np.allclose(toxicity.Scorer(model).scores(texts), [plain_score(model, t) for t in texts], atol=1e-6)


def test_long_texts_are_scored_whole(random_model, monkeypatch):
    texts = ["x" * 5000, prose(1, 20_000), "", "a", prose(2, 300) + " " + "y" * 3000]
    whole = toxicity.Scorer(random_model).scores(texts)
    assert np.allclose(whole, [plain_score(random_model, t) for t in texts], atol=1e-6)
    monkeypatch.setattr(toxicity, "BLOCK", 100)
    assert np.allclose(toxicity.Scorer(random_model).scores(texts), whole, atol=1e-9)


def test_spellings_share_buckets():
    a, b, c = (set(toxicity.subwords([w])[0].tolist()) for w in ("blarghy", "blargh1", "snorfing"))
    assert len(a & b) >= 6 and not a & c
    assert toxicity.words("1d10t's A_b É") == ["1d10t", "s", "a", "b", "é"]


def test_slopes_by_finite_differences():
    r = np.random.default_rng(3)
    bags = [toxicity.bag(prose(k, k % 12), {}) for k in range(20)]
    labels, share = r.integers(0, 2, 20).astype(float), r.random(20)
    share /= share.sum()
    rows = toxicity.Rows(bags, step=7)
    seen = rows.seen.tolist()
    assert seen == sorted({b for at, _ in bags for b in at.tolist()})
    vectors, soft, bias = r.normal(0, 1, (len(seen), toxicity.WIDTH)), r.normal(0, 1, (2, toxicity.WIDTH)), r.normal(0, 1, 2)

    def loss():
        means = np.zeros((20, toxicity.WIDTH))
        for k, (at, part) in enumerate(bags):
            means[k] = (vectors[[seen.index(b) for b in at.tolist()]] * part[:, None]).sum(0)
        z = means @ soft.T + bias
        z -= np.logaddexp.reduce(z, axis=1)[:, None]
        return -(share * z[np.arange(20), labels.astype(int)]).sum()

    value, pull, turn, tilt = toxicity.slopes(rows, vectors, soft, bias, labels, share)
    assert abs(value - loss()) < 1e-6
    by_vector = pull[:, None] * (soft[1] - soft[0])
    places = [(vectors, by_vector, (b, d)) for b in r.choice(len(seen), 6) for d in (0, 9)] + [(soft, turn, (c, d)) for c in (0, 1) for d in range(0, 16, 5)] + [(bias, tilt, (c,)) for c in (0, 1)]
    for x, slope, at in places:
        old = x[at]
        x[at] = old + 1e-4
        up = loss()
        x[at] = old - 1e-4
        down = loss()
        x[at] = old
        assert abs((up - down) / 2e-4 - slope[at]) < 1e-5, at


def test_softmax_and_vectors_are_both_trained():
    bags = [toxicity.bag(prose(k, 40) + (" blarghy" if k % 3 == 0 else ""), {}) for k in range(300)]
    labels = np.array([float(k % 3 == 0) for k in range(300)])
    before = toxicity.started(len(toxicity.Rows(bags).seen), labels, np.ones(300), 1)
    met = []
    real = toxicity.slopes

    def kept(rows, vectors, soft, bias, *rest):
        met.append((vectors.copy(), soft.copy(), bias.copy()))
        return real(rows, vectors, soft, bias, *rest)

    toxicity.slopes = kept
    try:
        model = toxicity.train(bags, labels, np.ones(300))
    finally:
        toxicity.slopes = real
    vectors, soft, bias = met[-1]
    assert np.linalg.norm(soft - before[1]) > 0.3 * np.linalg.norm(before[1]) and np.linalg.norm(vectors - before[0]) > np.linalg.norm(before[0])
    scores = toxicity.Scorer(model).scores([prose(900 + k, 40) + (" blargh1 blarghyy" if k % 2 else "") for k in range(40)])
    # Spellings that were never seen, one of them with a digit, rank above clean texts.
    assert (scores[1::2][:, None] > scores[0::2]).mean() > 0.9


def test_registered_query(spark, tmp_path):
    """The query on a small table: every row, held-out rows told right, scores as a plain loop gives them, labels of held-out rows unused."""
    rows = [(k, prose(k, 30) + (" blarghy gruntwad" if k % 4 == 0 else ""), "en", "s", 1) for k in range(120)] + [(None, None, None, None, None), (500, "", "en", "s", 0), (501, prose(9, 20_000), "en", "s", 0), (3, prose(3, 30), "en", "s", 1)]
    labels = [(k, 1, int(k % 4 == 0)) for k in range(120)]

    def run(folder, labels):
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        return sorted((tuple(r) for r in QUERIES["op1_toxicity"](spark, str(folder)).collect()), key=repr)

    got = run(tmp_path / "a", labels)
    assert len(got) == len(rows) and all(0 <= s <= 1 and p == (s >= 0.3) for _, _, s, p in got)
    assert all(h == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d, h, _, _ in got)
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, q, t in labels]
    assert run(tmp_path / "b", flipped) == got
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/a/labels.parquet"))
    want = sorted(((d, plain_score(model, t or "")) for d, t, *_ in rows), key=repr)
    assert np.allclose(sorted(s for _, s in want), sorted(s for _, _, s, _ in got), atol=1e-6)
    for table, n in (("documents", 0), ("labels", len(rows))):
        empty = tmp_path / f"no_{table}"
        for name in ("documents", "labels"):
            x = spark.read.parquet(f"{tmp_path}/a/{name}.parquet")
            (x.limit(0) if name == table else x).write.parquet(f"{empty}/{name}.parquet")
        assert QUERIES["op1_toxicity"](spark, str(empty)).count() == n
