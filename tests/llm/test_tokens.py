"""Packing and token shards against the tokenizers library and plain loops."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import common, packing, wavelet
from millrace.llm.tokens import encoder

from .conftest import prose

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain(path, text, end):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_give_the_texts_ids(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    coder = encoder(path)
    assert coder.split is not None

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from("ab 'sdrveltm\n\t\r .,!é ß²1 0İʼnſª’\x1c\x85漢<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
    def same(text):
        assert np.frombuffer(coder.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids

    same()


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_added_tokens_as_the_unmodified_library(path):
    t, coder = Tokenizer.from_file(path), encoder(path)
    added = {a.content: k for k, a in t.get_added_tokens_decoder().items()}
    assert coder.split is not None and added
    for content, k in added.items():
        assert k in np.frombuffer(coder.ids(f"end {content} start"), "<u4")

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.sampled_from([*added, "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "\n", "a", "End", "é", "漢"]), max_size=12).map("".join))
    def same(text):
        assert np.frombuffer(coder.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids

    same()


def test_added_tokens_in_packing_and_shards(spark, docs):
    texts = [(1, "end <|endoftext|> start"), (2, "one"), (3, "<|startoftext|>two<|endoftext|>")]
    want = {p: [[*Tokenizer.from_file(p).encode(t, add_special_tokens=False).ids, 0] for _, t in texts] for p in (BYTE, WORD)}
    got = packing.pack(docs(texts), BYTE, 0, 64).orderBy("doc_id").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == want[BYTE]
    shards = wavelet.read_shards(wavelet.write_shards(docs(texts), WORD, 0, common.new_folder(spark, "t"))).orderBy("start").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in shards] == want[WORD]
    assert [r.start for r in shards] == [sum(map(len, want[WORD][:k])) for k in range(3)]


@given(st.lists(st.integers(1, 64), max_size=300))
@settings(max_examples=200, deadline=None)
def test_placements(lengths):
    counts = Counter(lengths)
    table, opened = packing.place(counts, 64)
    fill, seen = defaultdict(list), Counter()
    for n, rank, k, first, offset in table.tolist():
        assert rank == seen[n]
        seen[n] += k
        for s in range(first, first + k):
            fill[s].append((offset, n))
    assert seen == counts and len(fill) == opened
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    # No worse than first fit of the longest first by more than one sequence in ten.
    bins = []
    for n in sorted(lengths, reverse=True):
        k = next((i for i, b in enumerate(bins) if b + n <= 64), None)
        bins = [*bins, n] if k is None else [b + n * (i == k) for i, b in enumerate(bins)]
    assert opened <= len(bins) * 1.1 + 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_distributed_rounds_are_those_of_one_machine(spark, seed):
    """Ranges with carried-over leftovers give what one sweep over everything does."""
    r = np.random.default_rng(seed)
    lengths = [r.integers(1, 65, 900), np.minimum(64, np.exp(r.normal(2, 1, 900)).astype(int) + 1), np.repeat([20, 21, 43, 64], 200)][seed - 1]
    counts = Counter(lengths.tolist())
    want, opened = packing.place(counts, 64)
    runs = spark.createDataFrame([(n, k) for n, k in counts.items()], "length long, n long").repartition(5)
    got = [(x["size"], x["first"] + j * x.n, x.n, x.sequence, x.offset + j * x["size"]) for x in packing.placements(runs, 64).collect() for j in range(x.per)]
    assert sorted(got) == [tuple(x) for x in want.tolist()] and max(x[3] + x[2] for x in got) == opened
    assert packing.placements(runs.limit(0), 64).collect() == []


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = min((k for k, room in enumerate(rooms) if room >= n), key=lambda k: rooms[k], default=None)
        if at is None:
            rooms.append(capacity - n)
        else:
            rooms[at] -= n
    return len(rooms)


def test_as_few_sequences_as_best_fit():
    r = np.random.default_rng(7)
    for lengths in (r.integers(1, 2049, 1500), np.minimum(2048, np.exp(r.normal(5.5, 1.2, 3000)).astype(int) + 1), np.full(500, 300), r.integers(1, 40, 2000)):
        counts = Counter(lengths.tolist())
        assert packing.place(counts, 2048)[1] <= best_fit_decreasing(lengths.tolist(), 2048) * 1.01 + 1


def test_registered_packing(spark, tmp_path, edges):
    """The query on a small table with a very long text, against the library and a plain check of every sequence."""
    from millrace.llm.queries import QUERIES

    rows = [*edges, (900, prose(1, 20_000)), *((1000 + k, prose(k, k * 7)) for k in range(60))]
    spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, rank string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op2_best_fit_packing"](spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(BYTE)
    want = Counter()
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        edges_ = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(edges_, edges_[1:], strict=False)):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter(tuple(x)[:5] for x in got) == want
    fill = Counter()
    for x in sorted(got, key=lambda x: (x.sequence_id, x.offset)):
        assert fill[x.sequence_id] == x.offset
        fill[x.sequence_id] += x.length
    assert max(fill.values()) <= 2048 and len(fill) <= best_fit_decreasing([x.length for x in got], 2048) * 1.01 + 1


def test_cut():
    ids = np.arange(10, dtype="<u4").tobytes()
    assert [(s, len(p) // 4) for s, p in packing.cut(ids, 4)] == [(0, 2), (2, 4), (6, 4)]
    assert [(s, len(p) // 4) for s, p in packing.cut(ids, 5)] == [(0, 5), (5, 5)]


def test_pack_edges(spark, docs, edges):
    out = packing.pack(docs(edges), BYTE, 0, 64)
    rows = out.collect()
    assert out.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    want = Counter()
    for d, text in edges:
        ids = plain(BYTE, text, 0)
        for k, (start, piece) in enumerate(packing.cut(np.array(ids, "<u4").tobytes(), 64)):
            want[d, k, start, piece] += 1
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in rows) == want
    for r in packing.sequences(out).collect():
        parts = sorted((x.offset, bytes(x.ids)) for x in rows if x.sequence_id == r.sequence_id)
        assert bytes(r.ids) == b"".join(p for _, p in parts) and len(r.ids) <= 4 * 64
        assert [o for o, _ in parts] == np.cumsum([0, *(len(p) // 4 for _, p in parts[:-1])]).tolist()
    assert packing.pack(docs([]), BYTE).collect() == []


@given(st.lists(st.integers(0, 40), max_size=1500))
@settings(max_examples=30, deadline=None)
def test_wavelet_matrix(values):
    m = wavelet.WaveletMatrix.of(np.array(values, np.uint32))
    assert m.values().tolist() == values
    for i in range(0, len(values), 97):
        assert m.access(i) == values[i]
    for v in (0, 3, 40, 999):
        at = [i for i, x in enumerate(values) if x == v]
        assert m.count(v) == len(at) and m.rank(v, len(values) // 2) == sum(i < len(values) // 2 for i in at)
        assert [m.select(v, k) for k in range(0, len(at), 11)] == at[::11]
        with pytest.raises(IndexError):
            m.select(v, len(at))


def test_shard_round_trip():
    ids = np.random.default_rng(1).integers(0, 49408, 5000).astype(np.uint32)
    data = wavelet.to_bytes([None, 4, -2], [1000, 0, 4000], ids)
    s = wavelet.Shard(data)
    assert s.doc_ids == [None, 4, -2] and s.starts.tolist() == [0, 1000, 1000, 5000] and (s.matrix.values() == ids).all() and s.matrix.access(77) == ids[77]
    with pytest.raises(ValueError):
        wavelet.Shard(data[:100] + b"x" + data[101:])


def test_lookups_read_little_of_a_compressed_file(tmp_path):
    r = np.random.default_rng(2)
    ids = (49407 * r.random(400_000) ** 4).astype(np.uint32)  # few ids are most of them, as in texts
    data = wavelet.to_bytes(list(range(1000)), [400] * 1000, ids)
    assert len(data) < 0.95 * 2 * len(ids) and (wavelet.Shard(data).matrix.values() == ids).all()
    (tmp_path / "x.wm").write_bytes(data)
    shard = wavelet.Shard.opened(str(tmp_path / "x.wm"))
    real, read = shard._read, []
    shard._read = lambda at, n: read.append(n) or real(at, n)
    assert shard.matrix.access(123_456) == ids[123_456] and sum(read) < len(data) / 2
    v = int(ids[7])
    at = np.flatnonzero(ids == v)
    assert shard.matrix.count(v) == len(at) and shard.matrix.rank(v, 200_000) == (at < 200_000).sum() and shard.matrix.select(v, len(at) // 2) == at[len(at) // 2]
    assert shard.starts[-1] == len(ids) and shard.doc_ids[:3] == [0, 1, 2]
    for k in (3, 60, len(data) // 2, len(data) - 30, len(data) - 1):
        with pytest.raises(ValueError):
            wavelet.Shard(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])
    with pytest.raises(ValueError):
        wavelet.Shard(data[:50])


def test_registered_token_ids(spark, tmp_path, edges):
    """The query on a small table with a very long text, against the library."""
    from millrace.llm.queries import QUERIES

    rows = [*(e for e in edges if e[0] != 5), (900, prose(1, 20_000)), *((1000 + k, prose(k, k * 7)) for k in range(60))]
    spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, part int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    t, at, want = Tokenizer.from_file(WORD), 0, []
    for d, text in sorted(rows, key=lambda e: (e[0] is not None, e[0] or 0, e[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in QUERIES["op9_token_ids"](spark, str(tmp_path)).orderBy("start").collect()] == want


def test_shards_edges(spark, docs, edges):
    shards = wavelet.write_shards(docs(edges), WORD, 1, common.new_folder(spark, "t"), shard_tokens=100)
    assert shards.count() > 2
    at, want = 0, []
    for d, text in sorted(edges, key=lambda e: (e[0] is not None, e[0] or 0, e[1] or "")):
        ids = np.array(plain(WORD, text, 1), "<u4").tobytes()
        want.append((d, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in wavelet.read_shards(shards).orderBy("start").collect()]
    assert got == want
    assert [tuple(r) for r in wavelet.read_shards(shards, sums=True).orderBy("start").collect()] == want
    assert wavelet.read_shards(wavelet.write_shards(docs([]), WORD, 1, common.new_folder(spark, "t"))).collect() == []
