"""Fingerprints and media features against plain versions, and their registered queries on edges."""

from __future__ import annotations

import base64
import hashlib
import math
import struct
import zlib

import pytest

from millrace.llm import fingerprint, media, shingles
from millrace.llm.queries import QUERIES

from .conftest import prose

WORD = (1 << 64) - 1


def mixed(x):
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & WORD
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & WORD
    return x ^ x >> 33


def plain_fingerprint(text):
    """One permutation: the least hash of each of 256 bins; an empty bin takes that of the first of its own trials that has one."""
    hashes = shingles.hashes(text, 5).tolist()
    if not hashes:
        return ""
    least = {}
    for h in hashes:
        least[h >> 56] = min(h, least.get(h >> 56, h))
    low = []
    for b in range(256):
        at, trial = b, 0
        while at not in least:
            at = mixed((trial * 256 + b + 1 << 20) & WORD) % 256
            trial += 1
        low.append(least[at] & 15)
    return base64.b64encode(bytes(low[k] | low[k + 1] << 4 for k in range(0, 256, 2))).decode()


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    x, y = (base64.b64decode(v) for v in (a, b))
    same = sum((p & 15 == q & 15) + (p >> 4 == q >> 4) for p, q in zip(x, y, strict=True)) / 256
    return 1.0 if a == b else min(1.0, max(0.0, (same - 1 / 16) / (15 / 16)))


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 40, 300, 3000])
def test_fingerprints_by_a_plain_version(n):
    a, b = prose(n, n), prose(n, n)[: n * 4] + " " + prose(n + 1, n // 3)
    x, y = fingerprint.fingerprint(a), fingerprint.fingerprint(b)
    assert (x, y) == (plain_fingerprint(a), plain_fingerprint(b))
    assert fingerprint.likeness(x, y) == pytest.approx(plain_likeness(x, y))


def documents(spark, folder, edges):
    rows = [*edges, (900, prose(1, 20_000)), *((1000 + k, prose(k, k * 7)) for k in range(25))]
    spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, part int, media string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return rows


def test_registered_fingerprints(spark, tmp_path, edges):
    rows = sorted(documents(spark, tmp_path, edges), key=lambda e: (e[0] is not None, e[0] or 0, e[1] or ""))
    want = []
    for k, (d, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, b, c = map(plain_fingerprint, (t, edited, following))
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    got = [(*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in QUERIES["op4_fingerprints"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def plain_features(samples):
    x = [b - 128 for b in samples]
    mean = sum(x) / len(x)
    cross = sum((p >= 0) != (q >= 0) for p, q in zip(x, x[1:], strict=False))
    frames = [x[k : k + 64] for k in range(0, len(x) // 64 * 64, 64)]
    bands = [sum(abs(sum(f[8 * b : 8 * b + 8])) for f in frames) / len(frames) for b in range(8)]
    return f"n={len(x)};mean={mean:.4f};std={math.sqrt(sum((v - mean) ** 2 for v in x) / len(x)):.4f};cross={cross};peak={max(map(abs, x))};bands=" + ",".join(f"{b:.2f}" for b in bands)


def test_registered_media(spark, tmp_path, edges):
    rows = documents(spark, tmp_path, edges)
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        wave = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 16000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
        want.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(wave), hashlib.sha256(wave).hexdigest(), plain_features(payload)))
    got = [tuple(r) for r in QUERIES["op5_media_columns"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert media.features(b"") == "n=0"
