"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

The field tags words as B, I or O: a secret's begin, inside, or outside. A word's
score is a sum over its own shape, the two words before, the word after, and the
file. It is trained by gradient on chunks labelled by the patterns, a bounded
sample. All features of a word derive from its key, a short text, so scores are
looked up. Viterbi decoding is exact: a word whose score for O exceeds the others
by more than any change of two transitions can be worth is O on the best path,
and the words between such are decoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Base patterns with the least length and the group it holds for (fixed values), in the order in which they are listed.
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 6, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20, 0),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 24, 0),
]
_HINTS = ("passw", "secret", "token", "api")
KINDS = ["assign", "access", "hex", "crf"]
SPANS = "array<struct<kind:string,start:int,end:int>>"
_NAMES = re.compile(r"passw|secret|token|api_?key|credential|auth|bearer|key", re.IGNORECASE)
_WORD = re.compile(r"\S+")
TAGS, CHUNK = 3, 64
O, B, I = 0, 1, 2


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the base patterns in code points, by start and then kind as listed."""
    found = []
    low = text.lower()
    for kind, pattern, least, group in BASE:
        if kind == "assign" and not any(h in low for h in _HINTS) or kind == "access" and "AKIA" not in text:
            continue
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def values(text: str) -> list[tuple[int, int]]:
    """Where the secret itself stands in each base match."""
    return [m.span(group) for _, pattern, least, group in BASE for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def key(word: str) -> str:
    """A word's key: what its shape is, whether it names a secret, how long and how varied it is."""
    name = "n" if _NAMES.search(word) else ""
    tail = word[-1] if not word[-1].isalnum() else ""
    stem = word[:-1] if tail else word
    if len(stem) < 20 and stem.isalpha():
        case = "a" if stem.islower() else "A" if stem.isupper() else "Aa" if stem[0].isupper() else "aA"
        return f"{case}|{tail}|{name}|{min(len(stem) // 6, 3)}"
    shape = re.sub(r"a+", "a", re.sub(r"A+", "A", re.sub(r"0+", "0", re.sub(r"[^\W\d_]", lambda m: "a" if m[0].islower() else "A", re.sub(r"\d", "0", word)))))
    mixed = "m" if re.search(r"[A-Za-z]", word) and re.search(r"\d", word) else ""
    size = len(word)
    many = min(len(set(word)) // 6, 4)
    return f"{'x' if len(shape) > 8 else shape}|{tail}|{name}{mixed}|{min(size // 6, 3) if size < 24 else 4 + min(size // 16, 4)}|{many}"


def parts(k: str) -> list[str]:
    """The features of a key: the whole of it and each of its parts."""
    return [k, *(f"{i}={p}" for i, p in enumerate(k.split("|")))]


def file_key(text: str) -> str:
    n = len(text) or 1
    return f"file{min(4, text.count('=') * 500 // n)}{min(4, text.count('{') * 500 // n)}{min(3, n.bit_length() // 5)}"


class Model(NamedTuple):
    """names: features in order; weights: for each and the places self, before, second before, after and file, a score per tag; moves: from tag, to tag."""

    names: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def scores(self, k: str) -> np.ndarray:
        at = [self.names[p] for p in parts(k) if p in self.names]
        return self.weights[at].sum(0)


PLACES = 5


def chunks(text: str) -> Iterator[tuple[list[str], list[int]]]:
    """(keys, tags) of each run of CHUNK words, by the base patterns."""
    where, tags, words = values(text), [], []
    last = -1
    for m in _WORD.finditer(text):
        hit = next((k for k, (a, b) in enumerate(where) if a < m.end() and m.start() < b), -1)
        tags.append(O if hit < 0 else I if hit == last else B)
        words.append(m[0])
        last = hit
    for k in range(0, len(words), CHUNK):
        yield [key(w) for w in words[k : k + CHUNK]], tags[k : k + CHUNK]


def sample(docs: DataFrame, documents: int = 8192, most: int = 3000) -> tuple[list[tuple[str, list[str], list[int]]], list[tuple[str, list[str], list[int]]]]:
    """At most `most` labelled chunks with a secret and as many without, from about `documents` documents chosen by a hash of doc_id.

    A chosen document is read whole and gives all its chunks with a secret, and the
    first of those without: prose is much the same throughout, and a long document
    would outnumber many short ones.
    """
    total = docs.count()
    if not total:
        return [], []
    share = min(1.0, documents / total)

    def run(it):
        def rows():
            for b in it:
                for t in b.column(0):
                    text = t.as_py()
                    plain = 0
                    for keys, tags in chunks(text):
                        if any(tags) or not plain:
                            plain += not any(tags)
                            yield any(tags), file_key(text), keys, tags

        kinds = pa.schema([("hit", pa.bool_()), ("file", pa.string()), ("keys", pa.list_(pa.string())), ("tags", pa.list_(pa.int32()))])
        yield from common.batches(rows(), kinds, limit=1000)

    order = F.xxhash64(F.lit(10), F.col("doc_id").cast("string"))
    picked = common.lean(docs).filter(F.pmod(order, F.lit(1_000_000)) < int(share * 1_000_000)).select(common.text_column(docs).alias("text"))
    found = picked.mapInArrow(common.frugal(run), "hit boolean, file string, keys array<string>, tags array<int>")
    ranked = common.staged(found.withColumn("order", F.xxhash64("keys", "tags")), "chunks")
    top = ranked.filter("hit").orderBy("order").limit(most).unionByName(ranked.filter("not hit").orderBy("order").limit(most)).toArrow().to_pylist()
    top.sort(key=lambda r: (not r["hit"], r["order"]))
    return tuple([(r["file"], r["keys"], r["tags"]) for r in top if r["hit"] == want] for want in (True, False))


def train(rows: list[tuple[str, list[str], list[int]]], steps: int = 60, rate: float = 0.15, decay: float = 1e-3) -> Model:
    """Maximum likelihood with Adam over chunks (file key, keys, tags)."""
    keys = sorted({k for _, ks, _ in rows for k in ks} | {f for f, _, _ in rows})
    names = {p: i for i, p in enumerate(sorted({p for k in keys for p in parts(k)}))}
    at = {k: i + 1 for i, k in enumerate(keys)}  # 0: no word
    n, m = len(rows), len(keys) + 1
    ids, tags = np.zeros((n, CHUNK + 3), np.int64), np.full((n, CHUNK), -1)
    for r, (_, ks, ts) in enumerate(rows):
        ids[r, 2 : 2 + len(ks)] = [at[k] for k in ks]
        tags[r, : len(ts)] = ts
    places = [ids[:, 2 : 2 + CHUNK], ids[:, 1 : 1 + CHUNK], ids[:, :CHUNK], ids[:, 3 : 3 + CHUNK], np.repeat(np.array([[at[f]] for f, _, _ in rows]), CHUNK, 1)]
    real = tags >= 0
    # Which features each key has, by key and by feature; both orders have sums of runs.
    sizes = np.array([0] + [len(parts(k)) for k in keys])
    link_k, link_f = np.repeat(np.arange(m), sizes), np.array([names[p] for k in keys for p in parts(k)])
    order = np.argsort(link_f, kind="stable")
    runs_k, runs_f = np.cumsum(sizes)[:-1], np.searchsorted(link_f[order], np.arange(len(names)))
    weights, moves = np.zeros((len(names), PLACES, TAGS)), np.zeros((TAGS, TAGS))
    state = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    gold = np.zeros((n, CHUNK, TAGS))
    gold[real] = np.eye(TAGS)[tags[real]]
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    scale = 1.0 / max(1, real.sum())
    for step in range(1, steps + 1):
        table = np.zeros((m, PLACES, TAGS))
        table[1:] = np.add.reduceat(weights[link_f], runs_k)
        emit = sum(table[p, j] for j, p in enumerate(places)) * real[:, :, None]
        back = np.zeros((n, CHUNK, TAGS))
        ahead = np.empty((n, CHUNK, TAGS))
        ahead[:, 0] = emit[:, 0]
        for t in range(1, CHUNK):
            step_in = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
            ahead[:, t] = np.where(real[:, t, None], step_in, ahead[:, t - 1])
        for t in range(CHUNK - 2, -1, -1):
            step_out = np.logaddexp.reduce(moves + (emit[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(real[:, t + 1, None], step_out, back[:, t + 1])
        whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
        share = np.exp(ahead + back - whole[:, None, None]) * real[:, :, None]
        pairs = np.exp(ahead[:, :-1, :, None] + moves + (emit[:, 1:] + back[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * real[:, 1:, None, None]
        error = share - gold
        by_key = np.zeros((m, PLACES, TAGS))
        for j, p in enumerate(places):
            for tag in range(TAGS):
                by_key[:, j, tag] = np.bincount(p.ravel(), error[:, :, tag].ravel(), m)
        by_key[0] = 0
        slope = np.add.reduceat(by_key[link_k[order]], runs_f)
        for k, (x, g) in enumerate(((weights, slope * scale + decay * scale * weights), (moves, (pairs.sum((0, 1)) - gold_moves) * scale))):
            one, two = state[2 * k], state[2 * k + 1]
            one += 0.1 * (g - one)
            two += 0.01 * (g * g - two)
            x -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
    return Model(names, weights.astype(np.float32), moves.astype(np.float32))


def fit(docs: DataFrame, documents: int = 8192, most: int = 3000) -> Model | None:
    """The model of a bounded sample of documents (doc_id, text); None where the patterns find nothing to learn from."""
    hits, plain = sample(docs, documents, most)
    return train(hits + plain) if hits else None


class Tagger:
    def __init__(self, model: Model, held: int = 400_000):
        self.model, self.moves, self.held = model, model.moves, held
        self.slack = 2 * float(self.moves.max() - self.moves.min()) + 1e-4
        self.rows, self.table = {"": 0}, np.zeros((1, PLACES, TAGS), np.float32)
        self.files = lru_cache(4096)(lambda k: model.scores(k)[4])
        self.words: dict[str, int] = {}

    def row(self, word: str) -> int:
        k = key(word)
        if k not in self.rows:
            if len(self.rows) == len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(1024, len(self.table)), PLACES, TAGS), np.float32)])
            self.table[len(self.rows)] = self.model.scores(k)
            self.rows[k] = len(self.rows)
        return self.rows[k]

    def emissions(self, words: list[str], file: str) -> np.ndarray:
        known = self.words
        if len(known) > self.held or len(self.rows) > self.held:
            known.clear()
            self.rows, self.table = {"": 0}, np.zeros((1, PLACES, TAGS), np.float32)
        try:
            ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        except KeyError:
            for w in {*words}.difference(known):
                known[w] = self.row(w)
            ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        out = self.table[ids, 0] + self.files(file)
        out[1:] += self.table[ids[:-1], 1]
        out[2:] += self.table[ids[:-2], 2]
        out[:-1] += self.table[ids[1:], 3]
        return out

    def tags(self, words: list[str], file: str) -> list[tuple[int, int]]:
        """(place, tag) of the words that are not O on the best path."""
        emit = self.emissions(words, file)
        open_ = np.flatnonzero(emit[:, O] - np.maximum(emit[:, B], emit[:, I]) <= self.slack)
        if not len(open_):
            return []
        found = []
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            a, b = int(run[0]), int(run[-1]) + 1
            best = viterbi(emit[a:b], self.moves, a > 0, b < len(words))
            found += [(a + i, t) for i, t in enumerate(best) if t != O]
        return found


def viterbi(emit: np.ndarray, moves: np.ndarray, before: bool, after: bool) -> list[int]:
    """The best tags; `before` and `after`: whether a word that is O stands there."""
    score = emit[0] + (moves[O] if before else 0)
    came = []
    for e in emit[1:]:
        through = score[:, None] + moves
        came.append(through.argmax(0))
        score = through.max(0) + e
    at = int((score + (moves[:, O] if after else 0)).argmax())
    path = [at]
    for c in reversed(came):
        at = int(c[at])
        path.append(at)
    return path[::-1]


def added_spans(text: str, tagger: Tagger, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the field but for those within a base span, without quotes and stops around them. They may reach beyond base spans."""
    words = text.split()
    tagged = tagger.tags(words, file_key(text)) if words else []
    if not tagged:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    spans: list[list[int]] = []
    last = -2
    for at, tag in tagged:
        a, b = places[at]
        if tag == I and at == last + 1 and spans:
            spans[-1][1] = b
        else:
            spans.append([a, b])
        last = at
    out = []
    for a, b in spans:
        part = text[a:b]
        a += len(part) - len(part.lstrip("\"'`([{<"))
        b -= len(part) - len(part.rstrip("\"'`)]}>,;.:!?#$%&*"))
        if a < b and not any(s <= a and b <= e for _, s, e in base):
            out.append(("crf", a, b))
    return out


def find(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and spans (kind, start, end; code points, end exclusive) of each document (doc_id, text): base ones and the field's.

    Null and empty texts have none. One row per input row, whatever its doc_id.
    """
    return common.lean(docs).select(F.col("doc_id"), common.text_column(docs).alias("text")).mapInArrow(common.frugal(_scanner(docs, model, False)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def _scanner(docs: DataFrame, model: Model | None, clean: bool):
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(it):
        tagger = Tagger(held.value) if held.value else None
        for b in it:
            spans, texts = [], []
            for t in b.column(b.num_columns - 1):
                text = t.as_py()
                found = base_spans(text)
                if tagger:
                    found = sorted(found + added_spans(text, tagger, found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                if clean:
                    texts.append(redacted(text, found))
            last = pa.array(texts, pa.string()) if clean else pa.array(spans, kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], last], names=[*b.schema.names[:-1], "text" if clean else "spans"])

    return run


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "<secret>") -> str:
    """The text with every span, and what overlaps it, replaced by a mark."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents (any columns) with the secrets in their texts replaced; null texts become empty."""
    rest = [c for c in docs.columns if c != "text"]
    rows = common.lean(docs).select(*(F.col(f"`{c}`") for c in rest), common.text_column(docs).alias("text"))
    return rows.mapInArrow(common.frugal(_scanner(docs, model, True)), rows.schema).select(*(F.col(f"`{c}`") for c in docs.columns))


def joined(spans: str, kinds: list[str] | None = None):
    """A column of kind:start:end of spans, comma-joined."""
    of = F.col(spans) if kinds is None else F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
