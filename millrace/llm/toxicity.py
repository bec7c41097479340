"""Toxicity: words as bags of character n-grams whose vectors are averaged into a linear softmax.

A word is itself and its character 3- to 5-grams with marked ends, hashed into
buckets; its vector is the mean of their vectors, and a text's vector is the mean
over its words. Vectors, the softmax's two rows and its biases are trained together
in numpy on a bounded sample of labelled rows. As the softmax is linear in a mean, a
trained text's score needs one number a bucket: tasks hash the n-grams of many texts
by array operations and hold no table of words. Unseen spellings get their score
from n-grams that they share with seen words; digits count as letters, so spellings
such as 1d1ot keep theirs.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common, shingles

BITS, WIDTH, GRAMS = 17, 16, (3, 4, 5)
BUCKETS = 1 << BITS
#: Code points that are hashed at a time.
BLOCK = 1 << 18
_ODD = [np.uint64(xxhash.xxh3_64_intdigest(j.to_bytes(8, "little"), seed=1) | 1) for j in range(8)]


@cache
def _letters() -> np.ndarray:
    """Which code points words consist of: letters and digits of all scripts."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def points(texts: list[str]) -> np.ndarray:
    """The code points of lower-case texts, with 0 before, between and after them and for all that is no letter or digit."""
    x = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(_letters()[x], x, np.uint32(0))


def spelled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of points(): where each word begins and ends, its own bucket, and for each size the buckets of the n-grams that begin at each place.

    The n-grams of a word from place a to b (exclusive) are those that begin from a - 1 to b + 1 - n, so each end is marked by a 0.
    """
    x = np.concatenate([x, np.zeros(GRAMS[-1], x.dtype)])
    inside = x != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, last = edges[0::2], edges[1::2]
    wide, grams, own = x.astype(np.uint64), [], np.empty(0, np.int64)
    for n in GRAMS:
        size = max(0, len(x) - n + 1)
        h = np.full(size, _ODD[n], np.uint64)
        for j in range(n):
            h += wide[j : j + size] * _ODD[j]
        h = shingles.mix(h)
        if not grams:  # a word's own bucket comes of its shortest n-grams together
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(h, out=sums[1:])
            own = (shingles.mix((sums[last + 2 - n] - sums[first - 1]) * _ODD[7]) >> np.uint64(64 - BITS)).astype(np.int64)
        grams.append((h >> np.uint64(64 - BITS)).astype(np.int64))
    return first, last, own, grams


def subwords(words: list[str]) -> list[np.ndarray]:
    """For each lower-case word its bucket and those of its n-grams."""
    first, last, own, grams = spelled(points(words))
    return [np.concatenate([[w], *(g[a - 1 : max(a - 1, b + 2 - n)] for n, g in zip(GRAMS, grams, strict=True))]) for a, b, w in zip(first.tolist(), last.tolist(), own.tolist(), strict=True)]


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    low = text.lower()
    return low.translate({ord(c): " " for c in {*low} if not c.isalnum()}).split()


def bag(text: str, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text with their shares of its mean. known: buckets of words met before, at most some 200,000."""
    found = words(text)
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    if len(known) > 200_000:
        known.clear()
    new = list({*found}.difference(known))
    known.update(zip(new, subwords(new), strict=True))
    each = [known[w] for w in found]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    total = np.bincount(np.concatenate(each), np.repeat(1.0 / sizes, sizes), BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / len(found)).astype(np.float32)


class Model(NamedTuple):
    """weights: what each bucket adds to the log odds (its vector times the difference of the softmax's rows); bias: the difference of its biases."""

    weights: np.ndarray
    bias: float


class Rows:
    """Bags of labelled texts, taken some at a time, so that only two arrays have the length of all bags. seen: the buckets that any has, in order."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], step: int = 128):
        self.sizes = np.array([len(a) for a, _ in bags], np.int64)
        at = np.concatenate([np.empty(0, np.int32), *(a for a, _ in bags)])
        self.seen = np.flatnonzero(np.bincount(at, minlength=BUCKETS))
        place = np.zeros(BUCKETS, np.int32)
        place[self.seen] = np.arange(len(self.seen))
        self.at = place[at]
        self.part = np.concatenate([np.empty(0, np.float32), *(p for _, p in bags)])
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        self.pieces = [(a, b, slice(int(ends[a] - self.sizes[a]), int(ends[b - 1]))) for a, b in ((k, min(k + step, len(bags))) for k in range(0, len(bags), step))]

    def mean(self, values: np.ndarray) -> np.ndarray:
        """For each row the mean of its buckets' values; values: of the seen buckets."""
        out = np.zeros(len(self.sizes))
        for a, b, s in self.pieces:
            some = np.arange(a, b)[self.sizes[a:b] > 0]
            if len(some):
                out[some] = np.add.reduceat(self.part[s] * values[self.at[s]], self.starts[some] - s.start)
        return out

    def summed(self, values: np.ndarray) -> np.ndarray:
        """For each seen bucket the sum over rows of the row's value times the bucket's part."""
        total = np.zeros(len(self.seen))
        for a, b, s in self.pieces:
            total += np.bincount(self.at[s], self.part[s] * np.repeat(values[a:b], self.sizes[a:b]), len(self.seen))
        return total


def slopes(rows: Rows, vectors: np.ndarray, soft: np.ndarray, bias: np.ndarray, labels: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The mean loss and its derivatives. Those by the vectors are pull * (soft[1] - soft[0]), row by row, of which `pull` is returned.

    With two classes the errors of one are those of the other with the sign changed,
    so both rows of the softmax are learned from one pass.
    """
    odds = rows.mean(vectors @ (soft[1] - soft[0]).astype(vectors.dtype)) + bias[1] - bias[0]
    loss = float((share * (np.logaddexp(0, odds) - labels * odds)).sum())
    error = (1 / (1 + np.exp(-np.clip(odds, -40, 40))) - labels) * share
    pull = rows.summed(error)
    turn, tilt = vectors.T @ pull.astype(vectors.dtype), float(error.sum())
    return loss, pull, np.stack([-turn, turn]), np.array([-tilt, tilt])


def train(bags: list[tuple[np.ndarray, np.ndarray]] | Rows, labels: np.ndarray, shares: np.ndarray, steps: int = 150, rate: float = 4.0, soft_rate: float = 0.003, rare: float = 2e-6, decay: float = 5e-3, seed: int = 1) -> Model:
    """Gradient descent with momentum on vectors, softmax and biases together.

    shares: how many labelled rows each row stands for. A bucket's step is divided
    by its mean share of a text plus `rare`, so common n-grams don't drown those
    that tell, and those of a few texts are held back; `decay` draws vectors back
    to 0. The softmax's steps are divided by the running size of its slopes, so
    `soft_rate` is about what it moves by in a step, whatever their scale.
    """
    rows, share = bags if isinstance(bags, Rows) else Rows(bags), shares / shares.sum()
    vectors, soft, bias = started(len(rows.seen), labels, shares, seed)
    step = (rate / (rows.summed(share) + rare)).astype(np.float32)
    moving, turning, size = np.zeros_like(vectors), np.zeros_like(soft), 0.0
    for k in range(1, steps + 1):
        _, pull, turn, tilt = slopes(rows, vectors, soft, bias, labels, share)
        moving *= 0.9
        moving += (step * pull)[:, None].astype(np.float32) * (soft[1] - soft[0]).astype(np.float32)
        turning = 0.9 * turning + turn
        size += 0.01 * (float((turn * turn).mean()) - size)
        vectors *= 1 - decay
        vectors -= moving
        soft -= soft_rate * turning / (np.sqrt(size / (1 - 0.99**k)) + 1e-12)
        bias -= 0.25 * tilt
    weights = np.zeros(BUCKETS, np.float32)  # n-grams of no labelled text say nothing
    weights[rows.seen] = vectors @ (soft[1] - soft[0])
    return Model(weights, float(bias[1] - bias[0]))


def started(buckets: int, labels: np.ndarray, shares: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, softmax and biases before the first step: small, of random direction, and of the odds of the labels."""
    r = np.random.default_rng(seed)
    vectors, way = r.normal(0, 0.01, (buckets, WIDTH)).astype(np.float32), r.normal(0, 1, WIDTH)
    way /= 2 * np.linalg.norm(way)
    prior = min(max(float((shares * labels).sum() / shares.sum()), 1e-6), 1 - 1e-6)
    odds = float(np.log(prior / (1 - prior)))
    return vectors, np.stack([-way, way]), np.array([-odds / 2, odds / 2])


def held_out(doc: Column) -> Column:
    """Whether a document is kept from training: the CRC-32 of its id as text has remainder 2 by 4. A null id is not."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = 1000, clean: int = 1500) -> Model:
    """The model of documents (doc_id, text) and labels (doc_id, toxic 0 or 1), from at most `toxic` and `clean` labelled rows.

    The rows are chosen by a hash of doc_id among those that aren't held out; only
    their n-gram shares come to the driver, at most BUCKETS a row. Labels that are
    null or of no document are not used. Without both classes every text has the
    share of toxic labels as its score (0 without labels).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 40.0 if 1 in totals else -40.0)
    order = F.xxhash64(F.lit(3), "doc_id")
    chosen = known.filter("toxic = 1").orderBy(order, "doc_id").limit(toxic).union(known.filter("toxic = 0").orderBy(order, "doc_id").limit(clean))
    # At most `toxic` + `clean` rows of two numbers are broadcast.
    texts = common.lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")

    def run(it):
        seen: dict[str, np.ndarray] = {}

        def rows():
            for b in it:
                for doc, label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    at, part = bag(text.as_py(), seen)
                    yield doc, label, at.tobytes(), part.tobytes()

        kinds = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("at", pa.binary()), ("part", pa.binary())])
        yield from common.batches(rows(), kinds, limit=200)

    found = texts.mapInArrow(common.frugal(run), "doc_id long, toxic int, at binary, part binary").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("at", "ascending")])
    labelled = found.column("toxic").to_numpy()
    if len({*labelled.tolist()}) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(totals[1] / totals[0])))
    rows = Rows([(np.frombuffer(a.as_py(), np.int32), np.frombuffer(p.as_py(), np.float32)) for a, p in zip(found.column("at"), found.column("part"), strict=True)])
    each = {k: totals[k] / max(1, int((labelled == k).sum())) for k in totals}
    del found
    common.release()
    model = train(rows, labelled.astype(np.float64), np.array([each[k] for k in labelled.tolist()]))
    del rows
    common.release()
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model, self.weights = model, model.weights.astype(np.float64)

    def _means(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of points() begin, and the mean that each adds."""
        first, last, own, grams = spelled(x)
        total, count = self.weights[own], np.ones(len(own))
        for n, g in zip(GRAMS, grams, strict=True):
            sums = np.zeros(len(g) + 1)
            np.cumsum(self.weights[g], out=sums[1:])
            some = np.maximum(last - first + 3 - n, 0)
            total += sums[first - 1 + some] - sums[first - 1]
            count += some
        return first, total / count

    def _odds(self, texts: list[str]) -> np.ndarray:
        x = points(texts)
        starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        at, gaps = 0, np.flatnonzero(x == 0)
        while at < len(x) - 1:  # blocks end and begin between words
            k = min(int(np.searchsorted(gaps, at + BLOCK)), len(gaps) - 1)
            end = int(gaps[k])
            first, means = self._means(x[at : end + 1])
            own = np.searchsorted(starts, first + at, side="right") - 1
            total += np.bincount(own, means, len(texts))
            count += np.bincount(own, minlength=len(texts))
            at = end
        return total / np.maximum(count, 1) + self.model.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        """Of whole texts, 0 to 1; a text without words has the bias alone."""
        out, held, size = [np.empty(0)], [], 0
        for t in texts:
            held.append(t.lower())
            size += len(held[-1]) + 1
            if size >= BLOCK:
                out.append(self._odds(held))
                held, size = [], 0
        if held:
            out.append(self._odds(held))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -40, 40)))

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs (any columns, among them text) with a column score_ of 0 to 1, in place of one of that name. Null texts count as empty."""
    docs = common.lean(docs).drop("score_")
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(it):
        scorer = Scorer(held.value)
        for b in it:
            scores = scorer.scores([t.as_py() or "" for t in b.column(at)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, "score_"])

    return docs.mapInArrow(common.frugal(run), StructType([*docs.schema.fields, StructField("score_", DoubleType())]))
