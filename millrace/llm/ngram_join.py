"""N-gram Jaccard join by prefixes under several global orders.

Two sets of shingles with similarity t or more share a token among the first
n - ceil(t n) + 1 tokens of each, whatever total order all sets are sorted by. So
they must share such a prefix token under every one of several orders: candidates
are found under each order and the filters are intersected before verification.
Every order puts tokens that many documents have last and sorts the rest by a
hash of its own.

A prefix token of few documents gives pairs of them, of sizes that allow a link. A
token of many never does: its documents become a star around the smallest id, and
stars become families. A pair stays if under each order it is in a family or shares
as many prefix tokens as a link between sets of its sizes needs at least.
Sets of connected candidates are then verified exactly, in groups of bounded size:
small components whole, families by pairs of blocks, the other pairs of large
components around one of their documents. Tasks return each document's number of
links and a spanning forest of links, so results grow with documents. Exact copies
of a set are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, shingles
from .components import components

ORDERS, BLOCK, SALTS, COMMON, BITS = 2, 128, 64, 1 << 18, 1 << 25
#: A token of more documents than FEW gives no pairs; one counted more than MANY times has its documents dealt to SALTS tasks.
FEW, MANY = 256, 1024


def shingle_set(text: bytes | str, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingles.hashes(text, size))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def least_shared(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens the prefixes of sets of a and b tokens share at least if the sets link, under any order.

    Of the set whose prefix ends first, shared tokens outside it are at most the rest of that set; the others are in both prefixes.
    """
    a, b = a.astype(np.int64), b.astype(np.int64)
    both = -(-percent * (a + b) // (100 + percent))
    rest = np.maximum(-(-percent * a // 100), -(-percent * b // 100)) - 1
    return np.maximum(1, both - rest)


def prefix(tokens: np.ndarray, order: int, percent: int, common_tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix of a set under an order, and how many of its last tokens have been counted more than MANY times."""
    n = prefix_length(len(tokens), percent)
    rank = shingles.mix(tokens ^ np.uint64(order)) if order else tokens
    if not len(common_tokens):
        return tokens[np.argpartition(rank, n - 1)[:n]] if n < len(tokens) else tokens, 0
    at = np.minimum(np.searchsorted(common_tokens, tokens), len(common_tokens) - 1)
    often = common_tokens[at] == tokens
    rare, rank_rare = tokens[~often], rank[~often]
    if n <= len(rare):
        return rare[np.argpartition(rank_rare, n - 1)[:n]] if n < len(rare) else rare, 0
    last = np.lexsort((rank[often], counts[at[often]]))[: n - len(rare)]
    return np.concatenate([rare, tokens[often][last]]), int(np.count_nonzero(counts[at[often]][last] > MANY))


def common_shingles(docs: DataFrame, size: int, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents have, with counts over all documents, for the orders to put last.

    Documents with some four million shingles at a time are counted together, and
    what three of them have is passed on; sums decide. At most `most` come to the driver: which these are affects
    the work only, as any order finds the same links.
    """

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
        many = counts >= 3
        return pa.RecordBatch.from_arrays([pa.array(tokens[many].view(np.int64)), pa.array(counts[many].astype(np.int64))], names=["token", "n"])

    def run(it):
        sets, held = [], 0
        for b in it:
            for t in b.column(0):
                sets.append(shingle_set(t.as_buffer(), size))
                held += len(sets[-1])
                if held >= 4_000_000:
                    yield counted(sets)
                    sets, held = [], 0
        yield counted(sets)

    found = docs.select(common.text_column(docs).alias("text")).mapInArrow(common.frugal(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "token").limit(most).toArrow()
    tokens, counts = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def prefixed(docs: DataFrame, size: int, percent: int, orders: int, often) -> DataFrame:
    """doc_id, n (set size), hi, lo (the set's 128-bit digest; null for empty sets), for each order the prefix p<k> and how many common tokens end it c<k>."""
    schema = "doc_id long, n long, hi long, lo long" + "".join(f", p{k} array<long>, c{k} int" for k in range(orders))

    def run(it):
        for b in it:
            n, hi, lo = [], [], []
            parts: list[list] = [[] for _ in range(orders)]
            ends: list[list] = [[] for _ in range(orders)]
            for t in b.column(1):
                tokens = shingle_set(t.as_buffer(), size)
                n.append(len(tokens))
                both = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), "<i8").tolist() if len(tokens) else (None, None)
                hi.append(both[0])
                lo.append(both[1])
                for k in range(orders):
                    found, c = prefix(tokens, k, percent, *often.value) if len(tokens) else (tokens, 0)
                    parts[k].append(found.view(np.int64))
                    ends[k].append(c)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())]
            for k in range(orders):
                edges = np.concatenate([[0], np.cumsum([len(x) for x in parts[k]])]).astype(np.int32)
                columns += [pa.ListArray.from_arrays(edges, np.concatenate(parts[k]) if parts[k] else np.empty(0, np.int64)), pa.array(ends[k], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "hi", "lo", *(x for k in range(orders) for x in (f"p{k}", f"c{k}"))])

    return docs.select(F.col("doc_id").cast("long"), common.text_column(docs).alias("text")).mapInArrow(common.frugal(run), schema)


CANDIDATES = "kind int, o int, a long, b long, n int, need int"
PAIR, STAR, TOP = 0, 1, 2


def postings(nodes: DataFrame, orders: int) -> DataFrame:
    """token, o (order), salt, node, n: a row per prefix token, dealt and sorted by token. Very common tokens are salted by node, others have salt 0."""

    def run(it):
        for b in it:
            node, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in range(orders):
                held, often = b.column(2 + 2 * k), b.column(3 + 2 * k).to_numpy()
                sizes = np.diff(held.offsets.to_numpy())
                tokens = held.flatten().to_numpy()
                owner = np.repeat(node, sizes)
                place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                hot = place >= np.repeat(sizes - often, sizes)
                salt = np.where(hot, 1 + (shingles.mix(owner.view(np.uint64)) % np.uint64(SALTS)).astype(np.int64), 0)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array((k * (SALTS + 1) + salt).astype(np.int32)), pa.array(owner), pa.array(np.repeat(n, sizes).astype(np.int32))], names=["token", "os", "node", "n"])

    columns = [x for k in range(orders) for x in (f"p{k}", f"c{k}")]
    rows = nodes.select("node", "n", *columns).mapInArrow(common.frugal(run), "token long, os int, node long, n int")
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(spread, "token", "os").sortWithinPartitions("token", "os", "node")


def _candidates(it, percent: int):
    """Rows (PAIR, o, a, b, n tokens shared, need), (STAR, o, node, smallest node) and, of salted tokens, (TOP, o, token, smallest node of the salt)."""
    kinds = pa.schema([("kind", pa.int32()), ("o", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("need", pa.int32())])

    def out(kind, o, a, b, need=0):
        shape = a.shape
        rows, counts = np.unique(np.stack([np.broadcast_to(o, shape).astype(np.int64), a, b, np.broadcast_to(need, shape).astype(np.int64)]), axis=1, return_counts=True) if len(a) else (np.empty((4, 0), np.int64), np.empty(0))
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows.shape[1], kind, np.int32)), pa.array(rows[0].astype(np.int32)), pa.array(rows[1]), pa.array(rows[2]), pa.array(counts.astype(np.int32)), pa.array(rows[3].astype(np.int32))], schema=kinds)

    held = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int32)]
    hub = None  # (token, os, smallest node) of a run that has been flushed in part
    for batch in _with_end(it):
        if batch is not None:
            held = [np.concatenate([x, c.to_numpy()]) for x, c in zip(held, batch.columns, strict=True)]
        token, os, node, n = held
        if not len(token):
            continue
        first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (os[1:] != os[:-1])])
        sizes = np.diff(np.r_[first, len(token)])
        if batch is not None and sizes[-1] <= 1 << 16:  # the last run may go on
            first, sizes, keep = first[:-1], sizes[:-1], int(first[-1])
        else:
            keep = len(token)
        held = [x[keep:] for x in held]
        if not len(first):
            continue
        order, salted = os // (SALTS + 1), os % (SALTS + 1) > 0
        low = node[first].copy()
        told = False
        if hub is not None:
            if (token[first[0]], os[first[0]]) == hub[:2]:
                low[0], told = hub[2], True
        hub = (token[first[-1]], os[first[-1]], low[-1]) if keep == len(token) and batch is not None else None
        many = (sizes > FEW) | salted[first]
        many[0] |= told
        if hub is not None:
            many[-1] = True
        # Runs of many nodes are stars around their smallest.
        inside = np.repeat(many, sizes)
        a, b, o = node[:keep][inside], np.repeat(low, sizes)[inside], order[:keep][inside]
        yield out(STAR, o[a != b], a[a != b], b[a != b])
        top = salted[first]
        yield out(TOP, order[first[top]], token[first[top]], low[top])
        # Runs of few nodes are pairs, all runs of one size at a time.
        for m in np.unique(sizes[~many]):
            if m > 1:
                at = first[~many & (sizes == m)]
                i, j = np.triu_indices(int(m), 1)
                step = max(1, 2_000_000 // len(i))
                for k in range(0, len(at), step):
                    x, y = (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
                    small, large = np.minimum(n[x], n[y]).astype(np.int64), np.maximum(n[x], n[y]).astype(np.int64)
                    fits = (node[x] != node[y]) & (100 * small >= percent * large)
                    x, y = x[fits], y[fits]
                    yield out(PAIR, order[x], node[x], node[y], least_shared(n[x], n[y], percent))


def _with_end(it):
    yield from it
    yield None


def groups(met: DataFrame, orders: int) -> DataFrame:
    """Groups to verify: kind, g, i, j (the group), own (a side; pairs of one side are left out where there are two), node."""
    stars = met.filter(F.col("kind") == STAR).select("o", F.col("a").alias("u"), F.col("b").alias("v"))
    tops = met.filter(F.col("kind") == TOP).select("o", F.col("a").alias("token"), F.col("b").alias("v")).distinct()
    least = tops.groupBy("o", "token").agg(F.min("v").alias("u"))
    families = components(stars.unionByName(tops.join(least, ["o", "token"]).select("o", "u", "v")), ["o"])
    every = [f"f{k}" for k in range(orders)]
    family = common.staged(families.groupBy("id").agg(*(F.max(F.when(F.col("o") == k, F.col("component"))).alias(f"f{k}") for k in range(orders))), "families")
    pairs = met.filter(F.col("kind") == PAIR).groupBy("a", "b").agg(F.min("need").alias("need"), *(F.sum(F.when(F.col("o") == k, F.col("n"))).alias(f"n{k}") for k in range(orders)))
    left = family.select(F.col("id").alias("a"), *(F.col(f).alias(f"a{f}") for f in every))
    right = family.select(F.col("id").alias("b"), *(F.col(f).alias(f"b{f}") for f in every))
    both = pairs.join(left, "a", "left").join(right, "b", "left")
    same = [F.coalesce(F.col(f"a{f}") == F.col(f"b{f}"), F.lit(False)) for f in every]
    stays, together = F.lit(True), F.lit(True)
    for k in range(orders):
        # A pair that isn't of one family shares only tokens that gave pairs, so all of them have been counted.
        stays &= (F.coalesce(F.col(f"n{k}"), F.lit(0)) >= F.col("need")) | same[k]
        together &= same[k]
    kept = common.staged(both.filter(stays).select("a", "b", together.alias("together")), "pairs")
    hot = family.dropna().groupBy(*every).agg(F.min("id").alias("g"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = common.staged(family.dropna().join(hot, every).select(F.col("id").alias("node"), "g", "size"), "members")
    links = kept.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(members.select(F.col("g").alias("u"), F.col("node").alias("v")))
    joined = components(links)
    sizes = joined.groupBy("component").agg(F.count(F.lit(1)).alias("all"))
    placed = common.staged(joined.join(sizes, "component").select(F.col("id").alias("node"), "component", "all"), "components")
    zero = F.lit(0)
    small = placed.filter(F.col("all") <= BLOCK).select(zero.alias("kind"), F.col("component").alias("g"), zero.alias("i"), zero.alias("j"), zero.alias("own"), "node")
    large = placed.filter(F.col("all") > BLOCK).select("node")
    blocks = members.join(large, "node").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    blocks = blocks.withColumn("own", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select(F.lit(1).alias("kind"), "g", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "node")
    apart = kept.filter("not together").join(large.withColumnRenamed("node", "a"), "a")
    parts = apart.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    around = apart.join(parts, "a").withColumn("i", F.pmod(F.xxhash64(F.lit(6), "b"), F.col("parts")).cast("int"))
    around = around.select(F.lit(2).alias("kind"), F.col("a").alias("g"), "i", F.lit(-1).alias("j"), F.explode(F.array(F.struct(zero.alias("own"), F.col("a").alias("node")), F.struct(F.lit(1).alias("own"), F.col("b").alias("node")))).alias("x"))
    around = around.select("kind", "g", "i", "j", "x.own", "x.node").distinct()
    return common.staged(small.unionByName(blocks).unionByName(around), "groups")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two of the sets share, as a matrix."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    tokens, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = np.flatnonzero(counts > 1)
    place = np.full(len(tokens), -1)
    place[keep] = np.arange(len(keep))
    where = place[at]
    owner, where = owner[where >= 0], where[where >= 0]
    total = np.zeros((m, m), np.float32)
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    step = 8192
    for start in range(0, len(keep), step):
        a, b = np.searchsorted(where, [start, start + step])
        part = np.zeros((m, min(step, len(keep) - start)), np.float32)
        part[owner[a:b], where[a:b] - start] = 1
        total += part @ part.T
    return total.astype(np.int64)


def linked(sets: list[np.ndarray], prefixes: list[list[np.ndarray]], percent: int, cross: np.ndarray | None = None) -> np.ndarray:
    """Which pairs link, as a symmetric matrix. Pairs must share a prefix token under every order; those are verified exactly. cross: sides; pairs of one side are left out."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    possible = 100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)
    np.fill_diagonal(possible, False)
    if cross is not None:
        possible &= cross[:, None] != cross[None, :]
    for held in prefixes:
        if not possible.any():
            return possible
        possible &= _shared(held) > 0
    if m <= 8:
        out = np.zeros((m, m), bool)
        for a, b in np.argwhere(np.triu(possible)):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            out[a, b] = out[b, a] = 100 * both >= percent * (sizes[a] + sizes[b] - both)
        return out
    if not possible.any():
        return possible
    both = _shared(sets)
    return possible & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both))


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Enough of the links to connect what all of them do."""
    seen, out = np.zeros(len(links), bool), []
    for root in range(len(links)):
        if seen[root]:
            continue
        seen[root] = True
        todo = [root]
        while todo:
            a = todo.pop()
            for b in np.flatnonzero(links[a] & ~seen):
                seen[b] = True
                out.append((a, int(b)))
                todo.append(int(b))
    return out


def verified(docs: DataFrame, members: DataFrame, copies: DataFrame, size: int, percent: int, orders: int, often) -> DataFrame:
    """node, other, n: a row per node and task with its number of links (weighted by copies), and a row per link of the forests (n 0)."""
    spark = docs.sparkSession
    # Texts of documents in no group stay where they are: a bit map of at most BITS bits over hashed ids tells most of them.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    marks = members.select(F.col("node").alias("doc_id")).select(place.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("k")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(32768))).alias("bits"))
    bitmap = np.zeros(BITS // 8, np.uint8)
    for r in marks.collect():
        bitmap[r.k * 4096 : (r.k + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    held = spark.sparkContext.broadcast(bitmap)

    def hit(it):
        for b in it:
            at = b.column(2).to_numpy()
            yield b.filter(pa.array((held.value[at >> 3] >> (at & 7) & 1).astype(bool))).select(["doc_id", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text")).filter("doc_id is not null")
    texts = rows.withColumn("at", place).mapInArrow(common.frugal(hit), "doc_id long, text string").withColumnRenamed("doc_id", "node")
    keys = ["kind", "g", "i", "j"]
    dealt = texts.join(members.join(copies, "node"), "node").select(*keys, "own", "node", "copies", "text")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(spread, *keys).sortWithinPartitions(*keys, "own", "node")
    width = len(keys)
    kinds = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])
    empty = np.empty(0, np.uint64)

    def test(key: tuple, group: list[tuple]) -> Iterator[tuple]:
        own, nodes, weights = (list(c) for c in zip(*(r[:3] for r in group), strict=True))
        crossed = key[0] == 2 or key[2] != key[3]
        if len(group) < 2 or crossed and len(set(own)) < 2:
            return
        sets = [shingle_set(r[3], size) for r in group]
        prefixes = [[prefix(s, k, percent, *often.value)[0] if len(s) else empty for s in sets] for k in range(orders)]
        links = linked(sets, prefixes, percent, np.array(own) if crossed else None)
        counts = links @ np.array(weights)
        yield from ((n, None, int(c)) for n, c in zip(nodes, counts, strict=True) if c)
        yield from ((nodes[a], nodes[b], 0) for a, b in forest(links) if nodes[a] != nodes[b])

    def run(it):
        def rows():
            key, group = None, []
            for b in it:
                columns = [c.to_pylist() for c in b.columns]
                for now, row in zip(zip(*columns[:width], strict=True), zip(*columns[width:], strict=True), strict=True):
                    if now != key:
                        if group:
                            yield from test(key, group)
                        key, group = now, []
                    group.append(row)
            if group:
                yield from test(key, group)

        yield from common.batches(rows(), kinds)

    return common.staged(dealt.mapInArrow(common.frugal(run), "node long, other long, n long"), "verified")


def join(docs: DataFrame, size: int = 4, percent: int = 85, orders: int = ORDERS) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row of documents (doc_id, text).

    Words have A-Z in lower case and end at ASCII white space; a set is a text's
    distinct shingles of `size` words, with fewer words the whole sequence. Two
    documents link when 100 * shared >= percent * united. component_id is the
    smallest doc_id reachable over links, n_links how many other rows link with it.
    Empty and null texts have no shingles and link with nothing. Rows of equal
    doc_id are one id in links and components; a null doc_id has a null component
    and no part in links. No documents give no rows.
    """
    spark = docs.sparkSession
    docs = common.lean(docs).select("doc_id", "text")
    often = spark.sparkContext.broadcast(common_shingles(docs, size))
    table = common.staged(prefixed(docs, size, percent, orders, often), "prefixes")
    held = [x for k in range(orders) for x in (f"p{k}", f"c{k}")]
    whole = table.filter("n > 0 and doc_id is not null")
    nodes = whole.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", *held)).alias("x"), F.min("n").alias("n"))
    met = common.staged(postings(nodes.select(F.col("x.doc_id").alias("node"), "n", *(F.col(f"x.{c}") for c in held)), orders).mapInArrow(common.frugal(lambda it: _candidates(it, percent)), CANDIDATES), "candidates")
    ids = common.staged(whole.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")), "nodes")
    sized = ids.groupBy("node").agg(F.sum("copies").alias("copies"))
    found = verified(docs, groups(met, orders), sized, size, percent, orders, often)
    joined = components(found.filter("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    degree = found.filter("other is null").groupBy("node").agg(F.sum("n").alias("links"))
    named = ids.join(joined.withColumnRenamed("id", "node"), "node", "left").join(degree, "node", "left")
    named = named.select("hi", "lo", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = table.select("doc_id", "n", "hi", "lo").join(named, ["hi", "lo"], "left")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("component", "doc_id")).alias("component_id"), F.when(known, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents (any columns) without near copies: of each component the row of the smallest doc_id stays, of equal ids the first text.

    Rows with a null doc_id are numbered after all others by text and compared as rows of their own.
    """
    unnamed, pairs = docs.filter("doc_id is null"), docs.select("doc_id", "text")
    if not unnamed.isEmpty():
        top = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0
        number = F.monotonically_increasing_id() + F.lit(max(top, 0) + 1)
        unnamed = common.staged(unnamed.orderBy("text").withColumn("__row", number), "unnamed")
        pairs = pairs.filter("doc_id is not null").unionByName(unnamed.select(F.col("__row").alias("doc_id"), "text"))
    found = join(pairs, size, percent).filter("doc_id = component_id").select("doc_id").distinct()
    same = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    known = docs.filter("doc_id is not null").join(found, "doc_id", "left_semi").withColumn("__same", same).filter("__same = 1").drop("__same")
    if "__row" not in unnamed.columns:
        return known
    return known.unionByName(unnamed.join(found.withColumnRenamed("doc_id", "__row"), "__row", "left_semi").drop("__row"))


#: join(documents, 4, 85) in DuckDB's SQL, by all pairs that share a shingle.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON r.c = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE d = doc_id) AS component_id, (SELECT count(*) FROM l WHERE a = doc_id) AS n_links FROM documents LEFT JOIN n USING (doc_id)"""
