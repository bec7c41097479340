"""The corpus pipeline stage by stage against plain versions, on small tables."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, packing, secrets, toxicity
from millrace.llm.tokens import encoder

from .conftest import prose
from .test_join import brute, near

BAD = ["blarghy", "snorfing", "gruntwad"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(6)
    rows, labels = [], []
    for d in range(160):
        text = near(d, prose(d // 8, 60), d % 4 == 1) if d % 2 else prose(1000 + d, 60)
        toxic = d % 5 == 0
        if toxic:
            w = text.split()
            for _ in range(5):
                w[r.randrange(60)] = r.choice(BAD)
            text = " ".join(w)
        if d % 10 == 3:
            text += ' token = "' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '" end'
        rows.append((d, text, "en" if d % 3 else "de", f"src{d % 4}", len(text)))
        labels.append((d, 1, int(toxic)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "best-fit packing"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        kept.append([tuple(x) for x in out.collect()])
        if out.columns == corpus_pipeline.COLUMNS:
            assert out.dtypes == docs.dtypes
            docs = spark.createDataFrame(kept[-1], out.schema) if kept[-1] else out
    start = [tuple(x) for x in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    clean, distinct, redacted, mixed, packed = kept

    toxic = {x[0] for x in start if x[0] % 5 == 0}
    gone = {x[0] for x in start} - {x[0] for x in clean}
    assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 3

    roots = {c for _, _, c, _ in brute([x[:2] for x in clean], 5, 80)}
    assert sorted(distinct) == sorted(x for x in clean if x[0] in roots) and len(distinct) < len(clean)

    assert {x[0] for x in redacted} == roots and all(x[4] == len(x[1]) for x in redacted)
    before = {x[0]: x[1] for x in distinct}
    for x in redacted:
        base = secrets.base_spans(before[x[0]])
        assert secrets.base_spans(x[1]) == [] and ("<secret>" in x[1] if base else x[1].count("<secret>") <= 1)

    tokens = sum(len(x[1].split()) for x in redacted)
    assert 0.5 * tokens <= sum(len(x[1].split()) for x in mixed) <= tokens and set(mixed) <= set(redacted) and max(Counter(mixed).values()) <= 2

    coder = encoder(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((x[0], k, start) for x in mixed for k, (start, _) in enumerate(packing.cut(coder.ids(x[1]) + b"\0\0\0\0", 2048)))
    assert Counter(p[:3] for p in packed) == want
    fill: dict = {}
    for p in sorted(packed, key=lambda p: (p[5], p[6])):
        assert fill.get(p[5], 0) == p[6]
        fill[p[5]] = p[6] + p[3]
    assert max(fill.values()) <= 2048


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_empty(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_parts_agree(spark, tables):
    """What stages share with the operators: the same scores and budgets."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    low = {x.doc_id for x in toxicity.score(docs, model).filter("score_ < 0.3").collect()}
    assert {x.doc_id for x in corpus_pipeline.not_toxic(spark, docs, tables).collect()} == low
    mixed = mixing.mix(docs, mixing.WEIGHTS, epochs=2, domain=F.expr(mixing.DOMAIN))
    assert Counter(x.doc_id for x in mixed.collect()) == Counter(x.doc_id for x in corpus_pipeline.mixed(spark, docs, tables).collect())


def test_stages_on_edges(spark, tables):
    """Every stage on nulls in any column, empty and very long texts, ties, repeated rows and columns with names used inside."""
    long = prose(77, 20_000)
    secret = 'token = "' + "ab12" * 10 + '"'
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n", None, "s", 3), (4, long, "en", None, 1), (5, prose(5, 40), "de", "s", 1), (5, prose(5, 40), "de", "s", 1), (None, prose(7, 20), "en", "s", 1), (None, prose(7, 20), "en", "s", 1), (None, None, None, None, None), (-9, f"a {secret} b", "en", "s", 1), (8, prose(5, 40), "en", "t", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score_ double, node long, spans string, mix_epoch int, mix_tokens long, length long, ids binary, part int, __row long"
    docs = spark.createDataFrame([(*x, 0.1, 1, "s", 2, 3, 4, b"x", 5, 6) for x in rows], schema).repartition(3)

    def texts(df):
        return Counter((x.doc_id, x.text) for x in df.collect())

    stages = [f for _, f in corpus_pipeline.STAGES]
    before = Counter(x[:2] for x in rows)
    kept = stages[0](spark, docs, tables)
    assert kept.columns == corpus_pipeline.COLUMNS and not texts(kept) - before and texts(kept)[5, prose(5, 40)] in (0, 2)
    one = stages[1](spark, docs, tables)
    assert texts(one) == Counter([(1, None), (2, ""), (3, " \t\n"), (4, long), (5, prose(5, 40)), (None, prose(7, 20)), (None, None), (-9, f"a {secret} b")])
    clean = stages[2](spark, docs, tables)
    want = Counter()
    for (d, t), n in before.items():
        want[d, (t or "").replace(secret[:-1], "<secret>")] += n
    assert texts(clean) == want and all(x.n_chars == len(x.text) for x in clean.collect())
    mixed = stages[3](spark, docs, tables)
    assert mixed.columns == corpus_pipeline.COLUMNS and set(texts(mixed)) <= set(before) and sum(len((t or "").split()) * n for (_, t), n in texts(mixed).items()) <= sum(len((t or "").split()) * n for (_, t), n in before.items())
    pieces = stages[4](spark, docs, tables).collect()
    coder = encoder(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((d, k, start, len(p) // 4) for d, t, *_ in rows for k, (start, p) in enumerate(packing.cut(coder.ids(t or "") + b"\0\0\0\0", 2048)))
    assert Counter(tuple(p)[:4] for p in pieces) == want
    for f in stages:
        assert f(spark, docs.limit(0), tables).collect() == []
