"""Shared folders and the memory of Python workers."""

from __future__ import annotations

import pyarrow as pa
import pytest

from millrace.llm import common, tokens


class Cluster:
    """A session of a cluster that names no shared folder."""

    class conf:
        @staticmethod
        def get(name, default):
            return default

    class sparkContext:
        master = "spark://host:7077"


def test_a_cluster_must_name_its_folder():
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Cluster)
    for master in ("yarn", "local-cluster[3,2,3000]", "k8s://https://h"):
        Cluster.sparkContext.master = master
        with pytest.raises(RuntimeError):
            common.new_folder(Cluster, "x")


def test_workers_forget_when_a_task_ends(monkeypatch):
    import public_tokenizers

    coder = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = coder.ids("some words here")

    def task(it):
        for b in it:
            coder.ids("some words here")
            assert coder.table
            yield b

    batch = pa.RecordBatch.from_pydict({"a": [1]})
    assert list(common.frugal(task)(iter([batch]))) == [batch]
    monkeypatch.setattr(common, "resident", lambda: 1 << 40)
    assert list(common.frugal(task)(iter([batch]))) == [batch] and not coder.table
    with pytest.raises(ZeroDivisionError):
        list(common.frugal(lambda it: (1 / 0 for _ in it))(iter([batch])))
    assert coder.ids("some words here") == want
