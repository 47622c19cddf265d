"""The driver contract without the training-data subpackage, and the scratch folder."""

import builtins
import sys

import pytest

import __spark_entry__ as entry
from tessera.plans import catalog
from tessera.sources import scratch


def test_queries_remain_when_a_dependency_of_the_subpackage_is_missing(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tessera.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    if "tessera" in sys.modules:
        monkeypatch.delattr(sys.modules["tessera"], "llm", raising=False)
    there = builtins.__import__

    def absent(name, *args, **kwargs):
        if name == "zstandard":
            raise ModuleNotFoundError(name)
        return there(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", absent)
    assert set(entry.queries()) == set(catalog.QUERIES)
    assert set(entry.oracle_sql()) == set(catalog.ORACLES)


class _Session:
    def __init__(self, master, folder=None):
        self.sparkContext = self
        self.master, self.folder, self.conf = master, folder, self

    def get(self, name, default=None):
        return self.folder or default


def test_shared_folder_must_be_named_on_a_cluster():
    assert scratch.shared_dir(_Session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            scratch.shared_dir(_Session(master))
    assert scratch.shared_dir(_Session("local[4]")).startswith("file:")
