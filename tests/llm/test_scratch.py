from types import SimpleNamespace

import pytest

from geomill.llm import scratch


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    assert scratch.root(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("local", "local[8]", "local[*]"):
        assert scratch.root(session(master)).startswith("file:///")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch.root(session(master))
