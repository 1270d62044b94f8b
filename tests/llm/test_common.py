from types import SimpleNamespace

import pytest

from gridloam.llm.common import shared_dir


def session(master, where=None):
    made = []
    sc = SimpleNamespace(master=master, getConf=lambda: {}, getCheckpointDir=lambda: made[0] if made else where, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: d))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
    assert shared_dir(session("local[4]")) and shared_dir(session("local"))
    assert shared_dir(session("yarn", "hdfs://a/b/")) == "hdfs://a/b"
